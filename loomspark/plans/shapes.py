"""The driver's tables in the shapes that operators take, and the same shapes as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.chunking import lines
from loomspark.operators.graph import EDGE_PAIRS
from loomspark.session import table

EDGES = sorted(EDGE_PAIRS)
_LIST = ", ".join(f"'{e}'" for e in EDGES)

SQL = {
    "nodes": "nodes AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'claim' WHEN 2 THEN 'formula' ELSE 'procedure' END AS object_type, p_name AS name, p_brand AS brand, p_size, p_type FROM part)",
    "relations": f"""relations AS (SELECT ((l_orderkey * 8 + l_linenumber) * 30000 + l_partkey) * 2000 + l_suppkey AS id, l_partkey AS src, (l_partkey * 7 + l_suppkey * 13) % 2000 AS dst,
        list_extract([{_LIST}], CAST((l_suppkey + l_linenumber) % 12 AS INT) + 1) AS edge_type, CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS status,
        CASE l_linestatus WHEN 'O' THEN 'base' ELSE 'personal' END AS tier, 1 - l_discount AS confidence, l_suppkey AS source_id,
        CASE WHEN l_tax > 0 THEN 'line ' || CAST(l_orderkey AS VARCHAR) ELSE '' END AS quote, l_quantity AS weight FROM lineitem)""",
    "elements": "elements AS (SELECT doc_id, pos, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(text, ' ') <> '')",
    "tokens": r"tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)",
}


def nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, "concept").when(F.col("p_size") % 4 == 1, "claim").when(F.col("p_size") % 4 == 2, "formula").otherwise("procedure")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("object_type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), "p_size", "p_type")


def relations(spark: SparkSession, d: str) -> DataFrame:
    ident = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 30000 + F.col("l_partkey")) * 2000 + F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        ident.alias("id"),
        F.col("l_partkey").alias("src"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 2000).alias("dst"),
        F.element_at(F.array(*map(F.lit, EDGES)), ((F.col("l_suppkey") + F.col("l_linenumber")) % 12 + 1).cast("int")).alias("edge_type"),
        F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("status"),
        F.when(F.col("l_linestatus") == "O", "base").otherwise("personal").alias("tier"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("line "), F.col("l_orderkey").cast("string"))).otherwise("").alias("quote"),
        F.col("l_quantity").alias("weight"),
    )


def elements(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "documents"))


def typed_elements(spark: SparkSession, d: str) -> DataFrame:
    """The first line of a document is its heading."""
    return elements(spark, d).withColumn("element_type", F.when(F.col("pos") == 0, "heading").otherwise("paragraph"))


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
