"""Sources, predicates and scalar functions over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions import vectors as V
from loomspark.operators import chunking, relational
from loomspark.plans import shapes
from loomspark.plans.registry import query
from loomspark.session import shared_dir, table
from loomspark.sources import files


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


@query("a01_parser_routing", r"""SELECT CASE WHEN regexp_matches(path, '\.(html?)$') THEN 'text' WHEN regexp_matches(path, '\.pdf$') THEN 'pdf' WHEN regexp_matches(path, '\.md$') THEN 'markdown' WHEN regexp_matches(path, '\.csv$') THEN 'csv' ELSE 'text' END AS parser, count(*) AS n
    FROM (SELECT url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '' END AS path FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)) GROUP BY 1""")
def a01(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    path = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(k == 0, ".pdf").when(k == 1, ".md").when(k == 2, ".csv").otherwise(""))
    return table(spark, d, "pages").groupBy(files.parser_of(path).alias("parser")).agg(F.count(F.lit(1)).alias("n"))


@query("a02_parser_chain", "SELECT doc_id, coalesce(CASE WHEN n_chars > 3000 THEN 'engine-a' END, CASE WHEN lang = 'en' THEN 'engine-b' END, 'builtin') AS engine FROM documents")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", files.first_parsed(F.when(F.col("n_chars") > 3000, "engine-a"), F.when(F.col("lang") == "en", "engine-b"), F.lit("builtin")).alias("engine"))


@query("a03_elements", shapes.with_("elements") + "SELECT doc_id, CAST(pos AS INT) AS pos, text FROM elements")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return shapes.elements(spark, d).select("doc_id", "pos", "text")


@query("a03_markdown_blocks")
def a03b(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_blocks(table(spark, d, "documents"))


@query("a04_section_tree", """WITH h AS (SELECT p_partkey AS pos, p_size % 7 AS k, CASE WHEN p_size % 5 = 0 THEN CAST(p_size % 7 + 1 AS VARCHAR) || '.' || CAST(p_size % 3 + 1 AS VARCHAR) || ' ' || p_name ELSE p_name END AS text, CASE WHEN p_size % 5 = 0 THEN CAST(p_size % 7 + 1 AS VARCHAR) || ' > ' || CAST(p_size % 7 + 1 AS VARCHAR) || '.' || CAST(p_size % 3 + 1 AS VARCHAR) END AS chain, p_brand AS doc_id FROM part),
    held AS (SELECT *, last_value(chain IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS cur FROM h)
    SELECT doc_id, pos, CASE WHEN chain IS NOT NULL THEN chain WHEN cur IS NOT NULL THEN cur || ' > ' || text ELSE text END AS section_path FROM held""")
def a04(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, k: (F.col(c) % k + 1).cast("string")
    numbered = F.concat(n("p_size", 7), F.lit("."), n("p_size", 3), F.lit(" "), "p_name")
    heads = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("pos"), F.lit("heading").alias("element_type"), F.when(F.col("p_size") % 5 == 0, numbered).otherwise(F.col("p_name")).alias("text"))
    return chunking.section_paths(heads).select("doc_id", "pos", "section_path")


@query("a07_pipe_tables", r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, trim(unnest(string_split(text, chr(10))), ' ') AS row FROM documents)
    SELECT doc_id, CAST(line AS INT) AS line, len(string_split(regexp_replace(row, '^\||\|$', '', 'g'), '|')) AS n_cells FROM l WHERE regexp_matches(row, '^\|.*\|$|.\|.') AND NOT regexp_matches(row, '^\|?[\s:|-]+\|?$')""")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return files.pipe_rows(table(spark, d, "documents"), "text").select("doc_id", "line", F.size("cells").alias("n_cells"))


@query("a08_transposed_grid", "SELECT n_nationkey AS row, 'name' AS heading, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation")
def a08(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return relational.transposed(grid, "row", "heading", "value", ["name", "region"])


@query("a06_csv_grid", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def a06(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "grid")
    table(spark, d, "nation").coalesce(1).write.option("header", "true").csv(path)
    return files.csv_grid(spark, path)


@query("a09_json_log", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def a09(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "log")
    table(spark, d, "events").select("event_id", "event_type", "props").write.option("compression", "gzip").json(path)
    read = files.log_lines(spark, path, "event_id long, event_type string, props string").where("_corrupt IS NULL")
    return read.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("a10_day_pruning", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    days = files.partitioned(table(spark, d, "events").withColumn("day", F.to_date("ts")), _scratch(spark, "days"), "day")
    return days.where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return files.tail(table(spark, d, "events"), "event_id", 50).select("event_id", "event_type")


@query("a12_matrix_scan", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS square, len(embedding[1:16]) AS dims FROM embeddings WHERE len(embedding) = 64")
def a12(spark: SparkSession, d: str) -> DataFrame:
    v = V.truncated(F.col("embedding"), 16)
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.round(V.dot(v, v), 5).alias("square"), F.size(v).alias("dims"))


@query("a14_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (10, 100) ORDER BY o_custkey, o_orderkey LIMIT 25")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return relational.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], (10, 100), 25)


@query("a15_edge_partitions", shapes.with_("relations") + "SELECT source_id, count(*) AS edges, count(DISTINCT src) AS heads FROM relations WHERE source_id < 5 GROUP BY 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    edges = shapes.relations(spark, d).select("source_id", "src", "dst", "edge_type")
    kept = files.partitioned(edges.repartition("source_id"), _scratch(spark, "edges"), "source_id")
    return kept.where("source_id < 5").groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("heads"))


@query("a17_portable_rows", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return files.portable(table(spark, d, "nation"))


@query("a20_fake_embedding", "SELECT doc_id, substr(sha256(text), 1, 16) AS head FROM documents")
def a20(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("v", V.fake_embedding(F.col("text")))
    return docs.where(F.size("v") == 8).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("head"))


@query("b01_log_filter", "SELECT event_id FROM events WHERE event_type = 'error' AND contains(lower(concat_ws(' ', event_type, props)), '\"k\": 6')")
def b01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where((F.col("event_type") == "error") & F.contains(F.lower(F.concat_ws(" ", "event_type", "props")), F.lit('"k": 6'))).select("event_id")


@query("b02_log_summary", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed: ' || props WHEN value > 100 THEN 'slow: ' || event_type ELSE substr(props, 1, 200) END AS preview FROM events")
def b02(spark: SparkSession, d: str) -> DataFrame:
    preview = F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), "props")).when(F.col("value") > 100, F.concat(F.lit("slow: "), "event_type")).otherwise(F.substring("props", 1, 200))
    return table(spark, d, "events").select("event_id", preview.alias("preview"))


@query("b03_like_escape", r"SELECT page_id, replace(replace(replace(url, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM pages")
def b03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.like_escaped(F.col("url")).alias("escaped"))


@query("b04_word_match", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the?s?($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9])thes?($|[^a-z0-9])') AS hit FROM documents")
def b04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_match(F.col("text"), F.lit("the")).alias("hit"))


@query("b05_alias_boundary", r"SELECT doc_id, regexp_matches(text, '(^|[^a-zA-Z0-9])License($|[^a-zA-Z0-9])') AS hit FROM documents")
def b05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.boundary_hit(F.lit("License"), F.col("text")).alias("hit"))


@query("b06_window_filter", shapes.with_("elements") + r"""SELECT doc_id, avg(CASE WHEN regexp_matches(trim(text, ' '), '^[A-Za-z][A-Za-z0-9 /(),-]+,\s*\d+') THEN 1.0 ELSE 0.0 END) < 0.6 AND avg(CASE WHEN contains(text, '|') THEN 1.0 ELSE 0.0 END) < 0.6 AS keep FROM elements GROUP BY doc_id""")
def b06(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    index = F.trim("text").rlike(r"^[A-Za-z][A-Za-z0-9 /(),-]+,\s*\d+")
    return shapes.elements(spark, d).groupBy("doc_id").agg(((share(index) < 0.6) & (share(F.contains("text", F.lit("|"))) < 0.6)).alias("keep"))


@query("b07_noise_names", r"""SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN '' WHEN length(code) <= 2 THEN 'too_short' WHEN regexp_matches(code, '^\d+$') THEN 'pure_number' WHEN regexp_matches(lower(code), '^(fig|figure|table|eq|equation|sec|section)\b') THEN 'reference' WHEN regexp_matches(code, '^\d+(\.\d+)+\s+[A-Z]') THEN 'section_heading' WHEN NOT contains(code, ' ') AND contains(code, '^') THEN 'symbol' WHEN regexp_matches(code, '^[A-Za-z]\d+$') THEN 'instance_label' ELSE '' END AS reason
    FROM (SELECT *, CASE p_size % 6 WHEN 0 THEN substr(p_name, 1, 2) WHEN 1 THEN CAST(p_partkey + 100 AS VARCHAR) WHEN 2 THEN 'Table ' || p_size WHEN 3 THEN '1.2 Name' WHEN 4 THEN 'R' || (p_size + 10) ELSE 'x^2' END AS code FROM part)""")
def b07(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 6
    code = F.when(k == 0, F.substring("p_name", 1, 2)).when(k == 1, (F.col("p_partkey") + 100).cast("string")).when(k == 2, F.concat(F.lit("Table "), F.col("p_size").cast("string"))).when(k == 3, "1.2 Name").when(k == 4, F.concat(F.lit("R"), (F.col("p_size") + 10).cast("string"))).otherwise("x^2")
    return table(spark, d, "part").withColumn("code", code).select("p_partkey", T.noise_reason(F.col("code"), F.col("p_name").isin("red widget")).alias("reason"))


@query("b08_meta_narrative", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(this (chapter|section|paper|book)|licensed under)\b')")
def b08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike(r"\b(this (chapter|section|paper|book)|licensed under)\b")).select("doc_id")


@query("b09_navigation", "SELECT page_id FROM pages WHERE NOT contains(url, '#') ORDER BY page_id")
def b09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(~F.contains("url", F.lit("#"))).orderBy("page_id").select("page_id")


@query("b12_source_ceiling", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (1, 2, 3)")
def b12(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "supplier").where("s_suppkey IN (1, 2, 3)").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(allowed, "l_suppkey", "left_semi").select("l_partkey").distinct()


@query("b13_private_rows", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY')")
def b13(spark: SparkSession, d: str) -> DataFrame:
    private = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(private, "o_custkey", "left_anti").select("o_orderkey")


@query("b14_mount_rule", "SELECT s_suppkey, coalesce(s_acctbal > 5000, FALSE) OR s_nationkey = 3 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS visible FROM supplier")
def b14(spark: SparkSession, d: str) -> DataFrame:
    granted = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("grant"))
    visible = F.coalesce(F.col("s_acctbal") > 5000, F.lit(False)) | (F.col("s_nationkey") == 3) | F.coalesce("grant", F.lit(False))
    return table(spark, d, "supplier").join(granted, "s_nationkey", "left").select("s_suppkey", visible.alias("visible"))


@query("b15_expired", "SELECT o_orderkey FROM orders o WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def b15(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderdate <= TIMESTAMP '1997-01-01'").join(live, "o_orderkey", "left_anti").select("o_orderkey")


@query("b16_json_contains", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) = 42")
def b16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.contains("props", F.lit("42"))).where(F.get_json_object("props", "$.k").cast("int") == 42).select("event_id")


@query("b17_narrow_scope", "SELECT source, count(*) * 1.0 / (SELECT count(*) FROM documents) <= 0.05 AS narrow FROM documents GROUP BY source")
def b17(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", (F.col("n") / F.sum("n").over(Window.partitionBy()) <= 0.05).alias("narrow"))


@query("b18_language_gate")
def b18(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array_append(T.recall_terms(F.col("text")), F.lit("时序图"))
    return table(spark, d, "benchmark").select("item_id", F.size(T.gated_terms(terms, F.array(F.lit("en"), F.lit("de")), F.lit(1))).alias("n_terms"))


@query("b19_dimension_filter", "SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def b19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).agg(F.count(F.lit(1)).alias("n"))


@query("s01_concept_norm", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM part")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.concept_norm(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("norm"))


@query("s02_seed_v1", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9_+/ ]+', ' ', 'g'), '[\s_-]+', ' ', 'g')) AS seed FROM part")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.seed_v1(F.concat("p_name", F.lit("-"), "p_brand")).alias("seed"))


@query("s03_seed_v2", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand || '.1'), '[\s_-]+', '', 'g'), '[^a-z0-9+/ ]+', ' ', 'g'), '\s+', ' ', 'g')) AS seed, replace(trim(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand || '.1'), '[\s_-]+', '', 'g'), '[^a-z0-9+/ ]+', ' ', 'g')), ' ', '') AS squash FROM part")
def s03(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("-"), "p_brand", F.lit(".1"))
    return table(spark, d, "part").select("p_partkey", T.seed_v2(name).alias("seed"), T.squash_key(name).alias("squash"))


@query("s05_statement_seed", r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', '', 'g'), '\s+', ' ', 'g')) AS statement, regexp_replace(lower(text), '\s+', '', 'g') AS formula FROM benchmark")
def s05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.statement_seed(F.col("text")).alias("statement"), T.formula_seed(F.col("text")).alias("formula"))


@query("s06_initialism", "SELECT p_partkey, lower(substr(string_split(p_name, ' ')[1], 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1)) = 'rw' AS fits FROM part")
def s06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.is_initialism(F.lit("RW"), F.col("p_name")).alias("fits"))


@query("s08_variant_base", r"SELECT p_partkey, CASE WHEN length(p_name) >= 3 THEN lower(trim(regexp_replace(p_name, '[\s\-_]+', ' ', 'g'))) END AS base FROM part")
def s08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.variant_base(F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"))).alias("base"))


@query("s09_content_key", r"SELECT item_id, coalesce(nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ''), CAST(item_id AS VARCHAR)) AS key FROM benchmark")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.content_key(F.col("text"), F.col("item_id")).alias("key"))


@query("s10_spaced_terms", r"SELECT s_suppkey, regexp_replace(regexp_replace(replace(s_name, '#', ''), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g') AS spaced FROM supplier")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", T.spaced_terms(F.replace("s_name", F.lit("#"), F.lit(""))).alias("spaced"))


@query("s12_identifiers", r"SELECT page_id, list_filter(regexp_extract_all(url, '[A-Za-z0-9]+(?:[._\-][A-Za-z0-9]+)+'), lambda x: length(x) >= 4 AND regexp_matches(x, '[A-Za-z]'))[1] AS first FROM pages")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.try_element_at(T.identifiers(F.col("url")), F.lit(1)).alias("first"))


@query("s13_exact_probes")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.exact_probes(F.col("url")).alias("probes"))


@query("s14_recall_terms")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(T.recall_terms(F.col("text"))).alias("n_terms"), T.model_aliases(F.concat(F.lit("gpt4 chapter 3 llama 3 "), "text")).alias("aliases"))


@query("s17_cjk", "SELECT lang, count(*) AS n, count(CASE WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 1 END) AS cjk FROM documents GROUP BY lang")
def s17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.has_cjk(F.col("text"))).alias("cjk"))


@query("s18_language", r"""WITH b AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) = 0 THEN 'other' WHEN length(regexp_replace(t, '[A-Za-z]', '', 'g')) <= length(t) - 0.5 * length(t) THEN 'en' ELSE 'other' END AS language FROM b""")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query("s19_query_head", "SELECT item_id, trim(split_part(text, '.', 1)) AS head FROM benchmark")
def s19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.head_of(F.col("text"), ".").alias("head"))


@query("s20_image_strip", "SELECT item_id, text AS plain FROM benchmark")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.without_images(F.concat("text", F.lit(" ![x](data:image/png;base64,AAAA)"))).alias("plain"))


@query("s21_names_and_keys", r"SELECT item_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS name, CASE WHEN length(k) > 80 THEN sha256(k) ELSE k END AS key FROM (SELECT *, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS k FROM benchmark)")
def s21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.node_name(F.col("text")).alias("name"), T.value_key(F.col("text")).alias("key"))


@query("s21_row_titles", "SELECT n_nationkey, substr(n_name, 1, 16) || ' / ' || CAST(n_regionkey AS VARCHAR) AS title FROM nation")
def s21b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.row_title(F.array("n_name", F.lit(""), F.col("n_regionkey").cast("string"))).alias("title"))


@query("s22_column_kinds", "SELECT * FROM (VALUES ('c_custkey', 'anchor'), ('c_acctbal', 'number'), ('c_name', 'text'), ('c_mktsegment', 'text'), ('c_nationkey', 'anchor')) t(name, kind)")
def s22(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").columns
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", T.column_kind(F.col("name")).alias("kind"))


@query("s23_grounding_norm", r"SELECT item_id, contains(g, 'the') AS holds FROM (SELECT item_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', '', 'g') AS g FROM benchmark)")
def s23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.contains(T.grounding_norm(F.col("text")), F.lit("the")).alias("holds"))


@query("s24_probe_tags", r"SELECT p_type, CASE WHEN length(p_type) <= 2 THEN 1 ELSE 0 END AS n_tags, regexp_replace(regexp_replace(lower(min(p_brand)), '\d+', '#', 'g'), '\b[ivx]+\b', '#', 'g') AS mask FROM part GROUP BY p_type")
def s24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.min("p_brand").alias("b")).select("p_type", F.size(T.probe_tags(F.col("p_type"))).alias("n_tags"), T.digit_mask(F.col("b")).alias("mask"))


@query("s25_equivalent", "SELECT p_partkey, contains(lower(p_name), 'widget') AS same FROM part")
def s25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.equivalent(F.col("p_name"), F.lit('"Widget"')).alias("same"))


@query("s27_jaccard", r"""SELECT conv_id, turn, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(a || b)), 6) END AS jaccard, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) * 1.0 / len(a), 6) END AS leak FROM (
    SELECT x.conv_id, x.turn, list_distinct(list_filter(regexp_split_to_array(lower(x.text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(y.text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)""")
def s27(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    both = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), F.round(T.leakage(F.col("w"), F.col("v")), 6).alias("leak"))


@query("s31_unit_vectors", "SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS first FROM embeddings")
def s31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(V.unit(V.truncated(F.col("embedding"), 32))[0], 5).alias("first"))


@query("s33_times", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def s33(spark: SparkSession, d: str) -> DataFrame:
    parsed = T.parsed_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, d, "events").select("event_id", F.unix_micros(parsed).alias("micros"))


@query("s34_tolerant_json", "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS n FROM events")
def s34(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("[broken")
    return table(spark, d, "events").select("event_id", F.size(F.filter(T.tolerant_array(raw), lambda x: x.isNotNull())).alias("n"))


@query("s35_json_path", "SELECT event_id, coalesce(CAST(props->>'$.k' AS BIGINT), -1) AS k, coalesce(props->>'$.missing', '-') AS other FROM events")
def s35(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("-")).alias("other"))


@query("s36_hashed_ids", "SELECT n_nationkey, 'N-' || substr(sha256(n_name || chr(31) || CAST(n_regionkey AS VARCHAR)), 1, 16) AS id, md5(n_name) AS digest FROM nation")
def s36(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.hashed_id("N-", F.col("n_name"), F.col("n_regionkey")).alias("id"), F.md5("n_name").alias("digest"))


@query("s37_reading_order", "SELECT n_nationkey, length(CAST(n_nationkey AS VARCHAR)) AS digits FROM nation ORDER BY digits, n_nationkey")
def s37(spark: SparkSession, d: str) -> DataFrame:
    ident = F.concat(F.lit("el-"), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", T.index_digits(ident).alias("digits")).orderBy("digits", "n_nationkey")


@query("s38_js_trim", "SELECT n_nationkey, n_name AS trimmed FROM nation")
def s38(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.js_trim(F.concat(F.lit("   "), "n_name", F.lit("\ufeff\t"))).alias("trimmed"))


@query("s39_group_path", "SELECT n_nationkey, CASE WHEN contains(lower(r_name), 'a') THEN r_name ELSE r_name || ' > ' || n_name END AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name || ' > ' || n_name), 'a')")
def s39(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    crumb = F.concat_ws(" > ", "r_name", "n_name")
    return both.where(F.contains(F.lower(crumb), F.lit("a"))).select("n_nationkey", T.group_path(crumb, F.lit("a")).alias("path"))


@query("s40_citations", "SELECT n_nationkey, 'K' || n_nationkey AS key, n_name || ' (K' || n_nationkey || ')' AS defused FROM nation")
def s40(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("n_name", F.lit(" [K"), F.col("n_nationkey").cast("string"), F.lit("]"))
    return table(spark, d, "nation").select("n_nationkey", T.citation_keys(text)[0].alias("key"), T.defused_citations(text).alias("defused"))


@query("s41_context_spans", shapes.with_("elements") + "SELECT doc_id, pos, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS length FROM elements")
def s41(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return shapes.elements(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start"), F.length("text").alias("length"))
