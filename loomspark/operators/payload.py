"""JSON payloads as rows of their scalar leaves, by Spark's VARIANT type: no schema, any depth, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import staged

#: Levels walked at most; deeper payloads fail the job rather than lose leaves.
DEEPEST = 64


def scalar_leaves(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, at, key, value: every scalar in a row's JSON payload as text, at its place (the positions on the way down, an object's
    members in order of their names) and under its nearest name. Nulls, and payloads that are no JSON, have none; logical values
    are spelled True and False.

    One level is one lateral explode without a shuffle; levels go on while there are containers left.
    """
    spark = rows.sparkSession
    level = rows.select(*keys, F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), F.try_parse_json(payload).alias("v"))
    out = None
    for _ in range(DEEPEST):
        kind = F.schema_of_variant("v")
        level = level.where("v IS NOT NULL").withColumn("__kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").otherwise(kind))
        scalar = level.where("__kind NOT IN ('object', 'array', 'null')")
        text = F.try_variant_get("v", "$", "string")
        found = scalar.select(*keys, "at", "key", F.when(F.col("__kind") == "BOOLEAN", F.initcap(text)).otherwise(text).alias("value"))
        out = found if out is None else out.unionByName(found)
        inner = staged(level.where("__kind IN ('object', 'array')").withColumn("v", F.to_json("v")), "level").withColumn("v", F.parse_json("v"))
        if inner.isEmpty():
            return out
        each = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value")))
        level = each.select(*keys, F.concat("at", F.array("__pos")).alias("at"), F.coalesce("__key", "key").alias("key"), F.col("__value").alias("v"))
    deep = F.raise_error(F.lit(f"a payload is deeper than {DEEPEST} levels")).cast("string")
    return out.unionByName(level.select(*keys, "at", "key", deep.alias("value")))


def payload_values(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys (not null) and the payload's scalars in order; rows without any have an empty list."""
    found = scalar_leaves(rows, keys, payload).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("__l"))
    return rows.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce(F.transform("__l", lambda x: x["value"]), F.array().cast("array<string>")).alias("values"))
