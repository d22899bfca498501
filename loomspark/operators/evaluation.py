"""Retrieval and extraction measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(results: DataFrame) -> DataFrame:
    """results (query_id, id, score) with their rank, best first, ties by id."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def retrieval_measures(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, recall at k, reciprocal rank and NDCG at k against gold (query_id, id); queries without a hit score zero."""
    hits = ranked(results).join(gold, ["query_id", "id"])
    per = hits.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("found"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    want = gold.groupBy("query_id").agg(F.countDistinct("id").alias("want"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("want"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    joined = want.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("query_id", F.round(zero(F.col("found") / F.col("want")), 6).alias("recall"), F.round(zero(1 / F.col("first")), 6).alias("rr"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"))


def precision_recall(tp: Column, n_pred: Column, n_gold: Column, empty: float = 1.0) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; both sides empty gives `empty`."""
    none = (n_pred == 0) & (n_gold == 0)
    p = F.when(none, empty).when(n_pred == 0, 0.0).otherwise(tp / n_pred)
    r = F.when(none, empty).when(n_gold == 0, 0.0).otherwise(tp / n_gold)
    return F.round(p, 6), F.round(r, 6), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6)


def topk_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id and the shared part of two runs' first k ids; a query that one run lacks has null."""
    first = lambda df, name: ranked(df).where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias(name))
    return first(a, "x").join(first(b, "y"), "query_id", "full_outer").select("query_id", F.round(F.size(F.array_intersect("x", "y")) / k, 6).alias("overlap"))


def replayed(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id and whether two runs gave the same ids and scores rank by rank."""
    x, y = ranked(a).alias("x"), ranked(b).alias("y")
    met = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.rank") == F.col("y.rank")), "full_outer")
    same = F.col("x.id").eqNullSafe(F.col("y.id")) & F.col("x.score").eqNullSafe(F.col("y.score"))
    return met.groupBy(F.coalesce("x.query_id", "y.query_id").alias("query_id")).agg(F.bool_and(same).alias("same"))
