"""The first rows by cosine, all pairs looked at in blocks, against the expression on each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import vectors as V
from loomspark.operators import evaluation, vector_index


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_every_pair(spark, kind):
    """Copies, near copies, zeros, other widths, nulls, NaN and infinity, repeated and missing ids."""
    rng = np.random.default_rng(1)
    some = [[float(x) for x in v] for v in rng.normal(size=(60, 6)).round(3)]
    some += [some[0]] * 15 + [[x + 1e-7 * k for x in some[1]] for k in range(15)] + [[0.0] * 6] * 12 + [some[2][:4]] * 3 + [[], None, [None, 1.0, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf")] + some[3][1:], [1e-200] * 6]
    order = rng.permutation(len(some)).tolist()
    rows = spark.createDataFrame([(None if n == 5 else n % 90, some[k]) for n, k in enumerate(order)], f"id long, vector array<{kind}>")
    queries = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    pairs = rows.crossJoin(queries.withColumnRenamed("vector", "q")).select("query_id", "id", F.round(V.cosine(F.col("vector"), F.col("q")), 6).alias("score"))
    firsts = lambda df: sorted(map(str, evaluation.ranked(df).where("rank <= 10").select("query_id", "rank", "id", "score").collect()))
    want = firsts(pairs)
    for packed, asked in ((1000, 1000), (16, 3)):
        assert firsts(vector_index.nearest(rows, queries, 10, packed, asked)) == want


def test_nearest_hands_on_the_first_only(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(400, 8)))], "id long, vector array<float>").coalesce(1)
    assert vector_index.nearest(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10).count() == 40
