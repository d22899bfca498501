"""The inverted-file index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import vector_index as V

RNG = np.random.default_rng(7)


def grouped(n, dims=24, groups=12, spread=0.25):
    centres = RNG.normal(size=(groups, dims))
    return centres[RNG.integers(0, groups, n)] + spread * RNG.normal(size=(n, dims))


def frame(spark, ids, x):
    rows = [(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    # Clashing names, on purpose.
    return spark.createDataFrame(rows, "id long, vector array<double>").withColumns({c: F.lit(1) for c in ("list", "ids", "codes", "other", "score", "queries")})


def brute(ids, x, asked, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 9)
        out[int(ids[q])] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


@pytest.fixture(scope="module")
def planted(spark):
    x, ids = grouped(3000), np.arange(3000) * 3
    return ids, x, frame(spark, ids, x).repartition(5)


def test_recall_and_exact(planted):
    ids, x, rows = planted
    asked = np.flatnonzero(ids % 100 == 0)
    want = brute(ids, x, asked, 10)
    queries = rows.where("id % 100 = 0")
    exact = V.exact_neighbours(rows, queries, 10, block=9)
    got = {}
    for r in exact.orderBy("id", F.desc("score"), "other").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == want
    index = V.fit(rows)
    segments = V.build(rows, index)
    assert sorted(i for r in segments.collect() for i in r.ids) == ids.tolist()
    assert index.probes < len(index.centroids) / 2
    told = V.recall(V.search(segments, index, rows, queries, 10), exact).head()
    assert told.queries == len(asked) and told.recall >= 0.9


def test_every_list_and_no_cut_is_exact(spark):
    x, ids = grouped(300), np.arange(300)
    rows = frame(spark, ids, x)
    index = V.fit(rows, lists=5)
    found = V.search(V.build(rows, index), index, rows, rows, 4, probes=5, wider=100)
    got = {}
    for r in found.orderBy("id", F.desc("score"), "other").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == brute(ids, x, range(300), 4)


def test_synonyms_and_awkward_rows(spark):
    x = [*grouped(200, 6), None, [0.0] * 6, [1.0, 2.0], [float("nan")] * 6, None]
    x += [x[0] * 2, x[1]]
    rows = frame(spark, [*range(200), 900, 901, 902, 903, 904, 500, 1], x)
    pairs = {(r.a, r.b): r.score for r in V.synonym_edges(rows, 3, 0.999999, probes=4).collect()}
    assert pairs[0, 500] == 1.0 and not {p for p in pairs if max(p) > 900}
    assert all(a < b for a, b in pairs)
    none = rows.limit(0)
    assert V.synonym_edges(none, 3, 0.5).count() == 0
    assert V.exact_neighbours(rows, none, 3).count() == 0 and V.exact_neighbours(none, rows, 3).count() == 0


def test_k_means_leaves_no_group_empty():
    x = np.array([[0.0, 0], [0, 0], [0, 0], [9, 9], [5, 0]])
    centres = V.k_means(x, 3)
    assert len({tuple(c) for c in centres.tolist()}) == 3
