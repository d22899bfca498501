"""Residual-driven ranking against a dense solution."""

import numpy as np
import pytest

from loomspark.operators import graph


def test_push_rank(spark):
    rng = np.random.default_rng(6)
    n, links = 60, {}
    for _ in range(150):
        u, v = rng.integers(0, 50, 2)  # the rest are sinks or stand alone
        links[int(u), int(v if u % 5 else v % 10 + 50)] = float(rng.integers(1, 9))
    share = np.zeros((n, n))
    for (u, v), w in links.items():
        share[v, u] = w
    out = share.sum(0)
    reset = np.zeros(n)
    reset[[3, 59]] = 0.75, 0.25
    share = np.where(out > 0, share / np.maximum(out, 1e-300), reset[:, None])
    want = np.linalg.solve(np.eye(n) - 0.6 * share, 0.4 * reset)
    edges = spark.createDataFrame([(u, v, w) for (u, v), w in links.items()], "u long, v long, weight double")
    seeds = spark.createDataFrame([(3, 1.0), (3, 2.0), (59, 1.0), (7, 0.0), (8, -1.0)], "id long, weight double")
    got = {r.id: r.score for r in graph.push_rank(edges, seeds, 0.6, 1e-7).collect()}
    assert sum(abs(got.get(k, 0.0) - want[k]) for k in range(n)) < 1e-6 and sum(got.values()) == pytest.approx(1.0)
    few = {r.id: r.score for r in graph.push_rank(edges, seeds, 0.6, 1e-7, most=1).collect()}
    assert sum(few.values()) == pytest.approx(1.0) and len(few) < len(got)
    assert graph.push_rank(edges, seeds.where("weight < 0")).count() == 0


def test_passages(spark):
    scores = spark.createDataFrame([(1, 0.2), (2, 0.6), (9, 5.0)], "id long, score double")
    ask = lambda *ids: {r.id: r.score for r in graph.passage_scores(scores, spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert ask(1, 2, 3) == {1: pytest.approx(1 / 3), 2: 1.0, 3: 0.0}
    assert ask(1) == {1: 0.0} and ask(3, 4) == {3: 0.0, 4: 0.0}
