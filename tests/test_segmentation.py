"""Parallel greedy segments against the loop over each group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import segmentation as S


def by_loop(sizes, target=None, most=None, chars=None):
    out, n, used, k = [], 0, 0, 0
    for size in sizes:
        if target is None and n and (n >= most or used + size > chars):
            k, n, used = k + 1, 0, 0
        out.append(k)
        n, used = n + 1, used + size
        if target is not None and used >= target:
            k, n, used = k + 1, 0, 0
    return out


RNG = np.random.default_rng(2)
GROUPS = {"hot": RNG.integers(1, 9, 3000).tolist(), "one": [5], "long": [1, 900, 1, 1, 5000, 2, 2] * 20, "same": [3] * 400, None: [4, 4, 4], "": RNG.integers(1, 40, 300).tolist()}


@pytest.mark.parametrize(("rule", "block"), [({"target": 20}, 2), ({"most": 4, "chars": 25}, 2), ({"most": 1000, "chars": 10}, 64), ({"target": 1}, 64)])
def test_segments(spark, monkeypatch, rule, block):
    monkeypatch.setattr(S, "BLOCK", block)
    groups = dict(GROUPS)
    if "most" in rule:
        groups["empty"] = [0] * 300 + [7, 0, 0, 30, 0]
    rows = [(g, k, int(s)) for g, sizes in groups.items() for k, s in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "g string, pos int, size int").withColumns({c: F.lit("x") for c in ("gid", "idx", "b", "own", "s", "local", "entry")})
    out = S.greedy_segments(frame.orderBy(F.rand(1)), ["g"], ["pos"], "size", **rule)
    assert out.columns == [*frame.columns, "segment"]
    got = {}
    for r in out.orderBy("pos").collect():
        got.setdefault(r.g, []).append(r.segment)
    assert got == {g: by_loop(sizes, **rule) for g, sizes in groups.items()}


def test_empty_null_and_ties(spark):
    frame = spark.createDataFrame([(1, 0, None), (1, 0, 3), (1, 0, 3)], "g int, pos int, size int")
    assert S.greedy_segments(frame.limit(0), ["g"], ["pos"], "size", most=2, chars=9).count() == 0
    assert sorted(r.segment for r in S.greedy_segments(frame, ["g"], ["pos"], "size", most=2, chars=9).collect()) == [0, 0, 1]
