"""Pairs of rows with equal keys, in blocks; conflicts of relations."""

import random
import re

from loomspark.operators import entities, relational


def test_pairs_in_blocks(spark):
    rng = random.Random(3)
    rows = [("hot" if i < 40 else rng.choice(["a", "b", None]), rng.choice([i, i, 7, None]), rng.choice([1, 2, None])) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, id long, v int")
    want = [((i, v), (j, w)) for k, i, v in rows for m, j, w in rows if k is not None and k == m and None not in (i, j) and i < j]
    for block in (1000, 8, 1):
        cut = relational.pairs_within(df, ["k"], "id", block)
        got = [((r.x.id, r.x.v), (r.y.id, r.y.v)) for r in cut.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def relations(spark, n, heads, tails, types):
    rng = random.Random(5)
    some = lambda m: rng.choice([*range(m), None]) if m > 1 else 0
    rows = [(rng.choice([i, 3]), some(heads), None if (e := some(types)) is None else f"t{e}", some(tails)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, src long, edge_type string, dst long")


def test_conflicts_equal_the_definition(spark):
    for shape in ((120, 5, 6, 3), (60, 1, 9, 2), (60, 9, 1, 1)):
        rows, df = relations(spark, *shape)
        want = []
        for a, s, e, t in rows:
            for b, u, f, v in rows:
                if a < b:
                    eq, ne = (lambda x, y: x is not None and x == y), (lambda x, y: None not in (x, y) and x != y)
                    want += ["shared_pair_diff_edge", a, b] * (eq(s, u) and eq(t, v) and ne(e, f)), ["shared_head", a, b] * (eq(s, u) and eq(e, f) and ne(t, v)), ["shared_tail", a, b] * (eq(t, v) and eq(e, f) and ne(s, u))
        assert sorted(map(tuple, entities.structural_conflicts(df).collect())) == sorted(tuple(w) for w in want if w)


def test_conflicts_deal_a_head_once(spark):
    plan = entities.structural_conflicts(relations(spark, 10, 3, 3, 3)[1])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(src#\d+L?, __of", plan) and not re.search(r"hashpartitioning\(src#\d+L?, (dst|edge_type)#", plan)
