"""Community peers: focals of one name and question are answered once, relations are shuffled once."""

import random

from loomspark.operators import graph, modularity


def both_ways(spark, links):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in links] + [(b, a, float(w)) for a, b, w in links], "u long, v long, weight double")


def test_peers_of_many_focals_equal_the_definition(spark):
    """Few names for many nodes; words of a question in another order or twice; a node in two communities, one in none."""
    rng = random.Random(4)
    names = [f"{a} {b}" for a in ("red", "blue", "Old") for b in ("bolt", "rod")]
    nodes = [(i, rng.choice(names) if i != 9 else "old " + "x" * 70) for i in range(80)]
    member = [(i, i % 4) for i in range(78)] + [(3, 1), (9, 2)]
    links = {(a, b): rng.randrange(1, 5) for a, b in (sorted(rng.sample(range(80), 2)) for _ in range(120))}
    focals = [(q, rng.choice([*names, "RED  bolt", "none"]), rng.choice(["which bolt, red?", "red bolt which", "rod", "", None])) for q in range(60)]
    weight = {i: float(sum(w for e, w in links.items() if i in e)) for i, _ in nodes}
    fold = lambda s: " ".join(s.lower().split())
    want = []
    for q, name, query in focals:
        same = sorted((-weight[i], i) for i, n in nodes if fold(n) == fold(name))
        asked = set("".join(c if c.isalnum() else " " for c in (query or "").lower()).split())
        if same:
            focal = same[0][1]
            rows = [(len(n) > 60, -round(len(asked & set(n.lower().split())) / max(len(asked), 1) * weight[i], 6), -weight[i], i, n) for f, c in member if f == focal for i, d in member if d == c and i != focal for j, n in nodes if j == i]
            want += [(q, k + 1, r[3], r[4], -r[1] + 0.0) for k, r in enumerate(sorted(rows)[:8])]
    edges = both_ways(spark, [(a, b, w) for (a, b), w in links.items()])
    got = modularity.community_peers(spark.createDataFrame(nodes, "id long, name string"), spark.createDataFrame(member, "id long, community long"), edges, spark.createDataFrame(focals, "q int, name string, query string"))
    assert sorted((*r[:4], r[4] + 0.0) for r in map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(focal" in plan  # ranked for each focal and question, not for each of their repeats


def test_relations_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 1, 2, 3.0), (0, 2, 1, 4.0), (2, 2, 2, 5.0), (3, 2, 3, 6.0)], "id long, src long, dst long, weight double")
    edges = graph.ranking_graph(rows)
    assert edges._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(lo") == 1
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 4.0), (2, 1, 4.0), (2, 3, 6.0), (3, 2, 6.0)]
