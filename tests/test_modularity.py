"""Communities against planted groups, label propagation and a plain modularity; peers against plain Python."""

import numpy as np
import pytest

from loomspark.operators import graph, modularity


def both_ways(spark, links):
    return spark.createDataFrame([e for a, b, w in links for e in ((a, b, float(w)), (b, a, float(w)))], "u long, v long, weight double")


def planted(groups, size, p_in, p_out, seed=3):
    rng = np.random.default_rng(seed)
    own = np.repeat(np.arange(groups), size)
    links = [(10 * i, 10 * j, 1) for i in range(len(own)) for j in range(i) if rng.random() < (p_in if own[i] == own[j] else p_out)]
    return own, links


def plain(links, label):
    all_, inner, total = 2 * sum(w for *_, w in links), 0.0, {}
    for a, b, w in links:
        inner += 2 * w * (label[a] == label[b])
        for x in (a, b):
            total[label[x]] = total.get(label[x], 0) + w
    return inner / all_ - sum(t * t for t in total.values()) / all_**2


def test_planted_groups_are_found(spark):
    own, links = planted(6, 24, 0.5, 0.02)
    edges = both_ways(spark, links)
    found = modularity.communities(edges)
    got = {r.id: r.community for r in found.collect()}
    assert got == {10 * i: 10 * int(np.flatnonzero(own == own[i])[0]) for i in range(len(own))}
    assert modularity.modularity(edges, found) == pytest.approx(plain(links, got))
    spread = graph.communities(edges, least=1).select("id", "community")
    assert modularity.modularity(edges, found) >= modularity.modularity(edges, spread)


def test_small_graphs(spark):
    def groups(links, least=1):
        out = {}
        for r in modularity.communities(both_ways(spark, links), least).collect():
            out.setdefault(r.community, set()).add(r.id)
        return sorted(map(sorted, out.values()))

    assert groups([(1, 2, 1), (2, 3, 1), (1, 3, 1), (8, 9, 1)], 2) == [[1, 2, 3], [8, 9]]
    ring = [(5 * k + a, 5 * k + b, 1) for k in range(6) for a in range(5) for b in range(a)] + [(5 * k, (5 * k + 5) % 30, 1) for k in range(6)]
    assert groups(ring) == [list(range(5 * k, 5 * k + 5)) for k in range(6)]
    assert modularity.communities(spark.createDataFrame([], "u long, v long, weight double")).count() == 0
    assert groups([(7, 7, 3)]) == []


def test_peers(spark):
    nodes = spark.createDataFrame([(1, "Focal  One"), (2, "Blue ring"), (3, "Red bolt"), (4, "blue " + "x" * 80), (5, "Away blue"), (6, None), (7, "focal one")], "id long, name string")
    membership = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (5, 5), (7, 5)], "id long, community long")
    edges = both_ways(spark, [(1, 2, 1), (1, 3, 5), (1, 4, 9), (1, 6, 1), (5, 7, 2)])
    focals = spark.createDataFrame([(1, " focal ONE", "which blue?"), (2, "unknown", "blue"), (3, None, None), (4, "Away blue", "")], "q int, name string, query string")
    got = [tuple(r) for r in modularity.community_peers(nodes, membership, edges, focals).orderBy("q", "rank").select("q", "rank", "id", "score").collect()]
    assert got == [(1, 1, 2, 0.5), (1, 2, 3, 0.0), (1, 3, 6, 0.0), (1, 4, 4, 4.5), (4, 1, 7, 0.0)]
    assert modularity.community_peers(nodes, membership, edges, focals, k=1).where("q = 1").count() == 1
    assert modularity.community_peers(nodes, membership, edges, focals.limit(0)).count() == 0
