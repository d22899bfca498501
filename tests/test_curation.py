"""Curation operators on worked examples and odd cases."""

import difflib

import pytest

from pyspark.sql import functions as F

from loomspark.operators import curation

SCOPE = "chain int, pos int, region array<string>, assumptions array<string>, approximation string, span string"


def test_scopes_merge(spark):
    rows = [
        (1, 0, ["Coastal", "High Valley"], ["long bridge"], "Thin Wall", "Early Spring"),
        (1, 1, ["coastal"], ["even ground", "LONG BRIDGE"], "thin wall", "early spring"),
        (1, 2, None, None, None, None),
        (2, 0, ["a"], [], None, None), (2, 1, ["b"], [], None, None),
        (3, 0, None, None, "thin wall", None), (3, 1, None, None, "thick wall", None),
        (4, 0, None, None, None, "low"), (4, 1, None, None, None, "high"),
        (5, 0, None, ["with side wind"], None, None), (5, 1, None, ["without side wind"], None, None),
        (6, 0, None, ["考虑风力"], None, None), (6, 1, None, ["不考虑风力"], None, None),
        (7, 0, None, ["long-arm crane"], None, None), (7, 1, None, ["short arm crane"], None, None),
        (8, 0, None, ["小信号区"], None, None), (8, 1, None, ["大信号区"], None, None),
        (9, 0, None, ["ideal beam"], None, None), (9, 1, None, ["nonideal beam"], None, None),
        (10, 0, None, ["nonideal beam"], None, None), (10, 1, None, ["even ground"], None, None),
        (11, 0, None, ["非理想梁"], None, None), (11, 1, None, ["even ground"], None, None),
    ]
    got = {r.chain: r for r in curation.merged_scopes(spark.createDataFrame(rows, SCOPE)).collect()}
    assert set(got) == {1, 10, 11}
    assert (got[1].region, got[1].assumptions, got[1].approximation, got[1].span) == (["coastal"], ["long bridge", "even ground"], "thin wall", "early spring")
    assert curation.merged_scopes(spark.createDataFrame([], SCOPE)).count() == 0


def floor_of(spark, selected, pool, n):
    s = spark.createDataFrame([(0, k, *r) for k, r in enumerate(selected)], "q int, place int, id string, local boolean, text string, extra boolean")
    p = spark.createDataFrame([(0, *r) for r in pool], "q int, id string, local boolean, text string, relevance double")
    return [r.id for r in curation.with_floor(s, p, n).orderBy("place").collect()]


def test_floor(spark):
    peer = lambda i, extra=False: (i, False, f"text {i}", extra)
    chosen = [("held", True, "text h", False), peer("far1"), peer("extra", True), peer("far2"), peer("far3")]
    spare = [("near1", True, "text n1", 0.4), ("near2", True, "text n2", 0.3)]
    assert floor_of(spark, chosen, spare, 3) == ["held", "far1", "near1", "far2", "near2"]
    assert floor_of(spark, chosen, spare, 1) == ["held", "far1", "extra", "far2", "far3"]
    peers = [peer(f"far{k}") for k in range(4)]
    assert floor_of(spark, peers, [("near1", True, "x", 0.2)], 3) == ["far0", "far1", "far2", "near1"]
    assert floor_of(spark, peers, [(f"near{k}", True, "same", 0.4 - k / 100) for k in range(4)], 3) == ["far0", "far1", "far2", "near0"]
    assert floor_of(spark, [("near1", True, "same", False), *peers[:3]], [("near2", True, "same", 0.3)], 2) == ["near1", "far0", "far1", "far2"]


def test_markers(spark):
    texts = ["x [k1, k2] y [k3].", "a  [k2]", "[k1,  k4]", "no marker", "", None]
    got = curation.without_dangling(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([("k1",), ("k4",)], "key string"))
    assert [r.text for r in got.orderBy("id").collect()] == ["x [k1] y.", "a", "[k1,  k4]", "no marker", "", None]


def test_aliases(spark):
    names = [(1, "Grouped Query Attention (GQA)"), (2, "ＢＥＲＴ (2018)"), (3, "GQA (Grouped Query)"), (4, "abc"), (5, "注意力"), (6, ""), (7, None), (8, "2018")]
    got = {}
    for r in curation.aliases(spark.createDataFrame(names, "id int, name string")).collect():
        got.setdefault(r.id, set()).add(r.alias)
    assert got == {1: {"grouped query attention", "gqa"}, 2: {"bert"}, 3: {"gqa", "grouped query"}, 5: {"注意力"}}


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "a"), ("同一", "同二")]
    got = spark.createDataFrame(pairs, "a string, b string").select(curation.sequence_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_partitions_fail_closed(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 3)], "source_id int, src int, dst int")
    manifest = lambda *r: spark.createDataFrame(list(r), "source_id int, n_edges long")
    assert {(r.source_id, r.n_edges) for r in curation.checked_partitions(edges, manifest((1, 2), (2, 1))).collect()} == {(1, 2), (2, 1)}
    for wrong in (manifest((1, 2)), manifest((1, 2), (2, 2)), manifest((1, 2), (2, 1), (3, 1))):
        with pytest.raises(Exception, match="not as declared"):
            curation.checked_partitions(edges, wrong).collect()


def test_clusters(spark):
    objects = spark.createDataFrame([("o1", "Foo Bar", "foo bar"), ("o2", "foo  bar", "foo bar"), ("o3", "Other", "other"), ("o4", "More", "more")], "id string, name string, seed string")
    pairs = lambda *r: spark.createDataFrame(list(r), "a string, b string")
    got = {r.id: r for r in curation.clustered(objects, pairs(("other", "more"), ("foo bar", "foo bar")), pairs()).collect()}
    assert got["o1"].cluster == got["o2"].cluster and got["o3"].cluster == got["o4"].cluster != got["o1"].cluster and got["o1"].display == "Foo Bar"
    got = {r.id: r for r in curation.clustered(objects, pairs(("other", "more")), pairs(("more", "other")), "KX-").collect()}
    assert got["o3"].cluster != got["o4"].cluster and got["o3"].cluster.startswith("KX-")


def test_outline(spark):
    rows = [("o", "c", "r", 0, True), ("o", "r", None, 1, True), ("o", "e", None, 2, False), ("o", "d", "e", 3, True)]
    got = curation.outline_order(spark.createDataFrame(rows, "outline string, id string, parent string, pos int, bound boolean"))
    assert [(r.id, r.place, r.parent) for r in got.orderBy(F.col("place").asc_nulls_last()).collect()] == [("r", 1, None), ("c", 2, "r"), ("d", 3, None), ("e", None, None)]
