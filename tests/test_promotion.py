"""Promotion of evidence: what stays, goes and is rewritten."""

import hashlib

from loomspark.operators import promotion as P

md5 = lambda *parts: hashlib.md5("|".join(parts).encode()).hexdigest()


def entry(source, element, span=None, title=None, kind=None, label=None):
    return (source, element, span, title, kind, label, None, None)


def test_promoted(spark):
    objects = [
        (1, [entry("own", "e0", "as it is"), entry("a", "e1", "old words", "First title"), entry("hidden", "e9", "private"), None, entry("a", "e2", None), entry("a", "gone", None)]),
        (2, [entry("a", "e1", "other excerpt", "Second title", "table", "p. 3"), entry("b", "e1", "b's own words")]),
        (3, []), (4, [entry("hidden", "e9", "x")]), (5, [entry(None, None, "no source at all")]),
    ]
    ids = lambda *s: spark.createDataFrame([(x,) for x in s], "source_id string")
    live = spark.createDataFrame([("e1", "a", "live words"), ("e2", "a", "w" * 900), ("e9", "hidden", "secret")], "element_id string, source_id string, text string")
    notebooks = spark.createDataFrame([("a", "nb-a"), ("hidden", "nb-h")], "source_id string, notebook string")
    frame = spark.createDataFrame(objects, f"id int, evidence array<struct<{P.ENTRY.replace(' string', ':string')}>>")
    whole, sources, elements = (df.collect() for df in P.promoted(frame, "lib", ids("own"), ids("hidden"), live, notebooks, "nb-x"))
    got = {r.id: r for r in whole}
    assert {k: (r.rewritten, r.dropped) for k, r in got.items()} == {1: (2, 2), 2: (2, 0), 3: (0, 0), 4: (0, 1), 5: (1, 0)}
    a, b = "src-promo-" + md5("lib", "a"), "src-promo-" + md5("lib", "b")
    one = got[1].evidence
    assert tuple(one[0]) == objects[0][1][0] and one[2] is None and len(one) == 4
    assert (one[1].source_id, one[1].quoted_span, one[1].origin_source_id, one[1].origin_notebook_id, one[1].source_title) == (a, "old words", "a", "nb-a", "First title")
    assert one[1].element_id == "el-promo-" + md5(a, "e1", "live words") == got[2].evidence[0].element_id
    assert one[3].quoted_span == "w" * 500 and got[4].evidence == [] and got[3].evidence == []
    # An element of another source lends no text.
    assert got[2].evidence[1].element_id == "el-promo-" + md5(b, "e1", "b's own words") and got[2].evidence[1].origin_notebook_id == "nb-x"
    assert {(r.id, r.title) for r in sources} == {(a, P.TITLE_PREFIX + "First title"), (b, P.TITLE_PREFIX), ("src-promo-" + md5("lib", ""), P.TITLE_PREFIX)}
    first = next(r for r in elements if r.id == one[1].element_id)
    assert (first.element_type, first.location_label, first.text, first.origin_element_id) == ("paragraph", "", "live words", "e1") and len(elements) == 4
