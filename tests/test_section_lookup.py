"""Section lookup: groups, subtrees, limits and awkward rows."""

from loomspark.operators.section_lookup import lookup_sections

CHUNKS = [
    (1, "m", "Manual", 0, "lists cut_db and see_log", False),
    (2, "m", "Manual > Orders > cut_db", 1, "cut_db writes", False),
    (3, "m", "Manual > Orders > cut_db > Values", 2, "a table", False),
    (4, "m", "Manual > Orders > cut_db > Samples", 3, "run CUT_DB now", False),
    (5, "m", "Manual > Orders > see_log", 4, "see_log reads", False),
    (6, "m", "Manual > Orders > see_log > Values", 5, None, False),
    (7, "m", "Contents", 6, "cut_db see_log", True),
    (8, "m", None, 7, "cut_db", False),
    (9, "", "Loose", 8, "cut_db", False),
    (10, "n", "cut_db extra", 0, "cut_db cut_db", False),
    (11, "m", "Manual > Orders > cut_dbx", 9, "other", None),
]


def look(spark, terms, **limits):
    chunks = spark.createDataFrame(CHUNKS, "id int, source_id string, section_path string, pos int, text string, navigation boolean")
    found = lookup_sections(chunks, spark.createDataFrame(terms, "q int, nth int, term string"), **limits)
    return {(r.q, r.section, r.place): (r.id, r.group_path, r.relevance) for r in found.collect()}


def test_groups_and_subtrees(spark):
    got = look(spark, [(1, 0, "cut_db"), (1, 1, "see_log"), (2, 0, ""), (2, 1, None), (3, 0, "nowhere")])
    # Two hits fold onto the order itself; the root is its own hit only, though everything lies under it.
    assert [got[k][:2] for k in sorted(got) if k[1] == 1] == [(i, "Manual > Orders > cut_db") for i in (2, 3, 4)]
    assert [got[k][0] for k in sorted(got) if k[1] == 2] == [1] and got[1, 2, 1][2] == 1.0
    assert [got[k][0] for k in sorted(got) if k[1] == 3] == [10]
    assert {k[0] for k in got} == {1} and got[1, 1, 2][2] == 0.5


def test_limits(spark):
    assert set(look(spark, [(1, 0, "cut_db")], sections=1, per_section=2).values()) == {(2, "Manual > Orders > cut_db", 1.0), (3, "Manual > Orders > cut_db", 1.0)}
    assert {v[0] for v in look(spark, [(1, 0, "see_log"), (1, 1, "cut_db")], most_terms=1, sections=9).values()} == {1, 5, 6}
    assert {v[0] for v in look(spark, [(1, 0, "cut_db")], per_term=1, sections=9).values()} == {1}
    assert look(spark, [(1, 0, "cut_db")], sections=0) == {}
