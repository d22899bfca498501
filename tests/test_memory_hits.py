"""Memory retrieval: who is a candidate, who stays, and in which order."""

from loomspark.operators.retrieval import memory_hits


def test_memory_hits(spark):
    memories = [
        (1, "red rope", "candidate", [1.0, 0.0]), (2, "red rope", "confirmed", [1.0, 0.0]), (3, "red rope", "confirmed", [1.0, 0.0]),
        (4, "nothing shared", "confirmed", [0.9, 0.1]), (5, "nothing shared", "confirmed", [0.5, 0.9]), (6, "red rope", "void", [1.0, 0.0]),
        (7, "rope", "candidate", None), (8, None, "candidate", [1.0, 0.01]), (9, "rope", "candidate", [-1.0, 0.0]),
    ]
    questions = [(0, "Red rope?", [1.0, 0.0]), (1, None, [0.0, 1.0]), (2, "rope", None), (4, "!", None)]
    found = memory_hits(spark.createDataFrame(memories, "id long, text string, status string, vector array<double>"), spark.createDataFrame(questions, "q long, text string, vector array<double>"))
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, r.score))
    # Equal scores: higher authority, then the higher id; without a word only what is like enough; against the floor 9 goes.
    assert [i for i, _ in got[0]] == [3, 2, 1, 8, 4, 7] and got[0][0] == (3, 1.0) and got[0][-1] == (7, 0.5)
    assert got[1] == [(5, 0.524494)] and [i for i, _ in got[2]] == [3, 2, 9, 7, 1]
    assert {i for i, s in got[2]} == {1, 2, 3, 7, 9} and {s for _, s in got[2]} == {1.0} and 4 not in got
    assert memory_hits(spark.createDataFrame(memories, "id long, text string, status string, vector array<double>").limit(0), spark.createDataFrame(questions, "q long, text string, vector array<double>")).count() == 0
