"""The corpus pipeline stage by stage."""

import re

import pytest

import corpus_pipeline
from loomspark.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), name))
    return out


def test_columns_stay(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns


def test_quality_keeps_good(steps, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = steps[1].join(labels, "doc_id").where("quality = 1").count()
    assert kept >= 0.97 * labels.where("quality = 1").count()


def test_copies_go(steps):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    before, after = ({norm(r.text): r.doc_id for r in df.orderBy("doc_id", ascending=False).collect()} for df in steps[1:3])
    assert before == after
    assert steps[2].count() == len(after)


def test_near_copies_go(steps):
    from test_llm import components_by_force

    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    want = {root for _, root in components_by_force(rows, 5, 80).values()}
    assert {r.doc_id for r in steps[3].collect()} == want


def test_redacted(steps):
    from test_llm import base_by_force

    for r in steps[4].collect():
        assert base_by_force(r.text) == [] or "<" in r.text
        assert not [x for x in base_by_force(r.text) if x.split(":")[0] in ("email", "ip")]
        assert r.n_chars == len(r.text)
    assert steps[4].count() == steps[3].count()


BASE = "a plain text of some twenty words that is long enough for shingles and says nothing of any interest to anybody at all "
ROWS = [
    (1, BASE + "one"),
    (1, BASE + "one"),
    (1, "another text under the same id, with mail to a.b@c.example and 10.1.2.3 and card 4111 1111 1111 1111"),
    (None, BASE + "one"),
    (None, "nobody's text, call +49 (30) 1234-5678, iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789"),
    (None, "nobody's text, call +49 (30) 1234-5678, iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789"),
    (2, BASE + "one " + BASE + "two " + BASE.replace("plain", "simple")),
    (3, BASE + "one  " + BASE + "two\t" + BASE.replace("plain", "simple")),
    (4, BASE + "one " + BASE + "two " + BASE.replace("plain", "simple") + "end"),
    (5, None),
    (6, ""),
    (7, None),
]


def test_stages_on_awkward_rows(spark):
    """Repeated and null ids, null and empty texts, clashing names, and then no rows at all."""
    docs = spark.createDataFrame([(i, t, "en", "web", 0, 1, "x") for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, n int, key string")
    _, exact, near, private, packed = (f for _, f in corpus_pipeline.STAGES)
    first = staged(exact(spark, docs, SF), "exact")
    assert first.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in first.collect()) == [(0, "nobody'"), (1, "a plain"), (1, "another"), (2, "a plain"), (4, "a plain"), (5, "")]
    second = staged(near(spark, first, SF), "near")
    assert second.columns == docs.columns
    assert len({r.text for r in second.collect() if r.text and r.text.count("plain") > 1}) == 1
    third = staged(private(spark, second, SF), "private")
    texts = " ".join(r.text or "" for r in third.collect())
    assert all(f"<{k}>" in texts for k in ("EMAIL", "IP", "CARD", "PHONE", "IBAN", "SSN"))
    assert third.where("text IS NULL").count() == second.where("text IS NULL").count()
    assert packed(spark, third, SF).count() == third.count()
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "none")
        assert docs.count() == 0


def test_packed(steps):
    assert steps[5].select("doc_id").distinct().count() == steps[4].count()


def test_run_is_the_stages(spark, steps):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert got == sorted(map(tuple, steps[5].select("doc_id", "piece", "length", "ids_crc32").collect()))
