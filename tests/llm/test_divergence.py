"""The divergence audit against plain Python over awkward rows."""

import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import divergence
from loomspark.llm.divergence import source_divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, least=3, top=200):
    docs, groups, of_lang, df = [], defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = Counter(WORD.findall((text or "").translate(FOLD)))
        docs.append((lang or "", source or "", words))
        df[lang or ""].update(words.keys())
    for lang, source, words in docs:
        kept = {w: n for w, n in words.items() if df[lang][w] >= least}
        groups[lang, source].update(kept)
        of_lang[lang].update(kept)
    vocab = {lang: [w for w, n in df[lang].items() if n >= least] for lang in {g[0] for g in groups}}

    def shares(counts, lang):
        total = sum(counts.values()) + len(vocab[lang])
        return {w: 1 + 10**9 * (counts[w] + 1) // total for w in vocab[lang]}

    f = lambda p, q: (p - q) ** 2 // q
    out = set()
    for (lang, source), counts in groups.items():
        p, q = shares(counts, lang), shares(of_lang[lang], lang)
        others = [(sum(f(p[w], x[w]) for w in p), s.encode()) for (g, s), c in groups.items() if g == lang and s != source for x in [shares(c, lang)]]
        terms = [(f(p[w], q[w]), w.encode()) for w in p if counts[w] and p[w] > q[w]]
        for part, listed, most in (("pair", others, len(others)), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(listed, key=lambda x: (-x[0], x[1]))[:most], 1):
                out.add((lang, source, part, item.decode(), value, rank))
    return out


ROWS = [
    ("The the THE cat; É é ǅ", "en", "a"), ("the cat sat", "en", "a"), ("the cat sat", "en", "a"), (None, "en", "b"), ("", "en", "c"),
    ("The dog's cat 42 x9y the", "en", "b"), ("漢字 😀 漢字 𝒳", None, None), ("漢字\x00😀", "", "x"), ("漢字 ﬁ 😀", "", ""), ("une fois", "fr", "a"),
    ("42 !? \x7f", "de", "a"), ("zz " * 3000 + "the cat", "en", None), ("sat sat sat", "en", "d"),
]


def frame(spark, rows):
    kept = spark.createDataFrame(rows, "text string, lang string, source string")
    # Clashing names, a repeated id and a null one, on purpose.
    return kept.withColumns({"term": F.lit("t"), "n": F.lit(1), "count": F.lit(2), "item": F.lit("i"), "doc_id": F.expr("if(lang = 'en', 7, null)"), "rank": F.lit(0)})


def test_awkward_rows(spark):
    got = [tuple(r) for r in source_divergence(frame(spark, ROWS)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == by_force(ROWS)
    assert {r[0] for r in got if r[2] == "pair"} == {"", "en"}
    assert set(map(tuple, source_divergence(frame(spark, ROWS), least=1, top=2).collect())) == by_force(ROWS, 1, 2)


def test_empty(spark):
    none = source_divergence(frame(spark, ROWS).limit(0))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0


def plan_nodes(node):
    """The physical plan as it ran, with what lies inside adaptive stages."""
    yield node
    if node.nodeName() == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif node.nodeName().endswith("QueryStage"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    for child in below:
        yield from plan_nodes(child)


def test_two_sources_meet_once_a_term(spark):
    sources, terms = 12, 20
    rows = [(" ".join(f"w{chr(97 + t)}" for t in range(terms)), "en", f"s{k:02}") for k in range(sources)]
    out = source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert out.where("part = 'pair'").count() == sources * (sources - 1)
    got = out._jdf.queryExecution()
    out._jdf.collectToPython()
    nodes = list(plan_nodes(got.executedPlan()))
    joined = [n.metrics().apply("numOutputRows").value() for n in nodes if n.nodeName().endswith("Join")]
    assert max(joined) == terms * sources * (sources - 1) // 2


def test_texts_are_split_between_terms(spark):
    texts = ["", "a", " a", "a ", "42", "\x00A\x7fb", "Éa-ÉA", "𝒳😀\t漢", "ǅ İ K Σ", "a" * 50 + "!" * 50 + "B"]
    counted = divergence.term_counts(frame(spark, [(t, "en", t) for t in texts]))
    # Extracting every match takes several times the CPU seconds of splitting.
    assert "regexp_extract_all" not in counted._jdf.queryExecution().toString()
    want = {(t, w): n for t in texts for w, n in Counter(WORD.findall(t.translate(FOLD))).items()}
    assert {(r.source, r.term): r.n for r in counted.collect()} == want


@given(st.lists(st.tuples(st.integers(0, 9 * 10**15 - 1), st.integers(1, 9 * 10**15 - 1)), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_shares_are_exact(spark, pairs):
    rows = [(min(a, b), b) for a, b in pairs]
    got = spark.createDataFrame(rows, "a long, b long").select(divergence.share(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [10**9 * a // b for a, b in rows]
