"""Operators on hand-made rows: ties, nulls, empty inputs, order-dependent logic."""

import io
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions import vectors as V
from loomspark.operators import chunking, entities, evaluation, graph, relational, retrieval
from loomspark.sources import files
from loomspark.streaming import changes


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "v1", "v2"),
    [("Q-Former", "q former", "qformer"), ("Llama 3.1", "llama 3 1", "llama3 1"), ("Llama-31", "llama 31", "llama31"), ("Mixture-of-Experts (MoE)", "mixture of experts", "mixtureofexperts"), ("Filter (LP)", "filter lp", "filter lp"), ("ＡＢＣ１", "abc1", "abc1"), ("铸币平价", "铸币平价", "铸币平价"), ("C++", "c++", "c++")],
)
def test_seeds(spark, name, v1, v2):
    assert one(spark, T.seed_v1(F.col("n")), n=name) == v1
    assert one(spark, T.seed_v2(F.col("n")), n=name) == v2


@pytest.mark.parametrize(("text", "want"), [("中文问题 about API", "zh"), ("plain English", "en"), ("REQ-2024-08-0091", "other"), ("日本語のテキスト", "other"), ("   ", "other")])
def test_language(spark, text, want):
    assert one(spark, T.language(F.col("t")), t=text) == want


def test_terms(spark):
    assert one(spark, T.identifiers(F.col("t")), t="run set_db. then 2.1 e.g a-b config.yaml set_db") == ["set_db", "config.yaml"]
    assert one(spark, T.exact_probes(F.col("t")), t="state-of-the-art GPT-4 set_db") == ["GPT-4", "set_db"]
    assert one(spark, T.model_aliases(F.col("t")), t="gpt4 and llama 3 in chapter 4") == ["gpt 4", "llama3"]
    assert one(spark, T.cjk_grams(F.col("t")), t="时序图表 x") == ["时序图表", "时序图", "序图表"]
    assert one(spark, T.quoted_phrases(F.col("t")), t='say "set db" or "ab" and "set db"') == ["set db"]
    assert one(spark, T.word_match(F.col("t"), F.lit("gpt")), t="the GPTs here") is True
    assert one(spark, T.word_match(F.col("t"), F.lit("gpt")), t="gptes") is False
    assert one(spark, T.word_match(F.lit(None).cast("string"), F.col("t")), t="x") is None
    assert one(spark, T.variant_base(F.col("t")), t="Qwen-2.5 7B") == "qwen"
    assert one(spark, T.variant_base(F.col("t")), t="plain") is None
    for name, base in (("Loom_v3.1-large", "loom v3. large"), ("Loom v3.1-large", "loom large"), ("Loom3", None), ("ab 7", None), ("Weft 13 B  chat", "weft b chat"), ("Weft 13B  chat", "weft chat"), ("v2", None), ("--plain  word", None), ("Warp (4)", "warp ( )")):
        assert one(spark, T.variant_base(F.col("t").cast("string")), t=name) == base, name
    for text, names in (("weft-2b, Part 3 and part_4x; Loom1, loom10", ["Loom 1", "weft2b"]), ("x9 ab9c9", []), ("", [])):
        assert one(spark, T.model_aliases(F.col("t")), t=text) == names, text


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 0.0]) is None
    assert one(spark, V.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.from_blob(F.col("a")), a=bytearray(b"\x00\x00\x80\x3f")) == [1.0]
    assert one(spark, V.from_blob(F.col("a")), a=bytearray(b"\x00\x00\x80")) is None


def test_latency_example(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (10, 20, 30, 40, 100)], "stage string, v double")
    assert relational.nearest_rank(df, ["stage"], "v").first()[1:] == (5, 30.0, 100.0, 100.0)


def test_mmr_prefers_what_is_new(spark):
    rows = [(0, 1, 1.0, [1.0, 0.0], 1), (0, 2, 0.99, [1.0, 0.0], 2), (0, 3, 0.5, [0.0, 1.0], 3)]
    got = retrieval.mmr(spark.createDataFrame(rows, "q int, id int, relevance double, vector array<double>, at int"), ["q"], 2)
    assert [r.id for r in got.orderBy("rank").collect()] == [1, 3]


def test_greedy_matching_ties(spark):
    rows = [(0, 1, 1, 0.5), (0, 1, 2, 0.9), (0, 2, 2, 0.9), (0, 2, 1, 0.4)]
    got = relational.greedy_matching(spark.createDataFrame(rows, "k int, gold_id int, pred_id int, iou double"), ["k"])
    assert {(r.gold_id, r.pred_id) for r in got.collect()} == {(1, 2), (2, 1)}


def test_chunks_and_sections(spark):
    rows = [(1, 0, "heading", "# 2.1 Setup"), (1, 1, "paragraph", "x" * 400), (1, 2, "paragraph", "y" * 300), (1, 3, "paragraph", "z"), (1, 4, "heading", "Notes"), (1, 5, "paragraph", "end")]
    paths = chunking.section_paths(spark.createDataFrame(rows, "doc_id int, pos int, element_type string, text string"))
    got = chunking.chunks(paths).orderBy("chunk").collect()
    assert [r.section_path for r in got] == ["2 > 2.1", "2 > 2.1", "2 > 2.1 > Notes"]
    assert [r.element_ids for r in got] == [["1", "2"], ["3"], ["5"]]
    assert got[2].text == "[2.1 > Notes] end"


def test_chunks_keep_captioned_pictures(spark):
    rows = [(1, 0, "paragraph", "before", None), (1, 1, "heading", "A", None), (1, 2, "image", "plot", "a plot"), (1, 3, "figure", "bare", ""), (1, 4, "paragraph", "  ", None), (1, 5, "paragraph", "ab", None), (2, 0, "heading", "only", None)]
    elements = spark.createDataFrame(rows, "doc_id int, pos int, element_type string, text string, caption string")
    got = [tuple(r) for r in chunking.chunks(elements, 5).orderBy("chunk").collect()]
    assert got == [(1, 0, "", "before", ["0"]), (1, 1, "A", "[A] plot\nab", ["2", "5"])]
    assert chunking.chunks(elements.limit(0)).count() == 0


def test_chunk_ends(spark):
    """Against element by element packing."""
    import random

    random.seed(2)
    sizes = [random.randint(1, 40) for _ in range(200)]
    want, held, size = [], [], 0
    for k, n in enumerate(sizes):
        held, size = [*held, str(k)], size + n
        if size >= 60:
            want, held, size = [*want, held], [], 0
    want += [held] if held else []
    got = chunking.chunks(spark.createDataFrame([(7, k, "paragraph", "x" * n) for k, n in enumerate(sizes)], "doc_id int, pos int, element_type string, text string"), 60)
    assert [r.element_ids for r in got.orderBy("chunk").collect()] == want


def test_noise_reasons(spark):
    names = {"ab": "too_short", "1234": "pure_number", "Fig. 3": "reference", "figures of speech": "", "§4 x": "reference", "2.1 Methods": "section_heading", "0.8 micron": "", "x^2": "symbol", "V_DD": "symbol", "set_db": "", "R12": "instance_label", "x_0": "symbol", "gain": ""}
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.noise_reason(F.col("name"), F.lit(False)).alias("reason")).collect()
    assert {r["name"]: r.reason for r in got} == names


def test_term_recall_by_grams(spark):
    docs = spark.createDataFrame([(1, "The License\nof all"), (2, "nothing"), (3, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("license",), ("E\nO",), ("no",), ("all",)], "term string")
    want = {("license", 1), ("E\nO", 1), ("all", 1)}
    assert {tuple(r) for r in retrieval.trigram_recall(docs, terms).collect()} == want
    assert {tuple(r) for r in retrieval.trigram_recall(docs, terms, few=0).collect()} == want


def test_markdown_blocks(spark):
    text = "# Title\n\npara one\nstill one\n\n- a\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n![i](data:image/png;base64,AA)\n\n```\ncode\n\nmore\n```\n> quote"
    got = chunking.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()
    assert [r.element_type for r in got] == ["heading", "paragraph", "list_item", "list_item", "table", "code_block", "blockquote"]
    assert all(text[r.char_start : r.char_end] == r.text for r in got)


def test_page_edges(spark):
    rows = [(1, p, k, t) for p in range(4) for k, t in enumerate(["Header", f"body {p}", str(p)])]
    got = chunking.without_page_edges(spark.createDataFrame(rows, "doc_id int, page int, pos int, text string")).collect()
    assert sum(r.text == "Header" for r in got) == 1
    assert len(got) == 9


def test_edge_contract(spark):
    rows = [(1, "defines", "claim", "concept"), (2, "defines", "concept", "claim"), (3, "defines", "claim", "widget"), (4, "unknown", "claim", "concept")]
    got = {r.id: (r.valid, r.queryable) for r in graph.validity(spark.createDataFrame(rows, "id int, edge_type string, src_type string, dst_type string")).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, False)}


def test_chain_rules(spark):
    cols = "id int, edge_type string, src int, dst int, status string, tier string, confidence double, quote string"
    rows = [(1, "part_of", 1, 2, "verified", "base", 1.0, "q"), (2, "part_of", 2, 3, "pending", "base", None, "q"), (3, "part_of", 2, 1, "verified", "base", 1.0, "q"), (4, "part_of", 2, 4, "verified", "base", 1.0, " "), (5, "kind_of", 2, 5, "verified", "base", 1.0, "q"), (6, "part_of", 3, 6, "verified", "personal", 0.6, "q")]
    got = {(r.a, r.b, r.c): r.trust for r in graph.chains(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, 2, 3): 0.81}


def test_rank_keeps_mass(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "u int, v int, weight double")
    seeds = spark.createDataFrame([(1, 1.0), (9, 1.0)], "id int, weight double")
    score = {r.id: r.score for r in graph.personalized_rank(edges, seeds).collect()}
    assert abs(sum(score.values()) - 1) < 1e-9
    assert score[2] > score[3]


def test_communities(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (7, 8)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "u int, v int, weight double")
    got = {r.id: r.community for r in graph.communities(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_relink_limit(spark):
    isolated = spark.createDataFrame([(0, 1)], "source_id int, id int")
    rows = [(0, 1, k, k, False, 5) for k in range(2, 8)]
    got = entities.relinked(isolated, spark.createDataFrame(rows, "source_id int, id int, other int, overlap int, is_concept boolean, name_length int"))
    assert sorted(r.other for r in got.collect()) == [5, 6, 7]


def test_families_chain(spark):
    rows = [(3, "a", None), (5, "a", "t"), (2, None, "t"), (9, "", None)]
    got = {r.id: r.family for r in entities.families(spark.createDataFrame(rows, "id int, hash string, title string"), ["hash", "title"]).collect()}
    assert got == {2: 2, 3: 2, 5: 2, 9: 9}


def test_measures(spark):
    results = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.8)], "query_id int, id int, score double")
    gold = spark.createDataFrame([(1, 11), (2, 5)], "query_id int, id int")
    got = {r.query_id: r for r in evaluation.retrieval_measures(results, gold, 2).collect()}
    assert (got[1].recall, got[1].rr, got[1].ndcg) == (1.0, 0.5, 0.63093)
    assert got[2].recall == got[2].ndcg == 0.0


def test_repeated_keys_fail(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated key"):
        relational.assert_unique(df, ["k"], "keys").collect()


def test_grids(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a,b\n1,2\n,\n3\n")
    assert [tuple(r) for r in files.csv_grid(spark, str(tmp_path / "g.csv")).collect()] == [("1", "2"), ("3", None)]
    (tmp_path / "bad.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="distinct"):
        files.csv_grid(spark, str(tmp_path / "bad.csv"))
    md = spark.createDataFrame([("| a | b\\|c |\n|---|---|\n| x<br>y | 2 |",)], "t string")
    assert [r.cells for r in files.pipe_rows(md, "t").orderBy("line").collect()] == [["a", "b|c"], ["x\ny", "2"]]
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row r="2"><c r="B2"><v>6</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>head</t></si></sst>")
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert [r.cells for r in files.workbook_rows(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()] == [["head", "5"], ["head", "6"]]
    routed = {r.path.split("/")[-1]: r.parser for r in files.files(spark, str(tmp_path)).collect()}
    assert routed == {"g.csv": "csv", "bad.csv": "csv", "b.xlsx": "xlsx"}


def test_corrupt_log_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nbroken\n')
    rows = files.log_lines(spark, str(tmp_path / "a.jsonl"), "k long").collect()
    assert [r.k for r in rows] == [1, None]
    assert rows[1]._corrupt == "broken"


def test_gbk(spark):
    df = spark.createDataFrame([(bytearray("中文".encode("gbk")),), (bytearray("\ufeff中文".encode()),)], "c binary")
    assert [r[0] for r in df.select(files.decoded_text(F.col("c"))).collect()] == ["中文", "中文"]


def test_stream_ring(spark, tmp_path):
    rows = [(1, k, f"2024-01-01 00:00:{k:02d}") for k in range(6)]
    spark.createDataFrame(rows, "u long, id long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = changes.followed(spark, str(tmp_path / "in"), "u long, id long, ts timestamp")
    q = changes.ring(stream, "u", "id", "ts", 3).writeStream.outputMode("update").format("memory").queryName("ring").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("ring").collect()[-1].ids == [5, 4, 3]


def test_retained_bounds(spark):
    log = spark.createDataFrame([(k, "2024-01-01") for k in range(5)], "seq int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert changes.retained(log, "seq", "ts", [3, None, 4], "2025-01-01").count() == 2
    assert changes.retained(log, "seq", "ts", [None], "2025-01-01").count() == 5
