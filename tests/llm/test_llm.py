"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import exact_dedup, jpeg, media, near_join, packing, pieces, pii, quality, repeats, token_counts, toxicity
from loomspark.llm.common import staged
from loomspark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
WORD_IDS = packing.WordIds(WORDS)
LINE = "A passage of some length that many of the documents share word for word, though what stands around it is never the same. "


def awkward():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aeioustnr"), 6))
    texts = ["", None, " ", "one two", "One  TWO", "one\ttwo", "漢字 😀 é", "a" * 700, "ab" * 400, "\n\n", "mail me: x.y@z.example.org or +49 (30) 1234-5678, card 4111 1111 1111 1111 at 10.0.0.255"]
    base = " ".join(word() for _ in range(300))
    texts += [base, base, base.replace(" ", "  "), base + " tail", "head " + base, base[: len(base) // 2] + " xx yy " + base[len(base) // 2 :]]
    texts += [f"{word()} {word()} {LINE}{word()} {word()} {word()}" for _ in range(150)]
    texts += [" ".join(word() for _ in range(9000)), (LINE * 30), LINE]
    df = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    # Clashing names, on purpose.
    return df.assign(id=7, norm="n", rep=1, n=2, gram=3, key="k", length=5, part=0)


DF = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DF, "doc_id long, text string, id int, norm string, rep int, n int, gram int, key string, length int, part int")


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def texts():
    return [(int(i), t or "") for i, t in zip(DF.doc_id, DF.text, strict=True)]


def removed_by_force(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = t.encode()
        m = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                m[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        runs = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        out[i] = (len(b), int(m.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [1, 64])
def test_repeats(docs, none, bucket, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "HEADS", 50 * bucket)
    if bucket == 1:
        assert repeats.remove_repeats(none).count() == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == removed_by_force(texts())


def test_repeats_of_awkward_ids_and_made_texts(spark):
    """Rows that share an id, and two texts that were written to have equal sums in a hash this operator once used."""
    made = ["vznwsbwguyxgjfksgcwexougawiwvpsypfiowdempyxzurktauskikfoikdnyerghfacntubqtoaionjmesiebzrovqyvyamalsb", "ukwidsekeklgaoksecmaubgouzmuflnsjzqrgjempyxzurktauskikfoikdnyenofgqdlenjqgucaaasncirlnswzdngamdgvwtv"]
    a, b = LINE * 2, "".join(np.random.default_rng(8).choice(list("abcdefgh"), 419))
    rows = [(1, made[0]), (2, made[1]), (3, a), (4, a), (4, b), (4, b), (None, a), (None, None), (5, None), (6, b + "x")]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    n = len(a)
    first = removed_by_force([(0, a)])[0][1]
    want = [(1, 100, 0), (2, 100, 0), (3, n, first), (4, n, n), (4, 419, 0), (4, 419, 419), (None, n, 0), (None, 0, 0), (5, 0, 0), (6, 420, 419)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_across_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    part = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes()
    runs = []
    for k, start, windows, gram, _ in repeats.segments([part, b"short", part[100:] * 300], b"key"):
        runs += zip(k.tolist(), start.tolist(), windows.tolist(), gram.tolist(), strict=True)
    by_text = defaultdict(list)
    for k, s, w, _ in runs:
        by_text[k].append((s, w))
    for k, size in ((0, len(part)), (2, 4900 * 300)):
        at = 0
        for s, w in sorted(by_text[k]):
            assert s == at
            at += w
        assert at == size - 99
    assert 1 not in by_text


@given(st.lists(st.binary(min_size=68, max_size=68), min_size=1, max_size=30))
@settings(max_examples=50, deadline=None)
def test_blind_trie(keys):
    trie, first = repeats.BlindTrie(8 * 68), {}
    for k, b in enumerate(keys + keys[:3]):
        assert trie.insert(int.from_bytes(b), k) == first.setdefault(b, k)


def test_exact_dedup(docs, none):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.without_copies(none).count() == 0
    assert exact_dedup.without_copies(docs).columns == docs.columns
    assert exact_dedup.without_copies(docs).count() == len(groups)


def test_exact_dedup_refused_identifiers(docs, monkeypatch):
    """With identifiers that tell nothing apart, texts are compared whole."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "identifier", lambda c: F.struct(F.lit(1).cast("long").alias("h"), F.lit(1).alias("n")))
    test_exact_dedup(docs, docs.limit(0))


def components_by_force(rows, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent", "tile"), [(4, 85, 512), (5, 80, 2), (1, 50, 8)])
def test_near_classes(docs, words, percent, tile, monkeypatch):
    monkeypatch.setattr(near_join, "TILE", tile)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_classes(docs, words=words, percent=percent).collect()}
    assert got == components_by_force(texts(), words, percent)


def test_near_classes_empty(none):
    assert near_join.near_classes(none).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41))
    assert [got[k] for k in (90, 95, 100)] == [90] * 3


def test_token_counts(docs, none, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 40)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PIECES).collect()}
    assert got == {i: (len(t.encode()), len(sp.encode(t))) for i, t in texts()}
    assert token_counts.token_counts(none, PIECES).count() == 0


def ids_by_library(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = []
    for i, t in rows:
        ids = np.array(sp.encode(t or ""), np.int64)
        out.append((i, len((t or "").encode()), len(ids), int((ids * np.arange(1, len(ids) + 1)).sum()), True))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [64, 1000, 32768])
def test_pieces(docs, none, chunk):
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.ids_sum, r.round_trip) for r in pieces.encoding_report(docs, PIECES, chunk=chunk).collect()]
    assert sorted(got, key=str) == ids_by_library(texts())
    if chunk == 1000:
        back = {r.doc_id: r.text for r in pieces.decoded_texts(pieces.encode(docs, PIECES, chunk=chunk), PIECES).collect()}
        assert back == dict(texts())
        assert pieces.encoding_report(none, PIECES).count() == 0


@pytest.mark.parametrize("chunk", [32, 48, 65])
def test_pieces_of_random_texts(spark, chunk, monkeypatch):
    """Short chunks, a tree of several levels, and rows that repeat an id or have none."""
    monkeypatch.setattr(pieces, "FAN", 3)
    rng = np.random.default_rng(chunk)
    parts = ["the", "ing", " ", "  ", "       ", "\n", "\t", "漢字", "かな", "😀", "é", "e\u0301", "\x00", "\x07", "▁", "123", "aaaa", "abab", "zzzzzz", ".", "-----", "Straße", "\u00a0", "؟", "x"]
    rows = [(int(k) // 2 if k % 7 else None, "".join(rng.choice(parts, int(rng.integers(0, 300))))) for k in range(40)]
    rows += [(1000, "ab" * 900), (1000, "ab" * 900), (1000, "c" * 700), (None, " " * 500), (None, None)]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.ids_sum, r.round_trip) for r in pieces.encoding_report(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, chunk=chunk).collect()]
    assert sorted(got, key=str) == ids_by_library(rows)
    with pytest.raises(ValueError, match="characters"):
        pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, chunk=8)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in packing.pack_documents(docs, WORDS).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in texts():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[i]) == [(n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, WORDS).count() == 0


@given(st.lists(st.text(alphabet=st.sampled_from("aZ\u0130\u00e9\u0301\u0958\u09dc\u212b\u00dfK1 .,;:!?'<|>%&\u4e2d\x01\n-s"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_word_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert WORD_IDS.many(texts) == want


def test_word_ids_of_every_letter_before_punctuation():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    letters = [chr(k) for k in range(0x41, 0x30000) if chr(k).isalpha()]
    letters = letters[:3000] + letters[3000::7] + [chr(k) for k in (*range(0x958, 0x960), *range(0x9DC, 0x9E0), 0x130, 0x1E9E)]
    for end in (",", ".", "!?", ";:", "%%"):
        texts = [f"x{c}{end}" for c in letters]
        want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        got = WORD_IDS.many(texts)
        assert [x for x, a, b in zip(texts, got, want, strict=True) if a != b] == []


def best_fit_by_force(sizes, capacity):
    gaps = []
    for n in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize(("capacity", "sizes"), [(60, "mixed"), (60, "small"), (60, "equal"), (4096, "mixed"), (7, "ties")])
def test_packing_supersteps(spark, capacity, sizes):
    """Every piece once, sequences gapless and within the capacity, and about as many of them as best fit one by one opens."""
    rng = np.random.default_rng(8)
    n = {"mixed": rng.integers(1, capacity + 1, 700), "small": rng.integers(1, 9, 500), "equal": np.full(100, capacity // 3 + 1), "ties": rng.integers(1, 4, 300)}[sizes]
    pieces = spark.createDataFrame([(int(k) if k % 9 else None, 0, int(x)) for k, x in enumerate(n)], "doc_id long, piece int, length long")
    rows = packing.best_fit_pack(staged(pieces, "pieces"), capacity).collect()
    assert sorted(r.length for r in rows) == sorted(n.tolist())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= 1.02 * best_fit_by_force(n.tolist(), capacity) + 2


def test_words_of_letters_skip_normalisation(monkeypatch):
    """Words of Latin letters, most of a text, are encoded without the costly rules, and give the library's ids."""
    from tokenizers import Tokenizer

    t, ours = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = ["Straße Ärger ÉTÉ été\tnaïve  Ǆ \n", "", " ", "THE cat sat on thononthing", "été Straße ƻ ǀ Ⱥ"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    monkeypatch.setattr(ours, "encode", None)
    assert ours.many(texts) == want
    assert ours.many(texts[::-1]) == want[::-1]


def test_pieces_of_batches_beyond_the_slice(spark):
    """Batches of more text than is looked up at once, and single texts of more."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    kinds = [None, "Straße, it's <|endoftext|> K9 été. " * 1500, "one two. " * 500_000, "x"]
    want = {}
    for k, text in enumerate(kinds):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[k] = [(n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    rows = [(k, kinds[2 if k in (0, 50) else (1, 0, 3)[k % 3]]) for k in range(150)]
    got = defaultdict(list)
    for r in packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORDS).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: want[kinds.index(x)] for k, x in rows}


@pytest.mark.parametrize("least", [30, 5000])
def test_sweeps_take_tasks_by_rows(spark, monkeypatch, least):
    """Few rows are swept by few tasks; where there are more tasks, what is left over still meets across ranges."""
    parts, real = [], packing._superstep
    monkeypatch.setattr(packing, "SWEPT_ROWS", least)
    monkeypatch.setattr(packing, "_superstep", lambda *a: parts.append(a[-1]) or real(*a))
    n = np.random.default_rng(9).integers(1, 61, 600)
    pieces = spark.createDataFrame([(k, 0, int(x)) for k, x in enumerate(n)], "doc_id long, piece int, length long")
    rows = packing.best_fit_pack(staged(pieces, "pieces"), 60).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(n.tolist()))
    by_sequence = defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 60
    assert len(by_sequence) <= 1.02 * best_fit_by_force(n.tolist(), 60) + 2
    assert set(parts) == {1} if least > 600 else max(parts) > 1


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_left_over_slots_go_to_the_nearest(tallies):
    runs, rest, total = packing.resolve([(k, a, b) for k, (a, b) in enumerate(tallies)])
    stack, want, lacking = [], {}, 0
    for k, (a, b) in enumerate(tallies):
        for i in range(a):
            if stack:
                want[k, i] = stack.pop()
            else:
                assert rest[k][1] + i - rest[k][0] == lacking
                lacking += 1
        stack += [(k, i) for i in range(b)]
    assert total == lacking
    assert want == {(p, at + i): (q, top - i) for p, at, n, q, top in runs for i in range(n)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_force(t):
    def luhn(s):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0

    def good(kind, m):
        n = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if good(k, m[0])]


SPANS = [
    "a@b.co_x@d.e, 1.2.3.4.5 and 1..2.3.4.5 or 256.1.1.1, 000255.1.1.1; " + "9" * 6000,
    "é x@y.z 😀 +1 (555) 010-9999 +1((((((( 4111-1111-1111-1111 4111 1111 1111 1112",
    "x" * 5000 + " @ " + "y." * 3000 + "@q.r",
    "my iban is DE89 3704 0044 0532 0130 00. not DE89370400440532013001; ssn 123-45-6789; id 123-45-6789",
]


def test_pii(spark, docs, none):
    rows = [(1000 + k, t) for k, t in enumerate(SPANS)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.pii_report(every).collect()}
    for i, t in [*texts(), *rows]:
        assert got[i].base_sha256 == hashlib.sha256(",".join(base_by_force(t)).encode()).hexdigest(), i
    assert (got[1003].n_iban, got[1003].n_ssn) == (1, 1)
    assert pii.pii_report(none).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(every.withColumn("n", every["doc_id"])).collect()}
    assert clean[1] is None
    assert clean[10] == "mail me: <EMAIL> or <PHONE>, card <CARD> at <IP>"


def test_pii_of_many_matches(spark):
    """Twenty thousand spans in one text, in about linear time."""
    import time

    texts = [" ".join(f"u{k}@h{k}.example" for k in range(n)) for n in (10_000, 20_000)]
    began = time.time()
    rows = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k].n_email for k in (0, 1)] == [10_000, 20_000]
    clean = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in clean] == [" ".join(["<EMAIL>"] * n) for n in (10_000, 20_000)]
    assert time.time() - began < 60


PII_FOUND = [
    ("SSN: " + ", ".join(f"{123 + k}-45-{6789 + k}" for k in range(12)) + ".", ["ssn"] * 12),
    ("ssn 123-45-6789 and also 234-56-7890; id 345-67-8901", ["ssn"] * 2),
    ("123-45-6789 or 234-56-7890 is my social security number", ["ssn"] * 2),
    ("id 123-45-6789, ssn 234-56-7890", ["ssn"]),
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF.", ["DE89 3704 0044 0532 0130 00"]),
    ("AB12 CD DE89370400440532013000 GB82 WEST 1234 5698 7654 32 AND 7", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]),
    ("é😀 DE89 3704 0044 0532 0130 01 FR14 2004 1010 0505 0001 3M02 606", ["FR14 2004 1010 0505 0001 3M02 606"]),
    ("the ssn form of 2020: 123 45 6789", []),
]


def test_pii_added_kinds(spark):
    """Lists share a context word on either side; an iban ends where it does, not where its line of capitals does."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PII_FOUND)], "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.pii_report(docs).collect()}
    for k, (t, want) in enumerate(PII_FOUND):
        got = [(kind, t[int(s) : int(e)]) for kind, s, e in spans[k] if kind in ("iban", "ssn")]
        assert [m if kind == "iban" else kind for kind, m in got] == want, t
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "SSN: " + ", ".join(["<SSN>"] * 12) + "."
    assert clean[4] == "IBAN <IBAN> BIC COBADEFF."


def test_jpeg_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 5, 6, 13):
        payload = rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        image = jpeg.decode(jpeg.store(payload))
        assert jpeg.load(image) == payload
        assert image.rgb().shape == (16 * -(-n // 6), 16, 3)


def test_jpeg_general_decoder(monkeypatch):
    """Symbol by symbol gives what the fixed layout gives."""
    payload = np.random.default_rng(4).integers(0, 256, 64 * 9, dtype=np.uint8).tobytes()
    file = jpeg.store(payload)
    fast = jpeg.decode(file)
    monkeypatch.setattr(jpeg, "_fixed_scan", lambda *a: False)
    slow = jpeg.decode(file)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components, strict=True))
    with pytest.raises(ValueError, match="not a JPEG"):
        jpeg.decode(b"plain text")


def test_jpeg_constant_block():
    """A DC value of 8 k moves every sample by k."""
    image = jpeg.Image(8, 8, [jpeg.Component(1, 1, 1, 0, 1, 1, 1, 1, np.array([[80] + [0] * 63], np.int32))], b"", {0: np.ones(64, np.int64)})
    assert (image.rgb() == 138).all()


def test_media(docs, none):
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for i, t in texts():
        b = t.encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[11].media_sha256 == got[12].media_sha256
    assert got[11].feature == got[12].feature
    assert media.media_digests(none).count() == 0
    some = media.tensors(media.stored(docs.where("doc_id < 5")), "doc_id").collect()
    assert all(r.error is None and len(r.rgb) == r.height * r.width * 3 for r in some)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.selectExpr("doc_id", "quality AS label")
    scored = quality.score_documents(docs, known, ~quality.held_out())
    rows = scored.join(known, "doc_id").where(quality.held_out()).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in rows) >= 0.95 * len(rows)


def test_quality_edges(spark, docs, none):
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score_documents(docs, no_labels, quality.held_out() | True).collect()} == {0.5}
    one_class = spark.createDataFrame([(20, 1), (21, 1), (22, None)], "doc_id long, label int")
    assert {round(r.score, 6) for r in quality.score_documents(docs, one_class, quality.held_out() | True).collect()} == {0.75}
    assert quality.score_documents(none, no_labels, quality.held_out() | True).count() == 0


def test_isotonic():
    raw = np.array([0.1, 0.2, 0.3, 0.4])
    x, y = quality.isotonic(raw, np.array([0.0, 3.0, 1.0, 4.0]), np.array([4.0, 4.0, 4.0, 4.0]))
    assert (np.diff(x) > 0).all()
    assert (np.diff(y) >= 0).all()
    assert len(x) == 3


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 <> 1").selectExpr("doc_id", "toxic", "toxic * (1 - quality) AS junk")
    scored = toxicity.score_documents(docs, train, ["toxic", "junk"])
    rows = scored.join(labels.where("doc_id % 3 = 1"), "doc_id").collect()
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in rows) >= 0.9 * len(rows)


def test_toxicity_chain_equals_a_plain_one():
    rng = np.random.default_rng(3)
    x = (rng.random((90, 6)) < 0.4).astype(np.float32)
    y = np.stack([x[:, 0], np.maximum(x[:, 0] * x[:, 1], x[:, 2])], 1).astype(np.float32)
    y[::7, 0] = np.nan
    fold = np.arange(90) % 3
    got = toxicity.fit_chain(x, y, fold)
    ok = ~np.isnan(y[:, 0])
    first = toxicity._logistic(x[ok], y[ok, 0])
    seen = np.zeros(90, np.float32)
    for f in range(3):
        seen[fold == f] = toxicity._probability(x[fold == f], toxicity._logistic(x[ok & (fold != f)], y[ok & (fold != f), 0]))
    second = toxicity._logistic(np.hstack([x, seen[:, None]]), y[:, 1])
    np.testing.assert_allclose(got[0], first, atol=1e-6)
    np.testing.assert_allclose(got[1], second, atol=1e-6)
    p = toxicity.chain_probabilities(x, got)
    np.testing.assert_allclose(p[:, 1], toxicity._probability(np.hstack([x, toxicity._probability(x, first)[:, None].astype(np.float32)]), second), atol=1e-5)


def test_toxicity_null_labels(spark, docs):
    labels = spark.createDataFrame([(k, None if k % 2 else 1, k % 2) for k in range(40)], "doc_id long, a int, b int")
    assert toxicity.score_documents(docs, labels, ["a", "b"]).where("p_a IS NULL OR p_b IS NULL").count() == 0


def test_toxicity_edges(spark, docs, none):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.p_toxic, 6) for r in toxicity.score_documents(docs, no_labels, ["toxic"]).collect()} == {0.5}
    assert toxicity.score_documents(none, no_labels, ["toxic"]).count() == 0
