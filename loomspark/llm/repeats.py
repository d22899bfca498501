"""Suffix-array dedup: every byte of a repeated 100-byte string is removed, but for the string's first occurrence.

A full suffix array of the corpus would move every position of it. This one is sparse and exact. Each 100-byte window is
assigned to its anchor, the position of the least hashed 24-byte string inside it - a choice that depends on the window's own
bytes alone, so equal windows have equal anchors at equal distances. Neighbouring windows with one anchor form a segment
(about 40 windows), and windows can only repeat where anchor strings repeat:

1. segments whose anchor string occurs once in the corpus are unique throughout and leave the race;
2. of equal segments all but the first are repeats throughout (equal by 128 bits of a hash whose key is drawn for each run);
3. segments that share an anchor string without being equal are contested. The suffixes at their windows are put in order by
   deep-shallow sorting: a multikey quicksort, eight bytes a character, to a shallow depth; groups of suffixes that still tie
   go into a blind trie each, which tells equal windows apart from those that differ further on.

A contested anchor string with more than `BUCKET` different segments is salted over several tasks; each passes on its own
first occurrences as packed runs of (128-bit keyed hash, position), cut by ranges of the hash. The runs of one range are merged in
one task; a window occurs there once a task, however often it does in the corpus.

Edge cases: null counts as empty; texts under 100 bytes keep all bytes; matches never cross documents; ties in position are
settled by doc_id, then start. Rows that repeat an id are documents of their own, one after the other in the order of a hash of
their texts, so of equal ones the first stays. A null id takes part in nothing and keeps its text. An empty table gives an empty result; extra columns are ignored. Long texts are scanned block by block, whole.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, drop_shuffles, staged

LENGTH = 100
GRAM = 24
#: Bytes scanned at once; positions in a block take BITS bits of a sort key.
BITS = 19
BLOCK = (1 << BITS) - LENGTH - 1
#: Segments of one anchor string that one task sorts; with their windows, some ten megabytes.
BUCKET = 1024
#: First windows that a task holds before it passes them on, and the record each has.
HEADS = 200_000
_HEAD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc_id", "<i8"), ("start", "<i4")])
#: Bytes that the quicksort looks at before it leaves a group to a trie.
SHALLOW = 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW = np.full(1 << BITS, _BASE, np.uint64)
_INV = np.full(1 << BITS, pow(_BASE, -1, 1 << 64), np.uint64)
_POW[0] = _INV[0] = 1
_POW, _INV = np.multiply.accumulate(_POW), np.multiply.accumulate(_INV)


def _mix(h: np.ndarray, a: int, b: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(a)
    h ^= h >> np.uint64(29)
    h *= np.uint64(b)
    h ^= h >> np.uint64(32)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def digests(text: bytes, starts: list[int], ends: list[int], key: bytes) -> np.ndarray:
    """128 bits of a keyed hash for each stretch of the text, as two numbers. The key is drawn for each run, so that no text can be
    written to collide."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(text[a:b], digest_size=16, key=key).digest() for a, b in zip(starts, ends, strict=True)]), "<u8").reshape(-1, 2)


def _segments_of(block: bytes, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, ...]:
    """Segments of a block of whole texts that end at `ends`: window start, windows, hash of the anchor string, digest of the bytes."""
    raw = np.frombuffer(block, np.uint8)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POW[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _INV[: n - GRAM + 1], 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
    mask = np.uint64((1 << BITS) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_least(keys, LENGTH - GRAM + 1) & mask).astype(np.int64)
    valid = np.ones(len(anchors) + 1, bool)
    valid[-1] = False
    for e in ends[:-1].tolist():
        valid[max(e - LENGTH + 1, 0) : e] = False
    changed = anchors[1:] != anchors[:-1]
    first = valid[:-1].copy()
    first[1:] &= changed | ~valid[:-2]
    last = valid[:-1].copy()
    last[:-1] &= changed | ~valid[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return s, e - s + 1, grams[anchors[s]], digests(block, s.tolist(), (e + LENGTH).tolist(), key)


def segments(texts: list[bytes], key: bytes = b"") -> Iterator[tuple[np.ndarray, ...]]:
    """Of the texts: index of the text, first window, windows, anchor hash, segment digest; block by block."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def scan() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(b) for _, _, b in held])
        s, runs, grams, whole = _segments_of(b"".join(b for _, _, b in held), ends, key)
        at = np.searchsorted(ends, s, "right")
        shift = np.array([base - (end - len(b)) for (_, base, b), end in zip(held, ends.tolist(), strict=True)], np.int64)
        return np.array([k for k, _, _ in held], np.int64)[at], s + shift[at], runs, grams, whole

    for k, text in enumerate(texts):
        for base in range(0, max(len(text) - LENGTH + 1, 0), BLOCK):
            part = text[base : base + BLOCK + LENGTH - 1]
            if held and size + len(part) > BLOCK:
                yield scan()
                held, size = [], 0
            held.append((k, base, part))
            size += len(part)
    if held:
        yield scan()


_SEGMENTS = "gram long, whole long, sure long, doc_id long, start int, windows int"


def _segment_rows(key: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids = some.column(0).to_numpy(zero_copy_only=False)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in some.column(1).cast(pa.large_binary())]
                for k, start, runs, grams, whole in segments(texts, key):
                    whole = whole.view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(ids[k]), pa.array(start.astype(np.int32)), pa.array(runs.astype(np.int32))],
                        names=["gram", "whole", "sure", "doc_id", "start", "windows"],
                    )

    return rows


class BlindTrie:
    """A Patricia trie over equally long strings, as whole numbers of `bits` bits; inner nodes know only the bit they test."""

    def __init__(self, bits: int):
        self.bits, self.root = bits, None

    def insert(self, key: int, owner: int) -> int:
        """owner, or the owner of an equal key that came before."""
        if self.root is None:
            self.root = (key, owner)
            return owner
        node = self.root
        while len(node) == 3:
            node = node[1 + (key >> node[0] & 1)]
        differ = key ^ node[0]
        if not differ:
            return node[1]
        bit = differ.bit_length() - 1
        parent, side, node = None, 0, self.root
        while len(node) == 3 and node[0] > bit:
            parent, side = node, 1 + (key >> node[0] & 1)
            node = node[side]
        fresh = [bit, node, (key, owner)] if key >> bit & 1 else [bit, (key, owner), node]
        if parent is None:
            self.root = fresh
        else:
            parent[side] = fresh
        return owner


def first_equal(text: bytes, group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Deep-shallow sort of the windows text[at : at + LENGTH] within their groups.

    The windows come in the order of their occurrence; returns, per window, the index of its group's first equal window.
    """
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    word = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        word |= raw[k : len(raw) - 7 + k] << np.uint64(56 - 8 * k)
    out = np.arange(len(at))
    live, tied = out, group
    for depth in range(0, SHALLOW, 8):
        if not len(live):
            return out
        w = word[at[live] + depth]
        order = np.lexsort((w, tied))
        live, tied, w = live[order], tied[order], w[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (tied[1:] != tied[:-1]) | (w[1:] != w[:-1])
        tied = np.cumsum(fresh)
        several = np.bincount(tied)[tied] > 1
        live, tied = live[several], tied[several]
    if not len(live):
        return out
    order = np.lexsort((live, tied))
    live, tied = live[order], tied[order]
    cuts = np.flatnonzero(np.r_[True, tied[1:] != tied[:-1], True]).tolist()
    where, members = at[live].tolist(), live.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        trie = BlindTrie(8 * (LENGTH - SHALLOW))
        for k in range(a, b):
            p = where[k]
            out[members[k]] = trie.insert(int.from_bytes(text[p + SHALLOW : p + LENGTH]), members[k])
    return out


_FOUND = [("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("bin", pa.int32()), ("run", pa.binary())]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FOUND, strict=True)], names=[n for n, _ in _FOUND])


def _runs(heads: list[np.ndarray], bins: int) -> pa.RecordBatch:
    """First windows, one run for each range of the hash."""
    every = np.concatenate(heads)
    of = ((every["h1"] >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    every, of = every[order], of[order]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]).tolist()
    return _found([(None, None, None, int(of[a]), every[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)])


def _sorted_windows(bins: int, key: bytes):
    """Contested segments, sorted by group: repeats within the task as spans, and of salted groups the runs of first windows."""

    def work(rows: list[tuple], heads: list[np.ndarray]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[3], r[4]))
        keys: dict[tuple, int] = {}
        group = np.array([keys.setdefault(r[:2], len(keys)) for r in rows], np.int64)
        windows = np.array([len(r[5]) - LENGTH + 1 for r in rows], np.int64)
        base = np.cumsum([0, *(len(r[5]) for r in rows)])[:-1]
        of = np.repeat(np.arange(len(rows)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        text = b"".join(r[5] for r in rows) + bytes(8)
        # Rows follow (doc_id, start) and segments of one document never overlap in windows, so windows follow their positions.
        first = first_equal(text, group[of], base[of] + within)
        again = np.flatnonzero(first != np.arange(len(first)))
        run = np.r_[True, (again[1:] != again[:-1] + 1) | (of[again[1:]] != of[again[:-1]])] if len(again) else np.zeros(0, bool)
        head = again[run]
        tail = again[np.r_[run[1:], True]] if len(again) else head
        salted = np.array([r[2] > 1 for r in rows], bool)
        own = np.flatnonzero(salted[of] & (first == np.arange(len(first))))
        if len(own):
            out = np.empty(len(own), _HEAD)
            where = base[of[own]] + within[own]
            hashes = digests(text, where.tolist(), (where + LENGTH).tolist(), key)
            out["h1"], out["h2"] = hashes[:, 0], hashes[:, 1]
            out["doc_id"] = np.array([r[3] for r in rows], np.int64)[of[own]]
            out["start"] = np.array([r[4] for r in rows], np.int64)[of[own]] + within[own]
            heads.append(out)
        return _found([(rows[of[a]][3], rows[of[a]][4] + int(within[a]), rows[of[b]][4] + int(within[b]) + LENGTH, None, None) for a, b in zip(head, tail, strict=True)])

    def sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        heads: list[np.ndarray] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 5000 and held[-1][:2] != r[:2]:
                    yield work(held, heads)
                    held = []
                    if sum(map(len, heads)) >= HEADS:
                        yield _runs(heads, bins)
                        heads = []
                held.append(r)
        if held:
            yield work(held, heads)
        if heads:
            yield _runs(heads, bins)

    return sorted_windows


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (bin, run) sorted by bin: all windows but the first of each hash, as spans."""

    def spans(runs: list[bytes]) -> pa.RecordBatch:
        every = np.frombuffer(b"".join(runs), _HEAD)
        order = np.lexsort((every["start"], every["doc_id"], every["h2"], every["h1"]))
        every = every[order]
        again = every[1:][(every["h1"][1:] == every["h1"][:-1]) & (every["h2"][1:] == every["h2"][:-1])]
        start = again["start"].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(again["doc_id"].astype(np.int64)), pa.array(start), pa.array(start + np.int32(LENGTH))], names=["doc_id", "start", "stop"])

    held, last = [], None
    for batch in batches:
        for k, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and k != last:
                yield spans(held)
                held = []
            last = k
            held.append(run)
    if held:
        yield spans(held)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (bytes) of strings that start earlier as well; spans of a document may overlap."""
    spark, key = docs.sparkSession, secrets.token_bytes(16)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    scan = texts.mapInArrow(_segment_rows(key), _SEGMENTS)
    grams = staged(scan.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("contested")), "grams")
    drop_shuffles(spark)
    shared = staged(scan.join(grams, "gram"), "segments")
    discard(grams)
    drop_shuffles(spark)
    firsts = staged(shared.groupBy("gram", "whole", "sure").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.first("windows").alias("windows"), F.first("contested").alias("contested"), F.count(F.lit(1)).alias("n")), "firsts")
    several = firsts.where("n > 1").select("gram", "whole", "sure", "at")
    copies = shared.join(several, ["gram", "whole", "sure"]).where((F.col("doc_id") != F.col("at.doc_id")) | (F.col("start") != F.col("at.start")))
    copies = staged(copies.select("doc_id", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("stop")), "copies")
    discard(shared)
    drop_shuffles(spark)

    contested = firsts.where("contested")
    salts = contested.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("salts"))
    wanted = contested.join(salts, "gram").select(
        F.col("at.doc_id").alias("doc_id"),
        F.struct("gram", "salts", F.pmod(F.hash("whole"), F.col("salts")).alias("salt"), F.col("at.start").alias("start"), "windows").alias("segment"),
    )
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list("segment").alias("segments"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                rows = [(s["gram"], s["salt"], s["salts"], doc_id, s["start"], raw[s["start"] : s["start"] + s["windows"] + LENGTH - 1]) for s in listed]
                rows = [r for r in rows if len(r[5]) >= LENGTH]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["gram", "salt", "salts", "doc_id", "start", "bytes"])

    strings = texts.join(by_doc, "doc_id").select("doc_id", "text", "segments").mapInArrow(cut, "gram long, salt int, salts int, doc_id long, start int, bytes binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = strings.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt")
    found = staged(dealt.mapInArrow(_sorted_windows(4 * parts, key), "doc_id long, start int, stop int, bin int, run binary"), "windows")
    discard(firsts)
    drop_shuffles(spark)
    local = found.where("stop IS NOT NULL").select("doc_id", "start", "stop")
    across = found.where("bin IS NOT NULL").select("bin", "run").repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(_merged, "doc_id long, start int, stop int")
    spans = staged(copies.unionByName(local).unionByName(across), "spans")
    discard(copies, found)
    drop_shuffles(spark)
    return spans


def _strip(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw, bytes removed, maximal runs removed."""
    merged: list[list[int]] = []
    for a, b in sorted((a, min(b, len(raw))) for a, b in spans):
        if b <= a:
            continue
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    edges = [0, *(x for run in merged for x in run), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(raw) - len(kept), len(merged)


def _in_order(texts: DataFrame) -> tuple[DataFrame, str]:
    """texts (doc_id, text) and a column that names each row and rises with doc_id: the id itself where ids are unique, else a
    number written down beside the rows; null ids have none."""
    if texts.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return texts, "doc_id"
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return staged(laid.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered"), "row"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with keep_bytes the remaining bytes."""
    texts, key = _in_order(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    spans = repeated_spans(texts, key, "text")
    by_doc = staged(spans.withColumnRenamed("doc_id", key).groupBy(key).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans-by-doc")
    discard(spans)
    drop_shuffles(docs.sparkSession)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                left, removed, runs = _strip(raw, [(s["start"], s["stop"]) for s in listed or ()])
                rows.append((doc_id, len(raw), removed, runs, hashlib.sha256(left).hexdigest(), *[left] * keep_bytes))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_bytes]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

    out = texts.join(by_doc, key, "left").select("doc_id", "text", "spans").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
    return out.withColumnRenamed("doc_id", id_col)
