"""Tokenizing and bulk-synchronous best-fit packing.

Documents become pieces of at most `capacity` tokens. Packing runs in supersteps over classes of lengths, longest first
(capacity/2 to capacity, capacity/3 to capacity/2, ...). All pieces of a class seek the best gap at once:

1. gaps and pieces are range-sorted together by size, descending. A gap that surely holds several pieces of the class offers
   as many slots;
2. each task sweeps its range and hands every piece its successor, the smallest slot left that is long enough. Pieces that want
   the same slot are told apart by rank: the first takes it, the next takes the next larger one, which is what a stack of slots
   gives;
3. pieces that found no slot in their range take the slots left over in the ranges before, nearest first. How many each range
   has left over and lacks - two numbers a partition - decides that; pieces and slots then meet in a join by range and rank;
4. what is left opens new sequences, as many pieces to each as surely fit. Gaps shrink by what they took, and the next class
   follows.

The number of supersteps is that of the classes, whatever the input. Nothing but two numbers a partition and one a class
reaches the driver.

Edge cases: a null or empty text is one piece that holds the end id alone; ties in length are ordered by id and piece; rows that
repeat an id, or have none, are packed each; an empty table gives an empty result; a text of any length is tokenized whole and
only cut at multiples of the capacity; only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import discard, drop_shuffles, staged

CAPACITY, END_ID = 4096, 1
#: Distinct words whose ids a worker remembers at once, and bytes of text that it looks up at once.
REMEMBER, AT_ONCE = 1_000_000, 4 << 20
#: Gaps and pieces that a task sweeps at least, where there are so many.
SWEPT_ROWS = 5000
#: Pieces of class k surely fit k times into an empty sequence.
SHARES = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64, 256, 4096)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Punctuation that ends a run of letters; apostrophes begin contractions, and <|> may belong to a special token.
_ENDS = b".,;:!?%&$#*+-/=@^_()[]\"\\`"
_APART = b"\x01"
#: Words of Latin letters up to U+024F, without U+0130, whose small letter is two characters.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: Texts whose capitals are left as they are: special tokens and combining marks may be in them.
_AS_IT_IS = r"<\||[\x{300}-\x{37f}]"

#: White space is 1, punctuation that ends letters 2; all of it comes before the small letters.
_KINDS = np.array([1 if x in b" \t\n\v\f\r" else 2 if x in _ENDS else 0 for x in range(97)], np.uint8)
_LETTER = np.array([bytes([x]).isalpha() for x in range(256)])
#: Second bytes of letters by first byte, for those that _PLAIN knows.
_LETTER_2 = np.array([[bool(_PLAIN.fullmatch(bytes((a, b)))) and a > 127 for b in range(256)] for a in range(256)])


#: The character that stands for each byte in a byte-level vocabulary, as UTF-16; a space stays one.
_SHOWN = np.arange(256, dtype="<u2")
_SHOWN[[*range(33), *range(127, 161), 173]] = range(256, 324)
_SHOWN[32] = 32


class WordIds:
    """Ids of texts, word by word: this tokenizer drops white space, so no token and no normalisation crosses it.

    Punctuation after a letter begins a token, so words are cut there too where normalisation leaves the letter one letter (a-z
    and Latin letters up to U+024F, U+0130 excepted). ASCII capitals are folded before where that cannot matter: not beside
    combining marks, and not where a special token's text might come about. A batch's words are told apart as Arrow dictionary
    entries, each distinct one is looked up once, and ids are laid out by number.

    Words that are not known yet are encoded together, in one text. For those of Latin letters alone normalisation is their small
    letters and each is one pre-token, so the library encodes them with white space as the only rule, and a token that closes a
    word ends each. Others go through the whole of the tokenizer, with a character between them that is a token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode, self.known = Tokenizer.from_file(path).encode, {}
        (self.apart,) = self.encode(_APART.decode(), add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        rules |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.plain = Tokenizer.from_str(json.dumps(rules))
        vocab, suffix = rules["model"]["vocab"], rules["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[k for token, k in vocab.items() if token.endswith(suffix)]] = True

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        for w, a, b in zip(words, [0, *(c + 4 * gap for c in cuts)], [*cuts, len(raw)], strict=False):
            self.known[w] = raw[a:b]

    def _learn(self, words: list[bytes]) -> None:
        plain, others = [], []
        for w in words:
            if w.isalpha() or _PLAIN.fullmatch(w):
                plain.append(w)
            elif _APART in w or b"<|" in w:
                self.known[w] = self._ids(w).tobytes()
            else:
                others.append(w)
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            small = np.frombuffer(b" ".join(some).decode().lower().encode(), np.uint8)
            (found,) = self.plain.encode_batch_fast([_SHOWN[small].tobytes().decode("utf-16-le")], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("words and closing tokens differ in number")
            self._keep(some, ids, ends, 0)
        for k in range(0, len(others), 512):
            some = others[k : k + 512]
            ids = self._ids((b" " + _APART + b" ").join(some))
            ends = np.flatnonzero(ids == self.apart)
            if len(ends) != len(some) - 1:
                raise ValueError("words and tokens between them differ in number")
            self._keep(some, ids, ends, 1)

    @staticmethod
    def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and the number of the first word of each text, with the number of all at the end."""
        small = pc.ascii_lower(texts)
        at = np.frombuffer(small.buffers()[1], np.int32)[small.offset : small.offset + len(small) + 1]
        data, at = np.frombuffer(small.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]
        as_it_is = np.flatnonzero(pc.match_substring_regex(texts, _AS_IT_IS).to_numpy(zero_copy_only=False)).tolist()
        if as_it_is:
            data = data.copy()
            for k in as_it_is:
                data[at[k] : at[k + 1]] = np.frombuffer(texts[k].as_buffer(), np.uint8)
        apart = np.flatnonzero(data < 97)
        kinds = _KINDS[data[apart]]
        blank, ends = apart[kinds == 1], apart[(kinds == 2) & (apart > 0)]
        first = np.zeros(len(data) + 1, bool)
        first[blank + 1] = True
        first[at] = True
        before = data[ends - 1]
        first[ends[_LETTER[before] | _LETTER_2[data[ends - 2], before]]] = True
        solid = np.ones(len(data), bool)
        solid[blank] = False
        offsets, kept = np.flatnonzero(first[:-1][solid]), data[solid]
        words = pa.Array.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(kept)).astype(np.int32)), pa.py_buffer(kept)])
        return words, np.searchsorted(offsets, at - np.searchsorted(blank, at))

    def packed(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text of a column of strings without nulls; what is new in all of them is learned at once."""
        words, firsts = self._words(texts)
        coded = words.dictionary_encode()
        listed, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if len(known) > REMEMBER:
            known.clear()
        found = [known.get(w) for w in listed]
        fresh = [k for k, ids in enumerate(found) if ids is None]
        self._learn([listed[k] for k in fresh])
        for k in fresh:
            found[k] = known[listed[k]] if len(listed[k]) <= 64 else known.pop(listed[k])
        out = pa.array(found, pa.large_binary()).take(coded.indices)
        ids = memoryview(out.buffers()[2] or b"")
        at = np.frombuffer(out.buffers()[1], np.int64)[out.offset :][firsts].tolist() if len(out) else [0] * len(firsts)
        return (bytes(ids[a:b]) for a, b in zip(at, at[1:], strict=False))

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        return list(self.packed(pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()))) if texts else []

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


_WORD_IDS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and with keep_ids the ids themselves as packed 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORD_IDS:  # one a worker, for all its tasks
            _WORD_IDS[tokenizer] = WordIds(tokenizer)
        ids_of, end = _WORD_IDS[tokenizer], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, texts = [], batch.column(1).cast(pa.string()).fill_null("")
            # Some megabytes of text at a time, or one longer text.
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(upto // AT_ONCE)) + 1).tolist(), batch.num_rows]
            for first, end_row in zip(cuts, cuts[1:], strict=False):
                some = batch.column(0).slice(first, end_row - first)
                for doc_id, found in zip(some.to_pylist(), ids_of.packed(texts.slice(first, end_row - first)), strict=True):
                    ids = found + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def resolve(tallies: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, tuple[int, int]], int]:
    """Which partitions' left-over slots go to which partitions' unplaced pieces; tallies are (partition, unplaced, left over) in
    the order of the sweep.

    Returns runs (pieces' partition, first piece, how many, slots' partition, first slot, counted downwards); by partition the
    first piece that no slot is left for, with its rank among all such; and the number of those.
    """
    slots: list[list[int]] = []
    runs, rest, total = [], {}, 0
    for part, lacking, left in tallies:
        at = 0
        while at < lacking and slots:
            n = min(slots[-1][1], lacking - at)
            runs.append((part, at, n, slots[-1][0], slots[-1][1] - 1))
            at += n
            slots[-1][1] -= n
            if not slots[-1][1]:
                slots.pop()
        rest[part] = (at, total)
        total += lacking - at
        if left:
            slots.append([part, left])
    return runs, rest, total


_PLACED, _LEFT, _LACKING = 0, 1, 2


def _sweep(names: list[str]):
    """Rows (the pieces' columns, seq, slots) come by size, descending; slots of gaps before pieces of the same size."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, lacking = TaskContext.get().partitionId(), [], 0
        types = None
        for batch in batches:
            types = types or [c.type for c in batch.columns[: len(names)]]
            keep, seqs, state, idx = [], [], [], []
            for i, (seq, slots) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if seq is not None:
                    stack.append([seq, slots])
                    continue
                keep.append(i)
                if stack:
                    top = stack[-1]
                    top[1] -= 1
                    if not top[1]:
                        stack.pop()
                    seqs.append(top[0])
                    state.append(_PLACED)
                    idx.append(None)
                else:
                    seqs.append(None)
                    state.append(_LACKING)
                    idx.append(lacking)
                    lacking += 1
            if keep:
                some = [c.take(pa.array(keep)) for c in batch.columns[: len(names)]]
                yield _swept(names, some, seqs, state, part, idx, [None] * len(keep))
        for k in range(0, len(stack), 10_000):
            if not k:
                below = 0
            some = stack[k : k + 10_000]
            counts = [n for _, n in some]
            firsts = [below + x for x in np.cumsum([0, *counts[:-1]]).tolist()]
            below += sum(counts)
            yield _swept(names, [pa.nulls(len(some), t) for t in types], [q for q, _ in some], [_LEFT] * len(some), part, firsts, counts)

    return sweep


def _swept(names: list[str], columns: list, seqs: list, state: list, part: int, idx: list, slots: list) -> pa.RecordBatch:
    more = [pa.array(seqs, pa.int64()), pa.array(state, pa.int32()), pa.array([part] * len(state), pa.int32()), pa.array(idx, pa.int64()), pa.array(slots, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "seq", "state", "part", "idx", "slots"])


def _superstep(waiting: DataFrame, used: DataFrame | None, capacity: int, share: int, least: int, opened: int, parts: int) -> tuple[DataFrame, int]:
    """Places all pieces of one class, lengths of more than `least` and at most capacity // share.

    used: seq and tokens in it. Returns the pieces with their seq, and how many sequences are open then.
    """
    names, most = waiting.columns, capacity // share
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema)
    rows = waiting.withColumns({"seq": F.lit(None).cast("long"), "slots": F.lit(0).cast("long"), "size": F.col("length").cast("long"), "gap": F.lit(0).cast("long")})
    if used is not None:
        gaps = used.select("seq", (capacity - F.col("used")).alias("gap")).where(F.col("gap") > least)
        slots = F.greatest(F.floor(F.col("gap") / most), F.lit(1)).cast("long")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in waiting.schema]
        rows = gaps.select(*nothing, "seq", slots.alias("slots"), F.least("gap", F.lit(most)).cast("long").alias("size"), "gap").unionByName(rows)
    order = [F.desc("size"), F.col("seq").isNull(), F.desc("gap"), "seq", "doc_id", "piece"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*names, "seq", "slots")
    swept = staged(dealt.mapInArrow(_sweep(names), schema + ", seq long, state int, part int, idx long, slots long"), "swept")
    told = swept.where(F.col("state") != _PLACED).groupBy("part").agg(F.count_if(F.col("state") == _LACKING).alias("lacking"), F.coalesce(F.sum("slots"), F.lit(0)).alias("left"))
    runs, rest, total = resolve(sorted((r["part"], r["lacking"], r["left"]) for r in told.collect()))
    by_piece: dict[int, list] = {}
    by_slot: dict[int, list] = {}
    for part, first, n, other, top in runs:
        by_piece.setdefault(part, []).append((first, n, other, top))
        by_slot.setdefault(other, []).append((top - n + 1, top))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unplaced pieces with the place of their slot, or with a new sequence."""
        for batch in batches:
            seqs, parts_of, slots_of = [], [], []
            for part, idx in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                first, rank = rest[part]
                hit = None if idx >= first else next((other, top - (idx - at)) for at, n, other, top in by_piece[part] if at <= idx < at + n)
                seqs.append(None if hit else opened + (rank + idx - first) // share)
                parts_of.append(hit and hit[0])
                slots_of.append(hit and hit[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seqs, pa.int64()), pa.array(parts_of, pa.int32()), pa.array(slots_of, pa.int64())], names=[*names, "seq", "of", "slot"])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The left-over slots that runs ask for."""
        for batch in batches:
            out = []
            for seq, part, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low, high in by_slot.get(part, ()):
                    out += [(part, k, seq) for k in range(max(low, first), min(high, first + n - 1) + 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["of", "slot", "found"])

    done = swept.where(F.col("state") == _PLACED).select(*names, "seq")
    sought = swept.where(F.col("state") == _LACKING).select(*names, "part", "idx").mapInArrow(seek, schema + ", seq long, of int, slot long")
    if runs:
        offered = swept.where(F.col("state") == _LEFT).select("seq", "part", "idx", "slots").mapInArrow(offer, "of int, slot long, found long")
        sought = sought.join(offered, ["of", "slot"], "left").withColumn("seq", F.coalesce("seq", "found"))
    placed = staged(done.unionByName(sought.select(*names, "seq")), "placed")
    discard(swept)
    return placed, opened + -(-total // share)


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length and more) with sequence_id and offset; pieces is read once a class, so it should be staged."""
    spark = pieces.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [k for k in SHARES if k <= capacity]
    bounds = [(k, capacity // m if m else 0) for k, m in zip(shares, [*shares[1:], None], strict=True)]
    held = F.array(*[F.lit(least) for _, least in bounds])
    counts = dict(pieces.groupBy(F.size(F.filter(held, lambda x: x >= F.col("length"))).alias("nth")).count().collect())
    used, opened, placed = None, 0, []
    for nth in sorted(counts):
        (share, least), tasks = bounds[nth], min(parts, -(-(counts[nth] + opened) // SWEPT_ROWS))
        waiting = pieces.where((F.col("length") > least) & (F.col("length") <= capacity // share))
        done, opened = _superstep(waiting, used, capacity, share, least, opened, tasks)
        placed.append(done)
        if nth < len(bounds) - 1:
            more = done.select("seq", F.col("length").cast("long").alias("used"))
            fresh = (more if used is None else used.unionByName(more)).groupBy("seq").agg(F.sum("used").alias("used")).where(F.col("used") < capacity)
            fresh, before = staged(fresh, "used"), used
            if before is not None:
                discard(before)
            used = fresh
        drop_shuffles(spark)
    every = pieces.where(F.lit(False)).withColumn("seq", F.lit(None).cast("long"))
    for done in placed:
        every = done if done is placed[0] else every.unionByName(done)
    in_sequence = Window.partitionBy("seq").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long")
    return every.withColumn("offset", offset).select(*pieces.columns, F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces and their places."""
    return best_fit_pack(staged(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
