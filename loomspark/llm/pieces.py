"""SentencePiece encoding and decoding of texts of any length, the library's ids.

For a merge vocabulary the library's result is the one segmentation in which every two neighbouring pieces are compatible:
merging their joint characters gives the two pieces again. With weight 0 for compatible neighbours and minus infinity for
others that is a best path in the max-plus semiring, and best paths compose:

1. a text is cut into chunks of CHUNK characters, at any character. The state at a cut is the piece that covers or ends at it;
   the few candidates are read off the characters around the cut. Before the first and after the last chunk there is one state;
2. each chunk, on its own, gives the matrix of best weights from its left states to its right states. Where the chunk holds a
   place that no piece crosses (a run of spaces begins, or a line feed), all paths meet there and only head and tail are scanned;
3. the matrices of a document - a few numbers a chunk - are combined in a tree, FAN children a node: products on the way up, and
   on the way down the states at the cuts between a node's children;
4. each chunk, given its two states, is traced back on its own; it owns the pieces that begin in it. Between two places that no
   piece crosses the path is the library's own result for that word, which is looked up in a bounded table.

A chunk that is a whole text has one state on either side and so a matrix of one number; it is traced back in the pass that cuts
it. Only chunks with neighbours are written down and combined.

Edge cases: null and empty texts have no ids and decode to an empty text; characters outside the vocabulary become byte
pieces; a text keeps its spaces (a literal space mark decodes to a space, as in the library); every row has a key of its own, so
rows that repeat an id, or have none, each have their own result, with the same text or another; an empty table gives an empty
result; only the id and text columns are read. Chunks have LEAST_CHUNK characters at least, so that no piece covers two cuts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import discard, small, staged
from loomspark.llm.token_counts import MARK, PRE_TOKEN

CHUNK, LONGEST = 16_384, 16
LEAST_CHUNK = 2 * LONGEST
#: Children of a node of the product tree.
FAN = 64
NEVER = -np.inf
#: Words, and parts of words, that a worker remembers, and the longest of them.
REMEMBER, REMEMBER_CHARS = 200_000, 48
#: Texts whose new words the library learns at once, and rows of a batch that goes out.
TOGETHER = 100


def marked(text: str) -> str:
    """The text as the library sees it: a mark in front, and a mark for every space."""
    return MARK + text.replace(" ", MARK) if text else ""


def is_seam(s: str, p: int) -> bool:
    """No piece has characters on both sides of position p of a marked text."""
    return s[p] == "\n" or s[p - 1] == "\n" or (s[p] == MARK and s[p - 1] != MARK)


class Scanner:
    """Compatible pieces of marked texts; one a worker."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.normal = {self.sp.id_to_piece(k): k for k in range(self.sp.get_piece_size()) if not (self.sp.is_control(k) or self.sp.is_byte(k) or self.sp.is_unknown(k))}
        self.cores: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.spelled = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(k) else p.replace(MARK, " ").encode() for k, p in ((k, self.sp.id_to_piece(k)) for k in range(self.sp.get_piece_size()))]

    def core(self, s: str) -> tuple[int, ...]:
        """The library's ids of a part of a marked text, without its own leading mark."""
        if (found := self.cores.get(s)) is None:
            if len(self.cores) > REMEMBER:
                self.cores.clear()
            found = self.cores[s] = tuple(self.sp.encode("\n" + s.replace(MARK, " "))[2:])
        return found

    def follow(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > REMEMBER:
                self.pairs.clear()
            found = self.pairs[a, b] = self.core(a + b) == self.core(a) + self.core(b)
        return found

    def ends(self, s: str, i: int) -> list[int]:
        """Where the pieces that begin at i may end; an unknown character is a piece of its own."""
        out = [j for j in range(i + 1, min(i + LONGEST, len(s)) + 1) if s[i:j] in self.normal and len(self.core(s[i:j])) == 1]
        return out or [i + 1] if i < len(s) else []

    def states(self, s: str, b: int) -> list[tuple[int, int]]:
        """Pieces (begin, end) that begin before position b and end at or after it."""
        return [(i, j) for i in range(max(b - LONGEST, 0), b) for j in self.ends(s, i) if j >= b]

    def scan(self, s: str, before: str | None, at: int, stop: int, across: bool) -> dict[tuple[int, int], tuple[int, int] | None]:
        """Pieces on paths from `at` (after the piece `before`) to the first end at or after stop, each with its predecessor."""
        came: dict[tuple[int, int], tuple[int, int] | None] = {}
        by_end: dict[int, list[tuple[int, int] | None]] = {at: [None]}
        for i in range(at, stop):
            for last in by_end.pop(i, ()):
                piece = before if last is None else s[slice(*last)]
                for j in self.ends(s, i):
                    if (j <= stop or across) and (i, j) not in came and self.follow(piece, s[i:j]):
                        came[i, j] = last
                        by_end.setdefault(j, []).append((i, j))
        return came

    def trace(self, s: str, before: str | None, at: int, last: tuple[int, int]) -> list[tuple[int, int]]:
        came, path = self.scan(s, before, at, last[0] + 1, True), []
        step: tuple[int, int] | None = last
        while step is not None:
            path.append(step)
            step = came[step]
        return path[::-1]

    def between(self, s: str, at: int, stop: int, before: str | None = None) -> list[tuple[int, int]]:
        """The path from `at` to exactly stop."""
        if at == stop:
            return []
        came = self.scan(s, before, at, stop, False)
        return self.trace(s, before, at, next(p for p in came if p[1] == stop))

    def seams(self, s: str, left: int, right: int, first: bool, last: bool) -> tuple[int, int] | None:
        """First and last place in left..right that no piece crosses; the ends of a text are such places."""
        low = left if first else next((p for p in range(max(left, 1), right) if is_seam(s, p)), right if last else None)
        if low is None:
            return None
        return low, right if last else next((p for p in range(right - 1, low, -1) if is_seam(s, p)), low)

    def matrix(self, s: str, left: int, right: int, first: bool, last: bool, lefts: list, rights: list) -> np.ndarray:
        """Best weights from the states at `left` to those at `right`."""
        out = np.full((len(lefts), len(rights)), NEVER)
        found = self.seams(s, left, right, first, last)
        if found:
            low, high = found
            tail = None if high == right else self.scan(s, None, high, right, True)
            ok = np.array([tail is None or r in tail for r in rights])
            for k, (i, j) in enumerate(lefts):
                head = self.scan(s, s[i:j] if j else None, j, low, False) if j < low else {}
                if j == low or any(e == low for _, e in head):
                    out[k, ok] = 0
            return out
        for k, (i, j) in enumerate(lefts):
            came = self.scan(s, s[i:j] if j else None, j, right, True)
            out[k, [r in came for r in rights]] = 0
        return out

    def chunk(self, s: str, left: int, right: int, first: bool, last: bool, start: tuple[int, int], stop: tuple[int, int]) -> bytes:
        """Packed ids of the pieces that begin in left..right, between the states at both ends."""
        before, at = (s[slice(*start)] if start[1] else None), start[1]
        found = self.seams(s, left, right, first, last)
        if not found:
            return self.ids(s, self.trace(s, before, at, stop))
        low, high = found
        head = self.ids(s, self.between(s, at, low, before))
        tail = b"" if high == right else self.ids(s, self.trace(s, None, high, stop))
        return head + self.of_words(PRE_TOKEN.findall(s[low:high].replace(MARK, " "))) + tail

    def ids(self, s: str, path: list[tuple[int, int]]) -> bytes:
        return np.array([x for i, j in path for x in self.core(s[i:j])], "<u4").tobytes()

    def learn(self, texts: list[str]) -> None:
        """Looks up the words of texts (with spaces for marks) together."""
        if len(self.words) > REMEMBER:
            self.words.clear()
        fresh = sorted(w for w in {w for t in texts for w in PRE_TOKEN.findall(t)}.difference(self.words) if len(w) <= REMEMBER_CHARS)
        for k in range(0, len(fresh), 2000):
            some = fresh[k : k + 2000]
            for w, ids in zip(some, self.sp.encode(["\n" + w for w in some], num_threads=1), strict=True):
                self.words[w] = np.array(ids[2:], "<u4").tobytes()

    def of_words(self, words: list[str]) -> bytes:
        known = self.words
        return b"".join([known[w] if w in known else np.array(self.sp.encode("\n" + w)[2:], "<u4").tobytes() for w in words])

    def bytes_of(self, ids: bytes) -> bytes:
        """The marked text's bytes, with spaces for marks, that packed ids stand for."""
        spelled = self.spelled
        return b"".join([spelled[k] for k in np.frombuffer(ids, "<u4").tolist()])


_SCANNERS: dict[str, Scanner] = {}


def scanner(model: str) -> Scanner:
    """One a worker, for all its tasks."""
    if model not in _SCANNERS:
        _SCANNERS[model] = Scanner(model)
    return _SCANNERS[model]


_PART = [("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("base", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("part", pa.string()), ("first", pa.bool_()), ("last", pa.bool_())]


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _ends(s: Scanner, part: str, left: int, right: int, first: bool, last: bool) -> tuple[list, list]:
    return ([(0, 0)] if first else s.states(part, left)), ([(right, right)] if last else s.states(part, right))


_NODE = "row long, node long, lefts array<long>, rights array<long>, weights array<double>"


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _steps(children: pd.DataFrame) -> tuple[list, list, list]:
    lefts, rights = ([np.array(x, np.int64).reshape(-1, 2) for x in children[c]] for c in ("lefts", "rights"))
    return lefts, rights, [np.array(w).reshape(len(a), len(b)) for w, a, b in zip(children["weights"], lefts, rights, strict=True)]


def _product(key: tuple, children: pd.DataFrame) -> pd.DataFrame:
    """The node (row, number) of its children, in order."""
    children = children.sort_values("node")
    lefts, rights, steps = _steps(children)
    total = steps[0]
    for m in steps[1:]:
        total = _times(total, m)
    return pd.DataFrame({"row": [key[0]], "node": [key[1]], "lefts": [lefts[0].ravel()], "rights": [rights[-1].ravel()], "weights": [total.ravel()]})


def _states(children: pd.DataFrame, start: tuple | None, stop: tuple | None) -> pd.DataFrame:
    """The states of a node's children on a best path between the node's own (of a root: any)."""
    children = children.sort_values("node")
    lefts, rights, steps = _steps(children)
    allowed = lambda states, want: np.where([want is None or tuple(x) == want for x in states.tolist()], 0.0, NEVER)
    after = [allowed(rights[-1], stop)[:, None]]
    for m in reversed(steps):
        after.append(_times(m, after[-1]))
    after.reverse()
    at = int((allowed(lefts[0], start) + after[0][:, 0]).argmax())
    out = []
    for k, m in enumerate(steps):
        then = int((m[at] + after[k + 1][:, 0]).argmax())
        out.append((*lefts[k][at], *rights[k][then]))
        at = then
    l1, l2, r1, r2 = np.array(out, np.int64).T
    return pd.DataFrame({"row": children["row"].to_numpy(), "node": children["node"].to_numpy(), "l1": l1, "l2": l2, "r1": r1, "r2": r2})


def combined(matrices: DataFrame) -> DataFrame:
    """row, node, l1, l2, r1, r2: the states of every chunk; matrices (row, node, lefts, rights, weights) are the tree's leaves."""
    chosen = "row long, node long, l1 long, l2 long, r1 long, r2 long"
    spread = max(int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    levels = [matrices]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) >= FAN:
        levels.append(staged(levels[-1].withColumn("parent", F.floor(F.col("node") / FAN)).repartition(spread, "row", "parent").groupBy("row", "parent").applyInPandas(_product, _NODE), "products"))
    out = levels[-1].repartition(spread, "row").groupBy("row").applyInPandas(lambda top: _states(top, None, None), chosen)
    for level in reversed(levels[:-1]):
        above = out

        def down(key: tuple, children: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
            p = parents.iloc[0]
            return _states(children, (p["l1"], p["l2"]), (p["r1"], p["r2"]))

        out = level.groupBy("row", F.floor(F.col("node") / FAN).alias("parent")).cogroup(above.groupBy("row", "node")).applyInPandas(down, chosen)
    return out


_ENCODED = [("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("ids", pa.binary()), ("n_bytes", pa.int64()), ("source_crc32", pa.int64())]
_ENCODED_SCHEMA = "row long, doc_id long, chunk int, ids binary, n_bytes long, source_crc32 long"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """row (a key of the input row), doc_id, chunk, ids (packed 32-bit numbers), n_bytes and source_crc32 of the characters the chunk's pieces cover."""
    return _encoded(docs, model, id_col, text_col, chunk, lambda batches: batches, _ENCODED_SCHEMA)


def _encoded(docs: DataFrame, model: str, id_col: str, text_col: str, chunk: int, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `then` makes of the encoded batches, in the worker that encodes them."""
    if chunk < LEAST_CHUNK:
        raise ValueError(f"chunks need {LEAST_CHUNK} characters")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def told(s: Scanner, r: dict, start: tuple[int, int], stop: tuple[int, int]) -> tuple:
        part = r["part"].replace(" ", MARK)
        ids = s.chunk(part, r["left"], r["right"], r["first"], r["last"], start, stop)
        own = slice(start[1], stop[1])
        n_bytes = len(r["part"][own].encode()) - (len(MARK.encode()) if r["first"] and r["part"] else 0)
        return (r["row"], r["doc_id"], r["chunk"], ids, n_bytes, zlib.crc32(part[own].replace(MARK, " ").encode()))

    def cut(whole: bool):
        """Chunks of texts; whole ones are traced back here, others given as parts."""

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = ((TaskContext.get().partitionId() << 32) << 1) + (not whole)
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    some, rows = batch.slice(at, TOGETHER), []
                    found = some.column(1).to_pylist()
                    if whole:
                        s = scanner(model)
                        s.learn([" " + t.replace(MARK, " ") for t in found if t])
                    for doc_id, text in zip(some.column(0).to_pylist(), found, strict=True):
                        key += 2
                        marked_text = MARK + text if text else ""
                        for n, b in enumerate(range(0, max(len(marked_text), 1), chunk)):
                            low, end = max(b - 2 * LONGEST, 0), min(b + chunk, len(marked_text))
                            rows.append((key, doc_id, n, low, b - low, end - low, marked_text[low : end + 2 * LONGEST], b == 0, end == len(marked_text)))
                    if whole:
                        named = (dict(zip((n for n, _ in _PART), r, strict=True)) for r in rows)
                        yield _rows([told(s, r, (0, 0), (r["right"], r["right"])) for r in named], _ENCODED)
                    else:
                        yield _rows(rows, _PART)

        return chunks

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(model)
        out = [("row", pa.int64()), ("node", pa.int64()), ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                part = r["part"].replace(" ", MARK)
                lefts, rights = _ends(s, part, r["left"], r["right"], r["first"], r["last"])
                m = s.matrix(part, r["left"], r["right"], r["first"], r["last"], lefts, rights)
                shift = lambda xs, base: [v + base for x in xs for v in x]
                rows.append((r["row"], r["chunk"], shift(lefts, r["base"]), shift(rights, r["base"]), m.ravel().tolist()))
            yield _rows(rows, out)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(model)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                listed = batch.slice(at, TOGETHER).to_pylist()
                s.learn([r["part"].replace(MARK, " ") for r in listed])
                rows = []
                for r in listed:
                    start = (0, 0) if r["first"] else (r["l1"] - r["base"], r["l2"] - r["base"])
                    rows.append(told(s, r, start, (r["r1"] - r["base"], r["r2"] - r["base"])))
                yield _rows(rows, _ENCODED)

    giant = F.length("text") >= chunk
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = texts.where(giant).mapInArrow(cut(False), "row long, doc_id long, chunk int, base int, left int, right int, part string, first boolean, last boolean")
    parts = staged(cuts.repartition(spread, "row", "chunk"), "parts")
    matrices = staged(parts.mapInArrow(transfer, _NODE), "matrices")
    states = small(staged(combined(matrices), "states"))
    discard(matrices)
    long_texts = parts.join(states.withColumnRenamed("node", "chunk").withColumn("chunk", F.col("chunk").cast("int")), ["row", "chunk"]).mapInArrow(lambda batches: then(trace(batches)), schema)
    whole = cut(True)
    return texts.where(~giant).mapInArrow(lambda batches: then(whole(batches)), schema).unionByName(long_texts)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (chunk, ids and more) with `spelled`, the bytes its pieces stand for; the first chunk keeps the mark in front."""
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.bytes_of(b) for b in batch.column(names.index("ids")).to_pylist()], pa.binary())], names=[*names, "spelled"])

    return encoded.mapInArrow(spell, schema + ", spelled binary")


def decoded_texts(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every input row."""
    parts = decode(encoded, model).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", F.hex("spelled").alias("h")))).alias("parts"))
    whole = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8")
    return parts.select("doc_id", F.substr(whole, F.lit(2)).alias("text"))


def encoding_report(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per input row: bytes, chunks, tokens, a sum of ids weighted by their places, and whether decoding gives the text again."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("weighted", pa.int64()), ("same", pa.bool_())]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(model)
        for batch in batches:
            rows = []
            for row, doc_id, k, ids, n_bytes, crc in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "chunk", "ids", "n_bytes", "source_crc32")), strict=True):
                x = np.frombuffer(ids, "<u4").astype(np.int64)
                rows.append((row, doc_id, k, n_bytes, len(x), int(x.sum()), int((x * np.arange(1, len(x) + 1)).sum()), zlib.crc32(s.bytes_of(ids)) == crc))
            yield _rows(rows, fields)

    told = _encoded(docs, model, id_col, text_col, chunk, digest, "row long, doc_id long, chunk int, n_bytes long, n long, total long, weighted long, same boolean")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        told.withColumn("before", before)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias(id_col),
            F.sum("n_bytes").alias("n_bytes"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.sum("n").alias("n_tokens"),
            F.sum(F.col("weighted") + F.col("before") * F.col("total")).alias("ids_sum"),
            F.bool_and("same").alias("round_trip"),
        )
        .drop("row")
    )
