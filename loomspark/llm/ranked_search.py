"""Ranked lexical search by sort-based accumulation.

The items are a stated query set and go through in blocks of bounded text; all documents meet every block:

1. one pass cuts each text into terms at byte level and keeps what the block's vocabulary holds: packed arrays of term numbers
   and frequencies, some hundred documents to a row. Each task adds up its documents, terms and document frequencies, so one
   row a task carries the statistics;
2. with the statistics of all documents known, each task concatenates the (item, document, impact) arrays its postings give,
   radix-sorts the packed keys and sums equal ones by `reduceat`. Whole documents lie in a row, so sums are final. A heap for each
   item keeps its best, a vector comparison with the heap's least passes over the rest;
3. what tasks kept is range-partitioned by item and ranked.

What moves is the postings of the items' terms, once, to the shared folder, and `most` rows an item from each task. A frequent
term, a hot source or a group of copies makes a row's arrays longer, never a task's share of the rows.

Edge cases: a null or empty text has no terms, is not counted and never ranks; ties are ordered by doc_id, null ids last; rows
that repeat an id are documents of their own; rows of items that repeat an id, or have none, are items of their own with ranks
of their own; items without terms give no rows; an empty table on either side gives an empty result; texts of any length are
read whole, a megabyte at a time; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import staged
from loomspark.llm.token_counts import from_planes, planes

MOST = 20
#: Bytes of item texts in a block; they and their numbers are what every task is sent.
BLOCK_BYTES = 4_000_000
#: Documents and postings of a packed row, and entries accumulated at once.
ROW_DOCS, ROW_POSTINGS, ENTRIES = 500, 60_000, 1_000_000
#: A-Z in lower case; ASCII's controls and signs are spaces; bytes of other characters stay.
FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
PIECE = 1 << 20


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, list by list."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        folded = raw[at:end].translate(FOLD)
        if end < len(raw):
            cut = folded.rfind(b" ")
            if cut < 0:  # a term of a megabyte: as far as it goes
                while end < len(raw) and FOLD[raw[end]] != 32:
                    end += 1
                folded = raw[at:end].translate(FOLD)
            else:
                end, folded = at + cut + 1, folded[:cut]
        yield folded.split()
        at = end


class Block:
    """Items of a block: their ids, the vocabulary, and for each term its items and how often they hold it."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        self.ids, self.number = [i for i, _ in rows], {}
        listed: list[list[tuple[int, int]]] = []
        for k, (_, text) in enumerate(rows):
            for term, n in sorted(sum((Counter(some) for some in terms(text or b"")), Counter()).items()):
                if (t := self.number.setdefault(term, len(listed))) == len(listed):
                    listed.append([])
                listed[t].append((k, n))
        self.held = np.array([len(x) for x in listed], np.int64)
        self.first = np.cumsum(self.held) - self.held
        self.items, self.times = (np.array([p[j] for x in listed for p in x], np.int64) for j in (0, 1))


_PACKED = pa.schema([("docs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("terms", pa.binary()), ("uses", pa.binary()), ("df", pa.list_(pa.int64()))])
_PACKED_DDL = "docs array<long>, n array<long>, held array<int>, terms binary, uses binary, df array<long>"


def _postings(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Packed rows, then one with the task's statistics: `n` holds documents and terms, `df` documents by term."""
    df, n_docs, n_terms = np.zeros(len(number), np.int64), 0, 0
    docs, ns, held, at, uses = [], [], [], [], []

    def row() -> pa.RecordBatch:
        packed = [[docs], [ns], [held], [planes(np.array(at, np.int64))], [planes(np.array(uses, np.int64))], [None]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(packed, _PACKED.types, strict=True)], schema=_PACKED)

    for batch in batches:
        for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
            n, found = 0, Counter()
            for some in terms(raw.as_py() or b""):
                n += len(some)
                found.update([number[w] for w in some if w in number])
            if not n:
                continue
            n_docs, n_terms = n_docs + 1, n_terms + n
            if not found:
                continue
            docs.append(doc_id.as_py())
            ns.append(n)
            held.append(len(found))
            at += found.keys()
            uses += found.values()
            if len(docs) >= ROW_DOCS or len(at) >= ROW_POSTINGS:
                df += np.bincount(at, minlength=len(df))
                yield row()
                docs, ns, held, at, uses = [], [], [], [], []
    if docs:
        df += np.bincount(at, minlength=len(df))
        yield row()
    if n_docs:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, [n_docs, n_terms], None, None, None, df.tolist()), _PACKED.types, strict=True)], schema=_PACKED)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative 64-bit keys, by digits of 16 bits (which numpy sorts by radix), lowest first."""
    order, top = np.arange(len(keys)), int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of impacts by (item, document), in that order."""
    keys = items * n_docs + docs
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts] // n_docs, keys[starts] % n_docs, np.add.reduceat(impacts[order], starts) if len(starts) else impacts


class Best:
    """The `most` highest (score, smallest id) of each item seen so far."""

    def __init__(self, n_items: int, most: int):
        self.heaps, self.least, self.most = [[] for _ in range(n_items)], np.ones(n_items, np.int64), most

    def add(self, items: np.ndarray, ids: list[int | None], docs: np.ndarray, scores: np.ndarray) -> None:
        """Rows come by item."""
        good = np.flatnonzero(scores >= self.least[items])
        if not len(good):
            return
        items, docs, scores = items[good], docs[good], scores[good]
        starts = np.flatnonzero(np.diff(items, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(items)], strict=True):
            item, own, of = int(items[a]), scores[a:b], docs[a:b]
            if len(own) > 4 * self.most:
                high = own >= np.partition(own, -self.most)[-self.most]
                own, of = own[high], of[high]
            heap = self.heaps[item]
            for score, doc in zip(own.tolist(), of.tolist(), strict=True):
                entry = (score, -(1 << 63) if ids[doc] is None else -ids[doc])
                if len(heap) < self.most:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.most:
                self.least[item] = heap[0][0]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(k, None if minus == -(1 << 63) else -minus, score) for k, heap in enumerate(self.heaps) for score, minus in sorted(heap)]


def _scores(batches: Iterator[pa.RecordBatch], block: Block, weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(block.ids), most)
    for batch in batches:
        for docs, ns, held, packed, packed_uses in zip(*(batch.column(c) for c in ("docs", "n", "held", "terms", "uses")), strict=True):
            ids, at, uses = docs.as_py(), from_planes(packed.as_py()).astype(np.int64), from_planes(packed_uses.as_py()).astype(np.int64)
            damp = np.array([12 * (75 + 25 * n * n_docs // n_terms) for n in ns.as_py()], np.int64)
            of = np.repeat(np.arange(len(ids)), held.values.to_numpy(zero_copy_only=False))
            impact = weights[at] * ((1_000_000_000 * uses) // (1000 * uses + damp[of]))
            # Postings of whole documents, a bounded number of entries at a time.
            made = np.add.reduceat(block.held[at], np.flatnonzero(np.diff(of, prepend=-1)))
            group = np.cumsum(made) // ENTRIES
            for g in np.unique(group):
                some = np.flatnonzero((group == g)[of])
                n_items = block.held[at[some]]
                which = np.repeat(some, n_items)
                entry = np.arange(len(which)) - np.repeat(np.cumsum(n_items) - n_items, n_items) + block.first[at[which]]
                items, found, scores = accumulate(block.items[entry], of[which], impact[which] * block.times[entry], len(ids))
                best.add(items, ids, found, scores)
    rows = best.rows()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])


def _ranked_block(docs: DataFrame, block: Block, most: int) -> DataFrame:
    spark, number = docs.sparkSession, block.number
    found = staged(docs.mapInArrow(lambda batches: _postings(batches, number), _PACKED_DDL), "postings")
    told = found.where("df IS NOT NULL")
    total = told.agg(F.sum(F.col("n")[0]).alias("docs"), F.sum(F.col("n")[1]).alias("terms")).head()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    weights = np.zeros(len(number), np.int64)
    for term, df in told.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col")).collect():  # the block's vocabulary at most
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    scored = found.where("df IS NULL").mapInArrow(lambda batches: _scores(batches, block, weights, n_docs, n_terms, most), "item int, doc_id long, score long")
    kept = staged(scored, "best")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    order = "PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST"
    ranked = kept.repartitionByRange(parts, "item").selectExpr("item", f"CAST(row_number() OVER ({order}) AS INT) AS rank", "doc_id", "score").where(F.col("rank") <= most)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, most: int = MOST, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `most` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    if blocks > 1:
        asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = None
    for k in range(blocks):
        rows = (asked.where(F.col("block") == k) if blocks > 1 else asked).select("item_id", "text").collect()
        part = _ranked_block(texts, Block([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0))]), most)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
