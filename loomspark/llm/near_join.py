"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share of their union, and the components they form.

Exact, in layers that each leave less to the next:

1. documents with equal shingle sets fold into one representative (a link of similarity one);
2. a representative is listed under the rarest of its shingles only - so many that two sets above the threshold must share
   one of them. Rarity comes from one count table of fixed size (COUNTERS numbers, so it can be broadcast at any scale), which
   puts passages that a large part of the corpus shares last in every list. A pair is decided where its first common shingle
   is; what stands before it in either list is not shared, so a pair whose places leave too little is passed over;
3. representatives listed under one shingle are first compared with the least of them (a star, never all pairs); what is
   linked needs no second look inside its component;
4. of shingles with the same members the first is kept. Pairs of different components that still share a shingle meet in
   size-banded tiles: members of a size band are hashed into tiles of about TILE members, and only tiles of the same or the
   next band meet. Hashed bitmap signatures, eight bits an element up to MAX_BITS, bound the overlap from above by bit counts
   before a pair is let through;
5. pairs that pass are decided on the sorted shingle arrays themselves.

A shingle is known by a 64-bit hash of its words. Sizes and overlaps are whole numbers, so the threshold is exact.

Edge cases: null and empty texts, and texts of white space, have an empty set and link with nothing, not even with each other;
texts with fewer words than a shingle have one shingle, the whole sequence; texts are read whole; repeated rows are copies of
each other; rows with a null id get a null component; an empty table gives an empty result; other columns are ignored. An id
should name one text: rows that repeat it with another text keep their own n_shingles, and a link of either may join both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, drop_shuffles, keyed, small, staged
from loomspark.llm.components import connected_components

WORDS, PERCENT = 4, 85
COUNTERS, CHUNK = 1 << 20, 1 << 14
MIN_BITS, MAX_BITS = 256, 4096
TILE = 512
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_known = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z folded, words divided by ASCII white space."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed + h[k : len(h) - n + 1 + k]) * _MULT[k % len(_MULT)]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(_mix(mixed))


def signature(s: np.ndarray) -> bytes:
    """A bitmap of hashed elements; its width, a power of two, grows with the set. Both halves of a bitmap laid over each other
    are the bitmap of half the width."""
    width = min(max(1 << (8 * len(s) - 1).bit_length(), MIN_BITS), MAX_BITS)
    bits = np.zeros(width, np.uint8)
    bits[((s >> np.uint64(40)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, all of the least width among them."""
    sizes = {len(b) for b in signatures}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)
    words = min(sizes) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), 0) for b in signatures])


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection i of sets of n and m with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def own_overlap(n: int, percent: int = PERCENT) -> int:
    """What any partner has to share with a set of n: the least partner that passes has ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _scan(words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One card a document, and at the end the count table of all shingles of the task."""
        table = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), words)
                np.add.at(table, (s & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
                with np.errstate(over="ignore"):
                    two = [int(_mix(s * m).sum(dtype=np.uint64)) if len(s) else 0 for m in _MULT[:2]]
                rows.append((doc_id, len(s), *(x - (1 << 64) if x >> 63 else x for x in two), None, None))
            yield _batch(rows, _CARD)
        rows = [(None, None, None, None, k // CHUNK, zlib.compress(table[k : k + CHUNK].tobytes(), 1)) for k in range(0, COUNTERS, CHUNK) if table[k : k + CHUNK].any()]
        yield _batch(rows, _CARD)

    return scan


_CARD = [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _pairs(ends: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(ends, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _count_table(cards: DataFrame) -> np.ndarray:
    """Occurrences of shingles by the low bits of their hash; COUNTERS numbers whatever the input."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint64)
        for batch in batches:
            for c in batch.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(c), np.uint32)
        yield _batch([(key[0].as_py(), np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes())], [("chunk", pa.int32()), ("counts", pa.binary())])

    table = np.zeros(COUNTERS, np.uint32)
    for r in cards.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint32)
    return table


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = staged(texts.mapInArrow(_scan(words), "doc_id long, n long, s1 long, s2 long, chunk int, counts binary"), "cards")
    cards = scanned.where("chunk IS NULL").select("doc_id", "n", "s1", "s2")
    rarity = spark.sparkContext.broadcast(_count_table(scanned))
    sets = cards.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), words)
                if len(s):
                    common = table[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    take = len(s) - own_overlap(len(s), percent) + 1
                    rows.append((doc_id, s[np.lexsort((s, common))[:take]].view(np.int64), len(s), signature(s)))
            yield _batch(rows, [("rep", pa.int64()), ("keys", pa.list_(pa.int64())), ("n", pa.int32()), ("bits", pa.binary())])

    prefixes = texts.where("doc_id IS NOT NULL").mapInArrow(listed, "rep long, keys array<long>, n int, bits binary").join(sets.select("rep"), "rep")
    prefixes = staged(prefixes, "prefixes")
    drop_shuffles(spark)
    under = prefixes.select("rep", "n", F.posexplode("keys").alias("pos", "key"))
    centres = under.groupBy("key").agg(F.min(F.struct("rep", "n", "pos")).alias("c"), F.max("rep").alias("top")).where("c.rep <> top").select("key", "c")
    shared = staged(under.join(centres, "key").select("key", "rep", "n", "pos", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.pos").alias("centre_pos")), "shared")
    drop_shuffles(spark)

    bits = staged(prefixes.select("rep", "n", "bits").join(shared.select("rep").distinct(), "rep"), "bits")
    discard(prefixes)
    star = shared.where((F.col("rep") != F.col("centre")) & _fits("n", "pos", "centre_n", "centre_pos", percent)).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    star = staged(within_bound(star, bits, percent), "star")
    links = staged(verified(star, arrays_of(texts, star, words), percent), "links")
    drop_shuffles(spark)
    label = connected_components(links)

    # Of two under a shingle the star is the only pair; from three on the others may link without their centre.
    named = shared.select("key", "rep", "n", "pos").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", "pos", F.coalesce("component", "rep").alias("label"), _band(F.col("n"), percent).alias("band"))
    named = staged(named, "named")
    discard(shared)
    members = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(0x7FFFFFFF)).alias("y")]
    open_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("rep", "pos")).alias("first"), F.collect_set("band").alias("bands"), *members).where("lo <> hi AND m > 2")
    # Members agree on the order of their keys, so the least place of one of them is the first for all.
    kept = open_keys.groupBy("m", "x", "y", "first.rep").agg(F.min(F.struct("first.pos", "key", "bands")).alias("least")).select("least.key", "least.bands")
    rest = staged(pairs_in_tiles(named.join(kept, "key"), bits.select("rep", "bits"), percent), "rest")
    drop_shuffles(spark)
    rest = staged(rest.join(star, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = staged(verified(rest, arrays_of(texts, rest, words), percent), "links")
        drop_shuffles(spark)
        label = connected_components(links.unionByName(more))
    component = sets.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    linked = cards.where("n > 0 AND doc_id IS NOT NULL").join(component, ["n", "s1", "s2"]).select("doc_id", "n", "component_id")
    alone = cards.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, all columns as they were: the row with the least id.

    Rows without a shingle stay. Where ids repeat or are null, rows are told apart by a number of their own, and the one with
    the least number stays.
    """
    rows, key = keyed(docs, id_col)
    classes = near_classes(rows, key, text_col, words, percent)
    gone = classes.where(F.col("component_id") != F.col(key)).select(F.col(key).alias("__gone"))
    return rows.join(gone, rows[key] == gone["__gone"], "left_anti").select(*docs.columns)


def arrays_of(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """rep and its sorted shingle array, for the ends of pairs (a, b)."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, shingles(text.as_py(), words).tobytes()) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield _batch(rows, [("rep", pa.int64()), ("items", pa.binary())])

    ends = small(staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends"))
    return staged(texts.join(ends, "doc_id").select("doc_id", "text").mapInArrow(arrays, "rep long, items binary"), "sets")


def within_bound(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures (rep, n, bits) allow the overlap."""
    left, right = (bits.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                keep = pa.array([bool(_may(p, q, *folded([x, y])[:, None], percent)[0]) for p, q, x, y in zip(n, m, batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(bound, "a long, b long")


def _fits(n: str, pos: str, m: str, other: str, percent: int) -> Column:
    """Two sets of n and m elements can reach the threshold if their first common element is at these places of their orders."""
    most = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other)).cast("long")
    return most * (100 + percent) >= (F.col(n).cast("long") + F.col(m)) * percent


def _may(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Each differing bit stands for an element that only one of the sets has, so the symmetric difference is at least the bits
    that differ, and the overlap at most half of what is left of the sizes."""
    most = (np.int64(n) + m - np.bitwise_count(x ^ y).sum(-1).astype(np.int64)) // 2
    return most * (100 + percent) >= percent * (n + m)


def _band(n: Column, percent: int) -> Column:
    """Sizes whose ratio reaches percent are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("int")


def pairs_in_tiles(rows: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a < b) of rows (key, rep, n, pos, label, band, bands of the key) that share a key but no label and whose places
    and signatures allow the overlap.

    Only bands that need several tiles have a row in a table, one for TILE members or more.
    """
    banded = staged(rows, "banded")
    wide = small(staged(banded.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("tiles > 1"), "wide"))
    placed = banded
    for name, off in (("tiles", 0), ("above", 1), ("below", -1)):
        placed = placed.join(wide.select("key", (F.col("band") - off).alias("band"), F.col("tiles").alias(name)), ["key", "band"], "left").withColumn(name, F.coalesce(name, F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.hash("rep"), F.col("tiles")))
    own = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.col("band").alias("band"), F.least(t, F.col("tile")).alias("t1"), F.greatest(t, F.col("tile")).alias("t2"), F.lit(0).alias("side")))
    side = lambda band, tiles, low: F.transform(F.sequence(F.lit(0), F.col(tiles) - 1), lambda t: F.struct(band.alias("band"), (F.col("tile") if low else t).alias("t1"), (t if low else F.col("tile")).alias("t2"), F.lit(1 if low else 2).alias("side")))
    none = F.array().cast("array<struct<band:int,t1:int,t2:int,side:int>>")
    there = lambda off, cells: F.when(F.array_contains("bands", F.col("band") + off), cells).otherwise(none)
    cells = F.concat(own, there(1, side(F.col("band"), "above", True)), there(-1, side(F.col("band") - 1, "below", False)))
    dealt = placed.select("key", "rep", "n", "pos", "label", F.explode(cells).alias("cell")).select("key", "cell.band", "cell.t1", "cell.t2", (F.col("cell.side") > 0).alias("cross"), "cell.side", "rep", "n", "pos", "label")
    keys = ["key", "cross", "band", "t1", "t2"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    names = ["key", "band", "t1", "t2", "cross"]

    def cells_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [table.column(c).to_numpy() for c in names]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        cuts = np.flatnonzero(np.r_[new, True])
        rep, n, pos, label, side = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "pos", "label", "side"))
        left = n - pos
        sig = table.column("bits").to_pylist()
        ends: list[np.ndarray] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2 or (label[lo:hi] == label[lo]).all():
                continue
            x = folded(sig[lo:hi])
            for i in range(lo, hi - 1):
                js = np.arange(i + 1, hi)
                able = np.minimum(left[js], left[i]) * (100 + percent) >= percent * (n[js] + n[i])
                js = js[able & (label[js] != label[i]) & (rep[js] != rep[i]) & ((side[js] != side[i]) | (side[i] == 0))]
                if len(js):
                    js = js[_may(n[js], n[i], x[js - lo], x[i - lo], percent)]
                if len(js):
                    ends.append(np.stack([np.minimum(rep[js], rep[i]), np.maximum(rep[js], rep[i])]))
                if len(ends) >= 10_000:
                    yield _pairs(ends)
                    ends = []
        if ends:
            yield _pairs(ends)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; whole cells are held, about 20,000 rows at a time, and a cell never spans more than two tiles."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > 20_000:
                table = pa.Table.from_batches(held)
                cols = [table.column(c).to_numpy() for c in names]
                last = np.flatnonzero(np.any([c[:-1] != c[1:] for c in cols], axis=0))
                if len(last):
                    held = table.slice(int(last[-1]) + 1).to_batches()
                    yield from cells_of(table.slice(0, int(last[-1]) + 1))
        if held:
            yield from cells_of(pa.Table.from_batches(held))

    sorted_cells = dealt.join(bits, "rep").repartition(parts, *keys).sortWithinPartitions(*names, "side")
    return sorted_cells.mapInArrow(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by intersection of the sorted arrays."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("right"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(decide, "a long, b long")
