"""Greedy segments of ordered rows, in parallel: next-cut pointers from prefix sums, composed by doubling.

Whether a segment ends at a row depends on where it began, so the textbook loop runs over a group from its first row. Here every
row gets the pointer to where the segment after it would begin if one began at it; following pointers from a group's first row
gives the cuts.

1. Rows are laid out by range of (group, order), so that a hot group spans many tasks; running sums within a task and the tasks'
   totals give positions and prefix sums.
2. A group's rows fall into blocks of bounded length. A segment reaches a bounded way into the next block, whose first rows are
   handed to both, so pointers are found within a block.
3. For groups of several blocks each row that a segment may hand on to knows where its block is left; these exits, a few for
   each block, are composed by doubling until the entry of every block is known.
4. From its entry each block marks its cuts, again by doubling over arrays of all groups in a batch.

Only numbers travel; a task holds one block at a time, plus its share of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import discard, staged

#: A block's length as a multiple of how far a segment can reach.
BLOCK = 64


def _laid_out(rows: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """rows with __gid (a number for the group), __idx (from 0) and __s (sizes before)."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    laid = staged(sorted_.withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id(), "__size": F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")}), "laid")
    key = F.struct(*group)
    told = laid.groupBy(key.alias("__g"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("s"), F.min("__n").alias("first"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = told.select(
        "__g", "__p", F.min("first").over(Window.partitionBy("__g")).alias("__gid"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__s0")
    )
    own = Window.partitionBy("__g", "__part").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumn("__g", key).withColumns({"__i": F.count(F.lit(1)).over(own), "__r": F.coalesce(F.sum("__size").over(own), F.lit(0))})
    met = local.join(offsets.withColumnRenamed("__p", "__part"), ["__g", "__part"])
    return met.withColumns({"__idx": F.col("__n0") + F.col("__i"), "__s": F.col("__s0") + F.col("__r")}).drop("__g", "__part", "__n0", "__i", "__s0", "__r", "__n")


class Rule:
    """Where the segment that begins at a row ends: with the row that brings it to `target`, or before the one that would take it
    over `chars` or `most` rows."""

    def __init__(self, target: int | None = None, most: int | None = None, chars: int | None = None):
        self.target, self.most, self.chars = target, most, chars
        # Length is counted as size + 1 a row, so that empty rows have some; where sizes are positive, twice the target.
        self.reach = max(1, 2 * target if target is not None else chars + most) + 1
        self.block = BLOCK * self.reach

    def following(self, first: np.ndarray, last: np.ndarray, s: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each row the place of the next segment's first row, `last` (its group's end) at most. s and end are the sizes before
        and through each row, made to rise from group to group."""
        if self.target is not None:
            return np.minimum(np.searchsorted(end, s + self.target) + 1, last)
        at = np.arange(len(s))
        return np.minimum(np.maximum(np.minimum(np.searchsorted(end, s + self.chars, "right"), at + self.most), at + 1), last)


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches as arrays, cut where the last run of equal keys ends; null is -1."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.fill_null(-1).to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        cut = int(np.flatnonzero((held[0] == held[0][-1]) & (held[key] == held[key][-1]))[0])
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _pointers(rule: Rule, gid: np.ndarray, block: np.ndarray, idx: np.ndarray, s: np.ndarray, size: np.ndarray):
    """first and last place of each row's run of (gid, block), and the next cut's place."""
    starts = np.flatnonzero(np.r_[True, (np.diff(gid) != 0) | (np.diff(block) != 0)])
    counts = np.diff(np.r_[starts, len(gid)])
    first, last = np.repeat(starts, counts), np.repeat(starts + counts, counts)
    # Each run's sums begin far above the one before.
    span = s[starts + counts - 1] + size[starts + counts - 1] - s[starts] + 3 * rule.reach
    base = np.repeat(np.cumsum(span) - span - s[starts], counts)
    return first, last, rule.following(first, last, s + base, s + size + base)


_NARROW = ["gid", "b", "own", "idx", "s", "size"]


def _exits(rule: Rule):
    """For a block's first row and the rows near its beginning, the row at which a chain through them leaves the block; where the
    group ends first that is a number no row has."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, b, own, idx, s, size in _runs(batches, 1):
            first, last, to = _pointers(rule, gid, b, idx, s, size)
            mine, here = own.astype(bool), np.arange(len(gid))
            in_run = np.minimum(to, last - 1)
            jump = np.where((to < last) & mine[in_run], to, here)  # a chain's last row of the block stays where it is
            while True:
                more = jump[jump]
                if (more == jump).all():
                    break
                jump = more
            # What follows is a row of the run that the next block owns, or the row after the run, if there is one.
            out = np.where(to[jump] < last[jump], idx[in_run[jump]], idx[last[jump] - 1] + 1)
            new = np.r_[True, (np.diff(gid) != 0) | (np.diff(b) != 0)]
            near = mine & ((s + idx - b * rule.block < rule.reach) | new)
            yield pa.RecordBatch.from_arrays([pa.array(x[near].astype(np.int64)) for x in (gid, b, idx, out)], names=["gid", "b", "idx", "exit"])

    return exits


def _marks(rule: Rule):
    """For each row how many cuts its block has up to it; for the block's first row also how many it has in all."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, b, own, idx, s, size, entry in _runs(batches, 1):
            first, last, to = _pointers(rule, gid, b, idx, s, size)
            end = len(gid)
            cut, jump = np.zeros(end + 1, bool), np.r_[np.where(to == last, end, to), end]
            cut[:end] = idx == entry
            while True:
                more = jump[np.flatnonzero(cut)]
                if cut[more].all():
                    break
                cut[more] = True
                jump = jump[jump]
            cut[end] = False
            mine = own.astype(bool)
            ranks = np.cumsum(cut[:end] & mine)
            local = ranks - (ranks[first] - (cut[:end] & mine)[first])
            yield pa.RecordBatch.from_arrays([pa.array(x[mine].astype(np.int64)) for x in (gid, b, idx, local)], names=["gid", "b", "idx", "local"])

    return marks


def greedy_segments(rows: DataFrame, group: list[str], order: list[str], size: str, target: int | None = None, most: int | None = None, chars: int | None = None) -> DataFrame:
    """rows with `segment` (long, from 0 within the group).

    With `target` a segment ends with the row that brings its sizes to target or more (sizes have to be positive); with `most`
    and `chars` it ends before the row that would take it over either, and a row over `chars` is one of its own. Null sizes
    count as 0; rows that tie in the order stand in any order, but in one; null groups are groups.
    """
    rule = Rule(target, most, chars)
    laid = staged(_laid_out(rows, group, order, size), "placed")
    base = laid.select(F.col("__gid").alias("gid"), F.col("__idx").alias("idx"), F.col("__s").alias("s"), F.col("__size").alias("size"))
    block = F.floor((F.col("s") + F.col("idx")) / rule.block).cast("long")
    at = F.when((F.col("b0") > 0) & (F.col("s") + F.col("idx") - F.col("b0") * rule.block < rule.reach), F.array("b0", F.col("b0") - 1)).otherwise(F.array("b0"))
    dealt = base.withColumn("b0", block).withColumn("b", F.explode(at)).select("gid", "b", (F.col("b") == F.col("b0")).cast("int").alias("own"), "idx", "s", "size")
    sizes = base.withColumn("b", block).groupBy("gid").agg(F.max("b").alias("top")).where("top > 0")
    top = sizes.agg(F.max("top")).head()[0] or 0
    entries = None
    if top:
        several = dealt.join(sizes.select("gid"), "gid", "left_semi").repartition("gid", "b").sortWithinPartitions("gid", "b", "idx").select(*_NARROW)
        exits = staged(several.mapInArrow(_exits(rule), "gid long, b long, idx long, exit long"), "exits")
        reached, jump = staged(exits.where("idx = 0").select("gid", "idx"), "reached"), exits.select("gid", "idx", "exit")
        for turn in range(int(top).bit_length()):
            more = reached.join(jump, ["gid", "idx"]).select("gid", F.col("exit").alias("idx"))
            then = jump.select("gid", F.col("idx").alias("exit"), F.col("exit").alias("then"))
            old, olds = reached, jump
            reached = staged(reached.unionByName(more).distinct(), "reached")
            jump = staged(jump.join(then, ["gid", "exit"]).select("gid", "idx", F.col("then").alias("exit")), "jump")
            discard(old, *([olds] if turn else []))
        entries = exits.join(reached, ["gid", "idx"], "left_semi").select("gid", "b", F.col("idx").alias("entry"))
    asked = dealt if entries is None else dealt.join(entries, ["gid", "b"], "left")
    entry = F.lit(0).cast("long") if entries is None else F.coalesce("entry", F.when(F.col("b") == 0, 0).otherwise(-2)).cast("long")
    marked = asked.withColumn("entry", entry).repartition("gid", "b").sortWithinPartitions("gid", "b", "idx").select(*_NARROW, "entry")
    local = staged(marked.mapInArrow(_marks(rule), "gid long, b long, idx long, local long"), "cuts")
    if top:
        before = Window.partitionBy("gid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counts = local.groupBy("gid", "b").agg(F.max("local").alias("n")).select("gid", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cuts"))
        local = local.join(counts, ["gid", "b"]).select("gid", "idx", (F.col("local") + F.col("cuts")).alias("local"))
    numbered = local.select(F.col("gid").alias("__gid"), F.col("idx").alias("__idx"), (F.col("local") - 1).alias("segment"))
    return laid.join(numbered, ["__gid", "__idx"]).select(*[c for c in rows.columns], "segment")
