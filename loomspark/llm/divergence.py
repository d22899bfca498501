"""Source divergence audit: how far the word use of each source of a language lies from the other sources and from the whole.

Plain relations, no Python:

1. a text is split between its terms, and these are exploded twice over, once with repeats and once distinct within the text,
   so that one grouping by (lang, source, term) counts occurrences and documents together, combined on the map side;
2. a language keeps the terms of `least` documents or more; one row for each kept term, numbered, holds its counts by source;
3. the groups of a language (a few numbers each, broadcast behind a count) cross its kept vocabulary, which makes absent counts
   zeros, and every count a smoothed share;
4. the dense table meets itself on the term's number. Each two sources meet once a term, which gives their divergence both ways,
   and the sums are by numbers of groups. The kept terms are dealt before they are crossed, so neither the crossing nor the
   self-join moves dense rows, and what is sorted and grouped there are numbers only;
5. windows rank pairs of sources, and terms within a source; the latter come from the counts above zero alone.

A common term costs one row for each source, however many documents hold it, and a hot source one row for each of its terms,
so no key is hot after the first grouping.

All arithmetic is in 64-bit integers and exact: shares by long division in three steps of a thousand, which holds for languages
of up to 9e15 term occurrences; divergences because a share is at most 1e9 + 1.

Edge cases: null text, lang and source count as ''; every row is a document, so rows that repeat an id count each; a group
without terms has uniform shares; a language without kept terms gives value 0 for each pair of its sources and no terms; an
empty table gives an empty result; only the three columns are read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import small, staged, text_or_empty

#: What lies between terms: ASCII's controls, digits and signs. Terms are runs of everything else, letters of any script.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 3, 200


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def terms(text: Column) -> Column:
    """The terms of a text in order, with an empty one before and after where it begins or ends with something else.

    Splitting the texts of check_s on six local threads took 2.2 s, extracting all their matches 22.0 s."""
    return F.split(lower_ascii(text), BETWEEN, -1)


def share(count: Column, total: Column) -> Column:
    """floor(1e9 * count / total), exact in 64 bits while total < 9e15 and count <= total: long division by steps of 1000."""
    div = lambda a, b: F.call_function("div", a, b)
    step = F.lit(1000).cast("long")
    one, two = div(count * step, total), (count * step) % total
    three = (two * step) % total
    return one * 1_000_000 + div(two * step, total) * 1000 + div(three * step, total)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    words = docs.select("lang", "source", terms(F.col("text")).alias("words"))
    arms = F.array(
        F.struct(F.lit(1).alias("n"), F.lit(0).alias("docs"), F.col("words")),
        F.struct(F.lit(0).alias("n"), F.lit(1).alias("docs"), F.array_distinct("words").alias("words")),
    )
    each = words.select("lang", "source", F.explode(arms).alias("arm")).select("lang", "source", "arm.n", "arm.docs", F.explode("arm.words").alias("term"))
    return each.where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's text."""
    read = docs.select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    held = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    kept = term_counts(read).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), held.alias("held")).where(F.col("docs") >= least)
    kept = staged(kept.select(F.monotonically_increasing_id().alias("t"), "lang", "term", "n", "held"), "kept_terms")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("v"))
    used = kept.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = read.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {"n_group": 0, "n_lang": 0, "v": 0}
    groups = groups.fillna(zero).select(F.monotonically_increasing_id().alias("g"), "lang", "source", *[F.col(c).cast("long").alias(c) for c in zero])
    groups = staged(groups, "groups")
    few = small(groups)

    dealt = kept.select("t", "lang", "held").repartition("t")
    count = F.coalesce(F.col("held")[F.col("source")], F.lit(0))
    mine = dealt.join(few, "lang").select("t", "g", (1 + share(count + 1, F.col("n_group") + F.col("v"))).alias("p"))
    other = mine.select("t", F.col("g").alias("h"), F.col("p").alias("q"))
    sums = mine.join(other, "t").where("g < h").groupBy("g", "h")
    sums = sums.agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("there"), F.sum(divergence(F.col("q"), F.col("p"))).alias("back"))
    ways = F.array(F.struct("g", "h", F.col("there").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    sums = sums.select(F.inline(ways))
    names = groups.select("g", "lang", "source")
    pairs = names.join(names.select(F.col("g").alias("h"), "lang", F.col("source").alias("item")), "lang").where("g <> h").join(sums, ["g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    # Every count above 0 is in a kept term's map, so the terms' part needs no zeros.
    there = kept.select("lang", "term", "n", F.explode("held").alias("source", "count")).join(few, ["lang", "source"])
    p, q = 1 + share(F.col("count") + 1, F.col("n_group") + F.col("v")), 1 + share(F.col("n") + 1, F.col("n_lang") + F.col("v"))
    more = there.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    over = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pairs).unionByName(ranked(over).where(F.col("rank") <= top)).withColumn("rank", F.col("rank").cast("int"))
