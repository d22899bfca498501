"""Curating what retrieval and extraction found: candidate pairs, quotas, floors, scopes, outlines, citations, aliases."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomspark.functions.text import nfkc
from loomspark.operators.graph import EDGE_PAIRS, SYMMETRIC, components, personalized_rank, ranking_graph

# Pairs of words that make two assumptions opposite.
OPPOSITES = (("with", "without"), ("long", "short"), ("small", "large"), ("ideal", "nonideal"), ("考虑", "不考虑"), ("小信号", "大信号"), ("理想", "非理想"))
# A name with a part in brackets, and an abbreviation.
BRACKETED, ABBREVIATION = r"^(.*\S)\s*\(([^)]+)\)\s*$", r"^(?=.*[A-Za-z])[A-Za-z0-9]{3,8}$"


def spread_sample(objects: DataFrame, run: str, most: int) -> DataFrame:
    """`most` objects (id, section), taken in turn from the sections, in each by the hash of run and id."""
    turn = F.row_number().over(Window.partitionBy("section").orderBy("__h"))
    hashed = objects.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(run), F.col("id").cast("string")), 256))
    return hashed.withColumn("__turn", turn).orderBy("__turn", "section").limit(most).drop("__turn", "__h")


def completion_candidates(objects: DataFrame, members: DataFrame, relations: DataFrame, run: str, most_objects: int, most_pairs: int, quota: int = 0) -> DataFrame:
    """Directed pairs that may lack a relation: source, target, score, allowed (edge types), best first.

    objects (id, object_type, name, section) are sampled section by section (the operator's bound). A pair needs evidence on
    both sides and no element in common (members: id, element_id); its score is the number of words its names share, which is
    also how pairs are found. Edge types that the contract forbids or that exist already are taken out. With a quota, no
    section's sources fill more than that many places.
    """
    backed = objects.join(members.select("id").distinct(), "id", "left_semi")
    sample = F.broadcast(spread_sample(backed, run, most_objects))  # most_objects rows at most
    words = sample.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    shared = words.select(F.col("id").alias("source"), "w").join(words.select(F.col("id").alias("target"), "w"), "w").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("score"))
    held = members.join(sample.select("id"), "id", "left_semi").distinct()
    met = held.select(F.col("id").alias("source"), "element_id").join(held.select(F.col("id").alias("target"), "element_id"), "element_id").select("source", "target").distinct()
    apart = shared.join(met, ["source", "target"], "left_anti")
    typed = apart.join(sample.select(F.col("id").alias("source"), F.col("object_type").alias("st"), "section"), "source").join(sample.select(F.col("id").alias("target"), F.col("object_type").alias("tt")), "target")
    contract = objects.sparkSession.createDataFrame([(e, a, b) for e, pairs in EDGE_PAIRS.items() for a, b in pairs], "edge_type string, st string, tt string")
    ends = lambda s, t: (F.when(F.col("edge_type").isin(*SYMMETRIC), F.least(s, t)).otherwise(F.col(s)).alias("e1"), F.when(F.col("edge_type").isin(*SYMMETRIC), F.greatest(s, t)).otherwise(F.col(t)).alias("e2"))
    there = relations.select("edge_type", *ends("src", "dst")).distinct()
    open_ = typed.join(F.broadcast(contract), ["st", "tt"]).select("source", "target", "score", "section", "edge_type", *ends("source", "target")).join(there, ["edge_type", "e1", "e2"], "left_anti")
    pairs = open_.groupBy("source", "target", "section", "score").agg(F.array_sort(F.collect_list("edge_type")).alias("allowed"))
    order = [F.desc("score"), F.sha2(F.concat_ws(":", F.lit(run), F.col("source").cast("string"), F.col("target").cast("string")), 256)]
    if quota:
        pairs = pairs.withColumn("__place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).where(F.col("__place") <= quota)
    return pairs.orderBy(*order).limit(most_pairs).select("source", "target", "section", "score", "allowed")


def library_page(rows: DataFrame, libraries: DataFrame, page: int, size: int, kept: int = 80) -> DataFrame:
    """One page over several libraries: every library that takes part (libraries: library, ready; one row each) has the same
    number of places, the first ones one more where the size leaves a rest; rows are (library, rank from 0, ...)."""
    ready = libraries.where("ready").select("library")
    n = F.count(F.lit(1)).over(Window.partitionBy())  # over libraries, not rows
    at = F.row_number().over(Window.orderBy("library")) - 1
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("n")).cast("int"))
    sized = ready.select("library", n.alias("n"), at.alias("at")).withColumn("q", quota)
    sized = sized.select("library", (F.col("q") + (F.col("at") < F.greatest(F.lit(0), size - F.col("q") * F.col("n"))).cast("int")).alias("quota"))
    return rows.join(sized, "library").where((F.col("rank") >= page * F.col("quota")) & (F.col("rank") < F.least((page + 1) * F.col("quota"), F.lit(kept)))).drop("quota")


def aliases(named: DataFrame, latin: int = 4, other: int = 3) -> DataFrame:
    """(id, alias) of names (id, name): the whole name, or its two parts if one is in brackets. An abbreviation beside its full
    name is kept at any length, other aliases from `latin` ASCII characters or `other` characters on; numbers are none."""
    n = named.select("id", F.trim(nfkc(F.coalesce("name", F.lit("")))).alias("n"))
    parts = n.select("id", "n", F.trim(F.regexp_extract("n", BRACKETED, 1)).alias("head"), F.trim(F.regexp_extract("n", BRACKETED, 2)).alias("inner"))
    short = lambda c: F.col(c).rlike(ABBREVIATION)
    item = lambda c, exempt: F.struct(F.lower(c).alias("alias"), exempt.alias("exempt"))
    two = F.when(short("head") & ~short("inner"), F.array(item("head", F.lit(True)), item("inner", F.lit(False)))).otherwise(F.array(item("head", F.lit(False)), item("inner", short("inner"))))
    found = parts.select("id", F.explode(F.when(F.col("head") == "", F.array(item("n", F.lit(False)))).otherwise(two)).alias("a")).select("id", "a.*")
    long_enough = F.length("alias") >= F.when(F.col("alias").rlike(r"^[\x00-\x7f]+$"), latin).otherwise(other)
    return found.where((F.col("exempt") | long_enough) & ~F.col("alias").rlike(r"^\p{Nd}*$")).select("id", "alias").distinct()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by longest matching blocks; null texts count as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def with_floor(selected: DataFrame, pool: DataFrame, floor: int) -> DataFrame:
    """selected (q, place, id, local, text, extra) with at least `floor` distinct local texts, as far as pool (q, id, local,
    text, relevance) has them: others give way, extras first, then from the end. A text fills one seat, the places stay."""
    held = selected.where("local").select("q", "text").distinct()
    fresh = pool.where("local").join(held, ["q", "text"], "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("q", "text").orderBy(F.desc("relevance"), "id"))).where("__n = 1")
    spare = first.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("relevance"), "id"))).select("q", "k", F.col("id").alias("new_id"))
    seats = held.groupBy("q").agg(F.count(F.lit(1)).alias("seats"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.col("extra").desc(), F.desc("place")))
    leaving = selected.where("NOT local").withColumn("k", order).join(seats, "q", "left").where(F.col("k") <= floor - F.coalesce("seats", F.lit(0)))
    swap = leaving.join(spare, ["q", "k"]).select("q", "place", "new_id")
    return selected.join(swap, ["q", "place"], "left").select("q", "place", F.coalesce("new_id", "id").alias("id"))


def source_rank(relations: DataFrame, sources: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """Ranking over the relations that the sources (source_id) own and that no review has rejected."""
    owned = relations.where(F.col("status").isin("pending", "verified")).join(sources, "source_id", "left_semi")
    return personalized_rank(ranking_graph(owned), seeds, rounds=rounds)


def spliced(base: DataFrame, delta: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) of base and of delta once its ends are the canonical ones (id, canonical), each once."""
    to = lambda end: canonical.select(F.col("id").alias(end), F.col("canonical").alias(f"c_{end}"))
    mapped = delta.join(to("src"), "src", "left").join(to("dst"), "dst", "left").select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"), "edge_type")
    return base.select("src", "dst", "edge_type").unionByName(mapped).where("src <> dst").distinct()


def checked_partitions(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, n_edges) of edges as the manifest (source_id, n_edges) declares them; a missing, surplus or short source, or an
    edge without an end, stops the job."""
    counted = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("src").isNull() | F.col("dst").isNull(), 1)).alias("open"))
    both = counted.join(manifest.withColumnRenamed("n_edges", "declared"), "source_id", "full")
    wrong = ~F.coalesce((F.col("n") == F.col("declared")) & (F.col("open") == 0), F.lit(False))
    told = F.raise_error(F.concat(F.lit("partition of source "), F.coalesce(F.col("source_id").cast("string"), F.lit("null")), F.lit(" is not as declared"))).cast("bigint")
    return both.select("source_id", F.when(wrong, told).otherwise(F.col("n")).alias("n_edges"))


def adjacency_blocks(edges: DataFrame, block: int = 1000) -> DataFrame:
    """Undirected neighbours of every node in sorted blocks of bounded size: id, degree, block, neighbours."""
    both = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()
    placed = both.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("id").orderBy("other")) - 1) / block))
    degree = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return placed.groupBy("id", "block").agg(F.array_sort(F.collect_list("other")).alias("neighbours")).join(degree, "id")


def without_keys(text: Column, dead: Column) -> Column:
    """text with the keys in `dead` taken out of its [k1, k2] markers; an emptied marker goes with the white space before it, and
    a marker that names none of them stays as it is."""
    marker = r"\s*\[k\d+(?:\s*,\s*k\d+)*\]"
    found, between = F.regexp_extract_all(text, F.lit(marker), F.lit(0)), F.split(text, marker, -1)

    def pruned(m: Column) -> Column:
        names = F.regexp_extract_all(m, F.lit(r"k\d+"), F.lit(0))
        left = F.filter(names, lambda k: ~F.array_contains(dead, k))
        return F.when(F.size(left) == F.size(names), m).when(F.size(left) == 0, "").otherwise(F.concat(F.regexp_extract(m, r"^(\s*)", 1), F.lit("["), F.array_join(left, ", "), F.lit("]")))

    return F.array_join(F.zip_with(between, F.transform(found, pruned), lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def without_dangling(texts: DataFrame, live: DataFrame) -> DataFrame:
    """texts (id, text) without the citation keys that are not live (key): id, text, n_dead. A null text stays null."""
    cited = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"k\d+"), F.lit(0)))).alias("key"))
    gone = cited.join(live.select("key").distinct(), "key", "left_anti").groupBy("id").agg(F.collect_set("key").alias("dead"))
    dead = F.coalesce("dead", F.array().cast("array<string>"))
    return texts.join(gone, "id", "left").select("id", without_keys(F.col("text"), dead).alias("text"), F.size(dead).alias("n_dead"))


def outline_order(sections: DataFrame) -> DataFrame:
    """Sections (outline, id, parent, pos, bound) in document order: roots as submitted, each followed by its children as
    submitted. Sections without evidence (bound false) are listed with no place; children of such count as roots."""
    kept = sections.where("bound")
    roots = kept.select("outline", F.col("id").alias("parent"), F.col("pos").alias("root_pos"))
    held = kept.join(roots, ["outline", "parent"], "left").withColumn("root_pos", F.when(F.col("parent") != F.col("id"), F.col("root_pos")))
    place = F.row_number().over(Window.partitionBy("outline").orderBy(F.coalesce("root_pos", "pos"), F.col("root_pos").isNotNull(), "pos"))
    ordered = held.select("outline", "id", place.alias("place"), F.when(F.col("root_pos").isNotNull(), F.col("parent")).alias("parent"))
    skipped = sections.where("NOT bound").select("outline", "id", F.lit(None).cast("int").alias("place"), F.lit(None).cast(sections.schema["parent"].dataType).alias("parent"))
    return ordered.unionByName(skipped)


def attributed(jobs: DataFrame) -> DataFrame:
    """(job_id, notebook) of jobs (job_id, payload JSON with a list `notebooks`), each once; unreadable payloads give none."""
    listed = F.from_json("payload", "notebooks array<string>")["notebooks"]
    return jobs.select("job_id", F.explode(F.array_distinct(listed)).alias("notebook")).where("notebook <> ''")


def merged_scopes(scopes: DataFrame) -> DataFrame:
    """One scope a chain from its scopes (chain, pos, region, assumptions, approximation, span), chains in conflict left out.

    Capitals do not count. Regions are those all scopes that name any have in common, and there must be one; approximation and
    span must agree where given; assumptions are joined in order of first appearance, and no two may be opposite.
    """
    low = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.lower(x), "-", " ")))
    row = F.struct("pos", low("region").alias("region"), low("assumptions").alias("assumptions"), F.lower("approximation").alias("approximation"), F.lower("span").alias("span"))
    g = scopes.groupBy("chain").agg(F.array_sort(F.collect_list(row)).alias("s"))  # a chain has a few scopes
    named = F.filter(F.transform("s", lambda x: x["region"]), lambda r: F.size(r) > 0)
    common = F.aggregate(named, F.array_distinct(F.flatten(named)), lambda a, r: F.array_intersect(a, r))
    one = lambda c: F.array_distinct(F.filter(F.transform("s", lambda x: x[c]), lambda v: v.isNotNull() & (v != "")))
    m = g.select("chain", common.alias("region"), F.size(named).alias("n"), F.array_distinct(F.flatten(F.transform("s", lambda x: x["assumptions"]))).alias("assumptions"), one("approximation").alias("a"), one("span").alias("p"))

    def opposite(p: str, q: str) -> Column:
        other = lambda x: F.regexp_replace(x, rf"\b{p}\b" if p.isascii() else f"(?<![不非]){p}", q)
        return F.transform("assumptions", lambda x: F.when(other(x) != x, other(x)))

    flipped = F.flatten(F.array(*[opposite(p, q) for p, q in OPPOSITES]))
    fits = ((F.col("n") == 0) | (F.size("region") > 0)) & (F.size("a") <= 1) & (F.size("p") <= 1) & ~F.coalesce(F.arrays_overlap("assumptions", F.filter(flipped, lambda x: x.isNotNull())), F.lit(False))
    return m.where(fits).select("chain", "region", "assumptions", F.get("a", F.lit(0)).alias("approximation"), F.get("p", F.lit(0)).alias("span"))


def clustered(objects: DataFrame, confirmed: DataFrame, rejected: DataFrame, prefix: str = "K-") -> DataFrame:
    """(id, cluster, display) of objects (id, name, seed): equal seeds are one cluster, and so are seeds that confirmed pairs
    (a, b) link; rejected pairs undo confirmed ones, pairs of one seed say nothing. The least id lends its name."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    seeds = objects.select("seed").distinct()
    links = pair(confirmed).join(pair(rejected), ["a", "b"], "left_anti").join(seeds.withColumnRenamed("seed", "a"), "a", "left_semi").join(seeds.withColumnRenamed("seed", "b"), "b", "left_semi")
    rooted = objects.join(components(links).withColumnRenamed("id", "seed"), "seed", "left").withColumn("root", F.coalesce("component", "seed"))
    display = rooted.groupBy("root").agg(F.min_by("name", "id").alias("display"))
    return rooted.join(display, "root").select("id", F.concat(F.lit(prefix), F.left(F.sha2("root", 256), F.lit(16))).alias("cluster"), "display")


def extract_seconds(chars: Column, window: int, at_once: int, p50: float, overhead: float) -> tuple[Column, Column]:
    """Windows of a text of so many characters, and the seconds they take when `at_once` run side by side."""
    n = F.ceil(chars / window)
    return n, F.round(F.ceil(n / max(1, at_once)) * p50 + overhead, 2)
