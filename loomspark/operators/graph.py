"""The typed evidence graph: contract, expansion, composition, ranking and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.session import discard, staged

# Edge types, the object types they may lead from and to, and which are symmetric or transitive.
NODE_TYPES = ("concept", "claim", "formula", "procedure")
EDGE_PAIRS = {
    "about": (("claim", "concept"), ("formula", "concept"),),
    "composed_of": (("concept", "concept"),),
    "contrasts_with": (("concept", "concept"), ("concept", "claim"), ("concept", "formula"), ("claim", "concept"), ("claim", "claim"), ("claim", "formula"), ("formula", "concept"), ("formula", "claim"), ("formula", "formula"),),
    "defines": (("claim", "concept"),),
    "depends_on": (("concept", "concept"), ("concept", "claim"), ("concept", "formula"), ("concept", "procedure"), ("claim", "concept"), ("claim", "claim"), ("claim", "formula"), ("claim", "procedure"), ("formula", "concept"), ("formula", "claim"), ("formula", "formula"), ("formula", "procedure"),),
    "derived_from": (("claim", "claim"), ("claim", "formula"), ("formula", "claim"), ("formula", "formula"),),
    "kind_of": (("concept", "concept"),),
    "part_of": (("concept", "concept"),),
    "precedes": (("claim", "claim"), ("formula", "formula"), ("procedure", "procedure"),),
    "prerequisite_of": (("concept", "concept"), ("concept", "claim"), ("claim", "concept"), ("claim", "claim"),),
    "supports": (("concept", "claim"), ("claim", "claim"), ("formula", "claim"),),
    "used_in": (("concept", "procedure"), ("formula", "procedure"),),
}
SYMMETRIC, TRANSITIVE = ("contrasts_with",), ("derived_from", "kind_of", "part_of", "precedes", "prerequisite_of")


def contract(spark: SparkSession) -> DataFrame:
    """edge_type, src_type, dst_type of every permitted pair."""
    return spark.createDataFrame([(e, *p) for e, pairs in EDGE_PAIRS.items() for p in pairs], "edge_type string, src_type string, dst_type string")


def plain_name(name: Column) -> Column:
    """Small letters and digits of ASCII, single spaces between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), r"\s+", " "))


def with_types(relations: DataFrame, nodes: DataFrame, labels: bool = False) -> DataFrame:
    """relations (src, dst) with src_type and dst_type, and with labels the ends' plain names as src_label and dst_label; null where
    an end is missing. Each end is one join, whatever it carries, and names are made plain once a node."""
    for end in ("src", "dst"):
        n = nodes.select(F.col("id").alias(end), F.col("object_type").alias(f"{end}_type"), *[plain_name(F.col("name")).alias(f"{end}_label")] * labels)
        relations = relations.join(n, end, "left")
    return relations


def validity(typed: DataFrame) -> DataFrame:
    """typed relations with `valid` (strict) and `queryable` (pairs with a type outside the core pass where the edge is known)."""
    pairs = contract(typed.sparkSession).withColumn("allowed", F.lit(True))
    core = lambda c: F.coalesce(F.col(c).isin(*NODE_TYPES), F.lit(False))
    known = F.coalesce(F.col("edge_type").isin(*EDGE_PAIRS), F.lit(False))
    marked = typed.join(F.broadcast(pairs), ["edge_type", "src_type", "dst_type"], "left").withColumn("valid", F.coalesce("allowed", F.lit(False)))  # the contract is a fixed few dozen rows
    return marked.withColumn("queryable", known & (~core("src_type") | ~core("dst_type") | F.col("valid"))).drop("allowed")


def canonical_ends(edge_type: Column, src: Column, dst: Column) -> tuple[Column, Column]:
    """Ends in a fixed order for symmetric types."""
    swap = edge_type.isin(*SYMMETRIC) & (dst < src)
    return F.when(swap, dst).otherwise(src), F.when(swap, src).otherwise(dst)


def trust(typed: DataFrame, nodes: DataFrame, cap: int = 3) -> DataFrame:
    """id and trust of each relation: 0.4 for a quote, 0.3 for independent sources of the same named triple, 0.3 for a valid type pair.

    typed may bring its ends' plain names (`with_types(..., labels=True)`); else they are joined here. Sources are counted by a hash of
    the triple and joined back by it, so that names do not travel twice.
    """
    if "src_label" not in typed.columns:
        for end in ("src", "dst"):
            typed = typed.join(nodes.select(F.col("id").alias(end), plain_name(F.col("name")).alias(f"{end}_label")), end, "left")
    name = lambda end: F.coalesce(f"{end}_label", F.col(end).cast("string"))
    triple = F.unhex(F.md5(F.concat_ws("\u0001", name("src"), F.coalesce("edge_type", F.lit("")), name("dst"))))
    source = F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), F.concat(F.lit("unique "), F.col("id").cast("string")))
    quoted = F.trim(F.coalesce("quote", F.lit(""))) != ""
    marked = validity(typed).select("id", triple.alias("triple"), source.alias("source"), quoted.alias("quoted"), "valid")
    backed = marked.groupBy("triple").agg(F.countDistinct("source").alias("sources"))
    score = 0.4 * F.when(F.col("quoted"), 1.0).otherwise(0.0) + 0.3 * F.least(F.col("sources") / cap, F.lit(1.0)) + 0.3 * F.when(F.col("valid"), 1.0).otherwise(0.0)
    return marked.join(backed, "triple").select("id", "sources", F.round(score, 6).alias("trust"))


def hop_trust(confidence: Column, status: Column, tier: Column) -> Column:
    """One hop's trust: confidence (unknown counts as 1) times review and tier factors."""
    return F.coalesce(confidence, F.lit(1.0)) * F.when(status == "verified", 1.0).otherwise(0.9) * F.when(tier == "base", 1.0).otherwise(0.85)


def chains(relations: DataFrame, least: float = 0.5) -> DataFrame:
    """Two-hop compositions A -> B -> C of one transitive type, both hops quoted, no end rejected, three nodes, no direct edge.

    One row a triple (edge_type, a, c): the strongest way, its middle and its trust (the weaker hop times 0.9).
    """
    usable = relations.where(F.col("edge_type").isin(*TRANSITIVE) & (F.col("status") != "rejected") & (F.trim("quote") != "") & (F.col("src") != F.col("dst")))
    hops = usable.withColumn("hop", F.round(hop_trust(F.col("confidence"), F.col("status"), F.col("tier")), 6))
    one = hops.groupBy("edge_type", "src", "dst").agg(F.max("hop").alias("hop"))
    two = one.select("edge_type", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("hop").alias("h1")).join(one.select("edge_type", F.col("src").alias("b"), F.col("dst").alias("c"), F.col("hop").alias("h2")), ["edge_type", "b"])
    scored = two.where("a <> c").withColumn("trust", F.round(F.least("h1", "h2") * 0.9, 6)).where(F.col("trust") >= least)
    direct = relations.select("edge_type", F.col("src").alias("a"), F.col("dst").alias("c"))
    fresh = scored.join(direct, ["edge_type", "a", "c"], "left_anti")
    return fresh.groupBy("edge_type", "a", "c").agg(F.max_by("b", F.struct("trust", (-F.col("b")).alias("b"))).alias("b"), F.max("trust").alias("trust"), F.count(F.lit(1)).alias("ways"))


def canonical_relations(relations: DataFrame, clusters: DataFrame, sample: int = 5) -> DataFrame:
    """Relations between clusters (id, canonical): rejected ones and those within a cluster go; rows, distinct sources, sample ids."""
    c = clusters.select("id", "canonical")
    mapped = relations.where("status <> 'rejected'").join(c.select(F.col("id").alias("src"), F.col("canonical").alias("cs")), "src", "left").join(c.select(F.col("id").alias("dst"), F.col("canonical").alias("cd")), "dst", "left")
    mapped = mapped.select("id", "edge_type", "source_id", F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst")).where("src <> dst")
    keep = F.row_number().over(Window.partitionBy("src", "edge_type", "dst").orderBy("id"))
    ranked = mapped.withColumn("rn", keep)
    return ranked.groupBy("src", "edge_type", "dst").agg(
        F.count(F.lit(1)).alias("support_count"),
        F.greatest(F.countDistinct("source_id"), F.lit(1)).alias("source_count"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= sample, F.col("id")))).alias("sample_ids"),
    )


def ranking_graph(relations: DataFrame) -> DataFrame:
    """(u, v, weight) both ways, one weight for each unordered pair: that of its first relation. Loops go."""
    ends = relations.where("src <> dst").select("id", "weight", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    one = ends.groupBy("lo", "hi").agg(F.min_by("weight", "id").alias("weight"))
    both = F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v"))))  # a union would shuffle relations twice
    return one.select(both.alias("e"), "weight").select("e.u", "e.v", "weight")


def personalized_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 10) -> DataFrame:
    """Personalised PageRank of (u, v, weight) from seeds (id, weight): id and score.

    Mass of nodes without edges goes back to the seeds. Each round is one join and one aggregate with map-side combine; what moved
    is written to the shared folder every round. `push_rank` runs to a tolerance instead of a number of rounds.
    """
    total = F.sum("weight").over(Window.partitionBy())
    reset = staged(seeds.groupBy("id").agg(F.sum("weight").alias("weight")).withColumn("r", F.col("weight") / total).select("id", "r"), "reset")
    out = edges.groupBy("u").agg(F.sum("weight").alias("out"))
    shares = staged(edges.join(out, "u").select("u", "v", (F.col("weight") / F.col("out")).alias("share")), "shares")
    score, moved = reset.select("id", F.col("r").alias("score")), None
    for _ in range(rounds):
        before = moved
        moved = staged(shares.join(score.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("share") * F.col("score")).alias("m")), "moved")
        held = moved.agg(F.sum("m")).head()[0] or 0.0
        score = moved.select("id", (damping * F.col("m")).alias("part")).unionByName(reset.select("id", (F.col("r") * (1 - damping * held)).alias("part"))).groupBy("id").agg(F.sum("part").alias("score"))
        if before is not None:
            discard(before)
    return score


def push_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """Personalised PageRank of (u, v, weight) from seeds (id, weight) to a tolerance: id and score of every node reached.

    Driven by residuals: a node holds a score and a residual that is still to be passed on. Only nodes with a residual above
    tolerance / (number of nodes) push: a part 1 - damping stays as score, the rest goes along their edges, or back to the seeds
    where there are none. When no node is active the residuals left sum to no more than the tolerance, which bounds the error of
    all scores together; `most` rounds are never exceeded. Work shrinks with the active nodes, and a round is one join and one sum
    combined on the map side. Seeds of weight 0 or less take no part; without any there are no scores.
    """
    weighed = seeds.where("weight > 0").groupBy("id").agg(F.sum("weight").cast("double").alias("weight"))
    total = weighed.agg(F.sum("weight")).head()[0]
    reset = staged(weighed.select("id", (F.col("weight") / F.lit(total)).alias("r")), "reset")
    out = edges.groupBy("u").agg(F.sum("weight").alias("out"))
    shares = staged(edges.join(out, "u").select("u", "v", (F.col("weight") / F.col("out")).alias("share")), "shares")
    n = shares.select(F.col("u").alias("id")).unionByName(shares.select(F.col("v").alias("id"))).unionByName(reset.select("id")).distinct().count()
    least = tolerance / max(n, 1)
    state = staged(reset.select("id", F.lit(0.0).alias("p"), "r"), "state")
    for _ in range(most):
        active = F.col("r") > least
        mass, count = state.agg(F.coalesce(F.sum(F.when(active, F.col("r"))), F.lit(0.0)), F.count_if(active)).head()
        if not count:
            break
        pushed = staged(shares.join(state.where(active).select(F.col("id").alias("u"), "r"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(damping * F.col("share") * F.col("r")).alias("r")), "pushed")
        back = damping * mass - (pushed.agg(F.sum("r")).head()[0] or 0.0)
        kept = state.select("id", (F.col("p") + F.when(active, (1 - damping) * F.col("r")).otherwise(0.0)).alias("p"), F.when(active, 0.0).otherwise(F.col("r")).alias("r"))
        parts = kept.unionByName(pushed.select("id", F.lit(0.0).alias("p"), "r"))
        if back > least * 1e-6:
            parts = parts.unionByName(reset.select("id", F.lit(0.0).alias("p"), (F.col("r") * back).alias("r")))
        before, state = state, staged(parts.groupBy("id").agg(F.sum("p").alias("p"), F.sum("r").alias("r")), "state")
        discard(before, pushed)
    return state.select("id", (F.col("p") + F.col("r")).alias("score"))


def passage_scores(scores: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, score) of all passages (id), their ranks from 0 to 1 between the least and the greatest; all 0 where they are equal. A
    passage that was not reached has the least there is, 0."""
    raw = passages.select("id").distinct().join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ends = raw.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return raw.crossJoin(F.broadcast(ends)).select("id", F.when(span > 0, (F.col("score") - F.col("lo")) / span).otherwise(0.0).alias("score"))  # one row


def bounded_search(edges: DataFrame, start: DataFrame, depth: int, fan_out: int) -> DataFrame:
    """Nodes within `depth` hops of start (id), each node following its first `fan_out` edges (src, dst, edge_type, id) in order: id, hop."""
    first = F.row_number().over(Window.partitionBy("src").orderBy("edge_type", "id"))
    followed = edges.withColumn("rn", first).where(F.col("rn") <= fan_out).select("src", "dst")
    seen = staged(start.select("id", F.lit(0).alias("hop")).distinct(), "seen")
    for hop in range(1, depth + 1):
        near = seen.where(F.col("hop") == hop - 1).join(followed, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        before, seen = seen, staged(seen.unionByName(near.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop"))), "seen")
        discard(before)
    return seen


def one_hop(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Other ends of edges that touch start (id), with how many do."""
    a = edges.join(start, edges["src"] == start["id"], "left_semi").select(F.col("dst").alias("id"))
    b = edges.join(start, edges["dst"] == start["id"], "left_semi").select(F.col("src").alias("id"))
    return a.unionByName(b).groupBy("id").agg(F.count(F.lit(1)).alias("touching"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): least reachable id; each round takes the least neighbouring label and jumps to that label's label."""
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = staged(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    held = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "label")
    while True:
        label = held.select("u", "l")
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        least = label.join(near, "u").select("u", F.col("l").alias("before"), F.least("l", "m").alias("l"))
        fresh = staged(least.join(label.select(F.col("u").alias("l"), F.col("l").alias("root")), "l").select("u", "before", F.least("l", "root").alias("l")), "label")
        discard(held)
        if fresh.where("l <> before").isEmpty():
            discard(both)
            return fresh.select(F.col("u").alias("id"), F.col("l").alias("component"))
        held = fresh


def communities(edges: DataFrame, rounds: int = 10, least: int = 3) -> DataFrame:
    """Groups of an undirected weighted graph (u, v, weight, both ways) by label propagation: every node takes the label with the
    most weight around it, ties to the smaller; every second round only nodes of odd hash move, which keeps it from swinging.
    Groups under `least` members are left out."""
    label = staged(edges.select(F.col("u").alias("id")).distinct().withColumn("l", F.col("id")), "communities")
    for k in range(rounds):
        votes = edges.join(label.withColumnRenamed("id", "v"), "v").groupBy("u", "l").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("u").agg(F.max_by("l", F.struct("w", (-F.col("l")).alias("l"))).alias("n"))
        move = F.pmod(F.hash("id"), F.lit(2)) == k % 2
        before = label
        label = staged(label.join(best, label["id"] == best["u"], "left").select("id", F.when(move, F.coalesce("n", "l")).otherwise(F.col("l")).alias("l")), "communities")
        discard(before)
    sizes = label.groupBy("l").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("community")).where(F.col("size") >= least)
    return label.join(sizes, "l").select("id", "community", "size")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
