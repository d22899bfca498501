"""Communities of a weighted graph by modularity, in bulk-synchronous rounds, level by level.

Within a level three nodes of four (by hash, the fourth in turn) move to the neighbouring community of highest gain; one round is a join of edges with labels, a sum by (node, community) combined on the map side, and a join with the communities'
totals. A round's modularity comes from the table it has written. Rounds end when one gains less than the tolerance,
and the best labels so far stay. Communities are then refined to their connected parts, the graph is summed by
part, and the next level starts from the communities with parts as nodes. Levels end when they gain nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.graph import components
from loomspark.session import discard, staged

TOLERANCE, MOST_ROUNDS, MOST_LEVELS = 1e-3, 20, 8


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of edges (u, v, weight, both ways) under labels (id, community); nodes without a label are alone."""
    nodes = edges.groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("k")).join(labels.select("id", "community"), "id", "left")
    nodes = nodes.select("id", "k", F.coalesce(F.concat(F.lit("c"), F.col("community").cast("string")), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("c"))
    all_ = nodes.agg(F.sum("k")).head()[0]
    if not all_:
        return 0.0
    ends = edges.join(nodes.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(nodes.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    inner = ends.where("cu = cv").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).head()[0]
    squares = nodes.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).head()[0]
    return inner / all_ - squares / all_**2


def _round(edges: DataFrame, state: DataFrame, all_: float, turn: int) -> DataFrame:
    """state (id, k, c) after one round: id, k, c, and about the round: was, inner (weight into the own community before), mass."""
    totals = state.groupBy("c").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("n"))
    own = state.join(totals, "c").select("id", "k", F.col("c").alias("was"), F.col("t").alias("own_t"), F.col("n").alias("own_n"))
    votes = edges.where("u <> v").join(state.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("weight").alias("w"))
    met = votes.join(totals, "c").withColumnRenamed("u", "id").join(own, "id")
    mine = F.col("c") == F.col("was")
    gain = F.round(F.col("w") - F.col("k") * F.when(mine, F.col("own_t") - F.col("k")).otherwise(F.col("t")) / all_, 9)
    # Two nodes that are alone do not swap places: the larger label moves to the smaller.
    swap = (F.col("own_n") == 1) & (F.col("n") == 1) & (F.col("c") > F.col("was"))
    best = met.groupBy("id").agg(
        F.max(F.when(mine, gain)).alias("stay"),
        F.max(F.when(mine, F.col("w"))).alias("inner"),
        F.max(F.when(~mine & ~swap, F.struct(gain.alias("gain"), (-F.col("c")).alias("c")))).alias("best"),
    )
    joined = own.join(best, "id", "left")
    stay = F.coalesce("stay", F.round(-F.col("k") * (F.col("own_t") - F.col("k")) / all_, 9))
    move = (F.pmod(F.xxhash64("id"), F.lit(4)) != turn % 4) & (F.col("best.gain") > stay)
    return joined.select("id", "k", F.when(move, -F.col("best.c")).otherwise(F.col("was")).alias("c"), "was", F.coalesce("inner", F.lit(0.0)).alias("inner"), (F.col("k") * F.col("own_t")).alias("mass"))


def _level(edges: DataFrame, state: DataFrame, all_: float, tolerance: float) -> tuple[DataFrame, float, bool]:
    """Labels (id, c) of highest modularity found, that modularity, and whether any node moved."""
    loops = edges.where("u = v").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).head()[0]
    best, best_q, idle, moved, last = None, None, 0, False, None
    for turn in range(MOST_ROUNDS):
        after = staged(_round(edges, state, all_, turn), "moves")
        inner, mass, moves = after.agg(F.sum("inner"), F.sum("mass"), F.count_if(F.col("c") != F.col("was"))).head()
        q = (inner + loops) / all_ - mass / all_**2  # of the labels this round began with
        idle = 0 if best_q is None or q > best_q + tolerance else idle + 1
        moved, before = moved or moves > 0, best
        if best_q is None or q > best_q:
            best, best_q = after, q
        if turn and previous is not best:
            discard(previous)
        if before is not None and before is not best and before is not (previous if turn else None):
            discard(before)
        previous, state = after, after.select("id", "k", "c")
        if idle or (moves == 0 and last == 0):
            break
        last = moves
    return best.select("id", F.col("was").alias("c")), best_q, moved


def communities(edges: DataFrame, least: int = 3, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, community, size) of an undirected graph (u, v, weight, both ways; ids are integers): connected groups of high
    modularity, named by their least id. Groups under `least` members are left out; loops and weights of 0 or less are passed
    over; an empty graph has none."""
    edges = staged(edges.where("u <> v AND weight > 0").groupBy("u", "v").agg(F.sum("weight").cast("double").alias("weight")), "edges")
    all_ = edges.agg(F.sum("weight")).head()[0]
    kind = edges.schema["u"].dataType
    if not all_:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("community"), F.lit(0).cast("long").alias("size")).limit(0)
    graph, member = edges, staged(edges.select(F.col("u").alias("id"), F.col("u").alias("part")).distinct(), "member")
    degrees = graph.groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("k"))
    state, reached = degrees.withColumn("c", F.col("id")), None
    for _ in range(MOST_LEVELS):
        labels, q, moved = _level(graph, state, all_, tolerance)
        # Parts: the connected pieces of each community.
        inside = graph.where("u < v").join(labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv")
        found = components(inside.select("u", "v"), "u", "v")
        parts = staged(labels.join(found, "id", "left").select("id", F.coalesce("component", "id").cast(kind).alias("part"), "c"), "parts")
        before, member = member, staged(member.withColumnRenamed("part", "of").join(parts.select(F.col("id").alias("of"), "part"), "of").select("id", "part"), "member")
        discard(before)
        if not moved or (reached is not None and q <= reached + tolerance):
            break
        reached = q
        to = lambda end: parts.select(F.col("id").alias(end), F.col("part").alias(f"p_{end}"))
        summed = staged(graph.join(to("u"), "u").join(to("v"), "v").groupBy(F.col("p_u").alias("u"), F.col("p_v").alias("v")).agg(F.sum("weight").alias("weight")), "summed")
        # The next level's nodes are parts, and start in their communities, each named by its least part.
        names = parts.groupBy("c").agg(F.min("part").alias("name"))
        k = summed.groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("k"))
        state = staged(parts.join(names, "c").select(F.col("part").alias("id"), F.col("name").alias("c")).distinct().join(k, "id"), "state")
        if graph is not edges:
            discard(graph)
        graph = summed
    sized = member.withColumns({"community": F.min("id").over(Window.partitionBy("part")), "size": F.count(F.lit(1)).over(Window.partitionBy("part"))})
    return sized.where(F.col("size") >= least).select("id", "community", "size")


#: Longer names are pieces of sentences rather than things.
LONGEST_NAME = 60


def community_peers(nodes: DataFrame, membership: DataFrame, edges: DataFrame, focals: DataFrame, k: int = 8, longest: int = LONGEST_NAME) -> DataFrame:
    """(q, rank, id, name, score): the k other members of a focal name's community, those that the question names first.

    nodes (id, name), membership (id, community), edges (u, v, weight, both ways), focals (q, name, query). A focal name is found
    by its words, capitals aside; of several nodes with it the one of most edge weight counts. A member's score is the part of
    the question's words its name holds, times its edge weight; ties go by that weight, then by id. Names over `longest`
    characters come last. Focals that are unknown, or in no community, give no rows.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    weight = edges.groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("centrality"))
    known = staged(nodes.join(weight, "id", "left").select("id", "name", F.coalesce("centrality", F.lit(0.0)).alias("centrality")), "known")
    asked = focals.select("q", norm(F.col("name")).alias("key"), F.array_sort(words(F.col("query"))).alias("asked")).where("key <> ''")
    # Names are told apart before questions meet them, and questions with the same focal and words are answered once.
    first = F.struct((-F.col("centrality")).alias("c"), "id")
    named = known.select(first.alias("first"), norm(F.col("name")).alias("key")).groupBy("key").agg(F.min("first").alias("first"))
    focal = asked.join(named, "key").groupBy("q").agg(F.min_by(F.struct("first.id", "asked"), "first").alias("f")).select("q", F.col("f.id").alias("focal"), "f.asked")
    placed = focal.select("focal", "asked").distinct().join(membership.select(F.col("id").alias("focal"), "community"), "focal")
    peers = placed.join(membership.select("id", "community"), "community").where("id <> focal").join(known, "id")
    part = F.size(F.array_intersect("asked", words(F.col("name")))) / F.greatest(F.size("asked"), F.lit(1))
    scored = peers.select("focal", "asked", "id", "name", "centrality", (F.coalesce(F.length("name"), F.lit(0)) > longest).alias("__long"), F.round(part * F.col("centrality"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("focal", "asked").orderBy("__long", F.desc("score"), F.desc("centrality"), "id"))
    answers = scored.withColumn("rank", place).where(F.col("rank") <= k)
    return focal.join(answers, ["focal", "asked"]).select("q", "rank", "id", "name", "score")
