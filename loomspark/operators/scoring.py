"""Extraction scored stage by stage against gold, for many documents (`doc`) at once.

Items of both sides are aligned one to one by `greedy_matching`; a true positive is an aligned pair of equal kind, and an aligned
pair of unequal kinds counts as one miss and one spurious item. With nothing on either side a measure is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.relational import greedy_matching, overlapping_spans

# Least scores for an alignment, shares of an object pair's score, the names that tell an object's identity.
ATOM_IOU, CHUNK_JACCARD, OBJECT_SCORE = 0.5, 0.5, 0.4
OBJECT_SHARES = {"type": 0.4, "evidence": 0.4, "payload": 0.2}
PACKAGE_SHARES, STRUCTURE_SHARES = (0.7, 0.3), (0.5, 0.5)

_TEXTS = "array<string>"


def measures(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1."""
    none = tp + fp + fn == 0
    p = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    r = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(c, 6).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"))]


def norm(text: Column) -> Column:
    """Trimmed, one layer of equal quotes off, white space single, small letters; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?s)^([\"'])(.*)\1$", "$2")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def equivalent(a: Column, b: Column) -> Column:
    """Normal texts that are equal, or of which the shorter has 4 characters or more and stands in the longer."""
    held = (F.length(a) >= 4) & F.contains(b, a) | (F.length(b) >= 4) & F.contains(a, b)
    return (a == b) | ((a != "") & (b != "") & held)


def pooled_matches(gold: Column, pred: Column) -> Column:
    """How many of gold's texts find an equivalent one in pred, in order, each of pred's being used once."""
    start = F.struct(pred.cast(_TEXTS).alias("pool"), F.lit(0).alias("n"))

    def step(state: Column, g: Column) -> Column:
        fits = F.transform(state["pool"], lambda p: equivalent(g, p))
        at = F.coalesce(F.array_position(fits, True), F.lit(0)).cast("int")
        rest = F.filter(state["pool"], lambda _, k: k != at - 1)
        return F.struct(F.when(at > 0, rest).otherwise(state["pool"]).alias("pool"), (state["n"] + (at > 0).cast("int")).alias("n"))

    return F.aggregate(gold.cast(_TEXTS), start, step, lambda s: s["n"])


def _docs(*sides: DataFrame) -> DataFrame:
    out = sides[0].select("doc")
    for s in sides[1:]:
        out = out.unionByName(s.select("doc"))
    return out.distinct()


def _kinds(matches: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """matches (doc, gold_id, pred_id, score) with `same`: the kinds are equal, two missing ones included."""
    g, p = gold.select("doc", F.col("id").alias("gold_id"), F.col("kind").alias("__g")), pred.select("doc", F.col("id").alias("pred_id"), F.col("kind").alias("__p"))
    return matches.join(g, ["doc", "gold_id"]).join(p, ["doc", "pred_id"]).withColumn("same", F.col("__g").eqNullSafe(F.col("__p"))).drop("__g", "__p")


def strict(kinds: DataFrame, gold: DataFrame, pred: DataFrame, *more: Column) -> DataFrame:
    """doc, tp, fp, fn, precision, recall, f1, type_accuracy and `more` (aggregates of the aligned pairs, null without any)."""
    per = kinds.groupBy("doc").agg(F.count_if("same").alias("tp"), F.count(F.lit(1)).alias("aligned"), *more)
    count = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    met = _docs(gold, pred).join(per, "doc", "left").join(count(gold, "n_gold"), "doc", "left").join(count(pred, "n_pred"), "doc", "left").fillna(0, ["tp", "aligned", "n_gold", "n_pred"])
    met = met.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gold") - F.col("tp")})
    accuracy = F.when(F.col("aligned") == 0, 1.0).otherwise(F.col("tp") / F.col("aligned"))
    return met.select("doc", "tp", "fp", "fn", *measures(F.col("tp"), F.col("fp"), F.col("fn")), F.round(accuracy, 6).alias("type_accuracy"), *[c for c in per.columns if c not in ("doc", "tp", "aligned")])


def match_atoms(gold: DataFrame, pred: DataFrame, width: int, least: float = ATOM_IOU) -> DataFrame:
    """(doc, gold_id, pred_id, score) of atoms (doc, id, kind, a, b) aligned by the overlap of their spans."""
    pairs = overlapping_spans(gold, pred, ["doc"], width).where(F.col("iou") >= least)
    return greedy_matching(pairs.select("doc", "gold_id", "pred_id", F.col("iou").alias("score")), ["doc"], "score")


def score_atoms(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Strict measures of atoms, with the mean overlap of what is aligned."""
    return strict(_kinds(matches, gold, pred), gold, pred, F.round(F.avg("score"), 4).alias("mean_iou")).fillna(1.0, ["mean_iou"])


def _sets(items: DataFrame, name: str, mapped: DataFrame | None) -> DataFrame:
    """(doc, <name>_id, <name>_atoms): distinct atoms of items (doc, id, atoms), those of pred by the gold atoms they are aligned
    with; what has no counterpart is left out."""
    each = items.select("doc", F.col("id").alias(f"{name}_id"), F.explode_outer("atoms").alias("atom"))
    if mapped is not None:
        each = each.join(mapped.select("doc", F.col("pred_id").alias("atom"), F.col("gold_id").alias("__to")), ["doc", "atom"], "left").withColumn("atom", F.col("__to"))
    return each.groupBy("doc", f"{name}_id").agg(F.collect_set("atom").alias(f"{name}_atoms"))


def _jaccard() -> Column:
    both, one = F.size(F.array_intersect("gold_atoms", "pred_atoms")), F.size(F.array_union("gold_atoms", "pred_atoms"))
    return F.when(one == 0, 1.0).otherwise(both / one)


def _sharing(g: DataFrame, p: DataFrame) -> DataFrame:
    """(doc, gold_id, pred_id) of items that share an atom."""
    return g.withColumn("atom", F.explode("gold_atoms")).join(p.withColumn("atom", F.explode("pred_atoms")), ["doc", "atom"]).select("doc", "gold_id", "pred_id").distinct()


def match_chunks(gold: DataFrame, pred: DataFrame, atoms: DataFrame, least: float = CHUNK_JACCARD) -> DataFrame:
    """(doc, gold_id, pred_id, score, gold_atoms, pred_atoms) of chunks (doc, id, kind, atoms) aligned by the atoms they hold.

    Chunks without atoms are alike, and unlike all others: the n-th of one side, by id, goes with the n-th of the other.
    """
    g, p = _sets(gold, "gold", None), _sets(pred, "pred", atoms)
    pairs = _sharing(g, p).join(g, ["doc", "gold_id"]).join(p, ["doc", "pred_id"]).withColumn("score", F.round(_jaccard(), 6)).where(F.col("score") >= least)
    met = greedy_matching(pairs.select("doc", "gold_id", "pred_id", "score"), ["doc"], "score")
    nth = lambda df, side: df.where(F.size(f"{side}_atoms") == 0).select("doc", f"{side}_id", F.row_number().over(Window.partitionBy("doc").orderBy(f"{side}_id")).alias("__n"))
    bare = nth(g, "gold").join(nth(p, "pred"), ["doc", "__n"]).select("doc", "gold_id", "pred_id", F.lit(1.0).alias("score"))
    return met.unionByName(bare).join(g, ["doc", "gold_id"]).join(p, ["doc", "pred_id"])


def score_chunks(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Strict measures of chunks, and how many are split too far (a part of their gold chunk, or not aligned) or too little."""
    less = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b)) & (F.size(a) > 0)
    kinds = _kinds(matches, gold, pred)
    out = strict(kinds, gold, pred, F.count(F.lit(1)).alias("__n"), F.count_if(less("pred_atoms", "gold_atoms")).alias("__over"), F.count_if(less("gold_atoms", "pred_atoms")).alias("under_split")).fillna(0, ["__n", "__over", "under_split"])
    return out.withColumn("over_split", F.col("__over") + F.col("tp") + F.col("fp") - F.col("__n")).drop("__n", "__over")


def match_objects(gold: DataFrame, pred: DataFrame, atoms: DataFrame, least: float = OBJECT_SCORE) -> DataFrame:
    """(doc, gold_id, pred_id, score, jaccard) of objects (doc, id, kind, atoms, values) aligned by kind, evidence and payload.

    Without an equal kind, a shared atom or two empty evidences no pair reaches `least`, so only such pairs are looked at.
    """
    g, p = _sets(gold, "gold", None), _sets(pred, "pred", atoms)
    kind = lambda df, side: df.select("doc", F.col("id").alias(f"{side}_id"), F.coalesce("kind", F.lit("")).alias("__kind"))
    bare = lambda df, side: df.where(F.size(f"{side}_atoms") == 0).select("doc", f"{side}_id")
    pairs = kind(gold, "gold").join(kind(pred, "pred"), ["doc", "__kind"]).select("doc", "gold_id", "pred_id")
    pairs = pairs.unionByName(_sharing(g, p)).unionByName(bare(g, "gold").join(bare(p, "pred"), "doc").select("doc", "gold_id", "pred_id")).distinct()
    told = lambda df, side: df.select("doc", F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.transform("values", norm).alias(f"{side}_values"))
    full = pairs.join(g, ["doc", "gold_id"]).join(p, ["doc", "pred_id"]).join(told(gold, "gold"), ["doc", "gold_id"]).join(told(pred, "pred"), ["doc", "pred_id"])
    most = F.greatest(F.size("gold_values"), F.size("pred_values"))
    payload = F.when(most == 0, 1.0).otherwise(pooled_matches(F.filter("gold_values", lambda v: v != ""), F.filter("pred_values", lambda v: v != "")) / most)
    w = OBJECT_SHARES
    score = w["type"] * F.col("gold_kind").eqNullSafe(F.col("pred_kind")).cast("double") + w["evidence"] * F.col("jaccard") + w["payload"] * payload
    scored = full.withColumn("jaccard", _jaccard()).withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return greedy_matching(scored.select("doc", "gold_id", "pred_id", "score", "jaccard"), ["doc"], "score")


def score_objects(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Strict measures of objects; payload_precision, payload_recall, payload_f1 over the values of aligned pairs, where values of
    gold objects that nothing is aligned with are missed; and mean_jaccard of evidence over all gold objects."""
    kinds = _kinds(matches, gold, pred)
    base = strict(kinds, gold, pred, F.sum("jaccard").alias("__j")).fillna(0.0, ["__j"])
    values = lambda df, side: df.select("doc", F.col("id").alias(f"{side}_id"), F.transform("values", norm).alias(f"{side}_values"))
    met = values(gold, "gold").join(matches.select("doc", "gold_id", "pred_id"), ["doc", "gold_id"], "left").join(values(pred, "pred"), ["doc", "pred_id"], "left")
    pred_values = F.coalesce("pred_values", F.array().cast(_TEXTS))
    hit = pooled_matches(F.col("gold_values"), pred_values)
    field = met.select("doc", hit.alias("tp"), F.size("gold_values").alias("g"), F.size(pred_values).alias("p"))
    per = field.groupBy("doc").agg(F.sum("tp").alias("t"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("__n"))
    joined = base.join(per, "doc", "left").fillna(0, ["t", "g", "p", "__n"])
    named = [m.alias(f"payload_{n}") for m, n in zip(measures(F.col("t"), F.col("p") - F.col("t"), F.col("g") - F.col("t")), ("precision", "recall", "f1"), strict=True)]
    mean = F.when(F.col("__n") == 0, 1.0).otherwise(F.col("__j") / F.col("__n"))
    return joined.select(*[c for c in base.columns if c != "__j"], *named, F.round(mean, 4).alias("mean_jaccard"))


def score_relations(gold: DataFrame, pred: DataFrame, objects: DataFrame) -> DataFrame:
    """doc, tp, fp, fn and measures of relations (doc, id, source, target, kind) between aligned objects (doc, gold_id, pred_id).

    Gold relations of the same ends choose in order of id: one of their kind, else the first left over, which is then wrong.
    """
    to = lambda end: objects.select("doc", F.col("pred_id").alias(end), F.col("gold_id").alias(f"__{end}"))
    mapped = pred.join(to("source"), ["doc", "source"]).join(to("target"), ["doc", "target"]).select("doc", F.col("__source").alias("source"), F.col("__target").alias("target"), "id", "kind")
    listed = lambda df, name: df.groupBy("doc", "source", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("kind", F.lit("")).alias("kind")))), lambda x: x["kind"]).alias(name))
    met = listed(gold, "g").join(listed(mapped, "p"), ["doc", "source", "target"], "left")
    start = F.struct(F.coalesce("p", F.array().cast(_TEXTS)).alias("pool"), F.lit(0).alias("n"))

    def step(state: Column, kind: Column) -> Column:
        own = F.array_position(state["pool"], kind).cast("int")
        at = F.when(own > 0, own).otherwise(1)
        return F.struct(F.filter(state["pool"], lambda _, k: k != at - 1).alias("pool"), (state["n"] + (own > 0).cast("int")).alias("n"))

    tp = met.select("doc", F.aggregate("g", start, step, lambda s: s["n"]).alias("tp")).groupBy("doc").agg(F.sum("tp").alias("tp"))
    count = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    full = _docs(gold, pred).join(tp, "doc", "left").join(count(gold, "g"), "doc", "left").join(count(pred, "p"), "doc", "left").fillna(0, ["tp", "g", "p"])
    full = full.select("doc", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    return full.select("*", *measures(F.col("tp"), F.col("fp"), F.col("fn")))


def score_packages(packages: DataFrame, objects: DataFrame, payload_keys: DataFrame) -> DataFrame:
    """doc, object_recall, field_coverage, score of packages (doc, id, expected: object ids, fields: object id -> payload names)
    against aligned objects (doc, gold_id, pred_id) and the names in pred objects' payloads (doc, pred_id, keys)."""
    found = objects.join(payload_keys, ["doc", "pred_id"], "left").select("doc", F.col("gold_id").alias("object"), F.coalesce("keys", F.array().cast(_TEXTS)).alias("keys"))
    wanted = packages.select("doc", F.explode("expected").alias("object")).join(found.select("doc", "object", F.lit(1).alias("hit")), ["doc", "object"], "left")
    recall = wanted.groupBy("doc").agg((F.count("hit") / F.count(F.lit(1))).alias("object_recall"))
    fields = packages.select("doc", F.explode("fields").alias("object", "names")).join(found, ["doc", "object"], "left")
    hit = F.size(F.filter("names", lambda n: F.coalesce(F.array_contains("keys", n), F.lit(False))))
    coverage = fields.groupBy("doc").agg(F.try_divide(F.sum(hit), F.sum(F.size("names"))).alias("field_coverage"))
    full = packages.select("doc").distinct().join(recall, "doc", "left").join(coverage, "doc", "left").fillna(1.0, ["object_recall", "field_coverage"])
    a, b = PACKAGE_SHARES
    return full.select("doc", F.round("object_recall", 6).alias("object_recall"), F.round("field_coverage", 6).alias("field_coverage"), F.round(a * F.col("object_recall") + b * F.col("field_coverage"), 6).alias("score"))


def score_structure(gold_paths: DataFrame, pred_paths: DataFrame, gold_mentions: DataFrame, pred_mentions: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc, sections_f1, mentions_f1, score: section paths (doc, path) as sets of normal texts; mentions (doc, atom, text) as sets of
    (gold atom, normal text), an atom without a counterpart standing for itself."""
    to = atoms.select("doc", F.col("pred_id").alias("atom"), F.col("gold_id").alias("__to"))
    moved = pred_mentions.join(to, ["doc", "atom"], "left").select("doc", F.coalesce("__to", "atom").alias("atom"), "text")
    sides = [
        (gold_paths.select("doc", F.struct(norm(F.col("path")).alias("t")).alias("x")), pred_paths.select("doc", F.struct(norm(F.col("path")).alias("t")).alias("x")), "sections_f1"),
        (gold_mentions.select("doc", F.struct("atom", norm(F.col("text")).alias("t")).alias("x")), moved.select("doc", F.struct("atom", norm(F.col("text")).alias("t")).alias("x")), "mentions_f1"),
    ]
    out = _docs(gold_paths, pred_paths, gold_mentions, pred_mentions)
    for g, p, name in sides:
        flags = g.withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(p.withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
        one = flags.groupBy("doc", "x").agg(F.max("g").alias("g"), F.max("p").alias("p"))
        per = one.groupBy("doc").agg(F.sum(F.col("g") * F.col("p")).alias("t"), F.sum("g").alias("g"), F.sum("p").alias("p"))
        f1 = measures(F.col("t"), F.col("p") - F.col("t"), F.col("g") - F.col("t"))[2]
        out = out.join(per.select("doc", f1.alias(name)), "doc", "left").fillna(1.0, [name])
    a, b = STRUCTURE_SHARES
    return out.select("doc", "sections_f1", "mentions_f1", F.round(a * F.col("sections_f1") + b * F.col("mentions_f1"), 6).alias("score"))


def score_suppression(forbidden: DataFrame, pred_surfaces: DataFrame, gold_surfaces: DataFrame) -> DataFrame:
    """doc, total, violations, score of forbidden texts (doc, text): one is violated if it stands in a surface of pred (doc, text)
    and in none of gold, both normal; an empty text never is. A document's surfaces are gathered in one row."""
    held = lambda df, name: df.select("doc", norm(F.col("text")).alias("t")).where("t <> ''").groupBy("doc").agg(F.collect_set("t").alias(name))
    met = forbidden.select("doc", norm(F.col("text")).alias("n")).join(held(pred_surfaces, "p"), "doc", "left").join(held(gold_surfaces, "g"), "doc", "left")
    named = lambda c: F.coalesce(F.exists(c, lambda s: F.contains(s, F.col("n"))), F.lit(False))
    per = met.groupBy("doc").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("n") != "") & named("p") & ~named("g")).alias("violations"))
    full = _docs(forbidden, pred_surfaces).join(per, "doc", "left").fillna(0, ["total", "violations"])
    return full.select("doc", "total", "violations", F.round(F.when(F.col("total") == 0, 1.0).otherwise(1 - F.col("violations") / F.col("total")), 6).alias("score"))
