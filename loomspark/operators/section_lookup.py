"""Sections that a question names by identifier, whole: hits, their groups in the breadcrumb tree, subtrees, one row a chunk.

Many questions go through at once. Texts are scanned once for all terms; the tree is the table of distinct breadcrumbs with the
nodes above each, so that "everything under the best group" is an equality of (source, node) and not a search by prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.retrieval import trigram_recall

SEPARATOR = " > "


def nodes_above(path: Column) -> Column:
    """The breadcrumb's nodes from the root down to itself."""
    parts = F.split(path, SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEPARATOR))


def group_path(path: Column, term: Column) -> Column:
    """The highest node that names the term, capitals aside; the breadcrumb itself if none does."""
    return F.coalesce(F.get(F.filter(nodes_above(path), lambda n: F.contains(F.lower(n), F.lower(term))), F.lit(0)), path)


def lookup_sections(chunks: DataFrame, terms: DataFrame, per_term: int = 50, sections: int = 3, per_section: int = 12, most_terms: int = 3) -> DataFrame:
    """(q, section, place, id, source_id, group_path, relevance) for questions' identifiers, terms (q, nth, term).

    chunks (id, source_id, section_path, pos, text, navigation). A question's first `most_terms` terms count; a term's hits are the
    first `per_term` chunks, by source and position, whose text holds it. Navigation pages and chunks without a breadcrumb neither
    hit nor come back. Hits are counted by group, the highest node that names the term that hit; the `sections` groups of most hits
    stay (then the shorter name, the name, the source). A group that names any of the terms gives its subtree in document order,
    another its own hits, `per_section` chunks each; a chunk comes with its first group only. relevance is the part of the terms
    that breadcrumb and text hold. Questions without terms or hits give nothing.
    """
    asked = terms.where("term IS NOT NULL AND term <> ''").withColumn("__n", F.row_number().over(Window.partitionBy("q").orderBy("nth", "term"))).where(F.col("__n") <= most_terms).select("q", "term", F.col("__n").alias("nth"))
    usable = chunks.where(~F.coalesce("navigation", F.lit(False)) & F.coalesce(F.col("source_id").cast("string") != "", F.lit(False)) & F.coalesce(F.col("section_path") != "", F.lit(False)))
    usable = usable.select("id", "source_id", "section_path", "pos", F.coalesce("text", F.lit("")).alias("text"))
    found = trigram_recall(usable.select(F.col("id").alias("doc_id"), "text"), asked.select("term"), n=1).withColumnRenamed("doc_id", "id")
    hits = asked.join(found, "term").join(usable.drop("text"), "id")
    hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy("q", "term").orderBy("source_id", "pos", "id"))).where(F.col("__n") <= per_term)
    grouped = hits.withColumn("group_path", group_path(F.col("section_path"), F.col("term")))
    once = grouped.groupBy("q", "source_id", "group_path", "id").agg(F.min(F.struct("nth", "__n")).alias("first"))
    counted = once.groupBy("q", "source_id", "group_path").agg(F.count(F.lit(1)).alias("hits"))
    order = [F.desc("hits"), F.length("group_path"), "group_path", "source_id"]
    best = counted.withColumn("section", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("section") <= sections)
    names = asked.groupBy("q").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("terms"))
    best = best.join(names, "q").withColumn("named", F.exists("terms", lambda t: F.contains(F.lower("group_path"), t)))

    tree = usable.select("source_id", "section_path").distinct().withColumn("group_path", F.explode(nodes_above(F.col("section_path"))))
    under = best.where("named").join(tree, ["source_id", "group_path"]).join(usable.select("id", "source_id", "section_path", "pos"), ["source_id", "section_path"])
    whole = under.select("q", "section", "source_id", "group_path", "id", F.struct("pos", F.lit(0).alias("b"), "id").alias("at"))
    own = best.where("NOT named").join(once, ["q", "source_id", "group_path"]).select("q", "section", "source_id", "group_path", "id", F.struct(F.col("first.nth").cast("long").alias("pos"), F.col("first.__n").alias("b"), "id").alias("at"))
    kind = usable.schema["pos"].dataType
    own = own.withColumn("at", F.struct(F.col("at.pos").cast(kind).alias("pos"), "at.b", "at.id"))
    listed = whole.unionByName(own).withColumn("place", F.row_number().over(Window.partitionBy("q", "section").orderBy("at"))).where(F.col("place") <= per_section)
    first = listed.withColumn("__n", F.row_number().over(Window.partitionBy("q", "id").orderBy("section"))).where("__n = 1")
    told = first.join(usable.select("id", F.lower(F.concat_ws(" ", "section_path", "text")).alias("__h")), "id").join(names, "q")
    part = F.size(F.filter("terms", lambda t: F.contains(F.col("__h"), t))) / F.size("terms")
    return told.select("q", "section", "place", "id", "source_id", "group_path", F.round(part, 6).alias("relevance"))
