"""Evidence of objects that move to a public library: foreign entries point at new sources and elements of that library's own.

Entries of every object are rows for the time of the rewrite: they meet what is known of their sources and elements in joins, and go
back to their object in the order they had. Names of new rows follow from their content, so a second run makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How new rows are named, and what an entry without an excerpt quotes.
SOURCE_PREFIX, ELEMENT_PREFIX, TITLE_PREFIX = "src-promo-", "el-promo-", "收录自："
EXCERPT, PLAIN_TYPE = 500, "paragraph"
ENTRY = "source_id string, element_id string, quoted_span string, source_title string, element_type string, location_label string, origin_source_id string, origin_notebook_id string"


def _named(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *parts)))


def promoted(objects: DataFrame, library: str, own: DataFrame, private: DataFrame, live: DataFrame, notebooks: DataFrame, fallback: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects (id, evidence, rewritten, dropped), new sources (id, title) and new elements (id, source_id, element_type,
    location_label, text, origin_source_id, origin_element_id, origin_notebook_id).

    objects: id and evidence, an array of structs with the members of ENTRY. Entries of the library's own sources (own: source_id) stay
    as they are, and so do nulls. Entries of private sources (private: source_id) go. The text of another entry is that of its live
    element (live: element_id, source_id, text), if that belongs to the source it names, else its excerpt; without text it goes. All
    entries of one source share a new one, and of entries that make the same source or element the first, by object and place,
    lends its title, type and label. notebooks (source_id, notebook) tells where a source is from. Ids in own, private, live and
    notebooks are each there once.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = objects.select("id", F.posexplode("evidence").alias("pos", "e"))
    rows = rows.withColumns({"s": F.coalesce("e.source_id", F.lit("")), "k": F.coalesce("e.element_id", F.lit(""))})
    known = rows.join(own.select(F.col("source_id").alias("s"), F.lit(True).alias("is_own")), "s", "left").join(private.select(F.col("source_id").alias("s"), F.lit(True).alias("is_private")), "s", "left")
    known = known.join(live.select(F.col("element_id").alias("k"), F.col("source_id").alias("live_source"), F.col("text").alias("live_text")), "k", "left").join(notebooks.select(F.col("source_id").alias("s"), "notebook"), "s", "left")
    now = F.when((F.col("k") != "") & (F.col("live_source") == F.col("s")), blank("live_text")).otherwise("")
    text = F.coalesce(F.nullif(now, F.lit("")), blank("e.quoted_span"))
    stays = F.col("e").isNull() | F.coalesce("is_own", F.lit(False))
    told = known.withColumns({"stays": stays, "text": text, "gone": ~stays & (F.coalesce("is_private", F.lit(False)) | (text == ""))})
    source = _named(SOURCE_PREFIX, F.lit(library), F.col("s"))
    named = told.withColumn("source", source).withColumn("element", _named(ELEMENT_PREFIX, F.col("source"), F.col("k"), F.col("text")))
    named = named.withColumn("origin", F.coalesce(F.nullif(blank("notebook"), F.lit("")), F.lit(fallback)))
    entry = F.struct(
        F.col("source").alias("source_id"), F.col("element").alias("element_id"), F.coalesce(F.nullif(blank("e.quoted_span"), F.lit("")), F.left("text", F.lit(EXCERPT))).alias("quoted_span"),
        *[F.col(f"e.{c}").alias(c) for c in ("source_title", "element_type", "location_label")], F.col("s").alias("origin_source_id"), F.col("origin").alias("origin_notebook_id"),
    )
    kept = named.where("NOT gone").select("id", "pos", F.when(F.col("stays"), F.col("e")).otherwise(entry).alias("e"))
    back = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("__e"))
    tally = named.groupBy("id").agg(F.count_if(~F.col("stays") & ~F.col("gone")).alias("rewritten"), F.count_if("gone").alias("dropped"))
    empty = F.array().cast(objects.schema["evidence"].dataType)
    whole = objects.select("id").join(back, "id", "left").join(tally, "id", "left").select("id", F.coalesce("__e", empty).alias("evidence"), F.coalesce("rewritten", F.lit(0)).alias("rewritten"), F.coalesce("dropped", F.lit(0)).alias("dropped"))
    fresh = named.where("NOT stays AND NOT gone")
    at = F.struct("id", "pos")
    sources = fresh.groupBy(F.col("source").alias("id")).agg(F.min_by(blank("e.source_title"), at).alias("title")).select("id", F.concat(F.lit(TITLE_PREFIX), "title").alias("title"))
    first = F.min_by(F.struct(F.col("source").alias("source_id"), F.coalesce(F.nullif(blank("e.element_type"), F.lit("")), F.lit(PLAIN_TYPE)).alias("element_type"), blank("e.location_label").alias("location_label"), "text", F.col("s").alias("origin_source_id"), F.col("k").alias("origin_element_id"), F.col("origin").alias("origin_notebook_id")), at)
    return whole, sources, fresh.groupBy(F.col("element").alias("id")).agg(first.alias("r")).select("id", "r.*")
