"""Change logs shipped as packages, one a micro-batch, and results that are made anew only when their input's version moved.

A package is a partition of a batch's net changes: rows to put (by table), keys to delete, and a manifest that is written last. Its
name follows from the batch, so a batch that runs again after a failure writes the same partition over, and one without a manifest
is none. A change of a key is a delete of the old one and a put of the new one. An epoch that rises says that everything before it is
void.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.relational import latest

#: What a change log's rows are: op is insert, update or delete; keys are JSON objects, old_key only where an update changed it.
CHANGES = "seq long, epoch long, table string, op string, key string, old_key string, row string, owner string, parent string"
_ENTRY = "seq long, key string, owner string, parent string, row string, package string, deleted boolean, table string"
_MANIFEST = "source string, package string, epoch long, from_seq long, to_seq long, puts long, deletes long"


def canonical_key(key: Column) -> Column:
    """A key's JSON with its members in order of their names, so that two spellings of one key are equal."""
    pairs = F.array_sort(F.map_entries(F.from_json(key, "map<string, string>")))
    return F.to_json(F.map_from_entries(pairs))


def net_entries(changes: DataFrame) -> DataFrame:
    """seq, table, key, owner, parent, row (null: delete): the last word on each key; older epochs than the newest go first."""
    newest = changes.groupBy().agg(F.max("epoch").alias("__e"))
    live = changes.join(F.broadcast(newest), F.col("epoch") == F.col("__e"))  # one row
    key, old = canonical_key(F.col("key")), canonical_key(F.col("old_key"))
    put = F.struct(key.alias("key"), F.when(F.col("op") != "delete", F.col("row")).alias("row"), F.lit(1).alias("step"))
    moved = F.when(old.isNotNull() & (old != key), F.struct(old.alias("key"), F.lit(None).cast("string").alias("row"), F.lit(0).alias("step")))
    each = live.select("seq", "table", "owner", "parent", F.explode(F.filter(F.array(moved, put), lambda x: x.isNotNull())).alias("e")).select("seq", "table", "owner", "parent", "e.*")
    return latest(each, ["table", "key"], F.desc("seq"), F.desc("step")).select("seq", "table", "key", "owner", "parent", "row")


def package_name(source: str, epoch: int, from_seq: int, to_seq: int, number: int) -> str:
    return f"{source}-{epoch}-{from_seq}-{to_seq}-{hashlib.sha256(f'{source}/{number}'.encode()).hexdigest()[:8]}"


def write_package(changes: DataFrame, root: str, source: str, number: int) -> str | None:
    """The package of batch `number`, or None if it holds no change."""
    told = changes.agg(F.max("epoch"), F.min("seq"), F.max("seq")).head()
    if told[0] is None:
        return None
    name = package_name(source, *told, number)
    entries = net_entries(changes).withColumn("deleted", F.col("row").isNull())
    entries.write.mode("overwrite").partitionBy("deleted", "table").json(f"{root}/entries/package={name}")
    spark = changes.sparkSession
    written = spark.read.schema(_ENTRY).json(f"{root}/entries").where(F.col("package") == name).agg(F.count_if(~F.col("deleted")).alias("puts"), F.count_if("deleted").alias("deletes"))
    row = written.select(F.lit(source).alias("source"), F.lit(name).alias("package"), *[F.lit(v).alias(c) for c, v in zip(("epoch", "from_seq", "to_seq"), told, strict=True)], "puts", "deletes")
    row.coalesce(1).write.mode("overwrite").json(f"{root}/manifests/of={name}")
    return name


def packaged(stream: DataFrame, root: str, source: str, checkpoint: str) -> Any:
    """Starts the writing of a stream of CHANGES, one package a micro-batch, up to what is there now."""
    put = lambda batch, number: write_package(batch, root, source, number) and None
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The packages that are whole."""
    return spark.read.schema(_MANIFEST).json(f"{root}/manifests/*")


def applied(spark: SparkSession, root: str, table: str, row: str) -> DataFrame:
    """seq, key and the members of `row` (a schema) of a table's rows once all whole packages of the newest epoch are applied. The
    order of packages is that of their changes, so one that is applied twice, or late, does no harm."""
    whole = manifests(spark, root)
    newest = whole.agg(F.max("epoch").alias("__e"))
    usable = whole.join(F.broadcast(newest), F.col("epoch") == F.col("__e")).select("package")
    entries = spark.read.schema(_ENTRY).json(f"{root}/entries").where(F.col("table") == table)
    named = entries.join(F.broadcast(usable), "package", "left_semi")  # a package is one row
    last = latest(named, ["key"], F.desc("seq")).where("NOT deleted")
    return last.select("seq", "key", F.from_json("row", row).alias("r")).select("seq", "key", "r.*")


_VERSIONS = "name string, epoch long, seq long, path string"


def versioned(spark: SparkSession, store: str, name: str, epoch: int, seq: int, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """What `make` gives for a version of its input, and whether it was made now.

    A table of versions in `store` tells which results exist. One made for the same (epoch, seq) is read; any other version is
    made, written and then entered, so a result that was not finished is never read. Numbers that come again after a reset belong
    to another epoch.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions")
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    hits = spark.read.schema(_VERSIONS).parquet(f"{store}/versions").where((F.col("name") == name) & (F.col("epoch") == epoch) & (F.col("seq") == seq)).select("path").take(1) if known else []
    if hits:
        return spark.read.parquet(hits[0].path), False
    at = f"{store}/results/{hashlib.sha256(name.encode()).hexdigest()[:16]}-{epoch}-{seq}"
    make().write.mode("overwrite").parquet(at)
    spark.createDataFrame([(name, epoch, seq, at)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{store}/versions")
    return spark.read.parquet(at), True
