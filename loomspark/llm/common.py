"""What the training-data operators share: table access, the shared folder, text defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds at once while a table is staged; texts can be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="loomspark-")
    return _local[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: its lineage is cut, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing lazy reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that every executor can hold, and so may be broadcast: 2 million take some 100 MB at most.
SMALL_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its rows are counted to be few; beyond that a join shuffles as usual."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def drop_shuffles(spark: SparkSession) -> None:
    """Lets the driver's JVM notice finished shuffles, so that their files go before the next stage writes its own."""
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and a column that names each row: the id where ids are unique, else a number written down beside the rows."""
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs, id_col
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
