"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here takes it: a run of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, lower: bool = False) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    text = F.coalesce(text, F.lit(""))
    if lower:
        text = ascii_lower(text)
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() also maps other letters, so it serves texts without any non-ASCII byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small, by rows and by bytes, in what this session runs from here on: plans that are returned
    run later. Smaller settings stay."""
    spark.conf.set(_ROWS, str(min(rows, int(spark.conf.get(_ROWS)))))
    spark.conf.set(_BYTES, str(32 << 20))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows in what is run inside."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine does in a
    session that runs on this machine alone; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "inkveil-checkpoints")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


#: Lets Spark drop the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Queries that end inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Tables that ``stored`` wrote, innermost scope last; those of no scope go when this process ends.
_scopes: list[list[tuple]] = [[]]


def _remove(tables: list[tuple]) -> None:
    """Deletes tables; the file system tells of folders that are gone already by False."""
    while tables:
        path, conf = tables.pop()
        path.getFileSystem(conf).delete(path, True)


def _remove_last() -> None:
    from py4j.protocol import Py4JError

    try:
        _remove(_scopes[0])
    except (Py4JError, OSError):  # Spark's JVM has ended before this process
        _scopes[0].clear()


atexit.register(_remove_last)


@contextlib.contextmanager
def scratch():
    """Tables that ``stored`` writes inside are deleted at its end: for work whose result is written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        _remove(_scopes.pop())


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Writes a table into the shared folder and reads it again: columnar, compressed, survives lost executors. The shuffle
    files behind it go when it is written; they would stay until the driver happens to collect its garbage. The table itself
    goes with the scope it was written in (``scratch``), outer: with the one around it, or with this process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkveil-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    _scopes[-2 if outer and len(_scopes) > 1 else -1].append((jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    with shuffles_cleaned(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined_split(rows: DataFrame, counts: DataFrame, key: str, by: list[str], least: int, most_hot: int = 10_000) -> DataFrame:
    """The rows whose key is in counts (key, n, ...), with its columns; the rows of a hot key are dealt, by the hash of some of
    their columns, over tasks of about least rows. No more than most_hot keys are hot: their list is broadcast."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    bound = max(least, total // most_hot)
    hot = counts.where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("_c"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_c")).cast("int"), F.lit(0))).drop("_c")
    dealt = counts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_c"), F.lit(1)) - 1))).drop("_c")
    return salted.join(dealt, [key, "_salt"]).drop("_salt")
