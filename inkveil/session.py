"""One place for the Spark settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "inkveil", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller passes its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("spark.driver.memory", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a table for each core below which ``spread`` deals it out.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table whose files give fewer partitions than there are cores, dealt over all cores before dear work on each
    row. A table that is large enough to be split by its files stays as it is: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df
