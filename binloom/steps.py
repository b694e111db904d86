"""Tables that cut the lineage of operators with several steps, and folders for files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has gone; nothing that can still be done at exit
        pass


def folder(spark: SparkSession, what: str = "steps") -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, deleted when the driver's Python ends. Only a local session, as in tests, gets a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='binloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/binloom/{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path, before = folder(spark), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "at") -> DataFrame:
    """``df`` with each row's place in an order, from 0: a range-partitioned sort, and for each partition the number of rows before it."""
    rows = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _delete(t.sparkSession, path)
