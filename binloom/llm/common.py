"""Helpers shared by the training-data operators: tables, scratch space, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regex of a white-space separated word, and of the space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session, as in tests, gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='binloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has gone; nothing that can still be done at exit
        pass


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/binloom/{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def drop_scratch(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:  # one folder
        _delete(df.sparkSession, path)


#: Shuffle files of an execution go when it ends, instead of whenever the driver's JVM next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back. Survives lost executors."""
    spark = df.sparkSession
    path, before = scratch_path(spark, what), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one row in this many; so there are fewer hot keys than this.
HOT_SHARE = 256


def join_hot(rows: DataFrame, per_key: DataFrame, on: list[str], count: str, total: float, how: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row a key and the rows of that key in ``count``.

    Of ``total`` rows, keys with more than one in HOT_SHARE are fewer than HOT_SHARE, whatever the input, so their side
    is broadcast and their rows stay where they are; all other keys are joined as usual, or by the strategy ``how`` at every size.
    """
    is_hot = F.col(count) > total / HOT_SHARE
    values = [c for c in per_key.columns if c not in on and c != count]
    hot = F.broadcast(per_key.where(is_hot).drop(count).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, on, "left")
    cold = per_key.where(~is_hot).drop(count)
    rest = marked.where("_hot is null").drop("_hot", *values).join(cold.hint(how) if how else cold, on)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, also where ``body`` names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def own_columns(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns; one that the table lacks becomes null, others (whatever their names) are put aside."""
    have = {c: None for c in df.columns}
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in wanted])


LONG, STR, INT, DBL, BOOL, BIN = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
