"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Session settings the Python-backed operators rely on.

    Arrow batches are bounded in rows and bytes, so a worker never holds more
    than a few MB of text at once, and workers can import this package when the
    driver found it through ``sys.path`` alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset on a local master, under the temporary folder."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a step as soon as the step is over, not at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: later steps neither recompute them nor depend on lost executors."""
    return Steps(df.sparkSession).put(df, name)


class Steps:
    """Tables of one operator's steps, in a new shared folder; those that nothing reads any more can go before its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.number, self.paths = spark, shared_dir(spark), 0, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.top}/{self.number}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that were put here."""
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                remove(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes the files of all other tables."""
        self.drop(*[t for t, _ in list(self.paths.values()) if all(t is not k for k in tables)])


#: Bytes of a table, as stored, for which a task is worth its start and its output file.
TASK_BYTES = 8 << 20


def compacted(df: DataFrame) -> DataFrame:
    """A table of many small partitions in fewer ones, merged without a shuffle; four tasks for each core stay in any case.

    The size is Spark's own estimate; where that is large or unknown, nothing is merged.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(size // TASK_BYTES, 4 * df.sparkSession.sparkContext.defaultParallelism), 2**31 - 1))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def top_bits(hashed: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash as a bucket number."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")
