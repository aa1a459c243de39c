"""What the operators of this subpackage share: tables, the shared folder, staged results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What Spark hands to a Python worker at once: texts can be long, and its own bound is 64 MB.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to ``ARROW_BYTES``, so that workers need little memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != f"{ARROW_BYTES}b":
        spark.conf.set(key, f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % mod, F.lit(0))


def drawn(hashed: Column, rate: Column) -> Column:
    """Whether a 64-bit hash falls to a sample of the given rate, however small the rate is."""
    return F.pmod(hashed, F.lit(1 << 52)).cast("double") < rate * float(1 << 52)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session names none (tests, a local master) is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if base is None:
        base = sc.getCheckpointDir()
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="plyset-")
            sc.setCheckpointDir(base)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage, survives lost executors and keeps a non-deterministic step from running twice.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged frames that no later step reads."""
    for df in frames:
        drop_folder(df.sparkSession, df.staged_at)


class Scratch:
    """Staged frames of one operator, deleted together when it has no more use for them."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.frames.append(staged(df, name))
        return self.frames[-1]

    def drop(self, *but: DataFrame) -> None:
        drop_staged(*(f for f in self.frames if all(f is not b for b in but)))
        self.frames = list(but)


def as_row(docs: DataFrame, *apart: str) -> Column:
    """All columns but ``apart`` as one struct, so that no column of a step's own can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in apart))


def without(docs: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` (a long) isn't in the staged frame ``bad`` (``key``); null keys stay.

    A Bloom filter of the bad keys lets most rows pass where they are; only those that it holds meet ``bad`` in a join.
    """
    from plyset.llm.bloom import key_filter

    tagged = docs.select(as_row(docs).alias("row"), key.alias("key"))
    tagged = tagged.withColumn("may", F.coalesce(key_filter(bad).column(F.coalesce("key", F.lit(0))) & F.col("key").isNotNull(), F.lit(False)))
    rest = tagged.filter("may").join(bad.select("key"), "key", "left_anti").select("row")
    return tagged.filter("not may").select("row").unionByName(rest).select("row.*")
