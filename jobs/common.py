"""What the jobs share: the command line's session, the config, and a log."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(path: str | None, default: str) -> dict:
    """A JSON file on the driver's side; without one, the file beside the job."""
    return json.loads(Path(path or Path(__file__).with_name(default)).read_text())


def session(name: str) -> SparkSession:
    """For the command lines alone; master and settings come from spark-submit."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and not fs.getFileStatus(p).isDirectory()


def parquet_or_none(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A Parquet folder with its schema; an empty frame where there is none yet."""
    return spark.read.schema(schema).options(**options).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
