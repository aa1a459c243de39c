"""Report by month how the sets of positions of several groups relate: sizes, overlap, inclusion, disjointness.

Who keeps sets checks them against each other: parts must be disjoint, one set must lie within another,
two must be equal. This job does so for all groups of a fact table at once, month by month. It reads
``lineitem`` and ``orders``, encodes each line as a position by the config's expressions, takes its group
from an expression over both tables, and writes one row for every two groups of a month.

Output is Parquet partitioned by ``month``, written with dynamic partition overwrite: a rerun for the
same months, also after a failure, replaces just those, and other months stay. ``--since`` and
``--until`` (months, both included) bound what is read; the bounds reach the scan as a filter of dates.

    spark-submit jobs/set_relations.py --lines PATH --orders PATH --out DIR [--since 1994-01] [--until 1994-12] [--config FILE]

Defined results: rows with a null date or group, or with a position outside the shape, count as
``skipped`` and belong to no set; repeated rows count once; a month with fewer than two groups has no rows.
"""

from __future__ import annotations

import argparse
import functools
import operator
import os
import sys

if __package__ in (None, ""):  # run as a script
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from plyset.operators.relations import relations
from plyset.shape import Shape
from plyset.storage import materialise

log = common.log.getChild("set_relations")
DEFAULT = "set_relations.json"
SCHEMA = "a string, b string, a_n long, b_n long, both_n long, either_n long, subset boolean, superset boolean, disjoint boolean, month string"


def placed(lines: DataFrame, orders: DataFrame, config: dict, since: str | None, until: str | None) -> DataFrame:
    """Month, group and slots of every line, and whether it is to be skipped."""
    shape, day = Shape(tuple(config["shape"])), F.col(config["date"])
    if since:
        lines = lines.filter(day >= F.to_timestamp_ntz(F.lit(f"{since}-01")))
    if until:
        lines = lines.filter(day < F.to_timestamp_ntz(F.add_months(F.to_date(F.lit(f"{until}-01")), 1).cast("string")))
    rows = lines.join(orders, F.expr(config["join"]), "left")
    slots = [F.expr(e).cast("int").alias(c) for e, c in zip(config["slots"], shape.columns)]
    rows = rows.select(F.date_format(day, "yyyy-MM").alias("month"), F.expr(config["group"]).cast("string").alias("group"), *slots)
    fits = functools.reduce(operator.and_, ((F.col(c) >= 0) & (F.col(c) < s) for c, s in zip(shape.columns, shape.sizes)), F.col("month").isNotNull() & F.col("group").isNotNull())
    return rows.withColumn("fits", F.coalesce(fits, F.lit(False)))


def run(spark: SparkSession, lines: str, orders: str, out: str, config: dict | None = None, since: str | None = None, until: str | None = None) -> dict[str, int]:
    """Write the months' relations under ``out``; returns counts of what was read and written."""
    config = config or common.config(None, DEFAULT)
    shape = Shape(tuple(config["shape"]))
    rows = placed(spark.read.parquet(lines), spark.read.parquet(orders), config, since, until)
    key = [F.when(F.col("fits"), F.col(c)).alias(c) for c in ("month", "group", *shape.columns)]
    # one pass over the tables: distinct positions with their lines, all that is skipped as one row
    held = materialise(rows.groupBy(*key).agg(F.count("*").alias("n")), "placed")
    told = held.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (("lines", F.col("n")), ("skipped", F.when(F.col("month").isNull(), F.col("n")))))).first().asDict()
    log.info("read %s and %s: %d lines, %d skipped", lines, orders, told["lines"], told["skipped"])
    found = relations(held.filter(F.col("month").isNotNull()), shape.columns, "group", ["month"])
    found.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(out)
    mine = state(spark, out)
    if since:
        mine = mine.filter(F.col("month") >= since)
    if until:
        mine = mine.filter(F.col("month") <= until)
    told |= mine.agg(F.count("*").alias("pairs"), F.countDistinct("month").alias("months")).first().asDict()
    log.info("wrote %s: %d pairs of groups in %d months", out, told["pairs"], told["months"])
    return told


def state(spark: SparkSession, out: str) -> DataFrame:
    return common.parquet_or_none(spark, out, SCHEMA)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--lines", "--orders", "--out"):
        parser.add_argument(name, required=True)
    for name in ("--since", "--until", "--config"):
        parser.add_argument(name)
    a = parser.parse_args(argv)
    spark = common.session("set_relations")
    try:
        run(spark, a.lines, a.orders, a.out, common.config(a.config, DEFAULT), a.since, a.until)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
