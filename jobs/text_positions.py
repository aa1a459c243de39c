"""Keep the set of positions that a growing collection of texts occupies, and how many texts hold each.

A set engine's user who collects records day by day wants three things of it: the set of all positions
met so far, which of them are new, and which lie outside the set that the rules allow. This job does
that for a text table. Each text becomes a position: one slot for each measure of the config (a class
of its length, its share of digits, its language, ...), all by Spark's own functions over whole texts.

It is incremental: a file stream with ``availableNow`` takes the files that the checkpoint doesn't know,
a batch of files at a time. A batch writes two folders under ``out``, partitioned by the first slot:

* ``counts/batch=k``: the batch's positions with their number of texts;
* ``seen/batch=k``: those of them that no earlier batch has (a set difference), and whether the rules
  allow them (a predicate set).

A batch that is run again after a failure replaces its own folders and reads earlier batches only, so
it gives the same files. ``state`` reads the whole ledger: positions, counts, allowed or not.

    spark-submit jobs/text_positions.py --input DIR --out DIR --checkpoint DIR [--config FILE]

Defined results: a null text is an empty one; a share of an empty text is 0; values that the config
doesn't list are class 0; repeated rows count again; no new files write nothing.
"""

from __future__ import annotations

import argparse
import functools
import operator
import os
import sys

if __package__ in (None, ""):  # run as a script
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from plyset.functions import predicates as P
from plyset.operators.positions import PositionSet
from plyset.shape import Shape

log = common.log.getChild("text_positions")
DEFAULT = "text_positions.json"


def without(runs: str) -> Column:
    """Characters that are left of the text without these; whole runs go at once, which costs a fraction of translating each character."""
    return F.char_length(F.regexp_replace("text", f"{runs}+", ""))


#: What a slot can measure of a text, in characters or counts.
MEASURES = {
    "chars": lambda: F.char_length("text"),
    "words": lambda: F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")),
    "lines": lambda: without(r"[^\n]") + 1,
    "digits": lambda: without("[^0-9]"),
    "capitals": lambda: without("[^A-Z]"),
    "other": lambda: without("[A-Za-z0-9 ]"),
}


def slot_of(slot: dict) -> Column:
    """A slot's character: the place of a column's value in a list, or how many bounds a measure (or its share in thousandths) reaches.

    Measures are columns ``_chars`` and so on (see ``measured``).
    """
    if "values" in slot:
        listed = F.array_position(F.array(*map(F.lit, slot["values"])), F.col(slot["column"]).cast("string"))
        return F.coalesce(listed, F.lit(0)).cast("tinyint")
    value = F.col(f"_{slot['measure']}")
    if "per" in slot:
        whole = F.col(f"_{slot['per']}")
        value = F.when(whole > 0, F.floor(value * 1000 / whole)).otherwise(0)
    return functools.reduce(operator.add, ((value >= b).cast("int") for b in slot["bounds"]), F.lit(0)).cast("tinyint")


def measured(texts: DataFrame, config: dict) -> DataFrame:
    """The columns that slots list, and each measure that they need, taken once of each text."""
    named = texts.withColumn("text", F.coalesce(F.col(config["text"]).cast("string"), F.lit("")))
    listed = dict.fromkeys(s["column"] for s in config["slots"] if "values" in s)
    needed = dict.fromkeys(s[k] for s in config["slots"] for k in ("measure", "per") if k in s)
    return named.select(*listed, *(MEASURES[m]().cast("long").alias(f"_{m}") for m in needed))


def shape_of(config: dict) -> Shape:
    return Shape(tuple(len(s["values"] if "values" in s else s["bounds"]) + 1 for s in config["slots"]))


def allowed(config: dict) -> P.Predicate:
    """One of the rules holds: each lists, for some slots, the characters it allows."""
    shape, at = shape_of(config), {s["name"]: i for i, s in enumerate(config["slots"])}
    return P.some([P.every([P.some([P.fixed(shape, at[name], c) for c in chars]) for name, chars in rule.items()]) for rule in config["rules"]])


def positions(texts: DataFrame, config: dict) -> DataFrame:
    """The positions of the texts and the number of texts at each."""
    slots = [slot_of(s).alias(c) for s, c in zip(config["slots"], shape_of(config).columns)]
    return measured(texts, config).select(*slots).groupBy(*shape_of(config).columns).agg(F.count("*").alias("texts"))


def _schema(config: dict, last: str) -> str:
    return ", ".join(f"{c} tinyint" for c in shape_of(config).columns) + f", {last}, batch long"


def _held(spark: SparkSession, out: str, kind: str, config: dict) -> DataFrame:
    schema = _schema(config, "texts long" if kind == "counts" else "allowed boolean")
    return common.parquet_or_none(spark, f"{out}/{kind}", schema)


def write_batch(batch: DataFrame, k: int, out: str, config: dict) -> None:
    spark, shape = batch.sparkSession, shape_of(config)
    first = shape.columns[0]
    own = f"{out}/counts/batch={k}"
    positions(batch, config).write.mode("overwrite").partitionBy(first).parquet(own)
    fresh = PositionSet.from_frame(_held(spark, out, "counts", config).filter(F.col("batch") == k).select(*shape.columns), shape, distinct=False)
    earlier = PositionSet.from_frame(_held(spark, out, "seen", config).filter(F.col("batch") < k).select(*shape.columns), shape, distinct=False)
    new = (fresh - earlier).frame().withColumn("allowed", allowed(config).column(lambda i: F.col(shape.columns[i])))
    new.write.mode("overwrite").partitionBy(first).parquet(f"{out}/seen/batch={k}")
    log.info("batch %d: wrote %s and %s", k, own, f"{out}/seen/batch={k}")


def state(spark: SparkSession, out: str, config: dict) -> DataFrame:
    """The ledger as it stands: every position met, its number of texts, and whether the rules allow it."""
    names = shape_of(config).columns
    counts = _held(spark, out, "counts", config).groupBy(*names).agg(F.sum("texts").alias("texts"))
    return _held(spark, out, "seen", config).drop("batch").join(counts, names)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take what is new in ``source`` (a Parquet folder or file) into the ledger at ``out``; returns what was read and done."""
    config = config or common.config(None, DEFAULT)
    needed = list(dict.fromkeys([config["text"], *(s["column"] for s in config["slots"] if "column" in s)]))
    schema = spark.read.parquet(source).select(*needed).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"])
    if common.is_file(spark, source):  # a stream reads folders
        folder, name = source.rsplit("/", 1)
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, k: write_batch(batch, k, out, config))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p.numInputRows > 0]
    told = {"read_rows": sum(p.numInputRows for p in done), "batches": len(done)}
    now = state(spark, out, config)
    told |= now.agg(F.count("*").alias("positions"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.count(F.when(~F.col("allowed"), 1)).alias("not_allowed")).first().asDict()
    log.info("read %s: %d new rows in %d batches; %s holds %d positions of %d texts, %d positions not allowed", source, told["read_rows"], told["batches"], out, told["positions"], told["texts"], told["not_allowed"])
    return told


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--input", required=True, help="folder of Parquet files that grows")
    parser.add_argument("--out", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--config")
    a = parser.parse_args(argv)
    spark = common.session("text_positions")
    try:
        run(spark, a.input, a.out, a.checkpoint, common.config(a.config, DEFAULT))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
