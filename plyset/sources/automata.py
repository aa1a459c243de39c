"""Automata kept in a shared folder: states by id, so that sets with common rests store them once.

``states/<save>/layer=<i>`` holds the states that a save brought along, ``roots`` one row for each
binding of a name (the latest wins). A state's id hashes what it leads to, so a root tells the whole
set, equal sets have equal roots, and a state that any earlier save stored isn't stored again. States
are written before the root is bound: a save that broke off leaves states that the next vacuum removes.
One writer at a time; readers may read while states are added.
"""

from __future__ import annotations

import functools
import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.operators.automaton import ACCEPT, REJECT, Automaton
from plyset.shape import Shape

ROOTS = "name string, root string, shape array<int>, at double"
STATES = "state string, next array<string>, layer int"


class AutomatonStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _of(self, shape: Shape) -> str:
        """Ids don't tell how many slots are left, so each shape has a folder of its own."""
        return f"{self.folder}/states/{hashlib.sha256(repr(shape.sizes).encode()).hexdigest()[:16]}"

    def _saves(self, shape: Shape) -> list[str]:
        base = self._of(shape)
        if not self._exists(base):
            return []
        fs, p = self._fs(base)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return [f"{base}/{n}" for n in names if self._exists(f"{base}/{n}/_SUCCESS")]

    def states(self, shape: Shape) -> DataFrame:
        """All stored states of a shape: ``state``, ``next``, ``layer``."""
        saves = self._saves(shape)
        if not saves:
            return self.spark.createDataFrame([], STATES)
        read = [self.spark.read.schema(STATES).parquet(path) for path in saves]
        return functools.reduce(DataFrame.union, read).dropDuplicates(["layer", "state"])

    def roots(self) -> DataFrame:
        """The current bindings."""
        if not self._exists(f"{self.folder}/roots"):
            return self.spark.createDataFrame([], ROOTS)
        best = self.spark.read.schema(ROOTS).parquet(f"{self.folder}/roots").groupBy("name").agg(F.max(F.struct("at", "root", "shape")).alias("b"))
        return best.select("name", "b.root", "b.shape", "b.at").filter(F.col("root") != "")

    def _bind(self, name: str, root: str, shape: Shape) -> None:
        self.spark.createDataFrame([(name, root, list(shape.sizes), time.time())], ROOTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/roots")

    def _write(self, rows: DataFrame, shape: Shape) -> None:
        rows.write.partitionBy("layer").parquet(f"{self._of(shape)}/{uuid.uuid4().hex}")

    def save(self, a: Automaton, name: str) -> str:
        """Store what isn't there yet and bind the name; returns the root."""
        rows = [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(a.layers)]
        if rows and a.root not in (REJECT, ACCEPT):
            new = functools.reduce(DataFrame.union, rows).join(self.states(a.shape), ["layer", "state"], "left_anti")
            self._write(new.select("state", "next", "layer"), a.shape)
        self._bind(name, a.root, a.shape)
        return a.root

    def load(self, name_or_root: str) -> Automaton:
        """The automaton of a name, or of a root that some name is bound to."""
        row = self.roots().filter((F.col("name") == name_or_root) | (F.col("root") == name_or_root)).orderBy(F.desc(F.col("name") == name_or_root), F.desc("at")).first()
        if row is None:
            raise KeyError(name_or_root)
        shape = Shape(tuple(row["shape"]))
        states = self.states(shape)
        layers = [states.filter(F.col("layer") == i).select("state", "next") for i in range(len(shape))]
        return Automaton(self.spark, shape, row["root"], layers)._reached()

    def unbind(self, name: str) -> None:
        row = self.roots().filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        self._bind(name, "", Shape(tuple(row["shape"])))

    def vacuum(self) -> dict[str, int]:
        """Remove the states that no bound root leads to. What stays is written anew before anything is deleted."""
        told = {"before": 0, "after": 0}
        bound = [(Shape(tuple(r["shape"])), r["root"]) for r in self.roots().select("shape", "root").distinct().collect()]
        known = self.spark.read.schema(ROOTS).parquet(f"{self.folder}/roots").select("shape").distinct().collect() if self._exists(f"{self.folder}/roots") else []
        for shape in {Shape(tuple(r["shape"])) for r in known}:
            old, states = self._saves(shape), self.states(shape)
            if not old:
                continue
            told["before"] += states.count()
            now = self.spark.createDataFrame([(r,) for s, r in bound if s == shape] or [], "state string")
            kept = []
            for i in range(len(shape)):
                layer = states.filter(F.col("layer") == i).join(now, "state", "left_semi").select("state", "next", "layer")
                kept.append(layer)
                now = layer.select(F.explode("next").alias("state")).distinct()
            whole = functools.reduce(DataFrame.union, kept)
            self._write(whole, shape)
            for path in old:
                fs, p = self._fs(path)
                fs.delete(p, True)
            told["after"] += self.states(shape).count()
        return told
