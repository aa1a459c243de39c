"""A catalog of sets in a shared folder: Parquet by content hash, names as rows that point to hashes.

``by_hash/<fingerprint>`` holds rows, ``names`` one small Parquet file per binding (the latest wins,
so replacing a name never touches a stored set). Writing is idempotent: a set that is there already
is not written again, and a half-written one has no ``_SUCCESS`` and is not found.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.operators.positions import PositionSet
from plyset.shape import Shape

NAMES = "name string, fingerprint string, shape array<int>, negated boolean, at double"


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def names(self) -> DataFrame:
        """The current bindings."""
        if not self._exists(f"{self.root}/names"):
            return self.spark.createDataFrame([], NAMES)
        rows = self.spark.read.schema(NAMES).parquet(f"{self.root}/names")
        best = rows.groupBy("name").agg(F.max(F.struct("at", "fingerprint", "shape", "negated")).alias("b"))
        return best.select("name", "b.fingerprint", "b.shape", "b.negated", "b.at")

    def save(self, s: PositionSet, name: str | None = None) -> str:
        """Store a set by content, bind a name to it; returns the fingerprint."""
        if s.where is not None:
            s = s.extensional()
        key = s.fingerprint()
        path = f"{self.root}/by_hash/{key}"
        if not self._exists(f"{path}/_SUCCESS"):
            s.rows.write.mode("overwrite").parquet(path)
        row = [(name if name is not None else f"#{key}", key, list(s.shape.sizes), s.negated, time.time())]
        self.spark.createDataFrame(row, NAMES).coalesce(1).write.mode("append").parquet(f"{self.root}/names")
        return key

    def _load(self, test) -> PositionSet:
        row = self.names().filter(test).orderBy(F.desc("at")).first()
        if row is None:
            raise KeyError("no such set")
        path = f"{self.root}/by_hash/{row.fingerprint}"
        if not self._exists(f"{path}/_SUCCESS"):
            raise KeyError(f"the set {row.fingerprint} isn't there any more")
        shape = Shape(tuple(row["shape"]))
        return PositionSet(self.spark, shape, rows=self.spark.read.schema(shape.schema).parquet(path), negated=row.negated)

    def load_by_name(self, name: str) -> PositionSet:
        return self._load(F.col("name") == name)

    def load_by_hash(self, fingerprint: str) -> PositionSet:
        return self._load(F.col("fingerprint") == fingerprint)

    def get(self, hash_or_name: str) -> PositionSet:
        """Something as long as a hash is tried as one first."""
        if len(hash_or_name) == 64:
            try:
                return self.load_by_hash(hash_or_name)
            except KeyError:
                pass
        return self.load_by_name(hash_or_name)

    def load_or_build(self, name: str, build: Callable[[], PositionSet]) -> PositionSet:
        """The set of that name, built and saved if there is none."""
        try:
            return self.load_by_name(name)
        except KeyError:
            self.save(build(), name)
            return self.load_by_name(name)

    def vacuum(self) -> list[str]:
        """Delete stored sets that no name points to; returns their fingerprints."""
        if not self._exists(f"{self.root}/by_hash"):
            return []
        bound = {r.fingerprint for r in self.names().filter(~F.col("name").startswith("#")).select("fingerprint").distinct().collect()}
        fs, base = self._fs(f"{self.root}/by_hash")
        gone = []
        for status in fs.listStatus(base):
            key = status.getPath().getName()
            if key not in bound:
                fs.delete(status.getPath(), True)
                gone.append(key)
        return sorted(gone)


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
