"""Sets of positions: a predicate over the universe, or rows; rows can stand for what they leave out.

* predicate sets cost nothing, whatever the universe: union, intersection, complement and
  ``change`` rewrite the predicate;
* row sets are DataFrames of distinct rows ``c0..cn`` (TINYINT, not null); ``negated`` makes them the
  complement of their rows, so that no complement is ever enumerated.

Operations choose the form: rows with a predicate become a filter, rows with rows set operations or
semi and anti joins on the slots. A result is enumerated only where asked, and only if its universe
has at most ``LIMIT`` positions.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.shape import Shape

LIMIT = 50_000_000


class PositionSet:
    def __init__(self, spark: SparkSession, shape: Shape, *, where: P.Predicate | None = None, rows: DataFrame | None = None, negated: bool = False):
        if (where is None) == (rows is None):
            raise ValueError("a set has either a predicate or rows")
        self.spark, self.shape = spark, shape
        self.where, self.rows, self.negated = (where if not negated else ~where, None, False) if where is not None else (None, rows, negated)

    # -- sources ------------------------------------------------------------------------------

    @classmethod
    def accept(cls, spark: SparkSession, shape: Shape) -> PositionSet:
        return cls(spark, shape, where=P.ALWAYS)

    @classmethod
    def reject(cls, spark: SparkSession, shape: Shape) -> PositionSet:
        return cls(spark, shape, where=P.NEVER)

    @classmethod
    def matching(cls, spark: SparkSession, shape: Shape, where: P.Predicate) -> PositionSet:
        return cls(spark, shape, where=where)

    @classmethod
    def fixed(cls, spark: SparkSession, shape: Shape, layer: int, char: int) -> PositionSet:
        return cls(spark, shape, where=P.fixed(shape, layer, char))

    @classmethod
    def count_character(cls, spark: SparkSession, shape: Shape, char: int, *bounds: int, **named: int) -> PositionSet:
        return cls(spark, shape, where=P.count_character(shape, char, *bounds, **named))

    @classmethod
    def count_pieces(cls, spark: SparkSession, shape: Shape, count: int) -> PositionSet:
        return cls(spark, shape, where=P.count_pieces(shape, count))

    @classmethod
    def from_strings(cls, spark: SparkSession, shape: Shape, positions: Iterable) -> PositionSet:
        checked = sorted({shape.check(p) for p in positions})
        if not checked:
            return cls.reject(spark, shape)
        return cls(spark, shape, rows=spark.createDataFrame(checked, shape.schema))

    @classmethod
    def from_string(cls, spark: SparkSession, shape: Shape, position) -> PositionSet:
        return cls.from_strings(spark, shape, [position])

    @classmethod
    def from_frame(cls, df: DataFrame, shape: Shape, distinct: bool = True) -> PositionSet:
        """Rows of a DataFrame whose columns are the slots in order; values are trusted to fit the shape, but a null fails."""
        refuse = F.raise_error(F.lit("a position has a null slot")).cast("tinyint")
        rows = df.select(*(F.coalesce(F.col(c).cast("tinyint"), refuse).alias(n) for c, n in zip(df.columns, shape.columns)))
        return cls(df.sparkSession, shape, rows=rows.distinct() if distinct else rows)

    # -- forms --------------------------------------------------------------------------------

    def _universe(self) -> DataFrame:
        if self.shape.universe > LIMIT:
            raise ValueError(f"a universe of {self.shape.universe} positions isn't enumerated")
        code = F.col("id")
        columns, below = [], 1
        for name, size in zip(self.shape.columns, self.shape.sizes):
            columns.append((F.floor(code / below) % size if below > 1 else code % size).cast("tinyint").alias(name))
            below *= size
        return self.spark.range(self.shape.universe).select(*(F.coalesce(c, F.lit(0).cast("tinyint")).alias(n) for c, n in zip(columns, self.shape.columns)))

    def frame(self) -> DataFrame:
        """The positions as rows."""
        if self.where is P.NEVER:
            return self.spark.createDataFrame([], self.shape.schema)
        if self.where is not None:
            return self._universe().filter(self.where.column(self._at))
        return self._universe().join(self.rows, self.shape.columns, "left_anti") if self.negated else self.rows

    @staticmethod
    def _at(layer: int):
        return F.col(f"c{layer}")

    def extensional(self) -> PositionSet:
        return PositionSet(self.spark, self.shape, rows=self.frame())

    def _same(self, other: PositionSet) -> None:
        if self.shape != other.shape:
            raise ValueError("sets of different shapes")

    def _rows(self, rows: DataFrame, negated: bool = False) -> PositionSet:
        return PositionSet(self.spark, self.shape, rows=rows, negated=negated)

    # -- algebra ------------------------------------------------------------------------------

    def __invert__(self) -> PositionSet:
        if self.where is not None:
            return PositionSet(self.spark, self.shape, where=~self.where)
        return self._rows(self.rows, not self.negated)

    inverse = __invert__

    def __and__(self, other: PositionSet) -> PositionSet:
        self._same(other)
        a, b = self, other
        if a is b or b.where is P.ALWAYS or a.where is P.NEVER:
            return a
        if a.where is P.ALWAYS or b.where is P.NEVER:
            return b
        if a.where is not None and b.where is not None:
            return PositionSet(self.spark, self.shape, where=a.where & b.where)
        if a.where is not None:
            a, b = b, a
        if b.where is not None:
            if not a.negated:
                return self._rows(a.rows.filter(b.where.column(self._at)))
            return self._rows(b.frame().join(a.rows, self.shape.columns, "left_anti"))
        if a.negated and b.negated:
            return self._rows(a.rows.union(b.rows).distinct(), True)
        if a.negated:
            a, b = b, a
        return self._rows(a.rows.join(b.rows, self.shape.columns, "left_anti" if b.negated else "left_semi"))

    def __or__(self, other: PositionSet) -> PositionSet:
        self._same(other)
        a, b = self, other
        if a is b or b.where is P.NEVER or a.where is P.ALWAYS:
            return a
        if a.where is P.NEVER or b.where is P.ALWAYS:
            return b
        if a.where is None and b.where is None and not a.negated and not b.negated:
            return self._rows(a.rows.union(b.rows).distinct())
        if a.where is not None and b.where is not None:
            return PositionSet(self.spark, self.shape, where=a.where | b.where)
        if a.where is not None:
            a, b = b, a
        if b.where is not None and not a.negated:
            return self._rows(b.frame().union(a.rows.filter(~b.where.column(self._at))))
        return ~(~a & ~b)

    def __sub__(self, other: PositionSet) -> PositionSet:
        return self & ~other

    def change(self, changes: dict[int, tuple[int, int]]) -> PositionSet:
        """Keep positions whose listed slots hold ``before``; write ``after`` there."""
        for layer, (before, after) in changes.items():
            if not (0 <= before < self.shape.layer(layer) and 0 <= after < self.shape.layer(layer)):
                raise ValueError("a change is out of the shape's range")
        if not changes:
            return self
        if self.where is not None:
            rest = self.where.given({i: b for i, (b, _) in changes.items()})
            return PositionSet(self.spark, self.shape, where=P.every([rest, *(P.fixed(self.shape, i, a) for i, (_, a) in changes.items())]))
        if self.negated:
            return PositionSet(self.spark, self.shape, where=P.ALWAYS).change(changes) - self._rows(self.rows).change(changes)
        kept = self.rows
        for layer, (before, _) in changes.items():
            kept = kept.filter(F.col(f"c{layer}") == before)
        written = {i: F.lit(a).cast("tinyint") for i, (_, a) in changes.items()}
        # one to one on what is kept, so no distinct
        return self._rows(kept.select(*(written.get(i, F.col(c)).alias(c) for i, c in enumerate(self.shape.columns))))

    # -- answers ------------------------------------------------------------------------------

    def size(self) -> int:
        if self.where is not None:
            sets = P.linear_sets(self.where, self.shape)
            if sets is not None:
                return functools.reduce(lambda n, s: n * len(s), sets, 1)
            return self.frame().count()
        n = self.rows.count()
        return self.shape.universe - n if self.negated else n

    def is_empty(self) -> bool:
        if self.where is None and not self.negated:
            return self.rows.isEmpty()
        return self.size() == 0

    def is_full(self) -> bool:
        return (~self).is_empty()

    def contains(self, position) -> bool:
        p = self.shape.check(position)
        if self.where is not None:
            return self.where.holds(p)
        test = functools.reduce(lambda a, b: a & b, (F.col(n) == c for n, c in zip(self.shape.columns, p)), F.lit(True))
        return self.rows.filter(test).isEmpty() == self.negated

    def contains_batch(self, others: PositionSet) -> PositionSet:
        """Those of ``others`` that this set holds."""
        return others & self

    def bound(self) -> list[set[int]]:
        """Per slot the characters in use."""
        if self.where is not None and (sets := P.linear_sets(self.where, self.shape)) is not None:
            return [set(s) for s in sets] if all(sets) else [set() for _ in sets]
        row = self.frame().select(*(F.collect_set(c).alias(c) for c in self.shape.columns)).first()
        return [set(row[c]) for c in self.shape.columns]

    def is_linear(self) -> bool:
        """Whether the set is a product of per-slot character sets."""
        if self.where is not None and P.linear_sets(self.where, self.shape) is not None:
            return True
        row = self.frame().select(F.count("*").alias("n"), *(F.size(F.collect_set(c)).cast("decimal(38,0)").alias(c) for c in self.shape.columns)).first()
        return row["n"] == functools.reduce(lambda a, c: a * int(row[c]), self.shape.columns, 1)

    def ordered(self) -> DataFrame:
        return self.frame().orderBy(*self.shape.columns)

    def first(self, k: int) -> DataFrame:
        """The k smallest positions in lexicographic order."""
        return self.ordered().limit(k)

    def __iter__(self):
        return (tuple(r) for r in self.ordered().toLocalIterator())

    def fingerprint(self) -> str:
        """A content hash: equal sets in the same form have equal ones, whatever the order of rows."""
        if self.where is not None:
            return PositionSet(self.spark, self.shape, rows=self.frame()).fingerprint()
        h = F.xxhash64(*self.shape.columns)
        row = self.rows.select(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *self.shape.columns))).first()
        return hashlib.sha256(repr((self.shape.sizes, self.negated, *(str(v) for v in row))).encode()).hexdigest()

    def equals(self, other: PositionSet) -> bool:
        return (self - other).is_empty() and (other - self).is_empty()

    def subset_of(self, other: PositionSet) -> bool:
        return (self - other).is_empty()

    def disjoint(self, other: PositionSet) -> bool:
        return (self & other).is_empty()

    def view(self, name: str) -> None:
        """Offer the positions to Spark SQL."""
        self.frame().createOrReplaceTempView(name)

    def __str__(self) -> str:
        form = "predicate" if self.where is not None else "co-finite rows" if self.negated else "rows"
        return f"PositionSet({self.shape.sizes}, {form})"


def bound_within(a: list[set[int]], b: list[set[int]]) -> bool:
    """Whether one set's bound lies within another's; positions outside a bound can't be in a set."""
    return all(x <= y for x, y in zip(a, b))


def intersection(spark: SparkSession, shape: Shape, sets: list[PositionSet]) -> PositionSet:
    """All of none is the universe. Predicates are joined first and filter the rows once; plain rows meet before complements."""
    predicate = P.every([s.where for s in sets if s.where is not None])
    rows = sorted((s for s in sets if s.where is None), key=lambda s: s.negated)
    return functools.reduce(lambda a, b: a & b, rows, PositionSet(spark, shape, where=predicate))


def union(spark: SparkSession, shape: Shape, sets: list[PositionSet]) -> PositionSet:
    """Of none: nothing. Plain rows are appended and made distinct once."""
    plain = [s.rows for s in sets if s.where is None and not s.negated]
    rest = [s for s in sets if s.where is not None or s.negated]
    out = PositionSet(spark, shape, where=P.some([s.where for s in rest if s.where is not None]))
    if plain:
        out = out | PositionSet(spark, shape, rows=functools.reduce(DataFrame.union, plain).distinct())
    return functools.reduce(lambda a, b: a | b, (s for s in rest if s.where is None), out)
