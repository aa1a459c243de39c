"""Othello on W x H (both even): all discs enclosed in any direction turn; one passes only if one can't place.

A placement turns discs in up to eight directions independently, so a rule for each combination would
be their product. Each direction and length is one row instead; rows of one placement are grouped.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.functions.board import DIAGONAL, STRAIGHT, ray, show_rows
from plyset.plans.game import Game
from plyset.plans.moves import MEETS
from plyset.shape import Shape


class Othello(Game):
    def __init__(self, width: int, height: int):
        if width % 2 or height % 2:
            raise ValueError("othello boards have even sides")
        self.width, self.height = width, height
        self.name, self.shape = f"othello_{width}x{height}", Shape((3,) * (width * height))

    def initial(self):
        w, h = self.width, self.height
        p = [0] * (w * h)
        x, y = w // 2 - 1, h // 2 - 1
        p[y * w + x] = p[(y + 1) * w + x + 1] = 2
        p[y * w + x + 1] = p[(y + 1) * w + x] = 1
        return tuple(p)

    @lru_cache(maxsize=None)  # noqa: B019
    def turns(self) -> list[tuple[int, tuple[int, ...], int]]:
        """(placed on, discs turned, own disc at the far end)"""
        out = []
        for y in range(self.height):
            for x in range(self.width):
                for dx, dy in STRAIGHT + DIAGONAL:
                    way = [b * self.width + a for a, b in ray(x, y, dx, dy, self.width, self.height)]
                    out += [(y * self.width + x, tuple(way[:k]), way[k]) for k in range(1, len(way))]
        return out

    def can_place(self, side: int) -> P.Predicate:
        own, other = side + 1, 2 - side
        f = lambda i, c: P.fixed(self.shape, i, c)
        return P.some([P.every([f(at, 0), f(end, own), *(f(i, other) for i in between)]) for at, between, end in self.turns()])

    def _more(self, side: int) -> P.Predicate:
        """Strictly more discs, when neither side can place."""
        return P.every([~self.can_place(0), ~self.can_place(1), Lead(side, len(self.shape))])

    def won(self, side: int) -> P.Predicate:
        return self._more(side)

    def lost(self, side: int) -> P.Predicate:
        return self._more(1 - side)

    def placements(self, positions: DataFrame, side: int) -> DataFrame:
        own, other = side + 1, 2 - side
        rows = [(end, own, at, [at, *between], [(i, 1 << other) for i in between] + [(at, 1)]) for at, between, end in self.turns()]
        table = positions.sparkSession.createDataFrame(rows, "layer int, char tinyint, at int, put array<int>, need array<struct<l:int,m:long>>")
        slots = positions.select("p", F.posexplode("p").alias("layer", "char"))
        met = slots.join(F.broadcast(table), ["layer", "char"]).filter(F.expr(MEETS))
        grouped = met.groupBy("p", "at").agg(F.flatten(F.collect_list("put")).alias("put"))
        turned = F.transform("p", lambda c, i: F.when(F.array_contains("put", i), F.lit(own).cast("tinyint")).otherwise(c))
        return grouped.select("p", turned.alias("q"))

    @lru_cache(maxsize=None)  # noqa: B019
    def results(self, side: int):
        """One for each square: a placement turns discs in all directions that enclose some."""
        if len(self.shape) > 64:
            return None
        own, other, found = side + 1, 2 - side, {}
        for at, between, end in self.turns():
            found.setdefault(at, []).append({at: frozenset([0]), end: frozenset([own]), **{i: frozenset([other]) for i in between}})
        return list(found.values())

    def passing(self, side: int):
        return self.results(1 - side)

    def edges(self, positions: DataFrame, side: int) -> DataFrame:
        placed = self.placements(positions, side)
        stuck = positions.join(placed.select("p").distinct(), "p", "left_anti")
        other = self.placements(stuck, 1 - side).select("p").distinct()
        passes = stuck.join(other, "p", "left_semi").select("p", F.col("p").alias("q"))
        return placed.unionByName(passes)

    def forward(self, side, s):
        from plyset.plans.game import packed, unpacked

        return unpacked(self.edges(packed(s, self.shape), side).select(F.col("q").alias("p")), self.shape, distinct=True)

    def backward(self, side, s):
        """Positions of the whole universe with a move into ``s`` (small boards only)."""
        from plyset.operators.positions import PositionSet
        from plyset.plans.game import packed, unpacked

        into = packed(s, self.shape).withColumnRenamed("p", "q")
        every = packed(PositionSet.accept(s.spark, self.shape), self.shape)
        return unpacked(self.edges(every, side).join(into, "q", "left_semi").select("p"), self.shape, distinct=True)

    def before(self, side, where):
        raise NotImplementedError("othello moves aren't rules of fixed slots")

    def has_moves(self, spark, side):
        from plyset.operators.positions import PositionSet

        return PositionSet(spark, self.shape, where=self.can_place(side) | self.can_place(1 - side))

    def legal(self) -> P.Predicate:
        """The four squares in the middle are never empty."""
        w, x, y = self.width, self.width // 2 - 1, self.height // 2 - 1
        return P.every([P.Among(b * w + a, frozenset([1, 2])) for a in (x, x + 1) for b in (y, y + 1)])

    def successors(self, side, position):
        def place(side):
            own, other, out = side + 1, 2 - side, {}
            for at, between, end in self.turns():
                if position[at] == 0 and position[end] == own and all(position[i] == other for i in between):
                    out.setdefault(at, set()).update((at, *between))
            return [tuple(own if i in put else c for i, c in enumerate(position)) for put in out.values()]

        return place(side) or ([tuple(position)] if place(1 - side) else [])

    def show(self, position):
        return show_rows(position, self.width, ".xo")


class Lead(P.Predicate):
    """A side has strictly more discs than the other."""

    def __init__(self, side: int, cells: int, ahead: int = 0, layers: tuple[int, ...] | None = None):
        self.side, self.ahead, self.layers = side, ahead, layers if layers is not None else tuple(range(cells))

    def _key(self):
        return self.side, self.ahead, self.layers

    def __eq__(self, other):
        return isinstance(other, Lead) and self._key() == other._key()

    def __hash__(self):
        return hash(self._key())

    def column(self, at):
        value = lambda i: F.when(at(i) == self.side + 1, 1).when(at(i) == 2 - self.side, -1).otherwise(0)
        total = F.lit(self.ahead)
        for i in self.layers:
            total = total + value(i)
        return total > 0

    def given(self, known):
        ahead = self.ahead + sum((known[i] == self.side + 1) - (known[i] == 2 - self.side) for i in self.layers if i in known)
        rest = tuple(i for i in self.layers if i not in known)
        return Lead(self.side, 0, ahead, rest) if rest else P.constant(ahead > 0)
