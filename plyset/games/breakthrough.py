"""Breakthrough on W x H: pieces step forward, straight onto empty squares, diagonally also onto the other's."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.functions.board import show_rows
from plyset.operators.positions import PositionSet
from plyset.plans.game import Game
from plyset.plans.moves import MoveGraph
from plyset.shape import Shape


class Breakthrough(Game):
    def __init__(self, width: int, height: int, column_wise: bool = False):
        if height < 4:
            raise ValueError("breakthrough needs four rows")
        self.width, self.height, self.column_wise = width, height, column_wise
        self.name = f"breakthrough{'cw' if column_wise else ''}_{width}x{height}"
        self.shape = Shape((3,) * (width * height))

    def at(self, x: int, y: int) -> int:
        return x * self.height + y if self.column_wise else y * self.width + x

    def initial(self):
        p = [0] * len(self.shape)
        for x in range(self.width):
            p[self.at(x, 0)] = p[self.at(x, 1)] = 1
            p[self.at(x, self.height - 1)] = p[self.at(x, self.height - 2)] = 2
        return tuple(p)

    def goal(self, side: int) -> list[int]:
        return [self.at(x, self.height - 1 if side == 0 else 0) for x in range(self.width)]

    def _arrived(self, side: int) -> P.Predicate:
        return P.some([P.fixed(self.shape, i, side + 1) for i in self.goal(side)])

    def _pieces(self, side: int) -> P.Predicate:
        n = len(self.shape)
        return P.count_character(self.shape, side + 1, 1, n)

    def lost(self, side: int) -> P.Predicate:
        return self._arrived(1 - side)

    def may_move(self, side: int) -> P.Predicate:
        return ~self._arrived(1 - side)

    def steps(self, side: int) -> list[tuple[int, int, bool]]:
        """(from, to, straight)"""
        dy = 1 if side == 0 else -1
        return [
            (self.at(x, y), self.at(x + dx, y + dy), dx == 0)
            for y in range(self.height) if 0 <= y + dy < self.height for x in range(self.width) for dx in (-1, 0, 1) if 0 <= x + dx < self.width
        ]

    def move_graph(self, side: int) -> MoveGraph:
        own, other = side + 1, 2 - side
        g = MoveGraph(self.shape)
        g.add_node("begin")
        steps = self.steps(side)
        for a in dict.fromkeys(a for a, _, _ in steps):
            g.add_node(f"lift {a}", {a: (own, 0)})
            g.add_edge(f"lift {a}", "begin", f"lift {a}")
        drops = dict.fromkeys((b, before) for _, b, straight in steps for before in ((0,) if straight else (0, other)))
        for b, before in drops:
            g.add_node(f"drop {b} on {before}", {b: (before, own)})
        g.add_node("end")
        for a, b, straight in steps:
            for before in (0,) if straight else (0, other):
                g.add_edge(f"{a} to {b} on {before}", f"lift {a}", f"drop {b} on {before}")
        for b, before in drops:
            g.add_edge(f"end {b} on {before}", f"drop {b} on {before}", "end")
        return g

    def successors(self, side, position):
        own, other = side + 1, 2 - side
        if any(position[i] == other for i in self.goal(1 - side)):
            return []
        out = []
        for a, b, straight in self.steps(side):
            if position[a] == own and position[b] in ((0,) if straight else (0, other)):
                q = list(position)
                q[a], q[b] = 0, own
                out.append(tuple(q))
        return out

    def reversed(self, s: PositionSet) -> PositionSet:
        """The board turned by half a circle with colours swapped: one to one, so no distinct."""
        cell = {self.at(x, y): self.at(self.width - 1 - x, self.height - 1 - y) for x in range(self.width) for y in range(self.height)}
        swap = lambda c: F.when(F.col(c) == 0, 0).otherwise(3 - F.col(c)).cast("tinyint")
        rows = s.frame().select(*(F.coalesce(swap(f"c{cell[i]}"), F.lit(0).cast("tinyint")).alias(f"c{i}") for i in range(len(self.shape))))
        return PositionSet(s.spark, self.shape, rows=rows)

    def show(self, position):
        if self.column_wise:
            position = [position[self.at(x, y)] for y in range(self.height) for x in range(self.width)]
        return show_rows(position, self.width, ".xo")
