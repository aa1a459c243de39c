"""Amazons on W x H: a queen move, then an arrow shot as a queen moves; who can't move has lost."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.functions.board import queen_moves, show_rows
from plyset.operators.positions import PositionSet
from plyset.plans.game import Game
from plyset.plans.moves import MoveGraph, Rule
from plyset.shape import Shape


class Amazons(Game):
    normal_play = True

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height
        self.name, self.shape = f"amazons_{width}x{height}", Shape((4,) * (width * height))

    def initial(self):
        # how far queens stand from the corners, by the shorter side: fixed values of the game
        offset = {4: 1, 5: 1, 6: 1, 7: 1, 8: 2, 9: 2, 10: 3}.get(min(self.width, self.height))
        if offset is None:
            raise ValueError("amazons boards have 4 to 10 squares on the shorter side")
        w, h = self.width, self.height
        p = [0] * (w * h)
        for x, y in ((offset, 0), (w - 1 - offset, 0), (0, offset), (w - 1, offset)):
            p[y * w + x] = 1
        for x, y in ((offset, h - 1), (w - 1 - offset, h - 1), (0, h - 1 - offset), (w - 1, h - 1 - offset)):
            p[y * w + x] = 2
        return tuple(p)

    @lru_cache(maxsize=None)  # noqa: B019
    def turns(self) -> list[tuple[int, int, int, frozenset[int]]]:
        """(from, to, arrow, squares that must be empty): every whole turn of a queen, the square it left counting as empty for the arrow."""
        lines: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for a, b, between in queen_moves(self.width, self.height):
            lines.setdefault(a, []).append((b, frozenset((b, *between))))
        return [(a, b, to, way | shot - {a}) for a, ways in lines.items() for b, way in ways for to, shot in lines[b]]

    @lru_cache(maxsize=None)  # noqa: B019
    def rules(self, side: int) -> list[Rule]:
        """A turn is one rule: what must hold before all of it, and the squares that it writes."""
        own, out = side + 1, []
        for a, b, to, free in self.turns():
            when = P.every([P.fixed(self.shape, a, own), *(P.fixed(self.shape, i, 0) for i in sorted(free))])
            out.append(Rule(when, tuple(sorted(({a: 0, b: own} | {to: 3}).items()))))
        return out

    def move_graph(self, side: int) -> MoveGraph:
        return MoveGraph.of_rules(self.shape, self.rules(side))

    def successors(self, side, position):
        moves = queen_moves(self.width, self.height)
        out = []
        for a, b, between in moves:
            if position[a] == side + 1 and position[b] == 0 and all(position[i] == 0 for i in between):
                q = list(position)
                q[a], q[b] = 0, side + 1
                for _, d, way in (m for m in moves if m[0] == b):
                    if q[d] == 0 and all(q[i] == 0 for i in way):
                        out.append((*q[:d], 3, *q[d + 1 :]))
        return out

    def reversed(self, s: PositionSet) -> PositionSet:
        """Colours swapped in place."""
        swap = lambda c: F.when(F.col(c).isin(1, 2), 3 - F.col(c)).otherwise(F.col(c)).cast("tinyint")
        return PositionSet(s.spark, self.shape, rows=s.frame().select(*(F.coalesce(swap(c), F.lit(0).cast("tinyint")).alias(c) for c in self.shape.columns)))

    def show(self, position):
        return show_rows(position, self.width, ".xo#", top_first=False)
