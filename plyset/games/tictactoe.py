"""Tic-tac-toe on N x N: a full row, column or diagonal wins; a full board without one is a draw."""

from __future__ import annotations

from plyset.functions import predicates as P
from plyset.functions.board import show_rows
from plyset.plans.game import Game
from plyset.plans.moves import MoveGraph
from plyset.shape import Shape


class TicTacToe(Game):
    def __init__(self, n: int):
        self.name, self.n, self.shape = f"tictactoe_{n}", n, Shape((3,) * (n * n))
        cells = range(n)
        self.lines = [[y * n + x for x in cells] for y in cells] + [[y * n + x for y in cells] for x in cells]
        self.lines += [[i * n + i for i in cells], [i * n + n - 1 - i for i in cells]]

    def initial(self):
        return (0,) * len(self.shape)

    def lost(self, side: int) -> P.Predicate:
        other = 2 - side
        return P.some([P.every([P.fixed(self.shape, i, other) for i in line]) for line in self.lines])

    def may_move(self, side: int) -> P.Predicate:
        return ~self.lost(side)

    def move_graph(self, side: int) -> MoveGraph:
        g = MoveGraph(self.shape)
        g.add_node("begin")
        for i in range(len(self.shape)):
            g.add_node(f"mark {i}", {i: (0, side + 1)})
        g.add_node("end")
        for i in range(len(self.shape)):
            g.add_edge(f"to {i}", "begin", f"mark {i}")
            g.add_edge(f"from {i}", f"mark {i}", "end")
        return g

    def successors(self, side, position):
        if any(all(position[i] == 2 - side for i in line) for line in self.lines):
            return []
        return [(*position[:i], side + 1, *position[i + 1 :]) for i, c in enumerate(position) if c == 0]

    def show(self, position):
        return show_rows(position, self.n, ".xo")
