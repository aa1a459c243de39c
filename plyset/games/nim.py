"""Normal Nim: take any number from one heap; who can't move has lost."""

from __future__ import annotations

from plyset.plans.game import Game
from plyset.plans.moves import MoveGraph
from plyset.shape import Shape


class NormalNim(Game):
    normal_play = True

    def __init__(self, heaps: int, most: int):
        self.name, self.shape, self.most = f"normalnim_{heaps}x{most}", Shape((most + 1,) * heaps), most

    def initial(self):
        return (self.most,) * len(self.shape)

    def move_graph(self, side: int) -> MoveGraph:
        g = MoveGraph(self.shape)
        takes = [(i, b, a) for i in range(len(self.shape)) for b in range(1, self.most + 1) for a in range(b)]
        g.add_node("begin")
        for i, b, a in takes:
            g.add_node(f"heap {i}: {b} to {a}", {i: (b, a)})
        g.add_node("end")
        for i, b, a in takes:
            g.add_edge(f"take {i} {b} {a}", "begin", f"heap {i}: {b} to {a}")
            g.add_edge(f"taken {i} {b} {a}", f"heap {i}: {b} to {a}", "end")
        return g

    def successors(self, side, position):
        return [(*position[:i], a, *position[i + 1 :]) for i, b in enumerate(position) for a in range(b)]

    def show(self, position):
        return " ".join(map(str, position))
