"""Move graphs, and what they are compiled to: rules that one join applies to all positions.

A graph's nodes change slots and its edges have conditions; a move is a path from the first node to
the last. Every path collapses to one rule (what must hold before, what is written), because a
condition met halfway can be said about the position before the move. Rules meet positions in an
equi-join on one slot and its character, never as a cross product; the rest of a rule is a test of
bit masks inside that join. The rules of a game depend on its board alone and are broadcast only
below ``MOST_RULES``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.shape import Shape

MOST_RULES = 200_000
#: The position is named outside the lambda too: the optimizer otherwise can take the test for one of the rules alone.
MEETS = "if(p[0] >= 0, forall(need, n -> (shiftright(n.m, cast(p[n.l] as int)) & 1) = 1), false)"
RULE = "layer int, char tinyint, rule int, need array<struct<l:int,m:long>>, put map<int,tinyint>"


@dataclass(frozen=True)
class Rule:
    """A collapsed path: what must hold before it, and what it writes."""

    when: P.Predicate
    put: tuple[tuple[int, int], ...]


@dataclass
class Node:
    name: str
    changes: dict[int, tuple[int, int]]
    pre: list[P.Predicate] = field(default_factory=list)
    post: list[P.Predicate] = field(default_factory=list)


@dataclass
class Edge:
    name: str
    start: int
    end: int
    conditions: list[P.Predicate]


class MoveGraph:
    def __init__(self, shape: Shape):
        self.shape, self.nodes, self.edges = shape, [], []
        self._at: dict[str, int] = {}
        self._edge_names: set[str] = set()

    def __len__(self) -> int:
        return len(self.nodes)

    def index(self, name: str) -> int:
        if name not in self._at:
            raise KeyError(f"no node {name}")
        return self._at[name]

    def add_node(self, name: str, changes: dict[int, tuple[int, int]] | None = None, pre=(), post=()) -> None:
        """Each change also demands its ``before`` on the way in and its ``after`` on the way out."""
        if name in self._at:
            raise ValueError(f"node {name} exists")
        changes = dict(changes or {})
        fixed = lambda k: [P.fixed(self.shape, i, c[k]) for i, c in sorted(changes.items())]
        self._at[name] = len(self.nodes)
        self.nodes.append(Node(name, changes, [*pre, *fixed(0)], [*post, *fixed(1)]))

    def add_edge(self, name: str, start: str, end: str, conditions=()) -> None:
        a, b = self.index(start), self.index(end)
        if a >= b:
            raise ValueError("an edge leads from an earlier node to a later one")
        if name in self._edge_names:
            raise ValueError(f"edge {name} exists")
        self._edge_names.add(name)
        self.edges.append(Edge(name, a, b, list(conditions)))

    @classmethod
    def of_rules(cls, shape: Shape, rules: list[Rule]) -> MoveGraph:
        """One node for each rule, between a first and a last node; slots that a rule writes must hold one character before."""
        g = cls(shape)
        g.add_node("first")
        for k, rule in enumerate(rules):
            sets, rest = split(rule)
            changes = {}
            for i, after in rule.put:
                (before,) = sets[i]
                changes[i] = (before, after)
            tests = [P.Among(i, c) for i, c in sorted(sets.items()) if i not in changes]
            g.add_node(f"rule {k}", changes, pre=[*tests, *([] if rest is P.ALWAYS else [rest])])
            g.add_edge(f"to {k}", "first", f"rule {k}")
        g.add_node("last")
        for k in range(len(rules)):
            g.add_edge(f"from {k}", f"rule {k}", "last")
        return g

    def optimized(self) -> MoveGraph:
        """Without nodes on no path from the first to the last."""
        last = len(self.nodes) - 1
        ahead, behind = {0}, {last}
        for e in sorted(self.edges, key=lambda e: e.start):
            if e.start in ahead:
                ahead.add(e.end)
        for e in sorted(self.edges, key=lambda e: -e.end):
            if e.end in behind:
                behind.add(e.start)
        return self._copy([i for i in range(len(self.nodes)) if i in ahead & behind or i in (0, last)], False)

    def reversed(self) -> MoveGraph:
        """Moves backward: changes swapped, edges turned, what held after holds before."""
        return self._copy(list(range(len(self.nodes)))[::-1], True)

    def _copy(self, order: list[int], flip: bool) -> MoveGraph:
        out = MoveGraph(self.shape)
        for i in order:
            n = self.nodes[i]
            out._at[n.name] = len(out.nodes)
            out.nodes.append(Node(n.name, {k: (b, a) if flip else (a, b) for k, (a, b) in n.changes.items()}, list(n.post if flip else n.pre), list(n.pre if flip else n.post)))
        place = {i: k for k, i in enumerate(order)}
        for e in self.edges:
            if e.start in place and e.end in place:
                a, b = (e.end, e.start) if flip else (e.start, e.end)
                out.edges.append(Edge(e.name, place[a], place[b], list(e.conditions)))
        return out

    def rules(self) -> list[Rule]:
        """One rule for each path from the first node to the last that some position can take."""
        leaving: dict[int, list[Edge]] = {}
        for e in self.edges:
            leaving.setdefault(e.start, []).append(e)
        found: dict[Rule, None] = {}

        def enter(node: int, when: P.Predicate, put: dict[int, int]):
            for i, (before, after) in self.nodes[node].changes.items():
                when, put = P.every([when, P.fixed(self.shape, i, before).given(put)]), put | {i: after}
            return when, put

        todo = [(0, *enter(0, P.every(self.nodes[0].pre), {}))]
        while todo:
            node, when, put = todo.pop()
            if when is P.NEVER:
                continue
            if node == len(self.nodes) - 1:
                found[Rule(when, tuple(sorted(put.items())))] = None
                continue
            for e in leaving.get(node, ()):
                tests = [*self.nodes[node].post, *e.conditions, *self.nodes[e.end].pre]
                todo.append((e.end, *enter(e.end, P.every([when, *(t.given(put) for t in tests)]), put)))
        return list(found)


def split(rule: Rule) -> tuple[dict[int, frozenset[int]], P.Predicate]:
    """A rule's condition as character sets by slot, and what else it tests."""
    parts = rule.when.parts if isinstance(rule.when, P.Every) else (rule.when,)
    sets = {p.layer: p.chars for p in parts if isinstance(p, P.Among)}
    return sets, P.every([p for p in parts if not isinstance(p, P.Among)])


def inverted(rules: list[Rule], shape: Shape) -> list[Rule]:
    """Rules that lead from a move's result to the positions before it; every written slot gets one character."""
    out = []
    for rule in rules:
        sets, rest = split(rule)
        choices: list[dict[int, int]] = [{}]
        for i, _ in rule.put:
            choices = [c | {i: b} for c in choices for b in sorted(sets.get(i, frozenset(range(shape.sizes[i]))))]
        for before in choices:
            when = [P.Among(i, s) for i, s in sets.items() if i not in before]
            out.append(Rule(P.every([*when, rest.given(before), *(P.fixed(shape, i, a) for i, a in rule.put)]), tuple(sorted(before.items()))))
    return list(dict.fromkeys(out))


def rule_rows(rules: list[Rule], shape: Shape) -> list[tuple]:
    """Rows of RULE: a rule once for each character of the slot that it is looked up by."""
    rows = []
    for k, rule in enumerate(rules):
        sets, _ = split(rule)
        if not sets:
            raise ValueError("a rule needs a slot to be looked up by")
        # a slot with one character, best one that isn't the common 0
        pivot = min(sets, key=lambda i: (len(sets[i]), 0 in sets[i], i))
        need = [(i, sum(1 << c for c in s)) for i, s in sorted(sets.items()) if i != pivot]
        rows += [(pivot, c, k, need, dict(rule.put)) for c in sorted(sets[pivot])]
    return rows


def apply(positions: DataFrame, rules: list[Rule], shape: Shape) -> DataFrame:
    """All (p, q): a position and what a rule makes of it. ``positions`` has one column ``p`` array<tinyint>."""
    spark: SparkSession = positions.sparkSession
    by_rest: dict[P.Predicate, list[Rule]] = {}
    for r in rules:
        by_rest.setdefault(split(r)[1], []).append(r)
    out = None
    for rest, own in by_rest.items():
        rows = rule_rows(own, shape)
        table = spark.createDataFrame(rows, RULE)
        some = positions if rest is P.ALWAYS else positions.filter(rest.column(lambda i: F.col("p")[i]))
        slots = some.select("p", F.posexplode("p").alias("layer", "char"))
        met = slots.join(F.broadcast(table) if len(rows) <= MOST_RULES else table, ["layer", "char"])
        met = met.filter(F.expr(MEETS))
        new = F.transform("p", lambda c, i: F.coalesce(F.try_element_at("put", i), c))
        made = met.select("p", new.alias("q"))
        out = made if out is None else out.unionByName(made)
    return positions.select("p", F.col("p").alias("q")).limit(0) if out is None else out


def results(rules: list[Rule], shape: Shape) -> list[list[dict[int, frozenset[int]]]] | None:
    """For each different result of a move, by what it writes, the conditions of which one must hold.

    Nothing where that can't be told from the rules: where one tests more than single slots, or may write what is
    there already, so that two writings can make the same position.
    """
    found: dict[tuple, list[dict[int, frozenset[int]]]] = {}
    for rule in rules:
        sets, rest = split(rule)
        if rest is not P.ALWAYS or not rule.put or any(after in sets.get(i, range(shape.sizes[i])) for i, after in rule.put):
            return None
        found.setdefault(rule.put, []).append(sets)
    return list(found.values())


def count_results(cells: np.ndarray, found: list[list[dict[int, frozenset[int]]]]) -> np.ndarray:
    """How many of the results each position has; a row of ``cells`` for each position, at most 64 slots.

    Slots that hold one of some characters are a bit mask for each position, so a condition is a few comparisons.
    """
    masks: dict[frozenset[int], np.ndarray] = {}

    def mask(chars: frozenset[int]) -> np.ndarray:
        if chars not in masks:
            masks[chars] = np.zeros(len(cells), np.uint64)
            for i in range(cells.shape[1]):
                masks[chars] |= np.isin(cells[:, i], list(chars)).astype(np.uint64) << np.uint64(i)
        return masks[chars]

    n = np.zeros(len(cells), np.int64)
    for ways in found:
        some = np.zeros(len(cells), bool)
        for sets in ways:
            need: dict[frozenset[int], int] = {}
            for i, chars in sets.items():
                need[chars] = need.get(chars, 0) | 1 << i
            holds = np.ones(len(cells), bool)
            for chars, bits in need.items():
                holds &= mask(chars) & np.uint64(bits) == np.uint64(bits)
            some |= holds
        n += some
    return n
