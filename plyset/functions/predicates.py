"""Predicates over the slots of a position: built without data, rewritten, compiled to one Column.

A predicate never enumerates anything, whatever the size of the universe. ``Among`` tests of one
slot are kept as character sets and merged, so contradictions on a slot fold to ``NEVER`` here
(Catalyst keeps them); everything else is left to the optimizer.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyset.shape import Shape


class Predicate:
    def column(self, at) -> Column:
        """``at(layer)`` gives the column of a slot."""
        raise NotImplementedError

    def given(self, known: dict[int, int]) -> Predicate:
        """What is left to test when some slots are known."""
        raise NotImplementedError

    def holds(self, position) -> bool:
        return self.given(dict(enumerate(position))) is ALWAYS

    def __and__(self, other: Predicate) -> Predicate:
        return every([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return some([self, other])

    def __invert__(self) -> Predicate:
        return Not.of(self)


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool

    def column(self, at) -> Column:
        return F.lit(self.value)

    def given(self, known) -> Predicate:
        return self


ALWAYS, NEVER = Constant(True), Constant(False)


def constant(value: bool) -> Predicate:
    return ALWAYS if value else NEVER


@dataclass(frozen=True)
class Among(Predicate):
    """The slot holds one of these characters."""

    layer: int
    chars: frozenset[int]

    def column(self, at) -> Column:
        c = at(self.layer)
        return c == next(iter(self.chars)) if len(self.chars) == 1 else c.isin(sorted(self.chars))

    def given(self, known) -> Predicate:
        return constant(known[self.layer] in self.chars) if self.layer in known else self


@dataclass(frozen=True)
class Count(Predicate):
    """Between ``low`` and ``high`` of the layers hold one of the characters (``plus`` are known to)."""

    layers: tuple[int, ...]
    chars: frozenset[int]
    low: int
    high: int

    def column(self, at) -> Column:
        hits = functools.reduce(operator.add, (at(i).isin(sorted(self.chars)).cast("int") for i in self.layers))
        return hits.between(self.low, self.high)

    def given(self, known) -> Predicate:
        inside = [i for i in self.layers if i in known]
        hits = sum(known[i] in self.chars for i in inside)
        rest = tuple(i for i in self.layers if i not in known)
        low, high = self.low - hits, self.high - hits
        if high < 0 or low > len(rest):
            return NEVER
        return ALWAYS if low <= 0 and high >= len(rest) else Count(rest, self.chars, low, high)


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    @staticmethod
    def of(p: Predicate) -> Predicate:
        if isinstance(p, Constant):
            return constant(not p.value)
        return p.inner if isinstance(p, Not) else Not(p)

    def column(self, at) -> Column:
        return ~self.inner.column(at)

    def given(self, known) -> Predicate:
        return Not.of(self.inner.given(known))


@dataclass(frozen=True)
class Every(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, at) -> Column:
        return functools.reduce(operator.and_, (p.column(at) for p in self.parts))

    def given(self, known) -> Predicate:
        return every([p.given(known) for p in self.parts])


@dataclass(frozen=True)
class Some(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, at) -> Column:
        return functools.reduce(operator.or_, (p.column(at) for p in self.parts))

    def given(self, known) -> Predicate:
        return some([p.given(known) for p in self.parts])


def every(parts: list[Predicate]) -> Predicate:
    flat: dict[Predicate, None] = {}
    chars: dict[int, frozenset[int]] = {}
    for p in (q for p in parts for q in (p.parts if isinstance(p, Every) else (p,))):
        if p is NEVER:
            return NEVER
        if isinstance(p, Among):
            chars[p.layer] = chars.get(p.layer, p.chars) & p.chars
            if not chars[p.layer]:
                return NEVER
        elif p is not ALWAYS:
            flat[p] = None
    kept = [Among(i, c) for i, c in sorted(chars.items())] + list(flat)
    return ALWAYS if not kept else kept[0] if len(kept) == 1 else Every(tuple(kept))


def some(parts: list[Predicate]) -> Predicate:
    flat: dict[Predicate, None] = {}
    for p in (q for p in parts for q in (p.parts if isinstance(p, Some) else (p,))):
        if p is ALWAYS:
            return ALWAYS
        if p is not NEVER:
            flat[p] = None
    kept = list(flat)
    return NEVER if not kept else kept[0] if len(kept) == 1 else Some(tuple(kept))


def fixed(shape: Shape, layer: int, char: int) -> Predicate:
    """One slot is given; a character beyond the slot's alphabet leaves nothing."""
    if char < 0:
        raise ValueError("characters aren't negative")
    return Among(layer, frozenset([char])) if char < shape.layer(layer) else NEVER


def count_character(shape: Shape, char: int, count_min: int, count_max: int | None = None, layer_min: int = 0, layer_max: int | None = None) -> Predicate:
    """How many slots of a range of layers hold ``char``: exactly ``count_min``, or up to ``count_max``."""
    count_max = count_min if count_max is None else count_max
    layer_max = len(shape) - 1 if layer_max is None else layer_max
    if not (0 <= layer_min <= layer_max < len(shape)) or not (0 <= count_min <= count_max) or char < 0:
        raise ValueError("counts and layers must be ranges within the shape")
    return Count(tuple(range(layer_min, layer_max + 1)), frozenset([char]), count_min, count_max).given({})


def count_pieces(shape: Shape, count: int) -> Predicate:
    """Exactly ``count`` slots hold something else than character 0."""
    if count < 0:
        raise ValueError("a count isn't negative")
    return Count(tuple(range(len(shape))), frozenset(range(1, max(shape.sizes))), count, count).given({}) if len(shape) else constant(count == 0)


def linear_sets(p: Predicate, shape: Shape) -> list[frozenset[int]] | None:
    """Per slot the characters, if the predicate is a product of character sets by its form."""
    full = [frozenset(range(s)) for s in shape.sizes]
    if p is NEVER:
        return [frozenset()] * len(shape)
    for q in p.parts if isinstance(p, Every) else (() if p is ALWAYS else (p,)):
        if isinstance(q, Not) and isinstance(q.inner, Among):
            full[q.inner.layer] -= q.inner.chars
        elif isinstance(q, Among):
            full[q.layer] &= q.chars
        else:
            return None
    return full
