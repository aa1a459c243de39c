"""The shape of a position: how many characters each of its slots (layers) may hold."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Shape:
    sizes: tuple[int, ...]

    def __post_init__(self):
        object.__setattr__(self, "sizes", tuple(int(s) for s in self.sizes))
        if any(not 1 <= s <= 127 for s in self.sizes):
            raise ValueError(f"layer sizes must lie in 1..127: {self.sizes}")

    def __len__(self) -> int:
        return len(self.sizes)

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.sizes))]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.ByteType(), False) for c in self.columns])

    @property
    def universe(self) -> int:
        """How many positions there are; exact at any size."""
        return math.prod(self.sizes)

    def check(self, position) -> tuple[int, ...]:
        """The position as a tuple; raises if it has a wrong length or a character out of range (negative ones too)."""
        p = tuple(int(c) for c in position)
        if len(p) != len(self.sizes) or any(not 0 <= c < s for c, s in zip(p, self.sizes)):
            raise ValueError(f"{p} is no position of shape {self.sizes}")
        return p

    def layer(self, i: int) -> int:
        if not 0 <= i < len(self.sizes):
            raise ValueError(f"shape {self.sizes} has no layer {i}")
        return self.sizes[i]
