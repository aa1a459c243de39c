"""Sets of positions and the automata that stand for them."""

from plyset.operators.positions import PositionSet

__all__ = ["PositionSet"]
