"""Geometry of rectangular boards, and text forms of positions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRAIGHT = ((1, 0), (-1, 0), (0, 1), (0, -1))
DIAGONAL = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def ray(x: int, y: int, dx: int, dy: int, width: int, height: int) -> list[tuple[int, int]]:
    """The squares from (x, y) on in one direction, without itself."""
    out = []
    while 0 <= (x := x + dx) < width and 0 <= (y := y + dy) < height:
        out.append((x, y))
    return out


def queen_moves(width: int, height: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(from, to, squares strictly between), squares numbered row by row."""
    out = []
    for y in range(height):
        for x in range(width):
            for dx, dy in STRAIGHT + DIAGONAL:
                way = [b * width + a for a, b in ray(x, y, dx, dy, width, height)]
                out += [(y * width + x, to, tuple(way[:k])) for k, to in enumerate(way)]
    return out


def show_rows(position, width: int, letters: str, top_first: bool = True) -> str:
    rows = [" ".join(letters[c] for c in position[i : i + width]) for i in range(0, len(position), width)]
    return "\n".join(rows if top_first else rows[::-1])


def show_column(columns: list[str], width: int, letters: str, top_first: bool = True) -> Column:
    """The text form of positions held in slot columns."""
    letter = F.array(*(F.lit(x) for x in letters))
    rows = [F.concat_ws(" ", *(F.element_at(letter, F.col(c).cast("int") + 1) for c in columns[i : i + width])) for i in range(0, len(columns), width)]
    return F.concat_ws("\n", *(rows if top_first else rows[::-1]))
