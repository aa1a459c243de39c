"""Games from the positions of a table: how many moves each has, and who wins within k plies.

Nothing is enumerated but what the given positions can reach: each ply is the distinct results of the
one before, written before the next begins, and values come back the same way. The work grows with the
table and its reach, not with the game's universe.

Positions are rows ``p array<tinyint>``. Defined results: repeated positions are judged once, every row
of the table gets its answer; an empty table gives no rows; a null or malformed position is refused by
``encoded``, which makes positions from columns; other columns of the table pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.plans.game import Game
from plyset.plans.moves import count_results
from plyset.shape import Shape
from plyset.storage import materialise

#: So many distinct positions with their answers are broadcast at most; more meet their rows in a salted join.
MOST_BROADCAST, SALTS = 200_000, 16


def encoded(slots: list[Column], shape: Shape) -> Column:
    """One position from a column for each slot; an error where a slot is null or no character of its layer."""
    if len(slots) != len(shape):
        raise ValueError(f"{len(shape)} slots are needed")
    checked = [F.when(c.between(0, n - 1), c.cast("tinyint")).otherwise(F.raise_error(F.lit("no character of the layer"))) for c, n in zip(slots, shape.sizes)]
    return F.array(*checked)


def from_code(code: Column, shape: Shape) -> Column:
    """One position from an integer, whose digits are its slots, the least first."""
    slots, unit = [], 1
    for n in shape.sizes:
        slots.append(F.pmod(F.floor(code / F.lit(unit)) if unit > 1 else code, F.lit(n)))
        unit *= n
    if unit > 1 << 52:
        raise ValueError("codes of this shape don't fit")
    return encoded(slots, shape)


def holds(p: P.Predicate) -> Column:
    return p.column(lambda i: F.col("p")[i])


def spelled(rows: DataFrame, on: tuple[str, ...], p: Column) -> DataFrame:
    """Each different value of the columns ``on`` with the position ``p`` that it spells, so that positions are made once and not for every row."""
    return materialise(rows.select(*on).distinct(), "spelled").withColumn("p", p)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that must not go through the driver: files and shuffles of positions are a fraction of their size in memory."""
    return df.hint("merge")


def moves_of(game: Game, side: int) -> Column | None:
    """How many different positions one move leads to from ``p``; nothing where the game's moves can't be counted on slots alone."""
    found = game.results(side)
    if found is None:
        return None
    passing, slots = game.passing(side), len(game.shape)

    def count(p: pa.Array) -> pa.Array:
        cells = p.flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)
        n = count_results(cells, found)
        if passing:
            n = np.where(n > 0, n, count_results(cells, passing) > 0)
        return pa.array(n, pa.int64())

    may, counted = game.may_move(side), F.arrow_udf(count, "long")(F.col("p"))
    return counted if may is P.ALWAYS else F.when(holds(may), counted).otherwise(F.lit(0).cast("long"))


def with_moves(game: Game, rows: DataFrame, side: int) -> DataFrame:
    """Every row of a table with ``moves``, the number of different positions that one move leads to from its ``p``.

    Counted row by row without a shuffle or a join where the game's moves are rules of slots.
    """
    moves = moves_of(game, side)
    return answered(rows, mobility(game, rows, side)) if moves is None else rows.withColumn("moves", moves)


def mobility(game: Game, positions: DataFrame, side: int) -> DataFrame:
    """p, moves: how many different positions one move leads to, 0 where there is none."""
    own, moves = positions.select("p").distinct(), moves_of(game, side)
    if moves is not None:
        return own.select("p", moves.alias("moves"))
    counted = game.edges(own, side).distinct().groupBy("p").agg(F.count("*").alias("moves"))
    return own.join(shuffled(counted), "p", "left").select("p", F.coalesce("moves", F.lit(0).cast("long")).alias("moves"))


def reached(game: Game, positions: DataFrame, side: int, plies: int) -> list[DataFrame]:
    """Distinct positions after 0, 1, .. plies from all given ones; ends after an empty one."""
    found = [materialise(positions.select("p").distinct(), "reached")]
    for ply in range(plies):
        found.append(materialise(game.edges(found[-1], (side + ply) % 2).select(F.col("q").alias("p")).distinct(), "reached"))
        if found[-1].isEmpty():
            break
    return found


def judged(game: Game, positions: DataFrame, side: int, plies: int) -> DataFrame:
    """p, result: 1 where ``side``, to move, wins within ``plies``, -1 where it loses, 0 where neither is forced.

    The same as a solver's winning and losing sets over the universe. A position that is won and lost by its
    own tests counts as won. In normal play who can't move has lost; elsewhere a position without moves that
    isn't lost stays at 0.
    """
    fronts = reached(game, positions, side, plies)
    later = None
    for ply in range(len(fronts) - 1, -1, -1):
        mover, own = (side + ply) % 2, fronts[ply]
        told = F.when(holds(game.won(mover)), 1).when(holds(game.lost(mover)), -1)
        if later is None and not game.normal_play:  # the last ply looks no further
            later = materialise(own.select("p", F.coalesce(told, F.lit(0)).cast("int").alias("result")), "judged")
            continue
        edges = game.edges(own, mover).distinct()
        if later is None:  # only whether there is a move
            sums = edges.groupBy("p").agg(F.lit(0).alias("some"), F.lit(0).alias("every"))
        else:
            met = edges.join(shuffled(later.withColumnRenamed("p", "q")), "q")
            sums = met.groupBy("p").agg(F.max((F.col("result") == -1).cast("int")).alias("some"), F.min((F.col("result") == 1).cast("int")).alias("every"))
        stuck = F.lit(-1 if game.normal_play else 0)
        value = F.coalesce(told, F.when(F.col("some").isNull(), stuck).when(F.col("some") == 1, 1).when(F.col("every") == 1, -1), F.lit(0))
        later = materialise(own.join(shuffled(sums), "p", "left").select("p", value.cast("int").alias("result")), "judged")
    return later


def answered(rows: DataFrame, answers: DataFrame, on: tuple[str, ...] = ("p",)) -> DataFrame:
    """Every row of a table with what is known of its position ``p``, or of what else spells it; one that most rows share is no hot key.

    Beyond ``MOST_BROADCAST`` answers the rows are salted by their other columns, so only rows that are wholly equal
    stay together; the answers never go through the driver then, however small their files are.
    """
    answers = materialise(answers, "answers")
    if answers.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(answers), list(on))
    others = [F.col(f"`{c}`") for c, kind in rows.dtypes if c not in on and "map<" not in kind]  # a row made again gets the same salt
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)) if others else F.lit(0).cast("long"))
    spread = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(shuffled(spread), [*on, "_salt"]).drop("_salt")


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """win, lose and unknown counts of judged rows by key."""
    count = lambda v: F.sum((F.col("result") == v).cast("long"))
    return rows.groupBy(*keys).agg(count(1).alias("win"), count(-1).alias("lose"), count(0).alias("unknown"))
