"""Checks of results: equality, subsets, partitions, and one-step rules of winning and losing sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.operators.positions import PositionSet
from plyset.plans.game import Game, packed, unpacked


def disjoint(a: PositionSet, b: PositionSet) -> bool:
    return (a & b).is_empty()


def equal(a: PositionSet, b: PositionSet) -> bool:
    """By content hash, or else by both differences."""
    if a.where is None and b.where is None and a.negated == b.negated and a.fingerprint() == b.fingerprint():
        return True
    return a.equals(b)


def subset(a: PositionSet, b: PositionSet, k: int | None = None) -> bool:
    """Whether (the first k members of) a lie in b."""
    some = PositionSet.from_frame(a.first(k), a.shape, distinct=False) if k else a
    return (some - b).is_empty()


def partition(target: PositionSet, parts: list[PositionSet]) -> bool:
    """Whether every member of the target lies in exactly one part and parts hold nothing else."""
    cols = target.shape.columns
    tagged = None
    for s in parts:
        rows = s.frame().withColumn("_part", F.lit(1))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    if tagged is None:
        return target.is_empty()
    counts = tagged.groupBy(*cols).agg(F.count("*").alias("_n"))
    both = target.frame().withColumn("_t", F.lit(1)).join(counts, cols, "full_outer")
    return both.filter("_t is null or _n is null or _n <> 1").isEmpty()


def sample(s: PositionSet, k: int) -> PositionSet:
    """The first k members in order."""
    return PositionSet.from_frame(s.first(k), s.shape, distinct=False)


def _children(game: Game, side: int, some: PositionSet, targets: PositionSet) -> DataFrame:
    """Per position: whether some child, and whether all children lie in the targets; null without moves."""
    p = packed(some, game.shape)
    inside = packed(targets, game.shape).select(F.col("p").alias("q"), F.lit(True).alias("_in"))
    met = game.edges(p, side).distinct().join(inside, "q", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return p.join(met.groupBy("p").agg(F.bool_or("_in").alias("some"), F.bool_and("_in").alias("all")), "p", "left")


def losing(game: Game, side: int, some: PositionSet, lost: PositionSet, winning: PositionSet) -> bool:
    """Members are lost, or all their moves lead to positions that the opponent wins (without moves only in normal play)."""
    rest = _children(game, side, some - lost, winning)
    bad = F.coalesce(~F.col("all"), F.lit(not game.normal_play))
    return rest.filter(bad).isEmpty()


def winning(game: Game, side: int, some: PositionSet, won: PositionSet, losing: PositionSet) -> bool:
    """Members are won, or some move leads to a position that the opponent loses."""
    return _children(game, side, some - won, losing).filter(~F.coalesce("some", F.lit(False))).isEmpty()


def moves(game: Game, side: int, some: PositionSet, k: int = 1000) -> bool:
    """Whether the plan's moves from the first k members are those of the independent generator."""
    part = sample(some, k)
    want = {q for p in part for q in game.successors(side, p)}
    got = set(game.forward(side, part))
    return want == got


def terminal(game: Game, spark, side: int) -> bool:
    """Whether no position is won and lost for the side to move, and none of either has a move (where the game lets nobody go on)."""
    won, lost = (PositionSet.matching(spark, game.shape, p) for p in (game.won(side), game.lost(side)))
    if not disjoint(won, lost):
        return False
    may = game.has_moves(spark, side)
    return disjoint(won, may) and disjoint(lost, may)


def solved(game: Game, solver, plies: int) -> bool:
    """The one-step rules over a solver's sets up to ``plies``, and that they part the universe."""
    shape = game.shape
    wrap = lambda df: unpacked(df, shape)
    for side in (0, 1):
        for k in range(1, plies + 1):
            lose, win = wrap(solver.losing(side, k)), wrap(solver.winning(side, k))
            start = lambda p: PositionSet.matching(solver.spark, shape, p)
            if not losing(game, side, lose, start(game.lost(side)), wrap(solver.winning(1 - side, k - 1))):
                return False
            if not winning(game, side, win, start(game.won(side)), wrap(solver.losing(1 - side, k - 1))):
                return False
            if not disjoint(lose, win):
                return False
    return True
