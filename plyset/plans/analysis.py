"""A whole analysis of a game, kept in a catalog: frontiers, wins and losses, the combined table, checks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plyset.operators import checks
from plyset.operators.positions import PositionSet
from plyset.plans.game import Game, solve_forward_backward, unpacked, with_fractions
from plyset.sources.catalog import Catalog, write_tsv


def kept(game: Game, catalog: Catalog, kind: str, build, **keys: int) -> PositionSet:
    """A named result of a game, built once."""
    return catalog.load_or_build(f"{game.name}/{game.names(kind, **keys)}", build)


def frontier(game: Game, catalog: Catalog, ply: int) -> PositionSet:
    """Positions after ``ply`` plies, each ply built from the one before as it was kept."""
    def build():
        if ply == 0:
            return game.start(catalog.spark)
        return game.forward((ply - 1) % 2, frontier(game, catalog, ply - 1))

    return kept(game, catalog, "forward", build, ply=ply)


def analyse(game: Game, spark: SparkSession, root: str, forward: int, backward: int = -1, examples: int = 100) -> dict[str, bool]:
    """Run all steps below ``root`` (a folder URI); returns what was checked and whether it held.

    ``backward`` is how far wins and losses are followed over the whole universe (small games only;
    negative: not at all).
    """
    catalog, held = Catalog(spark, f"{root}/sets"), {}
    for ply in range(forward + 1):
        s = frontier(game, catalog, ply)
        if s.is_empty():
            break
        try:
            held[f"moves at ply {ply}"] = checks.moves(game, ply % 2, s, examples)
        except NotImplementedError:
            held.pop(f"moves at ply {ply}", None)
    if backward >= 0:
        solver = game.solver(spark)
        for side in (0, 1):
            for kind in ("losing", "winning", "unknown"):
                kept(game, catalog, kind, lambda k=kind, s=side: unpacked(getattr(solver, k)(s, backward), game.shape), ply_max=backward, side=side)
        held["one-step rules"] = checks.solved(game, solver, backward)
    write_tsv(with_fractions(solve_forward_backward(game, spark, forward)).orderBy("ply"), f"{root}/stats")
    return held
