"""Queries about a two-player game: frontiers, wins and losses within a number of plies, combined solves.

Positions are rows ``p array<tinyint>`` here (one key whatever the board), and PositionSets at the
interface. Side 0 moves at even plies; the side is no part of a position.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.operators.positions import PositionSet
from plyset.plans import moves as M
from plyset.shape import Shape
from plyset.storage import materialise


def packed(s: PositionSet | DataFrame, shape: Shape) -> DataFrame:
    df = s.frame() if isinstance(s, PositionSet) else s
    return df.select(F.array(*shape.columns).alias("p"))


def unpacked(df: DataFrame, shape: Shape, distinct: bool = False) -> PositionSet:
    rows = df.select(*(F.coalesce(F.col("p")[i], F.lit(0).cast("tinyint")).alias(c) for i, c in enumerate(shape.columns)))
    return PositionSet(df.sparkSession, shape, rows=rows.distinct() if distinct else rows)


class Game:
    """Subclasses give a name, a shape, the initial position, ``move_graph`` and, where the game has them, terminal wins and losses."""

    name: str
    shape: Shape
    normal_play = False  # whoever can't move has lost

    def initial(self) -> tuple[int, ...]:
        raise NotImplementedError

    def move_graph(self, side: int) -> M.MoveGraph:
        raise NotImplementedError

    def may_move(self, side: int) -> P.Predicate:
        """What a position must satisfy besides a rule's own condition."""
        return P.ALWAYS

    def lost(self, side: int) -> P.Predicate:
        return P.NEVER

    def won(self, side: int) -> P.Predicate:
        return P.NEVER

    def successors(self, side: int, position) -> list[tuple[int, ...]]:
        """An independent generator, for validation."""
        raise NotImplementedError(f"{self.name} has no independent generator")

    def show(self, position) -> str:
        return str(list(position))

    # -- moves --------------------------------------------------------------------------------

    @lru_cache(maxsize=None)  # noqa: B019
    def rules(self, side: int) -> list[M.Rule]:
        return self.move_graph(side).optimized().rules()

    def _allowed(self, df: DataFrame, side: int, column: str = "p") -> DataFrame:
        may = self.may_move(side)
        return df if may is P.ALWAYS else df.filter(may.column(lambda i: F.col(column)[i]))

    def edges(self, positions: DataFrame, side: int) -> DataFrame:
        """All (p, q) with a move from p to q; a pair can repeat if two rules make it."""
        return M.apply(self._allowed(positions, side), self.rules(side), self.shape)

    @lru_cache(maxsize=None)  # noqa: B019
    def results(self, side: int) -> list[list[dict[int, frozenset[int]]]] | None:
        """What a position must hold for each different result of a move (see ``moves.results``); nothing where moves aren't such rules."""
        if len(self.shape) > 64:
            return None
        return M.results(self.rules(side), self.shape)

    def passing(self, side: int) -> list[list[dict[int, frozenset[int]]]]:
        """What makes a position without another result its own only one."""
        return []

    def forward(self, side: int, s: PositionSet) -> PositionSet:
        """All results of one move, each once."""
        return unpacked(self.edges(packed(s, self.shape), side).select(F.col("q").alias("p")), self.shape, distinct=True)

    def backward(self, side: int, s: PositionSet) -> PositionSet:
        """All positions of the universe with a move into ``s``, reachable or not."""
        if s.where is not None:
            return PositionSet(s.spark, self.shape, where=self.before(side, s.where))
        if s.negated:
            s = s.extensional()
        back = M.apply(packed(s, self.shape), M.inverted(self.rules(side), self.shape), self.shape).select(F.col("q").alias("p"))
        return unpacked(self._allowed(back, side), self.shape, distinct=True)

    def before(self, side: int, where: P.Predicate) -> P.Predicate:
        """The predicate of positions with a move into ``where``: no data is read."""
        return P.every([self.may_move(side), P.some([P.every([r.when, where.given(dict(r.put))]) for r in self.rules(side)])])

    def has_moves(self, spark: SparkSession, side: int) -> PositionSet:
        return PositionSet(spark, self.shape, where=self.before(side, P.ALWAYS))

    # -- frontiers ----------------------------------------------------------------------------

    def start(self, spark: SparkSession) -> PositionSet:
        return PositionSet.from_string(spark, self.shape, self.initial())

    def frontiers(self, spark: SparkSession, plies: int) -> list[PositionSet]:
        """Positions after 0, 1, .. plies; each ply is written, so a lost executor costs one ply. Ends after an empty one."""
        found = [self.start(spark)]
        for ply in range(1, plies + 1):
            step = materialise(self.forward((ply - 1) % 2, found[-1]).rows, f"ply{ply:03d}")
            found.append(PositionSet(spark, self.shape, rows=step))
            if step.isEmpty():
                break
        return found

    def positions_forward(self, spark: SparkSession, ply: int) -> PositionSet:
        found = self.frontiers(spark, ply)
        return found[ply] if ply < len(found) else PositionSet.reject(spark, self.shape)

    def reachable(self, spark: SparkSession, side: int, ply: int) -> PositionSet:
        """The universe pushed forward ``ply`` times, so that ``side`` is to move at the end."""
        s = PositionSet.accept(spark, self.shape)
        for k in range(ply):
            mover = (side + ply - k) % 2
            s = PositionSet(spark, self.shape, rows=materialise(self.forward(mover, s).rows, "reachable"))
        return s

    # -- wins and losses over a universe ------------------------------------------------------

    def solver(self, spark: SparkSession, universe: PositionSet | None = None) -> Solver:
        return Solver(self, spark, universe)

    def names(self, kind: str, **keys: int) -> str:
        """Names under which results are kept."""
        if kind in ("losing", "winning", "unknown"):
            return f"backward,ply_max={keys['ply_max']:03d},side={keys['side']},{kind}"
        if kind in ("lost", "won"):
            return f"{kind},side_to_move={keys['side']}"
        if kind == "forward":
            return f"forward,ply={keys['ply']:03d}"
        if kind == "reachable":
            return f"reachable,side_to_move={keys['side']},ply={keys['ply']}"
        if kind == "has_moves":
            return f"has_moves-side={keys['side']}"
        raise ValueError(kind)


class Solver:
    """Who wins within k plies, over all positions of a universe (by default all of the game's).

    Over the whole universe of a game that can be ``reversed`` (sides swapped), only side 0 is solved: side 1
    wins or loses where side 0 does in the reversed position, and its moves aren't generated.
    """

    def __init__(self, game: Game, spark: SparkSession, universe: PositionSet | None = None, mirrored: bool = True):
        self.game, self.spark = game, spark
        self.mirrored = mirrored and universe is None and hasattr(game, "reversed")
        self.universe = packed(universe or PositionSet.accept(spark, game.shape), game.shape)
        self._edges: dict[int, DataFrame] = {}
        self._memo: dict[tuple, DataFrame] = {}

    def edges(self, side: int) -> DataFrame:
        if side not in self._edges:
            self._edges[side] = materialise(self.game.edges(self.universe, side).distinct(), "edges")
        return self._edges[side]

    def _where(self, p: P.Predicate) -> DataFrame:
        return self.universe.filter(p.column(lambda i: F.col("p")[i]))

    def _kept(self, key: tuple, make) -> DataFrame:
        if key not in self._memo:
            self._memo[key] = materialise(make(), key[0])
        return self._memo[key]

    def has_moves(self, side: int) -> DataFrame:
        return self._kept(("has_moves", side), lambda: self.edges(side).select("p").distinct())

    def into(self, side: int, targets: DataFrame) -> DataFrame:
        return self.edges(side).join(targets.withColumnRenamed("p", "q"), "q", "left_semi").select("p").distinct()

    def out_of(self, side: int, targets: DataFrame) -> DataFrame:
        """Positions with a move that leads elsewhere."""
        return self.edges(side).join(targets.withColumnRenamed("p", "q"), "q", "left_anti").select("p").distinct()

    def _other(self, kind: str, k: int) -> DataFrame:
        """Side 1's positions as side 0's, reversed."""
        shape = self.game.shape
        return self._kept((kind, 1, k, "reversed"), lambda: packed(self.game.reversed(unpacked(getattr(self, kind)(0, k), shape)), shape))

    def winning(self, side: int, k: int) -> DataFrame:
        g = self.game
        if side and self.mirrored:
            return self._other("winning", k)
        if g.normal_play:
            k -= 1 - k % 2  # odd numbers of plies only
            if k < 0:
                return self.universe.limit(0)
            return self._kept(("winning", side, k), lambda: self.into(side, self.losing(1 - side, k - 1)))
        won = g.won(side)
        if won is P.NEVER and k % 2 == 0:
            k -= 1
        if k <= 0:
            return self._kept(("won", side), lambda: self._where(won))
        return self._kept(("winning", side, k), lambda: self._where(won).union(self.into(side, self.losing(1 - side, k - 1))).distinct())

    def losing(self, side: int, k: int) -> DataFrame:
        g = self.game
        if side and self.mirrored:
            return self._other("losing", k)
        if g.normal_play:
            k -= k % 2  # even numbers only
            if k == 0:
                return self._kept(("losing", side, 0), lambda: self.universe.join(self.has_moves(side), "p", "left_anti"))
            return self._kept(("losing", side, k), lambda: self.universe.join(self.out_of(side, self.winning(1 - side, k - 1)), "p", "left_anti"))
        lost = g.lost(side)
        if lost is P.NEVER and k % 2 == 0:
            k -= 1
        if k <= 0:
            return self._kept(("lost", side), lambda: self._where(lost))

        def make():
            stuck = self.has_moves(side).join(self.out_of(side, self.winning(1 - side, k - 1)), "p", "left_anti")
            return self._where(lost).union(stuck).distinct()

        return self._kept(("losing", side, k), make)

    def unknown(self, side: int, k: int) -> DataFrame:
        """The rest of the universe: draws, and positions that no play reaches, included."""
        return self.universe.join(self.winning(side, k), "p", "left_anti").join(self.losing(side, k), "p", "left_anti")

    def table(self, plies: int) -> DataFrame:
        """ply_max, side, winning, losing, unknown; stops when nothing is unknown for either side."""
        rows, total = [], self.universe.count()
        for k in range(plies + 1):
            own = []
            for side in (0, 1):
                w, n = self.winning(side, k).count(), self.losing(side, k).count()
                own.append((k, side, w, n, total - w - n))
            rows += own
            if all(r[4] == 0 for r in own):
                break
        return self.spark.createDataFrame(rows, "ply_max int, side int, winning long, losing long, unknown long")

    def outcome(self, plies: int) -> tuple[int, int] | None:
        """(ply, 1 or -1): within how few plies the first player wins or loses from the start; nothing if neither."""
        at = F.col("p") == F.array(*(F.lit(c).cast("tinyint") for c in self.game.initial()))
        for k in range(plies + 1):
            if not self.winning(0, k).filter(at).isEmpty():
                return k, 1
            if not self.losing(0, k).filter(at).isEmpty():
                return k, -1
        return None


def solve_forward_backward(game: Game, spark: SparkSession, plies: int) -> DataFrame:
    """ply, win, lose, unknown over the positions that play reaches: a forward pass, then back from the last ply.

    A position whose ply is the last possible and that neither side has won is undecided (a draw where
    the game ends there), never counted as lost. Trailing empty plies are left out.
    """
    fronts = game.frontiers(spark, plies)
    if fronts[-1].rows.isEmpty():
        fronts = fronts[:-1]
    later: DataFrame | None = None
    rows = []
    for ply in range(len(fronts) - 1, -1, -1):
        side = ply % 2
        positions = packed(fronts[ply], game.shape)
        at = lambda i: F.col("p")[i]
        start = F.when(game.won(side).column(at), 1).when(game.lost(side).column(at), -1)
        state = positions.select("p", start.alias("own"))
        complete = later is None and ply < plies  # the frontier after it is empty: nobody can move
        if later is not None:
            met = game.edges(positions, side).distinct().join(later.withColumnRenamed("p", "q"), "q", "left")
            sums = met.groupBy("p").agg(F.max((F.coalesce("r", F.lit(0)) == -1).cast("int")).alias("some"), F.min((F.coalesce("r", F.lit(0)) == 1).cast("int")).alias("all"))
            state = state.join(sums, "p", "left")
            result = F.coalesce("own", F.when(F.col("some") == 1, 1).when(F.col("all") == 1, -1), F.lit(0))
            if game.normal_play:
                result = F.when(F.col("all").isNull(), -1).otherwise(result)
        elif game.normal_play and complete:
            result = F.lit(-1)
        else:
            result = F.coalesce("own", F.lit(0))
        later = materialise(state.select("p", result.cast("int").alias("r")), f"solved{ply:03d}")
        row = later.agg(F.sum((F.col("r") == 1).cast("long")), F.sum((F.col("r") == -1).cast("long")), F.sum((F.col("r") == 0).cast("long"))).first()
        rows.append((ply, *(v or 0 for v in row)))
    return spark.createDataFrame(rows, "ply int, win long, lose long, unknown long")


def with_fractions(table: DataFrame, win: str = "win", lose: str = "lose") -> DataFrame:
    total = F.col(win) + F.col(lose) + F.col("unknown")
    return table.select("*", *(F.when(total > 0, F.col(c) / total).alias(f"{c}_share") for c in (win, lose, "unknown")))
