"""Chess as DataFrames: frontiers, counts of move paths, ends of games, and predicates over slots.

Boards are rows ``board string`` (FEN without clocks). Successors come from one ``mapInArrow`` per
ply; between plies equal boards are merged and their multiplicities added up, so that the number of
rows is that of distinct boards, not of paths.
"""

from __future__ import annotations

import functools
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.functions import chess as C
from plyset.functions import predicates as P
from plyset.operators.positions import PositionSet
from plyset.plans.game import Game, packed, unpacked
from plyset.shape import Shape
from plyset.storage import materialise

RIGHTS_SLOT, FILE_SLOT = 64, 65


def position_shape() -> Shape:
    """64 squares by piece letter, castling rights, en-passant file (see ``Board.slots``)."""
    return Shape((*(len(C.PIECES),) * 64, 1 << len(C.RIGHTS), 9))


def boards(spark: SparkSession, *fens: str) -> DataFrame:
    return spark.createDataFrame([(C.Board.parse(f).key(),) for f in fens], "board string")


def placed(df: DataFrame, pieces: dict[str, str], white: bool = True) -> DataFrame:
    """The table with a ``board`` column: each column of ``pieces`` holds the square (0 is a8, 63 is h1) of a piece of its letter.

    Rows with a null, an impossible or a doubly used square have no board and go.
    """
    columns = list(pieces)
    spots = F.array(*(F.col(c).cast("int") for c in columns))
    sound = F.forall(spots, lambda s: F.coalesce(s.between(0, 63), F.lit(False))) & (F.size(F.array_distinct(spots)) == len(columns))
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(*(F.when(F.col(c).cast("int") == i, F.lit(k)) for c, k in pieces.items()), F.lit("1")))
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda y: F.array_join(F.slice(cells, y + 1, 8), "")), "/")
    for n in range(8, 1, -1):  # runs of empty squares are counted, the longest first
        rows = F.replace(rows, F.lit("1" * n), F.lit(str(n)))
    return df.filter(sound).withColumn("board", F.concat(rows, F.lit(f" {'wb'[not white]} - -")))


def spread(df: DataFrame) -> DataFrame:
    """Each distinct board once, dealt to all cores: boards are small rows, but to generate their moves is slow."""
    return df.select("board").distinct().repartition(df.sparkSession.sparkContext.defaultParallelism, "board")


def successors(df: DataFrame) -> DataFrame:
    """(board, move, next, n): legal moves of each board; ``n`` (how often a board was met) is handed on."""
    if "n" not in df.columns:
        df = df.withColumn("n", F.lit(1).cast("long"))

    def run(stream):
        for batch in stream:
            rows = []
            for board, n in zip(batch.column("board").to_pylist(), batch.column("n").to_pylist()):
                rows += [(board, move, after.key(), n) for move, after in C.Board.parse(board).moves()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["board", "move", "next", "n"])

    return df.select("board", "n").mapInArrow(run, "board string, move string, next string, n long")


def frontier(df: DataFrame) -> DataFrame:
    """Distinct boards after one move."""
    return successors(df.select("board").distinct()).select(F.col("next").alias("board")).distinct()


def perft(spark: SparkSession, fen: str, depth: int) -> DataFrame:
    """depth, paths, boards: how many move paths of each length there are, and to how many distinct boards."""
    now = boards(spark, fen).withColumn("n", F.lit(1).cast("long"))
    rows = []
    for d in range(1, depth + 1):
        step = successors(now.repartition(spark.sparkContext.defaultParallelism, "board") if d > 2 else now)
        now = materialise(step.groupBy(F.col("next").alias("board")).agg(F.sum("n").alias("n")), "perft")
        r = now.agg(F.sum("n"), F.count("*")).first()
        rows.append((d, r[0] or 0, r[1]))
        if not r[1]:
            break
    return spark.createDataFrame(rows, "depth int, paths long, boards long")


def divide(spark: SparkSession, fen: str, depth: int) -> DataFrame:
    """move, paths: perft by first move."""
    return divide_of(boards(spark, fen), depth).select("move", "paths")


def divide_of(df: DataFrame, depth: int) -> DataFrame:
    """board, move, paths: perft of each distinct board of a table by first move; boards without a move have no row.

    Equal boards behind one first move are merged with their multiplicities, and moves of a board that many
    share are generated once for all.
    """
    now = successors(spread(df)).select(F.col("board").alias("root"), "move", F.col("next").alias("board"), "n")
    for _ in range(depth - 1):
        now = materialise(now, "divide")
        step = successors(spread(now)).select("board", "next")
        now = now.join(step, "board").groupBy("root", "move", F.col("next").alias("board")).agg(F.sum("n").alias("n"))
    return now.groupBy(F.col("root").alias("board"), "move").agg(F.sum("n").alias("paths"))


def states(df: DataFrame) -> DataFrame:
    """board, check, checkmate, stalemate, draw_by_material, final as boolean columns."""

    def run(stream):
        for batch in stream:
            names = batch.column("board").to_pylist()
            parsed = [C.Board.parse(b) for b in names]
            tests = [[getattr(b, t)() for b in parsed] for t in ("check", "checkmate", "stalemate", "draw_by_material", "final")]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(t, pa.bool_()) for t in tests)], names=["board", "check", "checkmate", "stalemate", "draw_by_material", "final"])

    return df.select("board").mapInArrow(run, "board string, check boolean, checkmate boolean, stalemate boolean, draw_by_material boolean, final boolean")


def as_slots(df: DataFrame) -> DataFrame:
    """board and its slots c0..c65."""

    def run(stream):
        for batch in stream:
            names = batch.column("board").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([C.Board.parse(b).slots() for b in names], pa.list_(pa.int8()))], names=["board", "p"])

    both = df.select("board").mapInArrow(run, "board string, p array<tinyint>")
    return both.select("board", *(F.col("p")[i].alias(c) for i, c in enumerate(position_shape().columns)))


# -- predicates over slots: side 0 is white ----------------------------------------------------


def _own(kind: str, side: int) -> frozenset[int]:
    return frozenset(C.PIECES.index(k.upper() if side == 0 else k.lower()) for k in kind)


def at(square: int, letters: str) -> P.Predicate:
    return P.Among(square, frozenset(map(C.PIECES.index, letters)))


_EMPTY, SQUARES = frozenset([0]), tuple(range(64))


@lru_cache(maxsize=None)
def threat(side: int, square: int) -> P.Predicate:
    """The square is attacked by the side that isn't ``side``."""
    ways = []
    for kind, steps, far in (("n", C._KNIGHT, False), ("k", C._ROOK + C._BISHOP, False), ("rq", C._ROOK, True), ("bq", C._BISHOP, True)):
        for way in C.rays(square, steps, far):
            for n, i in enumerate(way):
                ways.append(P.every([P.Among(i, _own(kind, 1 - side)), *(P.Among(j, _EMPTY) for j in way[:n])]))
    y = square // 8 + (1 if side == 1 else -1)
    if 0 <= y < 8:
        ways += [P.Among(y * 8 + square % 8 + dx, _own("p", 1 - side)) for dx in (-1, 1) if 0 <= square % 8 + dx < 8]
    return P.some(ways)


def king(side: int) -> P.Predicate:
    """The side has one king."""
    return P.Count(SQUARES, _own("k", side), 1, 1)


@lru_cache(maxsize=None)
def check(side: int) -> P.Predicate:
    """The side to move stands in check."""
    return P.every([king(side), P.some([P.every([P.Among(s, _own("k", side)), threat(side, s)]) for s in SQUARES])])


def attacks(side: int) -> list[tuple[int, int, int, int]]:
    """(square, from, pieces, between) of all ways in which the side that isn't ``side`` attacks a square, the sets as masks."""
    bits = lambda chars: sum(1 << c for c in chars)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out = []
    for s in SQUARES:
        for kind, steps, far in (("n", C._KNIGHT, False), ("k", C._ROOK + C._BISHOP, False), ("rq", C._ROOK, True), ("bq", C._BISHOP, True)):
            out += [(s, i, bits(_own(kind, 1 - side)), signed(bits(way[:n]))) for way in C.rays(s, steps, far) for n, i in enumerate(way)]
        y = s // 8 + (1 if side == 1 else -1)
        out += [(s, y * 8 + s % 8 + dx, bits(_own("p", 1 - side)), 0) for dx in (-1, 1) if 0 <= y < 8 and 0 <= s % 8 + dx < 8]
    return out


def in_check(slots: DataFrame, side: int) -> DataFrame:
    """The table of slots with a column ``in_check``: the same as ``check``, for tables of many boards.

    The king's square finds the lines that attack it in a table of 64 rows; no predicate over all squares is compiled.
    A side without exactly one king isn't in check.
    """
    ways = slots.sparkSession.createDataFrame(attacks(side), "square int, at int, pieces long, free long")
    ways = ways.groupBy("square").agg(F.collect_list(F.struct("at", "pieces", "free")).alias("ways"))
    cells = F.array(*(F.col(f"c{i}").cast("int") for i in SQUARES))
    kings = F.lit(next(iter(_own("k", side))))
    held = F.aggregate(F.transform("cells", lambda c, i: F.when(c != 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    df = slots.withColumn("cells", cells).withColumn("held", held)
    one = F.size(F.filter("cells", lambda c: c == kings)) == 1
    df = df.withColumn("square", F.when(one, F.array_position("cells", kings).cast("int") - 1))
    attacked = F.expr("exists(ways, w -> held & w.free = 0L and shiftright(w.pieces, cells[w.at]) & 1L = 1L)")
    return df.join(F.broadcast(ways), "square", "left").withColumn("in_check", F.coalesce(attacked, F.lit(False))).drop("cells", "held", "square", "ways")


def not_check(side: int) -> P.Predicate:
    return ~check(side)


def can_move_capture(side: int, square: int) -> P.Predicate:
    """A hostile piece that isn't the king stands there."""
    return P.Among(square, _own("qbnrp", 1 - side))


def can_move_basic(side: int, square: int) -> P.Predicate:
    """Empty, or to be captured."""
    return P.Among(square, _EMPTY | _own("qbnrp", 1 - side))


def legal_shared() -> P.Predicate:
    """No pawns on the outer rows, rights only with king and rook at home, one king each."""
    pawns = _own("p", 0) | _own("p", 1)
    tests: list[P.Predicate] = [P.Among(s, frozenset(range(len(C.PIECES))) - pawns) for s in SQUARES if s // 8 in (0, 7)]
    for k, (right, home, corner) in enumerate((("K", 60, 63), ("Q", 60, 56), ("k", 4, 7), ("q", 4, 0))):
        without = P.Among(RIGHTS_SLOT, frozenset(r for r in range(16) if not r >> k & 1))
        tests.append(P.some([without, P.every([at(home, "kK"[right.isupper()]), at(corner, "rR"[right.isupper()])])]))
    return P.every([*tests, king(0), king(1)])


def legal(side: int) -> P.Predicate:
    """What every position with ``side`` to move satisfies; that the other side stands in check isn't excluded."""
    row, up, pawn = (16, -8, "p") if side == 0 else (40, 8, "P")
    passed = [P.every([P.Among(FILE_SLOT, frozenset([x + 1])), at(row + x, "."), at(row + x + up, "."), at(row + x - up, pawn)]) for x in range(8)]
    return P.every([legal_shared(), P.some([P.Among(FILE_SLOT, _EMPTY), *passed])])


class Mated(P.Predicate):
    """The side to move is checkmated: no test of fixed slots, so legal moves are generated, in Arrow batches."""

    def __init__(self, side: int, known: tuple[tuple[int, int], ...] = ()):
        self.side, self.known = side, known

    def __eq__(self, other):
        return isinstance(other, Mated) and (self.side, self.known) == (other.side, other.known)

    def __hash__(self):
        return hash((self.side, self.known))

    def column(self, at):
        known, white = dict(self.known), self.side == 0

        @F.pandas_udf("boolean")
        def mated(p: pd.Series) -> pd.Series:
            return pd.Series([bool(C.Board.from_slots(map(int, x), white).checkmate()) for x in p])

        slot = lambda i: F.lit(known[i]).cast("tinyint") if i in known else at(i)
        return mated(F.array(*(slot(i) for i in range(66))))

    def given(self, known):
        every = dict(self.known) | {i: c for i, c in known.items() if i < 66}
        if len(every) == 66:
            return P.constant(C.Board.from_slots([every[i] for i in range(66)], self.side == 0).checkmate())
        return Mated(self.side, tuple(sorted(every.items())))


class Chess(Game):
    """Chess over slots. Its moves aren't rules of fixed slots: a generator makes them, forward and back, in Arrow batches.

    The universe is never enumerated: frontiers, backward steps from given positions and combined solves work.
    """

    name = "chess"

    def __init__(self, start: str = C.START):
        self.shape, self.start_board = position_shape(), C.Board.parse(start)
        if not self.start_board.white:
            raise ValueError("side 0 is white and moves first")

    def initial(self):
        return self.start_board.slots()

    def lost(self, side: int) -> P.Predicate:
        return Mated(side)

    def successors(self, side, position):
        return [after.slots() for _, after in C.Board.from_slots(position, side == 0).moves()]

    @staticmethod
    def _spread(positions: DataFrame, to) -> DataFrame:
        def run(stream):
            for batch in stream:
                rows = [(p, q) for p in batch.column("p").to_pylist() for q in to(p)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int8())) for c in zip(*rows)], names=["p", "q"])

        return positions.select("p").mapInArrow(run, "p array<tinyint>, q array<tinyint>")

    def edges(self, positions: DataFrame, side: int) -> DataFrame:
        return self._spread(positions, lambda p: [after.slots() for _, after in C.Board.from_slots(p, side == 0).moves()])

    def backward(self, side: int, s: PositionSet) -> PositionSet:
        back = self._spread(packed(s, self.shape), lambda q: [b.slots() for b in C.Board.from_slots(q, side == 1).unmoves()])
        return unpacked(back.select(F.col("q").alias("p")), self.shape, distinct=True)

    def before(self, side, where):
        raise NotImplementedError("chess moves aren't rules of fixed slots")

    def move_graph(self, side):
        raise NotImplementedError("chess moves aren't rules of fixed slots")

    def reversed(self, s: PositionSet) -> PositionSet:
        """Sides swapped: rows from top to bottom, colours, rights."""
        swap = {i: C.PIECES.index(k.swapcase()) for i, k in enumerate(C.PIECES)}
        mapped = lambda c, to: F.element_at(F.array(*(F.lit(to[k]).cast("tinyint") for k in range(len(to)))), F.col(c).cast("int") + 1)
        cells = [mapped(f"c{(7 - i // 8) * 8 + i % 8}", swap).alias(f"c{i}") for i in SQUARES]
        rights = mapped(f"c{RIGHTS_SLOT}", {k: (k >> 2) | (k & 3) << 2 for k in range(16)}).alias(f"c{RIGHTS_SLOT}")
        rows = s.frame().select(*cells, rights, f"c{FILE_SLOT}")
        return PositionSet.from_frame(rows, self.shape, distinct=False)

    def show(self, position):
        return "\n".join(" ".join(C.PIECES[c] for c in position[8 * y : 8 * y + 8]) for y in range(8))


def lost(df: DataFrame) -> DataFrame:
    """Boards of ``df`` whose side to move is checkmated; stalemates stay undecided."""
    return states(df).filter("checkmate").select("board")


def piece_universe(spark: SparkSession, pieces: str, white: bool = True) -> DataFrame:
    """All placements of both kings and the given pieces, whose side to move could have got there: the other's king isn't attacked."""
    side = "w" if white else "b"
    letters = "Kk" + pieces
    df = spark.range(64 ** len(letters))
    spots = [F.expr(f"cast(shiftright(id, {6 * k}) & 63 as int)").alias(f"s{k}") for k in range(len(letters))]
    df = df.select(*spots)
    for k in range(1, len(letters)):
        for j in range(k):  # equal pieces in order, so that each board comes once
            df = df.filter(F.col(f"s{j}") < F.col(f"s{k}") if letters[j] == letters[k] else F.col(f"s{j}") != F.col(f"s{k}"))
    for k, c in enumerate(letters):
        if c in "Pp":
            df = df.filter(F.col(f"s{k}").between(8, 55))

    def run(stream):
        for batch in stream:
            out = []
            for spots in zip(*(c.to_pylist() for c in batch.columns)):
                cells = ["."] * 64
                for s, c in zip(spots, letters):
                    cells[s] = c
                b = C.Board("".join(cells), side == "w")
                if not b.check(not b.white):
                    out.append(b.key())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["board"])

    return df.mapInArrow(run, "board string")


def materials(pieces: str) -> list[str]:
    """What is left of the pieces after any captures and promotions, themselves included."""
    found, todo = {}, ["".join(sorted(pieces))]
    while todo:
        own = todo.pop()
        if own in found:
            continue
        found[own] = None
        for k, c in enumerate(own):
            rest = own[:k] + own[k + 1 :]
            todo += [rest, *("".join(sorted(rest + q)) for q in ("QRBN" if c == "P" else "qrbn") if c in "Pp")]
    return sorted(found, key=lambda m: (len(m), m))


def endgame_database(spark: SparkSession, pieces: str, plies: int) -> DataFrame:
    """board, ply: boards of the given pieces, and of what captures and promotions leave of them, whose side to move is
    mated (0) or wins or loses within ``plies``.

    Odd plies hold wins (a move into a lost board), even ones losses (every move leads into a won board).
    """
    parts = [piece_universe(spark, m, white) for m in materials(pieces) for white in (True, False)]
    universe = materialise(functools.reduce(DataFrame.union, parts), "universe")
    edges = materialise(successors(universe).select("board", "next"), "edges")
    done = materialise(lost(universe).withColumn("ply", F.lit(0)), "db")
    for ply in range(1, plies + 1):
        last = done.filter((F.col("ply") % 2) == (ply - 1) % 2).select(F.col("board").alias("next"))
        if ply % 2:
            new = edges.join(last, "next", "left_semi").select("board").distinct()
        else:
            stuck = edges.join(last, "next", "left_anti").select("board").distinct()
            new = edges.select("board").distinct().join(stuck, "board", "left_anti")
        new = materialise(new.join(done.select("board"), "board", "left_anti").withColumn("ply", F.lit(ply)), "db")
        done = materialise(done.union(new), "db")
    return done
