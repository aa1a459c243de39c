import itertools

import pytest
from pyspark.sql import functions as F

from plyset import board_queries
from plyset.functions import predicates as P
from plyset.games import chess, get_game
from plyset.operators.positions import PositionSet
from plyset.plans import judged as J
from plyset.plans import moves
from plyset.plans.game import packed


def positions(spark, game, rows):
    return spark.createDataFrame([(list(r),) for r in rows], "p array<tinyint>")


def value(game, side, p, plies):
    """Plain minimax by the games' own generators."""
    tests = [(game.won(side), 1), (game.lost(side), -1)]
    for test, result in tests:
        if test.holds(p):
            return result
    moves = game.successors(side, p)
    if not moves:
        return -1 if game.normal_play else 0
    if not plies:
        return 0
    found = [value(game, 1 - side, q, plies - 1) for q in moves]
    return 1 if -1 in found else -1 if all(r == 1 for r in found) else 0


@pytest.mark.parametrize(("name", "side", "plies", "step"), [("normalnim_3x3", 0, 9, 1), ("normalnim_2x3", 1, 2, 1), ("tictactoe_3", 0, 2, 97), ("tictactoe_2", 1, 4, 1), ("breakthrough_3x4", 1, 2, 9973), ("othello_2x2", 0, 3, 1)])
def test_judged_is_minimax(spark, name, side, plies, step):
    g = get_game(name)
    rows = list(itertools.islice(itertools.product(*(range(n) for n in g.shape.sizes)), 0, None, step))
    got = {tuple(r.p): r.result for r in J.judged(g, positions(spark, g, rows + rows[:3]), side, plies).collect()}
    assert got == {p: value(g, side, p, plies) for p in rows}
    moves = {tuple(r.p): r.moves for r in J.mobility(g, positions(spark, g, rows), side).collect()}
    assert moves == {p: len(set(g.successors(side, p))) for p in rows}


def test_judged_equals_the_solver(spark):
    g = get_game("normalnim_3x3")
    every = packed(PositionSet.accept(spark, g.shape), g.shape)
    s = g.solver(spark)
    for k in (0, 1, 4):
        own = J.judged(g, every, 0, k)
        for r, kind in ((1, "winning"), (-1, "losing")):
            assert sorted(map(tuple, (x.p for x in own.filter(F.col("result") == r).collect()))) == sorted(map(tuple, (x.p for x in getattr(s, kind)(0, k).collect())))


def test_every_row_is_answered(spark, monkeypatch):
    g = get_game("normalnim_2x3")
    rows = spark.range(400).select("id", J.encoded([F.when(F.col("id") < 300, 3).otherwise(F.col("id") % 4), F.lit(1)], g.shape).alias("p"), F.lit("x").alias("result_of_mine"))
    told = J.judged(g, rows, 0, 4)
    broadcast = sorted(map(tuple, J.answered(rows, told).collect()))
    monkeypatch.setattr(J, "MOST_BROADCAST", 0)
    salted = J.answered(rows, told)
    assert sorted(map(tuple, salted.select("p", "id", "result_of_mine", "result").collect())) == broadcast and len(broadcast) == 400
    assert J.answered(rows.select("p"), told).count() == 400 == J.answered(rows.withColumn("a.b", F.create_map("id", "id")), told).count()
    assert {(r.id, r.result) for r in salted.collect()} == {(i, -1 if (3 if i < 300 else i % 4) == 1 else 1) for i in range(400)}


def test_empty_tables_nulls_and_strange_characters(spark):
    g = get_game("normalnim_2x3")
    none = positions(spark, g, [])
    assert J.judged(g, none, 0, 3).count() == 0 and J.mobility(g, none, 0).count() == 0
    assert J.answered(none.withColumn("k", F.lit(1)), J.judged(g, none, 0, 3)).columns == ["p", "k", "result"]
    for bad in (4, -1, None):
        with pytest.raises(Exception, match="no character of the layer"):
            spark.createDataFrame([(bad,)], "h int").select(J.encoded([F.col("h"), F.lit(0)], g.shape)).collect()
    with pytest.raises(ValueError):
        J.encoded([F.lit(0)], g.shape)
    codes = spark.range(16).select("id", J.from_code(F.col("id"), g.shape).alias("p")).collect()
    assert all(tuple(r.p) == (r.id % 4, r.id // 4) for r in codes)


def test_placed_and_in_check(spark):
    rows = [(k, (k * 37 + 5) % 64, (k * 11) % 64, (k * 23 + 1) % 64, (k * 7 + 3) % 64) for k in range(300)] + [(300, None, 1, 2, 3), (301, 5, 5, 6, 7), (302, 64, 1, 2, 3)]
    df = spark.createDataFrame(rows, "id int, wk int, bk int, x int, y int")
    for letters in ({"wk": "K", "bk": "k", "x": "q", "y": "R"}, {"wk": "K", "bk": "k", "x": "n", "y": "p"}, {"wk": "K", "bk": "k", "x": "P", "y": "b"}):
        for white in (True, False):
            made = chess.placed(df, letters, white).select("id", "board")
            boards = {r.id: r.board for r in made.collect()}
            assert set(boards) == {r[0] for r in rows[:300] if len(set(r[1:])) == 4}
            for i, text in boards.items():
                board = chess.C.Board.parse(text)
                assert board.key() == text and {c: board.cells.index(k) for c, k in letters.items()} == dict(zip(("wk", "bk", "x", "y"), rows[i][1:]))
            told = {r.board: r.in_check for r in chess.in_check(chess.as_slots(made), 0 if white else 1).select("board", "in_check").collect()}
            assert told == {b: chess.C.Board.parse(b).check() for b in boards.values()}
    bare = chess.as_slots(spark.createDataFrame([("8/8/8/8/8/8/8/r7 w - -",), ("K6K/8/8/8/8/8/8/r7 w - -",)], "board string"))
    assert [r.in_check for r in chess.in_check(bare, 0).collect()] == [False, False]


@pytest.mark.parametrize(("name", "side", "step"), [("amazons_4x4", 1, 40_000_003), ("othello_4x4", 0, 400_003), ("breakthrough_3x4", 1, 9973), ("tictactoe_3", 0, 97), ("normalnim_3x3", 1, 1)])
def test_moves_of_every_row_need_no_join(spark, name, side, step):
    g = get_game(name)
    codes = list(range(0, g.shape.universe, step))
    rows = spark.createDataFrame([(c,) for c in codes * 2], "code long").withColumn("p", J.from_code(F.col("code"), g.shape))
    df = J.with_moves(g, rows, side)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = sorted((tuple(r.p), r.moves) for r in df.collect())
    assert got == sorted((tuple(r.p), len(set(g.successors(side, tuple(r.p))))) for r in rows.collect())


def test_moves_that_may_meet_are_counted_on_their_results(spark):
    class Odd(type(get_game("tictactoe_2"))):
        """Two rules of which the second may write what is there."""

        def rules(self, side):
            return [moves.Rule(P.fixed(self.shape, 0, 1), ((1, 1),)), moves.Rule(P.fixed(self.shape, 0, 1), ((2, 1),))]

        def may_move(self, side):
            return P.ALWAYS

    g = Odd(2)
    assert g.results(0) is None
    told = {tuple(r.p): r.moves for r in J.with_moves(g, positions(spark, g, [(1, 1, 1, 0), (1, 0, 1, 0), (1, 0, 0, 0), (0, 0, 0, 0)]), 0).collect()}
    assert told == {(1, 1, 1, 0): 1, (1, 0, 1, 0): 2, (1, 0, 0, 0): 2, (0, 0, 0, 0): 0}


def test_many_answers_never_go_through_the_driver(spark, monkeypatch):
    g = get_game("normalnim_2x3")
    rows = spark.range(400).select("id", J.encoded([F.col("id") % 4, F.lit(1)], g.shape).alias("p"))
    told = J.judged(g, rows, 0, 4)
    monkeypatch.setattr(J, "MOST_BROADCAST", 0)
    df = J.answered(rows, told)
    assert df.count() == 400
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_boards_of_lines_are_made_once(spark, tmp_path):
    spark.createDataFrame([(k % 50, k % 7, k % 3) for k in range(600)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = board_queries.QUERIES["lines_tictactoe"](spark, str(tmp_path))
    assert df.count() == 600
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" not in plan and "no character" not in plan.split("Join")[0]  # rows meet answers by their code, no position is made for a row
    g = get_game("tictactoe_3")
    for r in df.distinct().collect():
        p = tuple(r.code // 3**i % 3 for i in range(9))
        assert (r.result, r.moves, r.lost) == (value(g, 0, p, 2), len(set(g.successors(0, p))), g.lost(0).holds(p))
