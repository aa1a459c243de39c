import functools
import operator

import pytest

from plyset.functions.chess import START, Board, between, move_table
from plyset.games import chess, get_game
from plyset.operators import checks
from plyset.operators.positions import PositionSet
from plyset.plans.game import Solver, solve_forward_backward, unpacked
from plyset.plans.moves import MoveGraph
from plyset.shape import Shape


@pytest.mark.parametrize("name", ["normalnim_2x3", "tictactoe_3", "breakthrough_4x4", "breakthroughcw_4x5", "amazons_4x4", "othello_4x4"])
def test_moves_agree_with_generators(spark, name):
    g = get_game(name)
    fronts = g.frontiers(spark, 2)
    for ply, s in enumerate(fronts):
        assert checks.moves(g, ply % 2, s, 40)
    assert isinstance(g.show(g.initial()), str)


@pytest.mark.parametrize("heaps,most", [(1, 3), (2, 3), (3, 3)])
def test_nim_losses_are_xor_zero(spark, heaps, most):
    g = get_game(f"normalnim_{heaps}x{most}")
    lost = set(unpacked(g.solver(spark).losing(0, heaps * most), g.shape))
    assert lost == {u for u in PositionSet.accept(spark, g.shape) if functools.reduce(operator.xor, u) == 0}


def test_backward_is_forward_turned(spark):
    g = get_game("normalnim_2x3")
    every = PositionSet.accept(spark, g.shape)
    some = PositionSet.from_strings(spark, g.shape, [(1, 2), (0, 0), (3, 1)])
    targets = set(some)
    want = {u for u in every if set(g.successors(0, u)) & targets}
    assert set(g.backward(0, some)) == want
    assert set(PositionSet(spark, g.shape, where=g.before(0, (PositionSet.fixed(spark, g.shape, 0, 0)).where)).frame().collect()) == {u for u in every if any(v[0] == 0 for v in g.successors(0, u))}
    b = get_game("breakthrough_4x4")
    after = b.forward(0, b.start(spark))
    assert set(b.start(spark)) <= set(b.backward(0, after))


def test_tictactoe_solved(spark):
    rows = {r.ply: (r.win, r.lose, r.unknown) for r in solve_forward_backward(get_game("tictactoe_3"), spark, 10).collect()}
    assert rows[9] == (0, 62, 16) and rows[8] == (142, 168, 80) and rows[0] == (0, 0, 1)


def test_solver_rules_and_outcomes(spark):
    g = get_game("tictactoe_2")
    s = g.solver(spark)
    assert s.outcome(4) == (3, 1) and checks.solved(g, s, 3)
    table = {(r.ply_max, r.side): (r.winning, r.losing, r.unknown) for r in get_game("normalnim_2x3").solver(spark).table(6).collect()}
    assert table[3, 0] == (10, 2, 4) and table[6, 1] == (12, 4, 0)
    assert g.names("losing", ply_max=3, side=1) == "backward,ply_max=003,side=1,losing"


def test_reversed_boards(spark):
    for name in ("breakthrough_4x4", "amazons_4x4"):
        g = get_game(name)
        s = g.forward(0, g.start(spark))
        assert g.reversed(g.reversed(s)).equals(s)
    b = get_game("breakthrough_4x4")
    assert b.reversed(b.start(spark)).equals(b.start(spark))


def test_names_and_graphs():
    for bad in ("chess_4", "othello_3x4", "breakthrough_4x3", "tictactoe_x"):
        with pytest.raises(ValueError):
            get_game(bad)
    g = MoveGraph(Shape((2, 2)))
    g.add_node("a")
    g.add_node("b", {0: (0, 1)})
    g.add_node("dead")
    g.add_node("c")
    g.add_edge("ab", "a", "b")
    g.add_edge("bc", "b", "c")
    g.add_edge("ad", "a", "dead")
    assert len(g.optimized()) == 3 and len(g.rules()) == 1
    back = g.optimized().reversed().rules()
    assert back[0].put == ((0, 0),)
    for call in (lambda: g.add_node("a"), lambda: g.add_edge("ab", "a", "c"), lambda: g.add_edge("x", "c", "a")):
        with pytest.raises(ValueError):
            call()


PERFT = {
    START: (20, 400, 8902),
    "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - -": (14, 191, 2812),
    "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -": (48, 2039),
    "n1n5/PPPk4/8/8/8/8/4Kppp/5N1N b - - 0 1": (24, 496),
    "8/8/8/8/1p6/8/P7/8 w KQkq - 0 1": (2, 4),
    "8/1p6/8/P7/8/8/8/8 b KQkq - 0 1": (2, 4),
}


def test_perft(spark):
    for fen, counts in PERFT.items():
        assert tuple(r.paths for r in chess.perft(spark, fen, len(counts)).orderBy("depth").collect()) == counts
    assert sum(r.paths for r in chess.divide(spark, START, 2).collect()) == 400


def test_chess_predicates_agree_with_the_generator(spark):
    df = chess.frontier(chess.boards(spark, "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - -"))
    df = df.union(chess.frontier(df).filter("board like '% w %'").limit(40))
    told = {r.board: r.check for r in chess.states(df).collect()}
    for side, letter in ((0, "w"), (1, "b")):
        rows = chess.as_slots(df.filter(f"board like '% {letter} %'")).select("board", chess.check(side).column(PositionSet._at).alias("c")).collect()
        assert rows and all(told[r.board] == r.c for r in rows)


def test_chess_boards():
    for fen in PERFT:
        b = Board.parse(fen)
        assert Board.parse(b.fen()) == b and Board.from_slots(b.slots(), b.white).key() == b.key()
    assert Board.parse("rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq -").play("d8h4").checkmate()
    assert Board.parse("7k/5Q2/6K1/8/8/8/8/8 b - -").stalemate()
    assert Board.parse("7k/8/6K1/8/8/8/8/6N1 w - -").draw_by_material() and Board.parse("7k/8/6K1/8/8/8/8/6R1 w - - 100 80").final()
    assert between(0, 63) == (9, 18, 27, 36, 45, 54) and between(0, 17) is None
    assert len([m for m in move_table() if m[0] == "n"]) == 336
    with pytest.raises(ValueError):
        Board.parse("8/8/8 w - -")


def test_small_endgame(spark):
    db = {r.ply: r.n for r in chess.endgame_database(spark, "Q", 1).groupBy("ply").count().withColumnRenamed("count", "n").collect()}
    assert db[0] == 364 and db[1] > 0  # mates of king and queen against king
    assert chess.materials("Pr") == ["", "B", "N", "P", "Q", "R", "r", "Br", "Nr", "Pr", "Qr", "Rr"]


def test_chess_is_a_game(spark):
    import random

    from plyset.plans.game import solve_forward_backward

    g = get_game("chess")
    assert [s.size() for s in g.frontiers(spark, 2)] == [1, 20, 400]
    one = g.positions_forward(spark, 1)
    turned = g.reversed(g.start(spark))
    assert g.reversed(one).equals(g.forward(1, turned)) and g.reversed(g.reversed(one)).equals(one)
    mate = chess.Chess("6k1/5ppp/8/8/8/8/5PPP/R5K1 w - -")
    table = {r.ply: r for r in solve_forward_backward(mate, spark, 2).collect()}
    assert (table[0].win, table[1].lose) == (1, 1)  # the rook mates on the last row
    rng = random.Random(5)
    for fen in ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -", "n1n5/PPPk4/8/8/8/8/4Kppp/5N1N b - -", "8/8/8/3pP3/8/8/4k2K/8 w - d6"):
        b = Board.parse(fen)
        for _, after in rng.sample(b.moves(), 3):
            before = {x.slots() for x in after.unmoves()}
            assert b.slots() in before
            assert all(after.slots() in {y.slots() for _, y in Board.from_slots(x, b.white).moves()} for x in list(before)[:5])
    end = Board.parse("8/8/8/8/8/5k2/8/R6K b - -")
    back = {tuple(p) for p in g.backward(0, PositionSet.from_string(spark, g.shape, end.slots()))}
    want = set()  # whatever the other side's man may have been is among them
    for i in range(64):
        if end.cells[i] == "." and abs(i % 8 - 7) <= 1 and i // 8 >= 6:
            want.add(Board("".join("K" if k == i else "." if end.cells[k] == "K" else c for k, c in enumerate(end.cells)), True).slots())
    want = {w for w in want if end.slots() in {y.slots() for _, y in Board.from_slots(w, True).moves()}}
    assert want and want <= back


def test_analysis(spark, tmp_path):
    from plyset.plans.analysis import analyse, frontier
    from plyset.sources import Catalog

    g = get_game("tictactoe_2")
    held = analyse(g, spark, f"file://{tmp_path}", 4, 3, 20)
    assert held and all(held.values())
    catalog = Catalog(spark, f"file://{tmp_path}/sets")
    assert catalog.load_by_name("tictactoe_2/forward,ply=002").size() == 12 and frontier(g, catalog, 2).size() == 12
    assert catalog.load_by_name("tictactoe_2/backward,ply_max=003,side=0,winning").size() > 0
    assert catalog.vacuum() == []
    assert spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/stats").count() == 4


def test_a_mirrored_solver_finds_the_same(spark):
    g = get_game("breakthrough_2x4")
    one, both = g.solver(spark), Solver(g, spark, mirrored=False)
    assert one.mirrored and not both.mirrored
    for k in (0, 1, 2, 3):
        for kind in ("winning", "losing"):
            for side in (0, 1):
                got, want = ({tuple(r.p) for r in getattr(s, kind)(side, k).collect()} for s in (one, both))
                assert got == want and (want or kind == "winning"), (kind, side, k)
    assert 1 not in one._edges
    assert checks.terminal(g, spark, 0) and checks.terminal(get_game("tictactoe_2"), spark, 1)
