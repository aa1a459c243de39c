"""Registered queries of the set engine, each with SQL that says the same.

Set algebra runs over all of ``lineitem``, encoded as positions of shape (16, 16, 7, 50). Games are
played from positions that tables hold in ``board_queries``; those here start from the games' own
boards, and their SQL is a closed formula where there is one, else the published or independently
computed counts.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyset import board_queries
from plyset.functions.board import show_column
from plyset.cli import main
from plyset.functions.predicates import count_character, every, fixed, some
from plyset.games import chess, get_game
from plyset.operators import checks
from plyset.operators import automaton as automata
from plyset.operators.automaton import Automaton, fold
from plyset.operators.positions import PositionSet, bound_within, intersection, union
from plyset.plans import moves
from plyset.plans.analysis import analyse
from plyset.plans.game import packed, solve_forward_backward, unpacked, with_fractions
from plyset.plans.judged import from_code
from plyset.shape import Shape
from plyset.sources.automata import AutomatonStore
from plyset.sources.catalog import Catalog, write_tsv
from plyset.storage import shared_dir

SHAPE = Shape((16, 16, 7, 50))


def lineitem(spark: SparkSession, sf_dir: str, test: str | None = None) -> PositionSet:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = df.filter(test) if test else df
    return PositionSet.from_frame(df.selectExpr("l_partkey % 16", "l_suppkey % 16", "l_linenumber - 1", "cast(l_quantity as int) - 1"), SHAPE)


def ints(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("int").alias(c) for c in df.columns))


def flag(spark, d, f):
    return lineitem(spark, d, f"l_returnflag = '{f}'")


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def q_change(spark, d):
    return ints(lineitem(spark, d).change({2: (3, 5)}).frame())


def q_change_complement(spark, d):
    return ints((~lineitem(spark, d)).change({0: (1, 2), 2: (3, 5)}).frame())


def q_bound(spark, d):
    rows = [(i, c) for i, s in enumerate(lineitem(spark, d).bound()) for c in sorted(s)]
    return spark.createDataFrame(rows, "layer int, c int")


def q_size(spark, d):
    a, r = flag(spark, d, "A"), flag(spark, d, "R")
    return _one(spark, all_n=lineitem(spark, d).size(), a_n=a.size(), both_n=(a & r).size(), not_a_n=(~a).size(), universe_n=SHAPE.universe)


def q_linear(spark, d):
    a = lineitem(spark, d)
    return _one(spark, rows_linear=a.is_linear(), fixed_linear=PositionSet.fixed(spark, SHAPE, 2, 3).is_linear(), cell_linear=(a & PositionSet.matching(spark, SHAPE, fixed(SHAPE, 0, 1) & fixed(SHAPE, 1, 1) & fixed(SHAPE, 2, 1))).is_linear())


def q_checks(spark, d):
    a, r, n = (flag(spark, d, f) for f in "ARN")
    all_ = lineitem(spark, d)
    parts = [a, r - a, n - a - r]
    return _one(
        spark, equal_self=checks.equal(all_, union(spark, SHAPE, [n, r, a])), equal_other=checks.equal(a, r), subset_a=checks.subset(a, all_), subset_back=checks.subset(all_, a),
        partition_parts=checks.partition(all_, parts), partition_bad=checks.partition(all_, [a, r, n]), disjoint_parts=checks.disjoint(parts[0], parts[1]), disjoint_ar=checks.disjoint(a, r),
    )


def q_contains(spark, d):
    wanted = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_linestatus = 'O'").selectExpr("l_partkey % 16", "l_suppkey % 16", "l_linenumber - 1", "cast(l_quantity as int) - 1")
    return ints(flag(spark, d, "A").contains_batch(PositionSet.from_frame(wanted, SHAPE)).frame())


def q_automaton(spark, d):
    a = Automaton.of(flag(spark, d, "A"))
    return spark.createDataFrame([(i, n) for i, n in enumerate(a.layer_sizes())], "layer int, states long")


def q_automaton_algebra(spark, d):
    a, r = Automaton.of(flag(spark, d, "A")), Automaton.of(flag(spark, d, "R"))
    return _one(spark, both_n=(a & r).size(), any_n=(a | r).size(), only_n=(a - r).size(), not_n=a.complement().size(), same=(a | r) == Automaton.of(lineitem(spark, d, "l_returnflag in ('A', 'R')")))


def heaps_among(spark, d, found: PositionSet) -> DataFrame:
    """The heaps of lines that belong to a set."""
    return ints((found & board_queries.small_heaps(spark, d, "true")).frame())


def q_nim(kind: str) -> Callable:
    def run(spark, d):
        g = get_game("normalnim_3x4")
        s = g.solver(spark)
        df = s.losing(0, 12) if kind == "losing" else s.winning(0, 12)
        return heaps_among(spark, d, unpacked(df, g.shape))

    return run


def q_nim_table(spark, d):
    return get_game("normalnim_3x4").solver(spark).table(12)


def q_nim_moves(direction: str) -> Callable:
    def run(spark, d):
        g = get_game("normalnim_3x4")
        s = PositionSet.from_strings(spark, g.shape, [(4, 2, 0), (1, 1, 3)])
        return ints((g.forward(0, s) if direction == "forward" else g.backward(0, s)).frame())

    return run


def q_nim_before(spark, d):
    g = get_game("normalnim_3x4")
    return heaps_among(spark, d, g.backward(0, PositionSet.matching(spark, g.shape, count_character(g.shape, 0, 3))))


def q_frontier(name: str, plies: int) -> Callable:
    def run(spark, d):
        return spark.createDataFrame([(k, s.size()) for k, s in enumerate(get_game(name).frontiers(spark, plies))], "ply int, positions long")

    return run


def q_ttt_solve(spark, d):
    return solve_forward_backward(get_game("tictactoe_3"), spark, 10)


def q_ttt_shares(spark, d):
    return with_fractions(solve_forward_backward(get_game("tictactoe_2"), spark, 4)).select("ply", F.round("win_share", 6).alias("win_share"), F.round("lose_share", 6).alias("lose_share"), F.round("unknown_share", 6).alias("unknown_share"))


def ttt_boards(spark, d) -> PositionSet:
    """The boards that lines spell, each once."""
    rows = board_queries.lines(spark, d).select(F.expr(board_queries.TTT).alias("code"))
    return unpacked(board_queries.ttt_boards(rows), get_game("tictactoe_3").shape, distinct=True)


def q_ttt_lost(spark, d):
    """How many of all boards are lost as they stand and how many have moves, and how many of those that lines spell."""
    g, boards = get_game("tictactoe_3"), ttt_boards(spark, d)
    lost, moving = PositionSet.matching(spark, g.shape, g.lost(0)), g.has_moves(spark, 0)
    return _one(spark, lost_n=lost.size(), moves_n=moving.size(), spelt_lost_n=(boards & lost).size(), spelt_moves_n=(boards & moving).size())


def q_ttt_boards(spark, d):
    g = get_game("tictactoe_3")
    return ttt_boards(spark, d).frame().select(show_column(g.shape.columns, 3, ".xo").alias("board"))


def q_breakthrough_reversed(spark, d):
    g = get_game("breakthrough_4x4")
    s = g.positions_forward(spark, 1)
    other = g.forward(1, g.start(spark))
    return _one(spark, same=g.reversed(s).equals(other), n=s.size())


def q_outcomes(spark, d):
    rows = []
    for name, plies in (("tictactoe_1", 1), ("tictactoe_2", 3), ("normalnim_1x3", 3), ("normalnim_2x3", 6)):
        found = get_game(name).solver(spark).outcome(plies)
        rows.append((name, *(found or (None, 0))))
    return spark.createDataFrame(rows, "game string, ply int, result int")


def q_perft(spark, d):
    fens = {"initial": chess.C.START, "endgame": "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - -", "castling": "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -", "promotion": "n1n5/PPPk4/8/8/8/8/4Kppp/5N1N b - - 0 1"}
    out = None
    for name, fen in fens.items():
        df = chess.perft(spark, fen, 3 if name in ("initial", "endgame") else 2).select(F.lit(name).alias("name"), "depth", "paths")
        out = df if out is None else out.unionByName(df)
    return out


def q_divide(spark, d):
    return chess.divide(spark, "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - -", 2).agg(F.count("*").alias("moves"), F.sum("paths").alias("paths"))


def q_chess_frontier(spark, d):
    now = chess.boards(spark, chess.C.START)
    rows = [(0, 1)]
    for ply in (1, 2):
        now = chess.frontier(now)
        rows.append((ply, now.count()))
    return spark.createDataFrame(rows, "ply int, boards long")


def q_chess_checks(spark, d):
    """The set-based predicate against the generator's answer, on all boards after two moves of a sharp position."""
    df = chess.frontier(chess.boards(spark, "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -"))
    told = chess.states(df)
    slots = chess.as_slots(df)
    both = slots.select("board", chess.not_check(1).column(PositionSet._at).alias("free"), chess.legal(1).column(PositionSet._at).alias("legal")).join(told, "board")
    return both.agg(F.count("*").alias("boards"), F.sum((F.col("check") == F.col("free")).cast("long")).alias("differ"), F.sum(F.col("legal").cast("long")).alias("legal"))


def q_catalog(spark, d):
    """Sets kept, found by name and by hash, built once, and removed when no name points to them."""
    folder = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex[:12]}"
    catalog, a, r = Catalog(spark, folder), flag(spark, d, "A"), flag(spark, d, "R")
    key, loose = catalog.save(a, "returned"), catalog.save(r)
    built = [catalog.load_or_build("either", lambda: a | r).size(), catalog.load_or_build("either", lambda: a).size()]
    again = catalog.save(lineitem(spark, d, "l_returnflag = 'A'"), "copy")
    write_tsv(catalog.load_by_name("either").frame(), f"{folder}/tsv")
    tsv = spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/tsv").count()
    by_hash = catalog.load_by_hash(loose).size()
    catalog.vacuum()  # what has a name stays, also where the loose set equals one that has
    other = Catalog(spark, f"{folder}/other")
    other.save(a, "returned")
    other.save(~r)  # a complement never has the hash of rows, whatever the lines hold: this one alone goes
    return _one(
        spark, by_name_n=catalog.load_by_name("returned").size(), by_hash_n=by_hash, got_hash_n=catalog.get(key).size(), got_name_n=catalog.get("copy").size(), built_n=built[0],
        kept_n=built[1], same_key=key == again, other_key=key != loose, tsv_n=tsv, gone_n=len(other.vacuum()), names_n=catalog.names().filter("name not like '#%'").count(),
    )


def q_fingerprint(spark, d):
    a = flag(spark, d, "A")
    other = PositionSet.from_frame(a.frame().orderBy(F.rand(1)), SHAPE)
    return _one(spark, shuffled=a.fingerprint() == other.fingerprint(), complement=a.fingerprint() == (~a).fingerprint(), r=a.fingerprint() == flag(spark, d, "R").fingerprint())


def q_bound_within(spark, d):
    all_, few = lineitem(spark, d).bound(), (flag(spark, d, "A") & PositionSet.fixed(spark, SHAPE, 2, 6)).bound()
    return _one(spark, few_in_every=bound_within(few, all_), every_in_few=bound_within(all_, few))


def q_dnf(spark, d):
    terms = [{0: 1, 1: 2}, {0: 1, 2: 3}, {3: 49, 2: 0, 1: 7}]
    where = some([every([fixed(SHAPE, i, c) for i, c in t.items()]) for t in terms])
    return ints((lineitem(spark, d) & PositionSet.matching(spark, SHAPE, where)).frame())


def q_fold(spark, d):
    sets = [Automaton.of(flag(spark, d, f)) for f in "ARN"]
    return _one(spark, all_n=fold(sets, lambda a, b: a and b).size(), any_n=fold(sets, lambda a, b: a or b).size())


def q_quick_stats(spark, d):
    return _one(spark, stats=Automaton.of(flag(spark, d, "A")).quick_stats())


def q_automaton_change(spark, d):
    a = Automaton.of(flag(spark, d, "A")).change({0: (1, 2), 2: (3, 5)})
    return ints(a.positions().frame())


def of_flag(spark, d, f):
    return Automaton.of(flag(spark, d, f))


def q_nth(spark, d):
    """The positions of A whose ranks are order keys."""
    ranks = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("rank")).distinct()
    return with_ints(of_flag(spark, d, "A").nth(ranks), "rank")


def with_ints(df, *others):
    return df.select(*others, *(F.col(c).cast("int").alias(c) for c in SHAPE.columns))


def q_ranks(spark, d):
    """Where the positions of R stand among those of A."""
    return with_ints(of_flag(spark, d, "A").ranks(flag(spark, d, "R").frame()).withColumn("rank", F.col("rank").cast("long")), "rank")


def q_automaton_contains(spark, d):
    """Every line with a flag other than A, and whether A's automaton accepts its position; no line is dropped or made distinct."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag != 'A'")
    rows = lines.selectExpr("l_orderkey", "l_partkey % 16 as c0", "l_suppkey % 16 as c1", "l_linenumber - 1 as c2", "cast(l_quantity as int) - 1 as c3")
    return of_flag(spark, d, "A").accepts(rows).select("l_orderkey", "c2", "accepted")


def q_together(spark, d):
    sets = [of_flag(spark, d, f) for f in "ARN"]
    return ints(automata.intersection(sets).positions().frame()).withColumn("kind", F.lit("all")).unionByName(ints(automata.union(sets).first(500).drop("rank")).withColumn("kind", F.lit("first of any")))


def q_cost_fold(spark, d):
    """Six sets by discount: how many positions all hold, paired by cost, and any, in one pass."""
    sets = [Automaton.of(lineitem(spark, d, f"cast(round(l_discount * 100) as int) % 6 = {k}")) for k in range(6)]
    return _one(spark, all_n=automata.fold_by_cost(sets, True).size(), any_n=automata.union(sets).size())


def q_automaton_bounds(spark, d):
    a = Automaton.of(flag(spark, d, "A") & PositionSet.fixed(spark, SHAPE, 0, 3))
    return a.bounds().withColumn("fixed", F.lit(a.check_fixed(0, 3))).withColumn("within", F.lit(a.check_bound([{3}, set(range(16)), set(range(7)), set(range(50))]))).withColumn("linear", F.lit(a.is_linear()))


def q_change_fixed(spark, d):
    """A change of a slot that holds one character in all positions, which takes one pass."""
    a = Automaton.of(flag(spark, d, "A") & PositionSet.fixed(spark, SHAPE, 2, 3))
    return ints(a.change({2: (3, 5)}).positions().frame())


def q_clauses(spark, d):
    """Lines that meet one of as many clauses as there are parts; slots that a clause leaves open are null."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    clauses = parts.selectExpr("if(p_size % 5 = 0, null, p_partkey * 7 % 16)", "if(p_size % 7 = 0, null, p_size % 16)", "if(p_size % 4 = 0, null, p_size % 7)", "p_partkey % 50")
    return ints(automata.of_clauses(clauses, SHAPE).contains_batch(lineitem(spark, d)).frame())


def q_image(spark, d):
    """Positions of A moved by a rule of each nation, forward and back."""
    nations = spark.read.parquet(f"{d}/nation.parquet")
    rules = nations.selectExpr("n_nationkey as rule", "0 as slot", "n_nationkey % 16 as before", "(n_nationkey + 1) % 16 as after")
    rules = rules.union(nations.selectExpr("n_nationkey", "2", "n_regionkey", "(n_regionkey + 2) % 7"))
    a = of_flag(spark, d, "A")
    found = [ints(automata.image(a, rules, back).positions().frame()).withColumn("back", F.lit(back)) for back in (False, True)]
    return found[0].unionByName(found[1])


def q_store(spark, d):
    """Two overlapping sets kept with the states that they share, then one of them alone."""
    folder = f"{shared_dir(spark)}/automata-{uuid.uuid4().hex[:12]}"
    store, a, r = AutomatonStore(spark, folder), of_flag(spark, d, "A"), of_flag(spark, d, "R")
    either = a | r
    store.save(a, "returned")
    store.save(either, "either")
    both = store.states(SHAPE).count()
    sizes = store.load("returned").size(), store.load(either.root).size()
    store.unbind("either")
    left = store.vacuum()["after"]
    return _one(spark, both_states=both, a_n=sizes[0], either_n=sizes[1], left_states=left)


def q_resumed(spark, d):
    """A product whose layers are kept, taken up by operands that were built anew."""
    folder = f"{shared_dir(spark)}/product-{uuid.uuid4().hex[:12]}"
    found = [of_flag(spark, d, "A").combine(of_flag(spark, d, "R"), lambda x, y: x and not y, folder) for _ in range(2)]
    return ints(found[1].positions().frame()).withColumn("same", F.lit(found[0] == found[1]))


def q_automaton_predicate(spark, d):
    """Sets that are never enumerated, of 89,600 positions, met with those of A."""
    a = of_flag(spark, d, "A")
    some_, three = (Automaton.matching(spark, SHAPE, p) for p in (count_character(SHAPE, 0, 1, 2), count_character(SHAPE, 1, 1, 3)))
    return _one(spark, some_n=some_.size(), a_both_n=automata.intersection([a, some_, three]).size())


def q_graph_sizes(spark, d):
    rows = []
    for heaps, most in ((1, 3), (2, 3), (3, 4)):
        g = get_game(f"normalnim_{heaps}x{most}")
        graph = g.move_graph(0)
        rows.append((heaps, most, len(graph), len(graph.edges), len(graph.optimized()), len(g.rules(0))))
    return spark.createDataFrame(rows, "heaps int, most int, nodes int, edges int, pruned int, rules int")


def q_graph_reversed(spark, d):
    g = get_game("normalnim_3x4")
    s = PositionSet.from_strings(spark, g.shape, [(4, 2, 0), (1, 1, 3)])
    back = moves.apply(packed(s, g.shape), g.move_graph(0).reversed().optimized().rules(), g.shape)
    return ints(unpacked(back.select(F.col("q").alias("p")), g.shape, distinct=True).frame())


def q_reachable(spark, d):
    g = get_game("normalnim_3x4")
    return heaps_among(spark, d, g.reachable(spark, 0, 3))


def q_nim_unknown(spark, d):
    g = get_game("normalnim_3x4")
    return heaps_among(spark, d, unpacked(g.solver(spark).unknown(0, 2), g.shape))


def q_nim_built(kind: str, k: int) -> Callable:
    def run(spark, d):
        g = get_game("normalnim_3x4")
        return heaps_among(spark, d, unpacked(getattr(g.solver(spark), kind)(1, k), g.shape))

    return run


def q_othello_won(spark, d):
    g = get_game("othello_2x2")
    boards = unpacked(board_queries.lines(spark, d).select(from_code(F.expr("l_partkey % 81"), g.shape).alias("p")), g.shape, distinct=True)
    return ints((boards & PositionSet.matching(spark, g.shape, g.won(0)) & PositionSet.matching(spark, g.shape, g.legal())).frame())


def q_names(spark, d):
    g = get_game("tictactoe_3")
    rows = [g.names(k, ply_max=p, side=s) for k in ("losing", "winning", "unknown") for p in (0, 7, 12) for s in (0, 1)]
    rows += [g.names("forward", ply=p) for p in range(3)] + [g.names(k, side=s) for k in ("lost", "won", "has_moves") for s in (0, 1)]
    return spark.createDataFrame([(r,) for r in rows], "name string")


def q_validated(spark, d):
    """The one-step rules on right sets hold, and on wrong ones don't."""
    g = get_game("normalnim_2x3")
    s = g.solver(spark)
    sets = {(kind, side): unpacked(getattr(s, kind)(side, 6), g.shape) for kind in ("losing", "winning") for side in (0, 1)}
    none = PositionSet.reject(spark, g.shape)
    return _one(
        spark, losing_ok=checks.losing(g, 0, sets["losing", 0], none, sets["winning", 1]), losing_bad=checks.losing(g, 0, sets["winning", 0], none, sets["winning", 1]),
        winning_ok=checks.winning(g, 0, sets["winning", 0], none, sets["losing", 1]), winning_bad=checks.winning(g, 0, sets["losing", 0], none, sets["losing", 1]),
        moves_ok=checks.moves(g, 0, sets["winning", 0], 100), solved_ok=checks.solved(g, s, 4), parts_ok=checks.partition(PositionSet.accept(spark, g.shape), [sets["losing", 0], sets["winning", 0]]),
    )


def q_analysis(spark, d):
    """A whole analysis kept in a catalog, and its table read back from text."""
    folder = f"{shared_dir(spark)}/analysis-{uuid.uuid4().hex[:12]}"
    held = analyse(get_game("tictactoe_2"), spark, folder, 4, 3, 20)
    if not all(held.values()):
        raise ValueError(f"checks failed: {held}")
    table = spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/stats")
    return table.select(*(F.col(c).cast("int").alias(c) for c in ("ply", "win", "lose", "unknown")))


#: Positions and what is true of them: check, checkmate, stalemate, too little material, end of the game. Fixed values.
ENDS = [
    ("rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq -", True, True, False, False, True),
    ("7k/5Q2/6K1/8/8/8/8/8 b - -", False, False, True, False, True),
    ("7k/8/6K1/8/8/8/8/6N1 w - -", False, False, False, True, True),
    ("7k/8/6K1/8/8/8/8/6R1 w - -", False, False, False, False, False),
    ("4k3/8/8/8/7b/8/8/4K3 w - -", True, False, False, True, True),
    ("6k1/5ppp/8/8/8/8/8/R3K3 w Q -", False, False, False, False, False),
    ("R5k1/5ppp/8/8/8/8/8/4K3 b - -", True, True, False, False, True),
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -", False, False, False, False, False),
]


def q_chess_ends(spark, d):
    return chess.states(chess.boards(spark, *(e[0] for e in ENDS)))


def q_chess_mated(spark, d):
    """Mates by the game's own predicate over slots."""
    out = None
    for side, letter in enumerate("wb"):
        slots = chess.as_slots(chess.boards(spark, *(e[0] for e in ENDS if e[0].split()[1] == letter)))
        df = slots.select("board", chess.Mated(side).column(PositionSet._at).alias("mated"))
        out = df if out is None else out.unionByName(df)
    return out


def q_chess_targets(spark, d):
    """Squares that a white piece may enter, and those where it takes something, on one board."""
    slots = chess.as_slots(chess.boards(spark, "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -"))
    test = lambda f: F.array(*(F.when(f(0, s).column(PositionSet._at), F.lit(s)) for s in range(64)))
    listed = slots.select(F.explode(test(chess.can_move_basic)).alias("square"), test(chess.can_move_capture).alias("takes")).filter("square is not null")
    return listed.select("square", F.array_contains(F.array_compact("takes"), F.col("square")).alias("takes"))


def q_chess_codec(spark, d):
    """Boards to slots and back, after every first move."""
    df = chess.frontier(chess.boards(spark, chess.C.START))
    p = packed(chess.as_slots(df).drop("board"), chess.position_shape())

    def back(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([chess.C.Board.from_slots(x, False).key() for x in batch.column("p").to_pylist()], pa.string())], names=["board"])

    return p.mapInArrow(back, "board string").select(F.split("board", " ")[0].alias("cells"), F.split("board", " ")[3].alias("passed"))


def moved(spark, d, table: DataFrame) -> DataFrame:
    """Rows of a table of moves whose squares some line holds."""
    return table.join(board_queries.lines(spark, d).selectExpr(*board_queries.MOVE).distinct(), ["a", "b"], "left_semi")


def q_chess_between(spark, d):
    c = chess.C
    return moved(spark, d, spark.createDataFrame([(a, b, len(w)) for a in range(64) for b in range(64) if (w := c.between(a, b)) is not None], "a int, b int, n int"))


def q_chess_move_table(spark, d):
    return moved(spark, d, spark.createDataFrame([(k, a, b, len(w)) for k, a, b, w in chess.C.move_table()], "piece string, a int, b int, n int"))


def q_chess_uci(spark, d):
    return chess.successors(chess.boards(spark, chess.C.START)).select("move")


def q_chess_unmoves(spark, d):
    """Boards with a move to the board after 1. e4 that have all men and rights: the first one alone."""
    g = get_game("chess")
    after = [q for q in g.successors(0, g.initial()) if q[36]]
    back = g.backward(0, PositionSet.from_strings(spark, g.shape, after[:1])).frame()
    men = F.lit(0)
    for i in range(64):
        men = men + (F.col(f"c{i}") != 0).cast("int")
    return back.filter((men == 32) & (F.col("c64") == 15) & (F.col("c65") == 0)).select(F.count("*").over(Window.partitionBy()).cast("int").alias("boards"), *(F.col(f"c{i}").cast("int").alias(f"c{i}") for i in (36, 44, 52)))


def q_cli(spark, d):
    """What the command line prints."""
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        codes = [main(a.split()) for a in ("graph normalnim_2x3", "print normalnim_2x3 1 3", "solve normalnim_1x3 3", "validate normalnim_2x3 1 10")]
    lines = [x for x in told.getvalue().splitlines() if x]
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(-1, " ".join(map(str, codes)))], "line int, told string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "accept": lambda s, d: ints((lineitem(s, d) & PositionSet.accept(s, SHAPE)).frame()),
    "reject": lambda s, d: ints((lineitem(s, d) & PositionSet.reject(s, SHAPE)).frame()),
    "fixed_layer": lambda s, d: ints((lineitem(s, d) & PositionSet.fixed(s, SHAPE, 2, 3)).frame()),
    "count_character": lambda s, d: ints((lineitem(s, d) & PositionSet.count_character(s, SHAPE, 0, 1, 2)).frame()),
    "count_pieces": lambda s, d: ints((lineitem(s, d) & PositionSet.count_pieces(s, SHAPE, 3)).frame()),
    "from_strings": lambda s, d: ints((lineitem(s, d) - PositionSet.from_strings(s, SHAPE, [(0, 0, c, 9) for c in (0, 1, 2, 3, 4, 5, 6, 0)])).frame()),
    "from_strings_lineitem": lambda s, d: ints(lineitem(s, d).frame()),
    "intersection": lambda s, d: ints((flag(s, d, "A") & flag(s, d, "R")).frame()),
    "union": lambda s, d: ints((flag(s, d, "A") | flag(s, d, "R")).frame()),
    "difference": lambda s, d: ints((flag(s, d, "A") - flag(s, d, "R")).frame()),
    "inverse": lambda s, d: ints((~lineitem(s, d)).frame()),
    "intersection_vector": lambda s, d: ints(intersection(s, SHAPE, [flag(s, d, f) for f in "ARN"] + [PositionSet.fixed(s, SHAPE, 2, 1)]).frame()),
    "union_vector": lambda s, d: ints(union(s, SHAPE, [flag(s, d, f) for f in "ARN"] + [PositionSet.matching(s, SHAPE, fixed(SHAPE, 0, 0) & fixed(SHAPE, 3, 49))]).frame()),
    "change": q_change,
    "change_complement": q_change_complement,
    "size": q_size,
    "layer_bound": q_bound,
    "is_linear": q_linear,
    "first_k": lambda s, d: ints(lineitem(s, d).first(100)),
    "contains_batch": q_contains,
    "checks": q_checks,
    "automaton_layers": q_automaton,
    "automaton_algebra": q_automaton_algebra,
    "nim_losing": q_nim("losing"),
    "nim_winning": q_nim("winning"),
    "nim_table": q_nim_table,
    "nim_forward": q_nim_moves("forward"),
    "nim_backward": q_nim_moves("backward"),
    "nim_before_predicate": q_nim_before,
    "ttt_counts": q_frontier("tictactoe_3", 9),
    "ttt_solve": q_ttt_solve,
    "ttt_shares": q_ttt_shares,
    "ttt_lost": q_ttt_lost,
    "ttt_boards": q_ttt_boards,
    "breakthrough_counts": q_frontier("breakthrough_5x5", 3),
    "breakthroughcw_counts": q_frontier("breakthroughcw_5x6", 3),
    "breakthrough_reversed": q_breakthrough_reversed,
    "othello_counts": q_frontier("othello_4x4", 6),
    "amazons_counts": q_frontier("amazons_4x4", 2),
    "outcomes": q_outcomes,
    "chess_perft": q_perft,
    "chess_divide": q_divide,
    "chess_frontier": q_chess_frontier,
    "chess_checks": q_chess_checks,
    "catalog": q_catalog,
    "fingerprint": q_fingerprint,
    "bound_within": q_bound_within,
    "dnf": q_dnf,
    "automaton_fold": q_fold,
    "quick_stats": q_quick_stats,
    "automaton_change": q_automaton_change,
    "automaton_first_k": lambda s, d: with_ints(of_flag(s, d, "A").first(100, offset=1000), "rank"),
    "automaton_nth": q_nth,
    "automaton_ranks": q_ranks,
    "automaton_contains_batch": q_automaton_contains,
    "automaton_together": q_together,
    "automaton_cost_fold": q_cost_fold,
    "automaton_bounds": q_automaton_bounds,
    "automaton_change_fixed": q_change_fixed,
    "dnf_clauses": q_clauses,
    "automaton_image": q_image,
    "automaton_store": q_store,
    "automaton_resumed": q_resumed,
    "automaton_predicate": q_automaton_predicate,
    "graph_sizes": q_graph_sizes,
    "graph_reversed": q_graph_reversed,
    "reachable": q_reachable,
    "nim_unknown": q_nim_unknown,
    "nim_losing_2": q_nim_built("losing", 2),
    "nim_winning_1": q_nim_built("winning", 1),
    "othello_won": q_othello_won,
    "result_names": q_names,
    "validated": q_validated,
    "analysis": q_analysis,
    "chess_ends": q_chess_ends,
    "chess_mated": q_chess_mated,
    "chess_targets": q_chess_targets,
    "chess_codec": q_chess_codec,
    "chess_between": q_chess_between,
    "chess_move_table": q_chess_move_table,
    "chess_uci": q_chess_uci,
    "chess_unmoves": q_chess_unmoves,
    "cli": q_cli,
}

_L = "(SELECT DISTINCT CAST(l_partkey % 16 AS INT) AS c0, CAST(l_suppkey % 16 AS INT) AS c1, CAST(l_linenumber - 1 AS INT) AS c2, CAST(l_quantity AS INT) - 1 AS c3 FROM lineitem{})"


def _l(test: str = "") -> str:
    return _L.format(f" WHERE {test}" if test else "")


_A, _R, _N = (_l(f"l_returnflag = '{f}'") for f in "ARN")
_U = "(SELECT CAST(a.r AS INT) AS c0, CAST(b.r AS INT) AS c1, CAST(c.r AS INT) AS c2, CAST(e.r AS INT) AS c3 FROM range(16) a(r), range(16) b(r), range(7) c(r), range(50) e(r))"
_NIM = "(SELECT CAST(a.r AS INT) AS c0, CAST(b.r AS INT) AS c1, CAST(c.r AS INT) AS c2 FROM range(5) a(r), range(5) b(r), range(5) c(r))"


def _values(columns: str, rows: list[tuple], casts: str) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {body}) t({columns})"


def _plies(counts: list[int], name: str = "positions") -> str:
    return _values(f"ply, {name}", list(enumerate(counts)), f"CAST(ply AS INT) AS ply, CAST({name} AS BIGINT) AS {name}")


def _residuals(layer: int) -> str:
    """Distinct sets of rests after the prefixes of one layer, besides the full one, and two constants."""
    rest, prefix = "(c{} * 50 + c3)", [f"c{i}" for i in range(layer)]
    code = {0: "((c0 * 16 + c1) * 7 + c2) * 50 + c3", 1: "(c1 * 7 + c2) * 50 + c3", 2: "c2 * 50 + c3", 3: "c3"}[layer]
    full = {0: 89600, 1: 5600, 2: 350, 3: 50}[layer]
    group = f" GROUP BY {', '.join(prefix)}" if prefix else ""
    return f"SELECT CAST({layer} AS INT) AS layer, CAST(count(DISTINCT s) + 2 AS BIGINT) AS states FROM (SELECT list({code} ORDER BY {code}) AS s FROM {_A}{group}) WHERE len(s) < {full}"


ORACLE_SQL: dict[str, str] = {
    "accept": f"SELECT * FROM {_l()}",
    "reject": f"SELECT * FROM {_l()} WHERE false",
    "fixed_layer": f"SELECT * FROM {_l()} WHERE c2 = 3",
    "count_character": f"SELECT * FROM {_l()} WHERE CAST(c0 = 0 AS INT) + CAST(c1 = 0 AS INT) + CAST(c2 = 0 AS INT) + CAST(c3 = 0 AS INT) BETWEEN 1 AND 2",
    "count_pieces": f"SELECT * FROM {_l()} WHERE CAST(c0 <> 0 AS INT) + CAST(c1 <> 0 AS INT) + CAST(c2 <> 0 AS INT) + CAST(c3 <> 0 AS INT) = 3",
    "from_strings": f"SELECT * FROM {_l()} WHERE NOT (c0 = 0 AND c1 = 0 AND c3 = 9)",
    "from_strings_lineitem": f"SELECT * FROM {_l()}",
    "intersection": f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_R}",
    "union": f"SELECT * FROM {_A} UNION SELECT * FROM {_R}",
    "difference": f"SELECT * FROM {_A} EXCEPT SELECT * FROM {_R}",
    "inverse": f"SELECT * FROM {_U} EXCEPT SELECT * FROM {_l()}",
    "intersection_vector": f"SELECT * FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_R} INTERSECT SELECT * FROM {_N}) WHERE c2 = 1",
    "union_vector": f"SELECT * FROM {_l()} UNION SELECT * FROM {_U} WHERE c0 = 0 AND c3 = 49",
    "change": f"SELECT c0, c1, CAST(5 AS INT) AS c2, c3 FROM {_l()} WHERE c2 = 3",
    "change_complement": f"SELECT CAST(2 AS INT) AS c0, c1, CAST(5 AS INT) AS c2, c3 FROM (SELECT * FROM {_U} EXCEPT SELECT * FROM {_l()}) WHERE c0 = 1 AND c2 = 3",
    "size": f"SELECT (SELECT count(*) FROM {_l()}) AS all_n, (SELECT count(*) FROM {_A}) AS a_n, (SELECT count(*) FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_R})) AS both_n, 89600 - (SELECT count(*) FROM {_A}) AS not_a_n, CAST(89600 AS BIGINT) AS universe_n",
    "layer_bound": " UNION ALL ".join(f"SELECT DISTINCT CAST({i} AS INT) AS layer, c{i} AS c FROM {_l()}" for i in range(4)),
    "is_linear": f"SELECT (SELECT count(*) = count(DISTINCT c0) * count(DISTINCT c1) * count(DISTINCT c2) * count(DISTINCT c3) FROM {_l()}) AS rows_linear, true AS fixed_linear, true AS cell_linear",
    "first_k": f"SELECT * FROM {_l()} ORDER BY c0, c1, c2, c3 LIMIT 100",
    "contains_batch": f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_l("l_linestatus = 'O'")}",
    "checks": f"SELECT true AS equal_self, NOT EXISTS (SELECT * FROM ((SELECT * FROM {_A} EXCEPT SELECT * FROM {_R}) UNION ALL (SELECT * FROM {_R} EXCEPT SELECT * FROM {_A}))) AS equal_other, true AS subset_a, NOT EXISTS (SELECT * FROM {_l()} EXCEPT SELECT * FROM {_A}) AS subset_back, true AS partition_parts, NOT EXISTS (SELECT c0 FROM (SELECT * FROM {_A} UNION ALL SELECT * FROM {_R} UNION ALL SELECT * FROM {_N}) GROUP BY c0, c1, c2, c3 HAVING count(*) > 1) AS partition_bad, true AS disjoint_parts, NOT EXISTS (SELECT * FROM {_A} INTERSECT SELECT * FROM {_R}) AS disjoint_ar",
    "automaton_layers": " UNION ALL ".join(_residuals(i) for i in range(4)),
    "automaton_algebra": f"SELECT (SELECT count(*) FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_R})) AS both_n, (SELECT count(*) FROM (SELECT * FROM {_A} UNION SELECT * FROM {_R})) AS any_n, (SELECT count(*) FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_R})) AS only_n, 89600 - (SELECT count(*) FROM {_A}) AS not_n, true AS same",
    "nim_losing": f"SELECT * FROM {_NIM} WHERE xor(xor(c0, c1), c2) = 0",
    "nim_winning": f"SELECT * FROM {_NIM} WHERE xor(xor(c0, c1), c2) <> 0",
    "nim_table": _values("ply_max, side, winning, losing, unknown", [(k, s, *r) for k, r in enumerate([(0, 1, 124), (12, 1, 112), (12, 4, 109), (40, 4, 81), (40, 7, 78), (62, 7, 56), (62, 16, 47), (96, 16, 13), (96, 19, 10), (106, 19, 0)]) for s in (0, 1)], "CAST(ply_max AS INT) AS ply_max, CAST(side AS INT) AS side, CAST(winning AS BIGINT) AS winning, CAST(losing AS BIGINT) AS losing, CAST(unknown AS BIGINT) AS unknown"),
    "nim_forward": f"SELECT q.* FROM {_NIM} q WHERE (c1 = 2 AND c2 = 0 AND c0 < 4) OR (c0 = 4 AND c2 = 0 AND c1 < 2) OR (c1 = 1 AND c2 = 3 AND c0 < 1) OR (c0 = 1 AND c2 = 3 AND c1 < 1) OR (c0 = 1 AND c1 = 1 AND c2 < 3)",
    "nim_backward": f"SELECT q.* FROM {_NIM} q WHERE (c0 = 4 AND c2 = 0 AND c1 > 2) OR (c0 = 4 AND c1 = 2 AND c2 > 0) OR (c1 = 1 AND c2 = 3 AND c0 > 1) OR (c0 = 1 AND c2 = 3 AND c1 > 1) OR (c0 = 1 AND c1 = 1 AND c2 > 3)",
    "nim_before_predicate": f"SELECT * FROM {_NIM} WHERE CAST(c0 > 0 AS INT) + CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT) = 1",
    "ttt_counts": _plies([1, 9, 72, 252, 756, 1260, 1520, 1140, 390, 78]),
    "ttt_solve": _values("ply, win, lose, unknown", [(9, 0, 62, 16), (8, 142, 168, 80), (7, 416, 524, 200), (6, 1056, 264, 200), (5, 540, 456, 264), (4, 584, 36, 136), (3, 50, 64, 138), (2, 48, 0, 24), (1, 0, 0, 9), (0, 0, 0, 1)], "CAST(ply AS INT) AS ply, CAST(win AS BIGINT) AS win, CAST(lose AS BIGINT) AS lose, CAST(unknown AS BIGINT) AS unknown"),
    "ttt_shares": _values("ply, w, l", [(3, 0, 1), (2, 1, 0), (1, 0, 1), (0, 1, 0)], "CAST(ply AS INT) AS ply, CAST(w AS DOUBLE) AS win_share, CAST(l AS DOUBLE) AS lose_share, CAST(0 AS DOUBLE) AS unknown_share"),
    "breakthrough_counts": _plies([1, 13, 156, 1188]),
    "breakthroughcw_counts": _plies([1, 13, 169, 1170]),
    "breakthrough_reversed": "SELECT true AS same, CAST(6 AS BIGINT) AS n",
    "othello_counts": _plies([1, 4, 12, 42, 120, 380, 1056]),
    "amazons_counts": _plies([1, 88, 3994]),
    "outcomes": _values("game, ply, result", [("tictactoe_1", 1, 1), ("tictactoe_2", 3, 1), ("normalnim_1x3", 1, 1), ("normalnim_2x3", 6, -1)], "game, CAST(ply AS INT) AS ply, CAST(result AS INT) AS result"),
    "chess_perft": _values("name, depth, paths", [(n, k + 1, v) for n, c in (("initial", (20, 400, 8902)), ("endgame", (14, 191, 2812)), ("castling", (48, 2039)), ("promotion", (24, 496))) for k, v in enumerate(c)], "name, CAST(depth AS INT) AS depth, CAST(paths AS BIGINT) AS paths"),
    "chess_divide": "SELECT CAST(14 AS BIGINT) AS moves, CAST(191 AS BIGINT) AS paths",
    "chess_frontier": _plies([1, 20, 400], "boards"),
    "chess_checks": "SELECT CAST(48 AS BIGINT) AS boards, CAST(0 AS BIGINT) AS differ, CAST(48 AS BIGINT) AS legal",
}

_TTT = "(SELECT " + ", ".join(f"(i // {3**k}) % 3 AS c{k}" for k in range(9)) + " FROM range(19683) t(i))"
_LINE = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6))
_O = "(" + " OR ".join("(" + " AND ".join(f"c{i} = 2" for i in line) + ")" for line in _LINE) + ")"
_EMPTY = "(" + " OR ".join(f"c{i} = 0" for i in range(9)) + ")"
_SPELT = f"(SELECT DISTINCT b.* FROM {_TTT} b JOIN (SELECT {board_queries.TTT} AS code FROM lineitem) ON code = {' + '.join(f'{3**k} * c{k}' for k in range(9))})"
ORACLE_SQL["ttt_lost"] = "SELECT " + ", ".join(f"(SELECT count(*) FROM {b} WHERE {_O}) AS {n}lost_n, (SELECT count(*) FROM {b} WHERE NOT {_O} AND {_EMPTY}) AS {n}moves_n" for n, b in (("", _TTT), ("spelt_", _SPELT)))
ORACLE_SQL["ttt_boards"] = "SELECT " + " || chr(10) || ".join("concat_ws(' ', " + ", ".join(f"substr('.xo', CAST(c{3 * y + x} + 1 AS INT), 1)" for x in range(3)) + ")" for y in range(3)) + f" AS board FROM {_SPELT}"


# -- the operators that no other query names ----------------------------------------------------

_E = f"(SELECT a.c0 AS a0, a.c1 AS a1, a.c2 AS a2, b.* FROM {_NIM} a JOIN {_NIM} b ON (a.c0 > b.c0 AND a.c1 = b.c1 AND a.c2 = b.c2) OR (a.c0 = b.c0 AND a.c1 > b.c1 AND a.c2 = b.c2) OR (a.c0 = b.c0 AND a.c1 = b.c1 AND a.c2 > b.c2))"
_W1 = f"(SELECT DISTINCT a0 AS c0, a1 AS c1, a2 AS c2 FROM {_E} WHERE c0 + c1 + c2 = 0)"
_L2 = f"(SELECT * FROM {_NIM} EXCEPT SELECT a0, a1, a2 FROM {_E} e WHERE NOT EXISTS (SELECT * FROM {_W1} w WHERE w.c0 = e.c0 AND w.c1 = e.c1 AND w.c2 = e.c2))"
_SQ = "(SELECT CAST(i.r AS INT) AS a, CAST(j.r AS INT) AS b, abs(i.r % 8 - j.r % 8) AS dx, abs(i.r // 8 - j.r // 8) AS dy, j.r // 8 - i.r // 8 AS down FROM range(64) i(r), range(64) j(r) WHERE i.r <> j.r)"
_FAR = "CAST(greatest(dx, dy) - 1 AS INT) AS n"
_AN, _RN, _NN = (f"(SELECT count(*) FROM {x})" for x in (_A, _R, _N))
_EITHER = f"(SELECT count(*) FROM (SELECT * FROM {_A} UNION SELECT * FROM {_R}))"
_FEW = f"(SELECT * FROM {_A} WHERE c2 = 6)"
_COUNT = lambda c: "(" + " + ".join(f"CAST(c{i} = {c} AS INT)" for i in range(4)) + ")"


def _ends(*columns: int) -> str:
    names = ("board", "check", "checkmate", "stalemate", "draw_by_material", "final")
    rows = [" AS ".join((f"'{e[0]}'", "board")) + "".join(f", {str(e[i]).lower()} AS \"{names[i]}\"" for i in columns) for e in ENDS]
    return " UNION ALL ".join(f"SELECT {r}" for r in rows)


ORACLE_SQL |= {
    "catalog": f"SELECT {_AN} AS by_name_n, {_RN} AS by_hash_n, {_AN} AS got_hash_n, {_AN} AS got_name_n, {_EITHER} AS built_n, {_EITHER} AS kept_n, true AS same_key, {_AN} <> {_RN} OR EXISTS (SELECT * FROM {_A} EXCEPT SELECT * FROM {_R}) AS other_key, {_EITHER} AS tsv_n, CAST(1 AS BIGINT) AS gone_n, CAST(3 AS BIGINT) AS names_n",
    "fingerprint": f"SELECT true AS shuffled, false AS complement, NOT EXISTS ((SELECT * FROM {_A} EXCEPT SELECT * FROM {_R}) UNION ALL (SELECT * FROM {_R} EXCEPT SELECT * FROM {_A})) AS r",
    "bound_within": "SELECT " + ", ".join("(" + " AND ".join(f"NOT EXISTS (SELECT c{i} FROM {x} EXCEPT SELECT c{i} FROM {y})" for i in range(4)) + f") AS {n}" for n, x, y in (("few_in_every", _FEW, _l()), ("every_in_few", _l(), _FEW))),
    "dnf": f"SELECT * FROM {_l()} WHERE (c0 = 1 AND c1 = 2) OR (c0 = 1 AND c2 = 3) OR (c3 = 49 AND c2 = 0 AND c1 = 7)",
    "automaton_fold": f"SELECT (SELECT count(*) FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_R} INTERSECT SELECT * FROM {_N})) AS all_n, (SELECT count(*) FROM {_l()}) AS any_n",
    "quick_stats": "SELECT concat((SELECT sum(states) FROM (" + " UNION ALL ".join(_residuals(i) for i in range(4)) + f")), ' states, ', {_AN}, ' positions') AS stats",
    "automaton_change": f"SELECT CAST(2 AS INT) AS c0, c1, CAST(5 AS INT) AS c2, c3 FROM {_A} WHERE c0 = 1 AND c2 = 3",
    "automaton_predicate": f"SELECT (SELECT count(*) FROM {_U} WHERE {_COUNT(0)} BETWEEN 1 AND 2) AS some_n, (SELECT count(*) FROM {_A} WHERE {_COUNT(0)} BETWEEN 1 AND 2 AND {_COUNT(1)} BETWEEN 1 AND 3) AS a_both_n",
    "graph_sizes": "SELECT CAST(h AS INT) AS heaps, CAST(m AS INT) AS most, CAST(2 + h * t AS INT) AS nodes, CAST(2 * h * t AS INT) AS edges, CAST(2 + h * t AS INT) AS pruned, CAST(h * t AS INT) AS rules FROM (SELECT h, m, m * (m + 1) // 2 AS t FROM (VALUES (1, 3), (2, 3), (3, 4)) v(h, m))",
    "graph_reversed": ORACLE_SQL["nim_backward"],
    "reachable": f"SELECT * FROM {_NIM} WHERE 12 - c0 - c1 - c2 >= 3",
    "nim_unknown": f"SELECT * FROM {_NIM} EXCEPT SELECT * FROM {_W1} EXCEPT SELECT * FROM {_L2}",
    "nim_losing_2": f"SELECT * FROM {_L2}",
    "nim_winning_1": f"SELECT * FROM {_W1}",
    "othello_won": "SELECT * FROM (SELECT " + ", ".join(f"CAST((i // {3**k}) % 3 AS INT) AS c{k}" for k in range(4)) + " FROM range(81) t(i) WHERE i IN (SELECT l_partkey % 81 FROM lineitem)) WHERE c0 * c1 * c2 * c3 > 0 AND CAST(c0 = 1 AS INT) + CAST(c1 = 1 AS INT) + CAST(c2 = 1 AS INT) + CAST(c3 = 1 AS INT) > 2",
    "result_names": "SELECT concat('backward,ply_max=', lpad(CAST(p AS VARCHAR), 3, '0'), ',side=', s, ',', k) AS name FROM (VALUES ('losing'), ('winning'), ('unknown')) a(k), (VALUES (0), (7), (12)) b(p), range(2) c(s) UNION ALL SELECT concat('forward,ply=', lpad(CAST(p AS VARCHAR), 3, '0')) FROM range(3) t(p) UNION ALL SELECT concat(k, ',side_to_move=', s) FROM (VALUES ('lost'), ('won')) a(k), range(2) c(s) UNION ALL SELECT concat('has_moves-side=', s) FROM range(2) c(s)",
    "validated": "SELECT true AS losing_ok, false AS losing_bad, true AS winning_ok, false AS winning_bad, true AS moves_ok, true AS solved_ok, true AS parts_ok",
    "analysis": _values("ply, win, lose, unknown", [(0, 1, 0, 0), (1, 0, 4, 0), (2, 12, 0, 0), (3, 0, 12, 0)], "CAST(ply AS INT) AS ply, CAST(win AS INT) AS win, CAST(lose AS INT) AS lose, CAST(unknown AS INT) AS unknown"),
    "chess_ends": _ends(1, 2, 3, 4, 5),
    "chess_mated": f"SELECT board, checkmate AS mated FROM ({_ends(2)})",
    "chess_targets": "SELECT CAST(i AS INT) AS square, c <> '.' AS takes FROM (SELECT i, substr('r...k..rp.ppqpb.bn..pnp....PN....p..P.....N..Q.pPPPBBPPPR...K..R', CAST(i + 1 AS INT), 1) AS c FROM range(64) t(i)) WHERE c = '.' OR c IN ('q', 'r', 'b', 'n', 'p')",
    "chess_between": f"SELECT a, b, {_FAR} FROM {_SQ} WHERE dx = 0 OR dy = 0 OR dx = dy",
    "chess_move_table": " UNION ALL ".join([
        f"SELECT 'k' AS piece, a, b, CAST(0 AS INT) AS n FROM {_SQ} WHERE greatest(dx, dy) = 1", f"SELECT 'q', a, b, {_FAR} FROM {_SQ} WHERE dx = 0 OR dy = 0 OR dx = dy", f"SELECT 'r', a, b, {_FAR} FROM {_SQ} WHERE dx = 0 OR dy = 0",
        f"SELECT 'b', a, b, {_FAR} FROM {_SQ} WHERE dx = dy", f"SELECT 'n', a, b, CAST(0 AS INT) FROM {_SQ} WHERE dx * dy = 2",
        *(f"SELECT '{p}', a, b, CAST(abs(down) - 1 AS INT) FROM {_SQ} WHERE a // 8 BETWEEN 1 AND 6 AND ((down = {s} AND dx <= 1) OR (down = {2 * s} AND dx = 0 AND a // 8 = {row}))" for p, s, row in (("P", -1, 6), ("p", 1, 1))),
    ]),
    "chess_uci": "SELECT concat(chr(CAST(97 + f AS INT)), '2', chr(CAST(97 + f AS INT)), CAST(r AS VARCHAR)) AS move FROM range(8) a(f), range(3, 5) b(r) UNION ALL SELECT * FROM (VALUES ('b1a3'), ('b1c3'), ('g1f3'), ('g1h3'))",
    "chess_unmoves": "SELECT CAST(1 AS INT) AS boards, CAST(0 AS INT) AS c36, CAST(0 AS INT) AS c44, CAST(1 AS INT) AS c52",
    "cli": "SELECT CAST(line AS INT) AS line, told FROM (VALUES (-1, '0 0 0 0'), (0, 'side 0: 14 nodes, 14 after pruning, 12 rules'), (1, 'side 1: 14 nodes, 14 after pruning, 12 rules'), (2, '0 3'), (3, '1 3'), (4, '2 3'), (5, 'win within 1'), (6, 'agree')) t(line, told)",
}
_PAWN = lambda f: f"concat('rnbqkbnr/pppppppp/8/8/', CASE WHEN r = 4 THEN {f} ELSE '8' END, '/', CASE WHEN r = 3 THEN {f} ELSE '8' END, '/', repeat('P', CAST(f AS INT)), '1', repeat('P', CAST(7 - f AS INT)), '/RNBQKBNR')"
_ALONE = "concat(CASE WHEN f > 0 THEN CAST(f AS VARCHAR) ELSE '' END, 'P', CASE WHEN f < 7 THEN CAST(7 - f AS VARCHAR) ELSE '' END)"
ORACLE_SQL["chess_codec"] = f"SELECT {_PAWN(_ALONE)} AS cells, CASE WHEN r = 4 THEN concat(chr(CAST(97 + f AS INT)), '3') ELSE '-' END AS passed FROM range(8) a(f), range(3, 5) b(r) UNION ALL SELECT concat('rnbqkbnr/pppppppp/8/8/8/', k), '-' FROM (VALUES ('N7/PPPPPPPP/R1BQKBNR'), ('2N5/PPPPPPPP/R1BQKBNR'), ('5N2/PPPPPPPP/RNBQKB1R'), ('7N/PPPPPPPP/RNBQKB1R')) t(k)"

_RANKED = f"(SELECT row_number() OVER (ORDER BY c0, c1, c2, c3) - 1 AS rank, * FROM {_A})"
_A3 = f"(SELECT * FROM {_A} WHERE c0 = 3)"
_D6 = [_l(f"CAST(round(l_discount * 100) AS INT) % 6 = {k}") for k in range(6)]
ORACLE_SQL |= {
    "automaton_first_k": f"SELECT * FROM {_RANKED} ORDER BY rank LIMIT 100 OFFSET 1000",
    "automaton_nth": f"SELECT * FROM {_RANKED} WHERE rank IN (SELECT o_orderkey FROM orders)",
    "automaton_ranks": f"SELECT a.rank, r.* FROM {_R} r LEFT JOIN {_RANKED} a USING (c0, c1, c2, c3)",
    "automaton_contains_batch": f"SELECT l_orderkey, CAST(l_linenumber - 1 AS INT) AS c2, (l_partkey % 16, l_suppkey % 16, l_linenumber - 1, CAST(l_quantity AS INT) - 1) IN (SELECT (c0, c1, c2, c3) FROM {_A}) AS accepted FROM lineitem WHERE l_returnflag <> 'A'",
    "automaton_together": f"SELECT *, 'all' AS kind FROM ({_A[1:-1]} INTERSECT {_R[1:-1]} INTERSECT {_N[1:-1]}) UNION ALL SELECT *, 'first of any' AS kind FROM (SELECT * FROM {_l()} ORDER BY c0, c1, c2, c3 LIMIT 500)",
    "automaton_cost_fold": f"SELECT (SELECT count(*) FROM ({' INTERSECT '.join(x[1:-1] for x in _D6)})) AS all_n, (SELECT count(*) FROM ({' UNION '.join(x[1:-1] for x in _D6)})) AS any_n",
    "automaton_bounds": " UNION ALL ".join(f"SELECT DISTINCT CAST({i} AS INT) AS layer, c{i} AS c, true AS fixed, true AS within, (SELECT count(*) = count(DISTINCT c1) * count(DISTINCT c2) * count(DISTINCT c3) FROM {_A3}) AS linear FROM {_A3}" for i in range(4)),
    "automaton_change_fixed": f"SELECT c0, c1, CAST(5 AS INT) AS c2, c3 FROM {_A} WHERE c2 = 3",
}


def _distinct_residuals(sets: list[str]) -> str:
    """How many different states several sets have together, without constants."""
    one = "SELECT {layer} AS layer, list({code} ORDER BY {code}) AS s FROM {rows} GROUP BY {prefix}"
    each = []
    for layer, (code, prefix) in enumerate((("((c0 * 16 + c1) * 7 + c2) * 50 + c3", "()"), ("(c1 * 7 + c2) * 50 + c3", "c0"), ("c2 * 50 + c3", "c0, c1"), ("c3", "c0, c1, c2"))):
        full = (89600, 5600, 350, 50)[layer]
        each += [f"SELECT layer, s FROM ({one.format(layer=layer, code=code, rows=rows, prefix=prefix)}) WHERE len(s) < {full}" for rows in sets]
    return f"(SELECT count(DISTINCT (layer, s)) FROM ({' UNION ALL '.join(each)}))"


_RULES = "(SELECT n_nationkey % 16 AS b0, (n_nationkey + 1) % 16 AS a0, n_regionkey AS b2, (n_regionkey + 2) % 7 AS a2 FROM nation)"
_CLAUSE = "(SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey * 7 % 16 END AS k0, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 16 END AS k1, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 7 END AS k2, p_partkey % 50 AS k3 FROM part)"
ORACLE_SQL |= {
    "dnf_clauses": f"SELECT DISTINCT l.* FROM {_l()} l JOIN {_CLAUSE} k ON k3 = c3 AND coalesce(k0 = c0, true) AND coalesce(k1 = c1, true) AND coalesce(k2 = c2, true)",
    "automaton_image": f"SELECT DISTINCT CAST(a0 AS INT) AS c0, c1, CAST(a2 AS INT) AS c2, c3, false AS back FROM {_A} JOIN {_RULES} ON c0 = b0 AND c2 = b2 UNION ALL SELECT DISTINCT CAST(b0 AS INT), c1, CAST(b2 AS INT), c3, true FROM {_A} JOIN {_RULES} ON c0 = a0 AND c2 = a2",
    "automaton_store": f"SELECT {_distinct_residuals([_A, _l("l_returnflag IN ('A', 'R')")])} AS both_states, {_AN} AS a_n, {_EITHER} AS either_n, {_distinct_residuals([_A])} AS left_states",
    "automaton_resumed": f"SELECT *, true AS same FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_R})",
}

_HEAPS = "SELECT l_partkey % 5 AS c0, l_suppkey % 5 AS c1, l_linenumber % 5 AS c2 FROM lineitem"
for _name in ("nim_losing", "nim_winning", "nim_before_predicate", "reachable", "nim_unknown", "nim_losing_2", "nim_winning_1"):
    ORACLE_SQL[_name] = f"SELECT * FROM ({ORACLE_SQL[_name]}) WHERE (c0, c1, c2) IN (SELECT (c0, c1, c2) FROM ({_HEAPS}))"

for _name in ("chess_between", "chess_move_table"):
    ORACLE_SQL[_name] = f"SELECT * FROM ({ORACLE_SQL[_name]}) WHERE (a, b) IN (SELECT (a, b) FROM ({board_queries.MOVED}))"

QUERIES |= board_queries.QUERIES
ORACLE_SQL |= board_queries.ORACLE_SQL
