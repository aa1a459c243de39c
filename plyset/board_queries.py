"""Queries that play games from positions which the given tables hold, each with SQL derived from the rules.

Lines and orders are read as boards: keys give heaps, cells or squares. Every row of a table gets its
answer, so the work and the result grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.functions import chess as C
from plyset.games import chess, get_game
from plyset.operators import checks
from plyset.operators.positions import PositionSet
from plyset.plans import moves
from plyset.plans.game import packed, unpacked, with_fractions
from plyset.plans.judged import answered, encoded, from_code, holds, judged, mobility, reached, shares, shuffled, spelled, with_moves
from plyset.storage import materialise

HEAPS = ("l_partkey % 16", "l_suppkey % 16", "l_orderkey % 16")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def heaps(spark, d) -> DataFrame:
    return lines(spark, d).withColumn("p", encoded([F.expr(h) for h in HEAPS], get_game("normalnim_3x15").shape))


def q_nim(spark, d):
    """Every line's heaps, won or lost within three plies."""
    rows = heaps(spark, d)
    return answered(rows, judged(get_game("normalnim_3x15"), rows, 0, 3)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "result")


def q_nim_whole(spark, d):
    """Small heaps played to the end: result and number of moves of each line."""
    g = get_game("normalnim_3x3")
    rows = lines(spark, d).withColumn("p", encoded([F.expr(h) for h in ("l_partkey % 4", "l_suppkey % 4", "l_linenumber % 4")], g.shape))
    both = judged(g, rows, 1, 9).join(mobility(g, rows, 1), "p")
    return answered(rows, both).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "result", "moves")


def q_nim_shares(spark, d):
    """Shares of won, lost and open lines by return flag."""
    rows = heaps(spark, d)
    table = with_fractions(shares(answered(rows, judged(get_game("normalnim_3x15"), rows, 0, 3)), "l_returnflag"))
    return table.select("l_returnflag", "win", "lose", "unknown", *(F.round(f"{c}_share", 9).alias(f"{c}_share") for c in ("win", "lose", "unknown")))


def small_heaps(spark, d, test: str) -> PositionSet:
    return PositionSet.from_frame(lines(spark, d).filter(test).selectExpr("l_partkey % 5", "l_suppkey % 5", "l_linenumber % 5"), get_game("normalnim_3x4").shape)


def q_nim_steps(spark, d):
    """One move forward, one back, back by the reversed graph, and what can move at all, from the heaps of each large line."""
    g, test = get_game("normalnim_3x4"), "l_quantity = 50 and l_discount > 0.09"
    s = small_heaps(spark, d, test)
    turned = moves.apply(packed(s, g.shape), g.move_graph(0).reversed().optimized().rules(), g.shape)
    kinds = {"forward": g.forward(0, s), "backward": g.backward(0, s), "turned": unpacked(turned.select(F.col("q").alias("p")), g.shape, distinct=True), "moving": s & g.has_moves(spark, 0)}
    out = None
    for kind, found in kinds.items():
        df = found.frame().select(F.lit(kind).alias("kind"), *(F.col(c).cast("int").alias(c) for c in g.shape.columns))
        out = df if out is None else out.unionByName(df)
    return out


def q_nim_reached(spark, d):
    """How many positions play from the lines' heaps reaches after each ply."""
    rows = lines(spark, d).filter("l_quantity = 50").withColumn("p", encoded([F.expr(h) for h in ("l_partkey % 5", "l_suppkey % 5", "l_linenumber % 5")], get_game("normalnim_3x4").shape))
    fronts = reached(get_game("normalnim_3x4"), rows, 0, 3)
    out = None
    for ply, front in enumerate(fronts):
        df = front.agg(F.count("*").alias("positions")).select(F.lit(ply).alias("ply"), "positions")
        out = df if out is None else out.unionByName(df)
    return out


def q_nim_validated(spark, d):
    """The one-step rules on the judged heaps of the lines hold; with sides changed they don't."""
    g = get_game("normalnim_3x15")
    rows = heaps(spark, d)
    now, none = judged(g, rows, 0, 3), PositionSet.reject(spark, g.shape)
    after = judged(g, reached(g, rows, 0, 1)[1], 1, 2)
    of = lambda df, r: unpacked(df.filter(F.col("result") == r).select("p"), g.shape)
    told = {
        "losing_ok": checks.losing(g, 0, of(now, -1), none, of(after, 1)), "losing_bad": checks.losing(g, 0, of(now, 1), none, of(after, 1)), "winning_ok": checks.winning(g, 0, of(now, 1), none, of(after, -1)),
        "winning_bad": checks.winning(g, 0, of(now, -1), none, of(after, -1)), "moves_ok": checks.moves(g, 0, of(now, 1), 200),
        "parts_ok": checks.partition(unpacked(now.select("p"), g.shape), [of(now, r) for r in (-1, 0, 1)]),
    }
    return now.groupBy("result").agg(F.count("*").alias("positions")).select("result", "positions", *(F.lit(v).alias(k) for k, v in told.items()))


TTT = "(l_orderkey * 9973 + l_partkey * 31 + l_linenumber * 7) % 19683"


def ttt_boards(rows: DataFrame) -> DataFrame:
    """The different codes of lines and the board of each."""
    return spelled(rows, ("code",), from_code(F.col("code"), get_game("tictactoe_3").shape))


def q_ttt(spark, d):
    """Every line as a board of noughts and crosses, x to move: result within two plies, moves, and whether it is lost as it stands."""
    g = get_game("tictactoe_3")
    rows = lines(spark, d).withColumn("code", F.expr(TTT))
    boards = ttt_boards(rows)
    both = judged(g, boards, 0, 2).join(shuffled(mobility(g, boards, 0)), "p").withColumn("lost", holds(g.lost(0)))
    return answered(rows, boards.join(shuffled(both), "p"), ("code",)).select("l_orderkey", "l_linenumber", "code", "result", "moves", "lost")


def counted(name: str, side: int, code: str) -> Callable:
    """Orders as boards of a game: how many moves each has."""

    def run(spark, d):
        g = get_game(name)
        rows = orders(spark, d).withColumn("code", F.expr(code)).withColumn("p", from_code(F.col("code"), g.shape))
        return with_moves(g, rows, side).select("o_orderkey", "code", "moves")

    return run


BREAKTHROUGH = "(o_orderkey * 104729 + o_custkey * 7919) % 531441"
OTHELLO = "(o_orderkey * 15485863 + o_custkey * 32452843) % 43046721"
AMAZONS = "(o_orderkey * 2038074743 + o_custkey * 179424673) % 4294967296"


def q_breakthrough_won(spark, d):
    """Orders as boards, o to move: won or lost by arrival, and the same boards turned round with sides changed."""
    g = get_game("breakthrough_3x4")
    rows = orders(spark, d).withColumn("code", F.expr(BREAKTHROUGH)).withColumn("p", from_code(F.col("code"), g.shape))
    turned = packed(g.reversed(unpacked(rows.select("p"), g.shape, distinct=True)), g.shape)
    own = turned.select(holds(g.lost(0)).alias("lost"))
    told = rows.select(holds(g.lost(1)).alias("lost"))
    return told.groupBy("lost").agg(F.count("*").alias("orders")).join(own.groupBy("lost").agg(F.count("*").alias("turned")), "lost")


#: Squares of pieces by order: the white king, and four black pieces.
SQUARES = {"wk": "o_orderkey % 64", "bk": "(o_custkey * 5 + 11) % 64", "br": "(o_orderkey * 7 + o_custkey) % 64", "bb": "(o_orderkey * 3 + o_custkey * 2 + 17) % 64", "bn": "(o_orderkey * 11 + 29) % 64"}
LETTERS = {"wk": "K", "bk": "k", "br": "r", "bb": "b", "bn": "n"}


def endgames(spark, d, pieces: dict[str, str] = LETTERS) -> tuple[DataFrame, DataFrame]:
    """Orders with the squares of a white king to move and of king, rook, bishop and knight against it, or some of these;
    and the board of each different placement, where no square is used twice and kings don't touch."""
    rows = orders(spark, d).select("o_orderkey", *(F.expr(SQUARES[c]).cast("int").alias(c) for c in pieces))
    apart = F.greatest(F.abs(F.expr("wk % 8 - bk % 8")), F.abs(F.expr("wk div 8 - bk div 8"))) > 1
    seats = materialise(rows.select(*pieces).filter(apart).distinct(), "seats")
    return rows, materialise(chess.placed(seats, pieces), "boards")


def told_of(rows: DataFrame, boards: DataFrame, told: DataFrame, pieces: dict[str, str] = LETTERS) -> DataFrame:
    """Every order with what is known of its board: by its squares, so that no board is spelt for a row."""
    return answered(rows, boards.join(shuffled(told), "board"), tuple(pieces))


def q_chess_states(spark, d):
    """Check, mate and stalemate of every order's board, from the generator; check by the lines of attack on the slots as well."""
    rows, boards = endgames(spark, d)
    each = chess.spread(boards)
    free = chess.in_check(chess.as_slots(each), 0).select("board", "in_check")
    moved = chess.successors(each).groupBy("board").agg(F.count("*").alias("moves"))
    told = chess.states(each).join(shuffled(free), "board").join(shuffled(moved), "board", "left")
    return told_of(rows, boards, told).select("o_orderkey", "check", "in_check", "checkmate", "stalemate", F.coalesce("moves", F.lit(0).cast("long")).alias("moves"))


def q_chess_moves(spark, d):
    """Every legal move of every order's board in UCI text, with the cells that it leads to."""
    rows, boards = endgames(spark, d)
    found = chess.successors(chess.spread(boards)).select("board", "move", F.split("next", " ")[0].alias("cells"))
    left = F.length(F.regexp_replace("cells", "[^a-z]", "")).cast("long")
    return told_of(rows, boards, found.select("board", "move", left.alias("black_left"))).select("o_orderkey", "move", "black_left")


ROOK = {k: LETTERS[k] for k in ("wk", "bk", "br")}


def q_chess_divide(spark, d):
    """Orders as king against king and rook: pairs of moves by the first, from the generator with equal boards merged."""
    rows, boards = endgames(spark, d, ROOK)
    return told_of(rows, boards, chess.divide_of(boards, 2), ROOK).select("o_orderkey", "move", "paths")


def q_chess_codec(spark, d):
    """Every order's board as FEN, and what its slots say of each piece's square."""
    rows, boards = endgames(spark, d)
    slots = chess.as_slots(chess.spread(boards))
    cells = F.array(*(F.col(f"c{i}") for i in range(64)))
    where = [(F.array_position(cells, F.lit(C.PIECES.index(LETTERS[c])).cast("tinyint")) - 1).cast("int").alias(f"{c}_told") for c in SQUARES]
    told = told_of(rows, boards, slots.select("board", *where))
    return told.select("o_orderkey", "board", *(F.col(f"{c}_told").alias(c) for c in SQUARES))


#: Parts and suppliers of lines as squares that something moves from and to.
MOVE = ("cast(l_partkey % 64 as int) as a", "cast((l_suppkey * 3 + l_linenumber) % 64 as int) as b")


def q_chess_between(spark, d):
    """Parts of lines as moves on an empty board: which pieces may go so from where to where, and how many squares lie between."""
    table = spark.createDataFrame([(k, a, b, len(w)) for k, a, b, w in C.move_table()], "piece string, a int, b int, n int")
    rows = lines(spark, d).selectExpr("l_orderkey", "l_linenumber", *MOVE)
    return rows.join(F.broadcast(table), ["a", "b"])  # 64 * 64 moves of eight kinds at most


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lines_nim": q_nim,
    "lines_nim_whole": q_nim_whole,
    "lines_nim_shares": q_nim_shares,
    "lines_nim_steps": q_nim_steps,
    "lines_nim_reached": q_nim_reached,
    "lines_nim_validated": q_nim_validated,
    "lines_tictactoe": q_ttt,
    "orders_breakthrough": counted("breakthrough_3x4", 1, BREAKTHROUGH),
    "orders_breakthrough_won": q_breakthrough_won,
    "orders_othello": counted("othello_4x4", 0, OTHELLO),
    "orders_amazons": counted("amazons_4x4", 1, AMAZONS),
    "orders_chess_states": q_chess_states,
    "orders_chess_moves": q_chess_moves,
    "orders_chess_divide": q_chess_divide,
    "orders_chess_codec": q_chess_codec,
    "lines_chess_between": q_chess_between,
}

# -- the same in SQL, from the rules of the games ------------------------------------------------


def _digit(code: str, base: int, k: int | str) -> str:
    unit = base**k if isinstance(k, int) else f"CAST(pow({base}, {k}) AS BIGINT)"
    return f"(({code}) // {unit} % {base})"


_SIZES = "least(h0, h1, h2) AS lo, h0 + h1 + h2 - least(h0, h1, h2) - greatest(h0, h1, h2) AS mid, greatest(h0, h1, h2) AS hi"
_HEAPS = "(SELECT *, " + ", ".join(f"{h} AS h{i}" for i, h in enumerate(HEAPS)) + " FROM lineitem)"
# lost at once: nothing left; won in one: one heap left; lost in two: two heaps of one; won in three: a move to these
_WITHIN = "CAST(CASE WHEN hi = 0 THEN -1 WHEN mid = 0 THEN 1 WHEN lo = 0 AND mid = 1 AND hi = 1 THEN -1 WHEN mid = 1 THEN 1 ELSE 0 END AS INT) AS result"
_NIM = f"(SELECT *, {_WITHIN} FROM (SELECT *, {_SIZES} FROM {_HEAPS}))"
_CUBE = "(SELECT a.r AS c0, b.r AS c1, c.r AS c2 FROM range(5) a(r), range(5) b(r), range(5) c(r))"
_TAKEN = f"(SELECT a.c0 AS a0, a.c1 AS a1, a.c2 AS a2, b.* FROM {_CUBE} a JOIN {_CUBE} b ON a.c0 >= b.c0 AND a.c1 >= b.c1 AND a.c2 >= b.c2 AND CAST(a.c0 > b.c0 AS INT) + CAST(a.c1 > b.c1 AS INT) + CAST(a.c2 > b.c2 AS INT) = 1)"
_INTS = "CAST(c0 AS INT) AS c0, CAST(c1 AS INT) AS c1, CAST(c2 AS INT) AS c2"


def _small(test: str) -> str:
    return f"(SELECT DISTINCT l_partkey % 5 AS c0, l_suppkey % 5 AS c1, l_linenumber % 5 AS c2 FROM lineitem WHERE {test})"


def _steps(test: str) -> str:
    s = _small(test)
    back = f"SELECT DISTINCT '{{}}' AS kind, CAST(a0 AS INT), CAST(a1 AS INT), CAST(a2 AS INT) FROM {_TAKEN} JOIN {s} USING (c0, c1, c2)"
    on = f"SELECT DISTINCT 'forward' AS kind, {_INTS} FROM {_TAKEN} WHERE (a0, a1, a2) IN (SELECT (c0, c1, c2) FROM {s})"
    return " UNION ALL ".join([on, back.format("backward"), back.format("turned"), f"SELECT 'moving', {_INTS} FROM {s} WHERE c0 + c1 + c2 > 0"])


def _reached(plies: int) -> str:
    parts = [f"r0 AS {_small('l_quantity = 50')}"]
    parts += [f"r{k} AS (SELECT DISTINCT e.c0, e.c1, e.c2 FROM {_TAKEN} e JOIN r{k - 1} r ON a0 = r.c0 AND a1 = r.c1 AND a2 = r.c2)" for k in range(1, plies + 1)]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS ply, count(*) AS positions FROM r{k}" for k in range(plies + 1))


_ROWS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6))


def _row_of(code: str, mark: int) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"{_digit(code, 3, i)} = {mark}" for i in row) + ")" for row in _ROWS) + ")"


_COMPLETES = "(" + " OR ".join(f"({_digit('q', 3, i)} = 0 AND {_row_of(f'q + {2 * 3**i}', 2)})" for i in range(9)) + ")"
_TTT = f"""
WITH b AS (SELECT DISTINCT {TTT} AS code FROM lineitem), open AS (SELECT code, {_row_of('code', 2)} AS lost FROM b),
e AS (SELECT code, code + CAST(pow(3, m) AS BIGINT) AS q FROM open, range(9) t(m) WHERE NOT lost AND {_digit('code', 3, 'm')} = 0),
v AS (SELECT code, CASE WHEN {_row_of('q', 1)} THEN -1 WHEN {_COMPLETES} THEN 1 ELSE 0 END AS r FROM e),
s AS (SELECT code, count(*) AS moves, bool_or(r = -1) AS one_wins, bool_and(r = 1) AS all_lose FROM v GROUP BY code)
SELECT l_orderkey, l_linenumber, code, CAST(CASE WHEN lost THEN -1 WHEN one_wins THEN 1 WHEN all_lose THEN -1 ELSE 0 END AS INT) AS result, coalesce(moves, 0) AS moves, lost
FROM (SELECT *, {TTT} AS code FROM lineitem) l JOIN open USING (code) LEFT JOIN s USING (code)
"""

_ARRIVED = f"({' OR '.join(f'{_digit("code", 3, i)} = 1' for i in (9, 10, 11))})"
_BREAK = f"""
WITH b AS (SELECT DISTINCT {BREAKTHROUGH} AS code FROM orders), way AS (SELECT a, dx, a - 3 + dx AS t FROM range(3, 12) x(a), range(-1, 2) y(dx) WHERE a % 3 + dx BETWEEN 0 AND 2),
m AS (SELECT code, count(*) AS moves FROM b, way WHERE NOT {_ARRIVED} AND {_digit('code', 3, 'a')} = 2 AND ({_digit('code', 3, 't')} = 0 OR (dx <> 0 AND {_digit('code', 3, 't')} = 1)) GROUP BY code)
SELECT o_orderkey, code, coalesce(moves, 0) AS moves FROM (SELECT *, {BREAKTHROUGH} AS code FROM orders) LEFT JOIN m USING (code)
"""

#: Squares from each square of a 4 x 4 board on, in eight directions, and masks of those on the way.
_RAYS = """
r AS (SELECT a, dx, dy, n, a + n * (4 * dy + dx) AS c FROM range(16) x(a), range(-1, 2) u(dx), range(-1, 2) v(dy), range(1, 4) s(n)
    WHERE (dx <> 0 OR dy <> 0) AND a % 4 + n * dx BETWEEN 0 AND 3 AND a // 4 + n * dy BETWEEN 0 AND 3),
way AS (SELECT i.a, i.c AS t, i.n, bit_or(1 << j.c) AS w FROM r i JOIN r j USING (a, dx, dy) WHERE j.n <= i.n GROUP BY i.a, i.c, i.n, dx, dy)"""


def _mask(code: str, base: int, test: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {_digit(code, base, k)} {test} THEN {1 << k} ELSE 0 END)" for k in range(16)) + ")"


def _placing(own: str, other: str) -> str:
    on_way = "(w - (1 << t))"
    return f"SELECT code, count(DISTINCT a) AS n FROM m, way WHERE n >= 2 AND ({own} | {other}) & (1 << a) = 0 AND {own} & (1 << t) > 0 AND {other} & {on_way} = {on_way} GROUP BY code"


_OTHELLO = f"""
WITH {_RAYS}, m AS (SELECT DISTINCT code, {_mask('code', 3, '= 1')} AS x, {_mask('code', 3, '= 2')} AS o FROM (SELECT {OTHELLO} AS code FROM orders)),
own AS ({_placing('x', 'o')}), other AS ({_placing('o', 'x')})
SELECT o_orderkey, code, CASE WHEN own.n > 0 THEN own.n WHEN other.n > 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS moves FROM (SELECT *, {OTHELLO} AS code FROM orders) LEFT JOIN own USING (code) LEFT JOIN other USING (code)
"""
_AMAZONS = f"""
WITH {_RAYS}, turn AS (SELECT q.a, (q.w | s.w) & ~(1 << q.a) AS free FROM way q JOIN way s ON s.a = q.t),
m AS (SELECT DISTINCT code, {_mask('code', 4, '<> 0')} AS held, {_mask('code', 4, '= 2')} AS own FROM (SELECT {AMAZONS} AS code FROM orders)),
n AS (SELECT code, count(*) AS moves FROM m, turn WHERE own & (1 << a) > 0 AND held & free = 0 GROUP BY code)
SELECT o_orderkey, code, coalesce(moves, 0) AS moves FROM (SELECT *, {AMAZONS} AS code FROM orders) LEFT JOIN n USING (code)
"""


def _far(a: str, b: str) -> tuple[str, str]:
    return f"abs({a} % 8 - {b} % 8)", f"abs({a} // 8 - {b} // 8)"


def _clear(piece: str, king: str, others: tuple[str, ...], straight: bool) -> str:
    """No other man that is still there stands between a piece and the king's square on their common line."""
    tests = []
    for x in others:
        inside = f"({x} % 8 - {piece} % 8) * ({x} % 8 - {king} % 8) < 0", f"({x} // 8 - {piece} // 8) * ({x} // 8 - {king} // 8) < 0"
        if straight:
            on = f"(({piece} // 8 = {king} // 8 AND {x} // 8 = {king} // 8 AND {inside[0]}) OR ({piece} % 8 = {king} % 8 AND {x} % 8 = {king} % 8 AND {inside[1]}))"
        else:
            p, k = _far(x, piece), _far(x, king)
            on = f"({p[0]} = {p[1]} AND {k[0]} = {k[1]} AND {inside[0]})"
        tests.append(f"NOT ({x} <> {king} AND {on})")
    return " AND ".join(tests)


def _attacked(k: str) -> str:
    """The white king on square k, where it has taken what stood there, is attacked."""
    (rx, ry), (bx, by), (nx, ny), (kx, ky) = (_far(p, k) for p in ("br", "bb", "bn", "bk"))
    rook = f"(br <> {k} AND ({rx} = 0 OR {ry} = 0) AND {_clear('br', k, ('bk', 'bb', 'bn'), True)})"
    bishop = f"(bb <> {k} AND {bx} = {by} AND {_clear('bb', k, ('bk', 'br', 'bn'), False)})"
    return f"({rook} OR {bishop} OR {nx} * {ny} = 2 OR greatest({kx}, {ky}) <= 1)"


_KX, _KY = _far("wk", "bk")
_ENDGAMES = "(SELECT * FROM (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in SQUARES.items()) + f" FROM orders) WHERE len(list_distinct([wk, bk, br, bb, bn])) = 5 AND greatest({_KX}, {_KY}) > 1)"
_KING = f"(SELECT * FROM (SELECT g.*, wk + 8 * dy + dx AS t FROM {_ENDGAMES} g, range(-1, 2) u(dx), range(-1, 2) v(dy) WHERE (dx <> 0 OR dy <> 0) AND wk % 8 + dx BETWEEN 0 AND 7 AND wk // 8 + dy BETWEEN 0 AND 7) WHERE NOT {_attacked('t')})"
#: King against king and rook: a white move, then what the black king and the rook, if it is still there, can do.
_ROOKS = f"(SELECT * FROM (SELECT o_orderkey, {', '.join(f'{SQUARES[c]} AS {c}' for c in ('wk', 'bk', 'br'))} FROM orders) WHERE wk <> bk AND wk <> br AND bk <> br AND greatest({_KX}, {_KY}) > 1)"
_EIGHT = "range(-1, 2) u(dx), range(-1, 2) v(dy) WHERE (dx <> 0 OR dy <> 0)"


def _beside(s: str) -> str:
    return f"{s} % 8 + dx BETWEEN 0 AND 7 AND {s} // 8 + dy BETWEEN 0 AND 7"


_RX, _RY = _far("br", "t")
_TX, _TY = _far("t", "bk")
_ROOK_SEES = f"(br <> t AND ({_RX} = 0 OR {_RY} = 0) AND {_clear('br', 't', ('bk',), True)})"
_DIVIDE = f"""
WITH w AS (SELECT * FROM (SELECT g.*, wk + 8 * dy + dx AS t FROM {_ROOKS} g, {_EIGHT} AND {_beside('wk')}) WHERE NOT {_ROOK_SEES} AND greatest({_TX}, {_TY}) > 1),
k AS (SELECT o_orderkey, t, count(*) AS n FROM (SELECT w.*, bk + 8 * dy + dx AS b FROM w, {_EIGHT} AND {_beside('bk')}) WHERE greatest(abs(b % 8 - t % 8), abs(b // 8 - t // 8)) > 1 AND (b <> br OR br = t) GROUP BY o_orderkey, t),
r AS (SELECT o_orderkey, t, count(*) AS n FROM w, range(64) x(b) WHERE br <> t AND b <> br AND b <> bk AND (b % 8 = br % 8 OR b // 8 = br // 8) AND {_clear('br', 'b', ('bk', 't'), True)} GROUP BY o_orderkey, t)
SELECT o_orderkey, concat({{wk}}, {{t}}) AS move, CAST(coalesce(k.n, 0) + coalesce(r.n, 0) AS BIGINT) AS paths FROM w LEFT JOIN k USING (o_orderkey, t) LEFT JOIN r USING (o_orderkey, t) WHERE coalesce(k.n, 0) + coalesce(r.n, 0) > 0
"""
_FILE = lambda s: f"chr(CAST(97 + {s} % 8 AS INT)), CAST(8 - {s} // 8 AS VARCHAR)"
_CELL = lambda s: "CASE " + " ".join(f"WHEN {c} = {s} THEN '{k}'" for c, k in LETTERS.items()) + " ELSE '1' END"
_FEN = " || '/' || ".join("concat(" + ", ".join(_CELL(8 * y + x) for x in range(8)) + ")" for y in range(8))
for _n in range(8, 1, -1):
    _FEN = f"replace({_FEN}, '{'1' * _n}', '{_n}')"

_TABLE = " UNION ALL ".join([
    "SELECT 'k' AS piece, a, b, 0 AS n FROM s WHERE greatest(dx, dy) = 1", "SELECT 'q', a, b, greatest(dx, dy) - 1 FROM s WHERE dx = 0 OR dy = 0 OR dx = dy", "SELECT 'r', a, b, greatest(dx, dy) - 1 FROM s WHERE dx = 0 OR dy = 0",
    "SELECT 'b', a, b, dx - 1 FROM s WHERE dx = dy", "SELECT 'n', a, b, 0 FROM s WHERE dx * dy = 2",
    "SELECT 'P', a, b, dy - 1 FROM s WHERE a // 8 BETWEEN 1 AND 6 AND b < a AND ((dy = 1 AND dx <= 1) OR (dy = 2 AND dx = 0 AND a // 8 = 6))",
    "SELECT 'p', a, b, dy - 1 FROM s WHERE a // 8 BETWEEN 1 AND 6 AND b > a AND ((dy = 1 AND dx <= 1) OR (dy = 2 AND dx = 0 AND a // 8 = 1))",
])
MOVED = "SELECT l_orderkey, l_linenumber, l_partkey % 64 AS a, (l_suppkey * 3 + l_linenumber) % 64 AS b FROM lineitem"

ORACLE_SQL: dict[str, str] = {
    "lines_nim": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, result FROM {_NIM}",
    "lines_nim_whole": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN xor(xor(a, b), c) = 0 THEN -1 ELSE 1 END AS INT) AS result, a + b + c AS moves FROM (SELECT *, CAST(l_partkey % 4 AS BIGINT) AS a, CAST(l_suppkey % 4 AS BIGINT) AS b, CAST(l_linenumber % 4 AS BIGINT) AS c FROM lineitem)",
    "lines_nim_shares": f"SELECT *, round(win / (win + lose + unknown), 9) AS win_share, round(lose / (win + lose + unknown), 9) AS lose_share, round(unknown / (win + lose + unknown), 9) AS unknown_share FROM (SELECT l_returnflag, count(*) FILTER (result = 1) AS win, count(*) FILTER (result = -1) AS lose, count(*) FILTER (result = 0) AS unknown FROM {_NIM} GROUP BY l_returnflag)",
    "lines_nim_steps": _steps("l_quantity = 50 AND l_discount > 0.09"),
    "lines_nim_reached": _reached(3),
    "lines_nim_validated": f"SELECT result, count(DISTINCT (h0, h1, h2)) AS positions, true AS losing_ok, false AS losing_bad, true AS winning_ok, false AS winning_bad, true AS moves_ok, true AS parts_ok FROM {_NIM} GROUP BY result",
    "lines_tictactoe": _TTT,
    "orders_breakthrough": _BREAK,
    "orders_breakthrough_won": f"SELECT {_ARRIVED} AS lost, count(*) AS orders, count(DISTINCT code) AS turned FROM (SELECT {BREAKTHROUGH} AS code FROM orders) GROUP BY lost",
    "orders_othello": _OTHELLO,
    "orders_amazons": _AMAZONS,
    "orders_chess_states": f"SELECT o_orderkey, attacked AS \"check\", attacked AS in_check, attacked AND n = 0 AS checkmate, NOT attacked AND n = 0 AS stalemate, n AS moves FROM (SELECT g.o_orderkey, {_attacked('wk')} AS attacked, coalesce(n, 0) AS n FROM {_ENDGAMES} g LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM {_KING} GROUP BY o_orderkey) USING (o_orderkey))",
    "orders_chess_moves": f"SELECT o_orderkey, concat({_FILE('wk')}, {_FILE('t')}) AS move, CAST(4 - CAST(t IN (br, bb, bn) AS INT) AS BIGINT) AS black_left FROM {_KING}",
    "orders_chess_divide": _DIVIDE.format(wk=_FILE("wk"), t=_FILE("t")),
    "orders_chess_codec": f"SELECT o_orderkey, concat({_FEN}, ' w - -') AS board, {', '.join(f'CAST({c} AS INT) AS {c}' for c in SQUARES)} FROM {_ENDGAMES}",
    "lines_chess_between": f"WITH s AS (SELECT i.r AS a, j.r AS b, abs(i.r % 8 - j.r % 8) AS dx, abs(i.r // 8 - j.r // 8) AS dy FROM range(64) i(r), range(64) j(r) WHERE i.r <> j.r), t AS ({_TABLE}) SELECT l_orderkey, l_linenumber, CAST(a AS INT) AS a, CAST(b AS INT) AS b, piece, CAST(n AS INT) AS n FROM ({MOVED}) JOIN t USING (a, b)",
}
