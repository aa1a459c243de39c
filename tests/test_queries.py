import itertools
import os

import pytest

import __spark_entry__ as entry
from plyset.board_queries import QUERIES as BOARDS
from plyset.board_queries import endgames
from plyset.games import get_game
from plyset.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
FAST = ["accept", "reject", "fixed_layer", "count_character", "count_pieces", "from_strings", "from_strings_lineitem", "intersection", "union", "difference", "inverse", "intersection_vector", "union_vector", "change", "change_complement", "size", "layer_bound", "is_linear", "first_k", "contains_batch", "checks", "automaton_layers", "nim_forward", "nim_backward", "nim_before_predicate", "ttt_lost", "ttt_boards", "chess_divide", "chess_frontier", "dnf", "bound_within", "fingerprint", "quick_stats", "automaton_change", "automaton_first_k", "automaton_nth", "automaton_ranks", "automaton_contains_batch", "automaton_together", "automaton_cost_fold", "automaton_bounds", "automaton_change_fixed", "dnf_clauses", "automaton_image", "automaton_store", "automaton_resumed", "graph_sizes", "graph_reversed", "reachable", "nim_unknown", "othello_won", "result_names", "chess_ends", "chess_mated", "chess_targets", "chess_codec", "chess_between", "chess_move_table", "chess_uci", "chess_unmoves", "cli", *(n for n in BOARDS if n not in ("lines_nim_whole", "lines_nim_shares"))]  # two that repeat much of lines_nim


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and set(FAST) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("lineitem", "orders", "part", "nation"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    told = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def agrees(spark, name, folder):
    import duckdb

    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    told = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    rows = QUERIES[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("flags", ["AR", "ARRR", "A"])  # equal sets, one within the other, one empty
def test_catalog_where_sets_coincide(spark, tmp_path, flags):
    rows = [(k, k, 1, 5.0, f) for f in set(flags) for k in range(10 * flags.count(f))]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    agrees(spark, "catalog", tmp_path)


def test_ttt_lost_counts_all_boards_and_those_of_lines(spark, tmp_path):
    spark.createDataFrame([(k, k, 1) for k in range(9)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    agrees(spark, "ttt_lost", tmp_path)
    row = QUERIES["ttt_lost"](spark, str(tmp_path)).first()
    every = list(itertools.product(range(3), repeat=9))
    g = get_game("tictactoe_3")
    assert (row.lost_n, row.moves_n) == (sum(g.lost(0).holds(p) for p in every), sum(bool(g.successors(0, p)) for p in every))
    assert row.spelt_lost_n + row.spelt_moves_n <= 9


def test_ttt_boards_reads_lines_once(spark, tmp_path):
    spark.createDataFrame([(k % 5, k, 1) for k in range(90)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    agrees(spark, "ttt_boards", tmp_path)
    plan = QUERIES["ttt_boards"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # boards come from the different codes, kept once


@pytest.mark.parametrize("name", ["orders_chess_moves", "orders_chess_codec", "orders_chess_states"])
def test_chess_boards_are_placed_once(spark, tmp_path, name):
    spark.createDataFrame([(k, k % 9) for k in range(300)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    agrees(spark, name, tmp_path)
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan  # orders meet answers by their squares, no board is spelt for a row


def test_more_orders_spell_no_more_boards(spark, tmp_path):
    counts = []
    for times in (1, 3):
        keys = [(a + 64 * 977 * n, b + 64 * 31 * n) for n in range(times) for a in range(64) for b in range(64)]
        spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/{times}/orders.parquet")
        counts.append(tuple(df.count() for df in endgames(spark, f"{tmp_path}/{times}")))
    (rows, boards), (more_rows, same_boards) = counts
    assert (rows, more_rows) == (4096, 3 * 4096) and 0 < same_boards == boards <= 4096


@pytest.mark.parametrize("name", ["orders_breakthrough", "orders_othello"])
def test_moves_of_orders_send_nothing_to_the_driver(spark, tmp_path, name):
    spark.createDataFrame([(k * 7919, k % 9) for k in range(300)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    agrees(spark, name, tmp_path)
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Exchange" not in plan  # one pass over the orders, no broadcast


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["c0", "c1", "c2", "c3"]
