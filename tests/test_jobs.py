import json
import os
import shutil
from collections import Counter
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import common, queries, set_relations, text_positions
from plyset.operators.relations import relations
from plyset.shape import Shape

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CONFIG = common.config(None, text_positions.DEFAULT)
TEXTS = [("Ab 12", "en"), ("", "de"), (None, None), ("x" * 500, "xx"), ("É\n\n1", "fr"), ("Ab 12", "en"), ("A" * 400 + "\n" * 30, "es")]


def plain_position(text, lang):
    """A text's position, read character by character."""
    t = text or ""
    count = {
        "chars": len(t), "lines": t.count("\n") + 1, "digits": sum(c in "0123456789" for c in t), "capitals": sum("A" <= c <= "Z" for c in t),
        "other": sum(not (c == " " or c.isascii() and c.isalnum()) for c in t), "words": len(t.split()),
    }
    out = []
    for s in CONFIG["slots"]:
        if "values" in s:
            out.append(1 + s["values"].index(lang) if lang in s["values"] else 0)
        else:
            v = count[s["measure"]]
            if "per" in s:
                v = v * 1000 // count[s["per"]] if count[s["per"]] else 0
            out.append(sum(v >= b for b in s["bounds"]))
    return tuple(out)


def plain_state(rows):
    names = [s["name"] for s in CONFIG["slots"]]
    ok = lambda p: any(all(p[names.index(n)] in chars for n, chars in rule.items()) for rule in CONFIG["rules"])
    return sorted((*p, ok(p), n) for p, n in Counter(plain_position(t, g) for t, g in rows).items())


def add_file(spark, folder, name, rows):
    """One Parquet file more, as a producer would put it there."""
    made = f"{folder}-made-{name}"
    spark.createDataFrame([(k, t, g, "x") for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, allowed string").coalesce(1).write.parquet(made)
    part = next(f for f in os.listdir(made) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{made}/{part}", f"{folder}/{name}.parquet")


def ledger(spark, out):
    return sorted(tuple(r) for r in text_positions.state(spark, str(out), CONFIG).collect())


def run_texts(spark, tmp_path, config=CONFIG):
    return text_positions.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), config)


def test_text_positions_over_growing_input(spark, tmp_path):
    add_file(spark, f"{tmp_path}/in", "one", TEXTS[:4])
    told = run_texts(spark, tmp_path)
    assert told["read_rows"] == 4 and told["batches"] == 1 and ledger(spark, tmp_path / "out") == plain_state(TEXTS[:4])
    files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    add_file(spark, f"{tmp_path}/in", "two", TEXTS[4:])
    assert run_texts(spark, tmp_path)["read_rows"] == 3  # what is new, no more
    assert ledger(spark, tmp_path / "out") == plain_state(TEXTS)
    assert run_texts(spark, tmp_path)["read_rows"] == 0 and ledger(spark, tmp_path / "out") == plain_state(TEXTS)
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert files.items() <= now.items()  # earlier batches are not written again


def test_text_positions_by_single_files_is_the_same(spark, tmp_path):
    for k, r in enumerate(TEXTS):
        add_file(spark, f"{tmp_path}/in", f"f{k}", [r])
    told = run_texts(spark, tmp_path, CONFIG | {"files_per_batch": 2})
    assert told["batches"] == 4 and told["texts"] == len(TEXTS) and ledger(spark, tmp_path / "out") == plain_state(TEXTS)
    assert text_positions._held(spark, str(tmp_path / "out"), "seen", CONFIG).select("c0", "c1", "c2", "c3", "c4", "c5").distinct().count() == told["positions"]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """What a driver does that died after writing and before the stream's commit."""
    out = str(tmp_path / "out")
    frames = [spark.createDataFrame(rows, "text string, lang string") for rows in (TEXTS[:4], TEXTS[4:])]
    for k in (0, 1, 1, 0, 1):
        text_positions.write_batch(frames[k], k, out, CONFIG)
    assert ledger(spark, out) == plain_state(TEXTS)


def test_text_positions_of_nothing(spark, tmp_path):
    add_file(spark, f"{tmp_path}/in", "none", [])
    assert run_texts(spark, tmp_path) == {"read_rows": 0, "batches": 0, "positions": 0, "texts": 0, "not_allowed": 0}


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"


def lines_of(months):
    return [(o, o % 5, o % 3, 1 + o % 7, 1.0 + o % 4, "ANR"[o % 3], datetime(1995, m, 1 + o % 28)) for m in months for o in range(60)]


def put(spark, tmp_path, lines):
    spark.createDataFrame(lines, LINES).write.mode("overwrite").parquet(f"{tmp_path}/lines")
    spark.createDataFrame([(o, f"{o % 2}-P") for o in range(60)], "o_orderkey long, o_orderpriority string").write.mode("overwrite").parquet(f"{tmp_path}/orders")
    return f"{tmp_path}/lines", f"{tmp_path}/orders", f"{tmp_path}/out"


def plain_relations(lines):
    sets = {}
    for o, p, s, n, q, f, day in lines:
        sets.setdefault((day.strftime("%Y-%m"), f"{o % 2}-P/{f}"), set()).add((p % 16, s % 16, n - 1, int(q) - 1))
    out = []
    for (m, a), x in sets.items():
        for (k, b), y in sets.items():
            if m == k and a < b:
                out.append((a, b, len(x), len(y), len(x & y), len(x | y), x <= y, x >= y, not x & y, m))
    return sorted(out)


def test_set_relations_replace_their_months(spark, tmp_path):
    first, more = lines_of([1, 2]), lines_of([2, 3])
    paths = put(spark, tmp_path, first)
    told = set_relations.run(spark, *paths)
    assert told == {"lines": 120, "skipped": 0, "pairs": 30, "months": 2}
    read = lambda: sorted(tuple(r) for r in set_relations.state(spark, paths[2]).collect())
    assert read() == plain_relations(first)
    put(spark, tmp_path, more[:90])
    assert set_relations.run(spark, *paths, since="1995-02", until="1995-03")["lines"] == 90
    assert read() == plain_relations(lines_of([1]) + more[:90])
    assert set_relations.run(spark, *paths, since="1995-03")["months"] == 1 and read() == plain_relations(lines_of([1]) + more[:90])


def test_set_relations_defined_results(spark, tmp_path):
    bad = [(1, 1, 1, 1, 1.0, "A", None), (99, 1, 1, 1, 1.0, "A", datetime(1995, 1, 1)), (1, 1, 1, 9, 1.0, "A", datetime(1995, 1, 1)), (1, 1, 1, 1, 1.0, None, datetime(1995, 1, 1))]
    paths = put(spark, tmp_path, bad)
    assert set_relations.run(spark, *paths) == {"lines": 4, "skipped": 4, "pairs": 0, "months": 0}
    assert set_relations.run(spark, *put(spark, tmp_path, []))["lines"] == 0


def test_the_dates_reach_the_scan(spark, tmp_path):
    lines, orders, _ = put(spark, tmp_path, lines_of([1]))
    df = set_relations.placed(spark.read.parquet(lines), spark.read.parquet(orders), common.config(None, set_relations.DEFAULT), "1995-01", "1995-02")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(l_shipdate,1995-01-01T00:00)" in plan and "LessThan(l_shipdate,1995-03-01T00:00)" in plan


def test_relations_without_an_outer_key(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None), (None, "a"), (None, "b")], "x int, g string")
    got = sorted(tuple(r) for r in relations(df, ["x"], "g").collect())
    assert got == [("a", "b", 3, 2, 2, 3, False, True, False), ("a", "c", 3, 1, 0, 4, False, False, True), ("b", "c", 2, 1, 0, 3, False, False, True)]
    assert relations(df.limit(0), ["x"], "g").collect() == [] and Shape((2, 3)).universe == 6


def test_command_lines(spark, tmp_path, monkeypatch):
    class Kept:
        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            pass

    monkeypatch.setattr(common, "session", lambda name: Kept())
    add_file(spark, f"{tmp_path}/in", "one", TEXTS)
    own = tmp_path / "own.json"
    own.write_text(json.dumps(CONFIG | {"slots": CONFIG["slots"][:2], "rules": [{"lang": [2]}]}))
    assert text_positions.main(["--input", f"{tmp_path}/in", "--out", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/c", "--config", str(own)]) == 0
    assert text_positions.state(spark, f"{tmp_path}/o", json.loads(own.read_text())).filter("allowed").first().texts == 2
    lines, orders, out = put(spark, tmp_path, lines_of([1]))
    assert set_relations.main(["--lines", lines, "--orders", orders, "--out", out]) == 0
    assert set_relations.state(spark, out).count() == 15


@there
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "lineitem", "orders"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    told = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_a_measure_is_taken_once_of_each_text(spark):
    rows = [*TEXTS, ("\r\n𝔸A1𝟙 \n", "de"), ("\n" * 3, "en"), ("12 34", "fr"), ("a" * 100_000 + "Z.", "es")]
    texts = spark.createDataFrame(rows, "text string, lang string")
    found = text_positions.positions(texts, CONFIG)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 4 and "translate(" not in plan and plan.count("char_length(text") + plan.count("length(text") <= 2
    names = Shape(tuple([1] * len(CONFIG["slots"]))).columns
    got = Counter({tuple(r[c] for c in names): r.texts for r in found.collect()})
    assert got == Counter(plain_position(t, g) for t, g in rows)


def test_groups_are_bits_as_they_are_lists(spark, monkeypatch):
    from plyset.operators import relations as R

    df = spark.createDataFrame([(k % 3, k * 7 % 11, f"g{k % n}") for n in (5, 63) for k in range(400)], "m int, x int, g string")
    some = relations(df, ["x"], "g", ["m"])
    assert "collect_set" not in some._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(R, "MOST_BITS", 0)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, relations(df, ["x"], "g", ["m"]).collect()))
