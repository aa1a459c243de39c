import itertools
import math
import random

import pytest

from plyset.functions import predicates as P
from plyset.operators import automaton
from plyset.operators.automaton import ACCEPT, REJECT, Automaton, fold, fold_by_cost, intersection, product_cost, union
from plyset.operators.positions import PositionSet
from plyset.shape import Shape

SHAPE = Shape((3, 2, 4, 3))
ALL = list(itertools.product(*map(range, SHAPE.sizes)))


def some_rows(seed, share):
    rng = random.Random(seed)
    return sorted(p for p in ALL if rng.random() < share)


def made(spark, rows):
    return Automaton.of(PositionSet.from_strings(spark, SHAPE, rows))


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sets(spark):
    rows = {"few": some_rows(1, 0.1), "half": some_rows(2, 0.5), "none": [], "all": ALL, "block": [p for p in ALL if p[0] in (0, 2) and p[2] == 1], "free": [p for p in ALL if p[:2] == (1, 0)]}
    return {k: (v, made(spark, v)) for k, v in rows.items()}


@pytest.fixture(params=[200_000, 0], ids=["broadcast", "salted"])
def either_join(request, monkeypatch):
    monkeypatch.setattr(automaton, "BROADCAST_CELLS", request.param)


@pytest.mark.parametrize("name", ["few", "half", "none", "all", "block", "free"])
def test_ordered_reads(spark, sets, name, either_join):
    rows, a = sets[name]
    assert a.size() == len(rows)
    assert told(a.first(5)) == [(k, *p) for k, p in enumerate(rows[:5])]
    assert told(a.first(4, offset=3)) == [(k + 3, *p) for k, p in enumerate(rows[3:7])]
    asked = [0, 2, 2, len(rows) - 1, len(rows), -1, 10**9]
    want = sorted((r, *rows[r]) for r in asked if 0 <= r < len(rows))
    assert told(a.nth(spark.createDataFrame([(r,) for r in asked], "rank long"))) == want
    place = {p: k for k, p in enumerate(rows)}
    got = {tuple(r)[:4]: r["rank"] for r in a.ranks(spark.createDataFrame(ALL, SHAPE.schema)).collect()}
    assert got == {p: place.get(p) for p in ALL}


@pytest.mark.parametrize("name", ["few", "half", "none", "all", "free"])
def test_membership_of_a_table(spark, sets, name, either_join):
    rows, a = sets[name]
    asked = [(*p, k) for k, p in enumerate(ALL)] + [(9, 0, 0, 0, -1), (0, 0, -1, 0, -2), (None, 0, 0, 0, -3)]
    got = a.accepts(spark.createDataFrame(asked, "c0 int, c1 int, c2 int, c3 int, id int"))
    assert {r.id for r in got.filter("accepted").collect()} == {k for k, p in enumerate(ALL) if p in set(rows)}
    assert got.count() == len(asked)
    some = PositionSet.from_strings(spark, SHAPE, ALL[::3])
    assert told(a.contains_batch(some).frame()) == sorted(set(rows) & set(ALL[::3]))
    assert a.contains(ALL[5]) == (ALL[5] in rows)


def test_one_plan_for_a_batch(spark, sets):
    """Membership is one job's plan whatever the number of positions, and a broadcast layer isn't shuffled."""
    df = sets["half"][1].accepts(spark.createDataFrame(ALL, SHAPE.schema))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["few", "half", "none", "all", "block", "free"])
def test_bounds(spark, sets, name):
    rows, a = sets[name]
    want = [{p[i] for p in rows} for i in range(4)]
    assert a.bound() == want
    assert a.is_linear() == (len(rows) == math.prod(map(len, want)))
    assert a.check_bound(want) and a.check_bound([set(range(n)) for n in SHAPE.sizes])
    if rows:
        assert not a.check_bound([want[0] - {rows[0][0]}, *want[1:]])
    assert a.check_fixed(2, 1) == (name in ("block", "none"))


def test_every_state_is_met(spark, sets):
    """The invariant that bounds and one-pass changes rely on."""
    whole = [a for _, a in sets.values()]
    whole += [whole[0] & whole[1], whole[0] | whole[1], whole[0] - whole[1], whole[1].complement(), union(whole[:2]), intersection(whole[:2])]
    whole += [whole[1].change({0: (1, 2)}), sets["block"][1].change({2: (1, 3)}), Automaton.matching(spark, SHAPE, P.count_character(SHAPE, 0, 1, 2))]
    for a in whole:
        assert [n.count() for n in a._reached().layers] == [n.count() for n in a.layers]


def jobs_of(spark, work):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("name,changes", [("half", {0: (1, 2), 2: (3, 0)}), ("block", {2: (1, 3)}), ("block", {2: (1, 1)}), ("block", {2: (0, 1)}), ("free", {0: (1, 0), 1: (0, 1)}), ("none", {0: (0, 1)}), ("all", {3: (0, 2)})])
def test_change(spark, sets, name, changes):
    rows, a = sets[name]
    want = sorted({tuple(changes[i][1] if i in changes else c for i, c in enumerate(p)) for p in rows if all(p[i] == b for i, (b, _) in changes.items())})
    got = a.change(changes)
    assert told(got.positions().frame()) == want and got == made(spark, want)


def test_a_change_of_fixed_slots_takes_one_pass(spark, sets, monkeypatch):
    a = sets["block"][1]
    one, few = jobs_of(spark, lambda: a.change({2: (1, 3)}))
    monkeypatch.setattr(Automaton, "bound", lambda self: [set(range(n)) for n in self.shape.sizes])
    two, many = jobs_of(spark, lambda: a.change({2: (1, 3)}))
    assert one == two and few < many


@pytest.mark.parametrize("names", [("few", "half", "block", "free"), ("half", "all", "few"), ("all", "none")])
def test_products_of_many(spark, sets, names):
    rows, own = zip(*(sets[n] for n in names))
    for found, want in ((intersection(list(own)), set(ALL).intersection(*rows)), (union(list(own)), set().union(*rows))):
        assert told(found.positions().frame()) == sorted(want) and found == made(spark, sorted(want))
    assert fold_by_cost(list(own), True) == intersection(list(own)) and fold_by_cost(list(own), False) == union(list(own))


def test_a_product_of_many_is_one_pass(spark):
    own = [made(spark, some_rows(k, 0.5)) for k in range(4)]
    together, few = jobs_of(spark, lambda: intersection(own))
    pair, two = jobs_of(spark, lambda: own[0] & own[1])
    by_pairs, many = jobs_of(spark, lambda: fold(own, lambda a, b: a and b))
    assert together == by_pairs and few <= 1.5 * two and few < many / 1.5


def test_cost_order(spark, sets):
    """Small sets meet first, results are estimated anew, and sets that can't meet end it."""
    own = [sets[n][1] for n in ("half", "few", "block", "free")]
    trace = []
    fold_by_cost(own, False, trace)
    assert [t[:2] for t in trace][0] == (2, 3) and len(trace) == 3 and trace[1][1] == 4 or trace[1][0] == 1
    apart = [made(spark, [p for p in ALL if p[0] == c]) for c in (0, 1)]
    trace = []
    assert fold_by_cost([*own, *apart], True, trace).root == REJECT
    sizes = ([2, 3, 3, 2], [{0}, {0, 1}, {1}, {0}])
    assert product_cost(sizes, sizes, True) == 1 + 1 + 2 + 2
    assert fold_by_cost([own[0], own[0]], True) == own[0]


def test_sizes_without_an_enumeration(spark):
    shape = Shape((8,) * 9)
    a = Automaton.matching(spark, shape, P.count_character(shape, 0, 3))
    assert a.size() == 84 * 7**6 and a.bound() == [set(range(8))] * 9 and not a.is_linear()
    assert told(a.first(2)) == [(0, 0, 0, 0, 1, 1, 1, 1, 1, 1), (1, 0, 0, 0, 1, 1, 1, 1, 1, 2)]
    last = a.nth(spark.createDataFrame([(84 * 7**6 - 1,)], "rank long"))
    assert told(last) == [(84 * 7**6 - 1, 7, 7, 7, 7, 7, 7, 0, 0, 0)]
    big = Shape((100,) * 30)
    assert Automaton.matching(spark, big, P.fixed(big, 0, 1)).size() > 10**50 and ACCEPT == "1"
