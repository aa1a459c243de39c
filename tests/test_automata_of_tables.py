import itertools
import random

import pytest

from plyset.operators import automaton
from plyset.operators.automaton import ACCEPT, REJECT, Automaton, image, of_clauses
from plyset.operators.positions import PositionSet
from plyset.shape import Shape
from plyset.sources.automata import AutomatonStore

SHAPE = Shape((3, 2, 4, 3))
ALL = list(itertools.product(*map(range, SHAPE.sizes)))


def made(spark, rows):
    return Automaton.of(PositionSet.from_strings(spark, SHAPE, rows))


def told(a):
    return sorted(tuple(r) for r in a.positions().frame().collect())


def rows_of(seed, share):
    rng = random.Random(seed)
    return sorted(p for p in ALL if rng.random() < share)


@pytest.mark.parametrize("clauses", [
    [(0, None, 1, None), (0, None, 2, None), (None, 1, None, 2), (0, 1, 3, 0)], [(None, None, None, None), (1, 1, 1, 1)], [], [(9, None, None, None), (None, None, -1, 0)],
    [(None, None, None, c) for c in range(3)], [(p[0], None, p[2], p[3]) for p in ALL[::5]] + [(None, p[1], None, p[3]) for p in ALL[::17]],
])
def test_clauses(spark, clauses):
    want = [p for p in ALL if any(all(x is None or x == y for x, y in zip(c, p)) for c in clauses)]
    a = of_clauses(spark.createDataFrame(clauses, "a int, b int, c int, d int"), SHAPE)
    assert told(a) == want and a.root == made(spark, want).root
    assert [n.count() for n in a._reached().layers] == [n.count() for n in a.layers]


RULES = [
    {0: (0, 1)}, {0: (1, 2), 2: (3, 0)}, {3: (2, 2)}, {1: (0, 1), 3: (1, 0)}, {2: (3, 0), 0: (2, 2)}, {2: (9, 0)}, {7: (0, 0)},
]


@pytest.mark.parametrize("share,rules", [(0.3, RULES), (0.9, RULES[:3]), (1.0, RULES), (0.0, RULES), (0.5, []), (0.5, RULES[5:])])
def test_images(spark, share, rules):
    rows = set(rows_of(7, share))
    a = made(spark, sorted(rows))
    df = spark.createDataFrame([(f"r{k}", s, b, f) for k, r in enumerate(rules) for s, (b, f) in r.items()], "rule string, slot int, before int, after int")
    ok = [r for r in rules if all(s < 4 and max(x) < SHAPE.sizes[s] for s, x in r.items())]

    def moved(p, rule, old, new):
        return tuple(rule[i][new] if i in rule else c for i, c in enumerate(p)) if all(p[i] == x[old] for i, x in rule.items()) else None

    for backward in (False, True):
        want = sorted({q for p in rows for r in ok if (q := moved(p, r, int(backward), int(not backward)))})
        found = image(a, df, backward)
        assert told(found) == want and found == made(spark, want)


def test_a_broken_product_goes_on(spark, tmp_path, monkeypatch):
    a, b = made(spark, rows_of(1, 0.5)), made(spark, rows_of(2, 0.5))
    both = lambda x, y: x and y
    plain, written = automaton.materialise_once, []

    def failing(df, path):
        if len(written) == 5:
            raise RuntimeError("the driver is gone")
        written.append(path)
        return plain(df, path)

    monkeypatch.setattr(automaton, "materialise_once", failing)
    with pytest.raises(RuntimeError):
        a.combine(b, both, str(tmp_path))
    at = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert {p.parent.name for p in tmp_path.rglob("_SUCCESS")} == {"pairs000", "pairs001", "pairs002", "pairs003", "layer003"}
    monkeypatch.setattr(automaton, "materialise_once", plain)
    assert made(spark, rows_of(1, 0.5)).combine(b, both, str(tmp_path)) == a & b  # another driver's operands, made anew
    assert all(p.stat().st_mtime_ns == t for p, t in at.items())  # no finished layer was made again
    assert a.combine(b, lambda x, y: x or y, str(tmp_path)) == (a | b)  # another operation has other layers
    assert len(list(tmp_path.iterdir())) == 2


def test_store_shares_states(spark, tmp_path):
    store = AutomatonStore(spark, str(tmp_path))
    one, two = rows_of(3, 0.4), rows_of(4, 0.4)
    a, b, c = made(spark, one), made(spark, one + [p for p in two if p[0] == 0]), made(spark, [p for p in ALL if p[3] != 1])
    key = store.save(a, "a")
    assert store.load("a") == a and told(store.load(key)) == one and key == a.root
    alone = store.states(SHAPE).count()
    assert alone == sum(n.count() for n in a.layers)
    store.save(b, "b")
    store.save(a, "again")
    shared = sum(len({r.state for r in x.collect()} | {r.state for r in y.collect()}) for x, y in zip(a.layers, b.layers))
    assert store.states(SHAPE).count() == shared < alone + sum(n.count() for n in b.layers)
    store.save(c, "c")
    store.unbind("b")
    store.unbind("c")
    assert store.vacuum()["after"] == alone and store.load("again") == a
    with pytest.raises(KeyError):
        store.load("b")
    store.save(b, "a")  # a name may move
    assert store.load("a") == b and store.load("again") == a
    for k, root in (("none", REJECT), ("all", ACCEPT)):
        store.save(Automaton(spark, SHAPE, root, [x.limit(0) for x in a.layers]), k)
        assert store.load(k).root == root
    assert AutomatonStore(spark, str(tmp_path / "new")).vacuum() == {"before": 0, "after": 0}
