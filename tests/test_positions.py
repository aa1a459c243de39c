import itertools

import pytest

from plyset.functions import predicates as P
from plyset.operators import checks
from plyset.operators.automaton import ACCEPT, REJECT, Automaton
from plyset.operators.positions import PositionSet, bound_within, intersection, union
from plyset.shape import Shape
from plyset.sources import Catalog

SHAPES = [(1,), (1, 2), (1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4, 5)]
COUNTS = {(1,): (1, 1, 0, 0, 0), (1, 2): (2, 1, 1, 0, 0), (1, 2, 3): (6, 1, 3, 2, 0), (1, 2, 3, 4): (24, 1, 6, 11, 6), (1, 2, 3, 4, 5): (120, 1, 10, 35, 50)}


@pytest.mark.parametrize("sizes", SHAPES)
def test_stated_counts(spark, sizes):
    s = Shape(sizes)
    accept, *counts = COUNTS[sizes]
    assert PositionSet.accept(spark, s).size() == accept and PositionSet.reject(spark, s).is_empty()
    sets = [PositionSet.count_pieces(spark, s, k) for k in range(4)]
    assert [x.size() for x in sets] == counts
    assert (~sets[1]).size() == accept - counts[1]
    assert (sets[0] & sets[1]).is_empty() and (sets[0] | sets[1]).size() == counts[0] + counts[1]
    assert PositionSet.count_character(spark, s, 0, len(sizes)).size() == 1


SHAPE = Shape((3, 3, 2))
UNIVERSE = set(itertools.product(range(3), range(3), range(2)))


def forms(spark):
    """The same kinds of sets in every form, with their members."""
    rows = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (0, 0, 0)]
    more = [(1, 1, 1), (2, 2, 0), (0, 0, 0)]
    where = P.fixed(SHAPE, 0, 0) | P.fixed(SHAPE, 1, 1)
    a, b, p = PositionSet.from_strings(spark, SHAPE, rows), PositionSet.from_strings(spark, SHAPE, more), PositionSet.matching(spark, SHAPE, where)
    inside = {u for u in UNIVERSE if where.holds(u)}
    return [(a, set(rows)), (b, set(more)), (p, inside), (~a, UNIVERSE - set(rows)), (~b, UNIVERSE - set(more))]


def test_algebra_over_all_forms(spark):
    for (x, mx), (y, my) in itertools.product(forms(spark), repeat=2):
        assert set((x & y).frame().collect()) == mx & my
        assert set((x | y).frame().collect()) == mx | my
        assert set((x - y).frame().collect()) == mx - my


def test_change(spark):
    for x, mx in forms(spark):
        for change in ({0: (0, 1)}, {0: (1, 2), 2: (1, 0)}, {}, {1: (1, 1)}):
            want = {tuple(change[i][1] if i in change else c for i, c in enumerate(u)) for u in mx if all(u[i] == b for i, (b, _) in change.items())}
            assert {tuple(r) for r in x.change(change).frame().collect()} == want
    assert PositionSet.accept(spark, SHAPE).change({0: (0, 1)}).size() == 6


def test_answers(spark):
    for x, mx in forms(spark):
        assert x.size() == len(mx) and list(x) == sorted(mx)
        assert [tuple(r) for r in x.first(3).collect()] == sorted(mx)[:3]
        assert x.contains((0, 1, 0)) == ((0, 1, 0) in mx)
        assert x.bound() == [{u[i] for u in mx} for i in range(3)]
        product = set(itertools.product(*x.bound()))
        assert x.is_linear() == (product == mx)
        assert bound_within(x.bound(), PositionSet.accept(spark, SHAPE).bound())
        a = Automaton.of(x)
        assert a.size() == len(mx) and {tuple(r) for r in a.positions().frame().collect()} == mx
        assert a.contains((1, 1, 1)) == ((1, 1, 1) in mx)
    with pytest.raises(ValueError):
        PositionSet.accept(spark, Shape((100,) * 10)).frame()
    assert (~PositionSet.from_strings(spark, Shape((100,) * 10), [(1,) * 10])).size() == 100**10 - 1


def test_vectors(spark):
    sets = forms(spark)
    assert set(intersection(spark, SHAPE, [x for x, _ in sets[:3]]).frame().collect()) == set.intersection(*(m for _, m in sets[:3]))
    assert set(union(spark, SHAPE, [x for x, _ in sets]).frame().collect()) == set.union(*(m for _, m in sets))
    assert intersection(spark, SHAPE, []).is_full() and union(spark, SHAPE, []).is_empty()


def test_automata_are_canonical(spark):
    a, b, p = (x for x, _ in forms(spark)[:3])
    x, y = Automaton.of(a), Automaton.of(b)
    assert (x & y) == Automaton.of(a & b) and (x | y) == Automaton.of(a | b) and (x - y) == Automaton.of(a - b)
    assert x.complement() == Automaton.of(~a) and x.complement().complement() == x
    assert (x & x.complement()).root == REJECT and (x | x.complement()).root == ACCEPT
    assert Automaton.of(PositionSet.accept(spark, SHAPE)).states() == 6
    assert Automaton.of(p) != x


def test_checks(spark):
    a, b, p, na, nb = (x for x, _ in forms(spark))
    assert checks.equal(a, ~na) and not checks.equal(a, b)
    assert checks.subset(a & b, b) and not checks.subset(a, b) and checks.subset(a, p, k=1)
    assert checks.disjoint(a, na) and not checks.disjoint(a, b)
    every = PositionSet.accept(spark, SHAPE)
    assert checks.partition(every, [a, na]) and not checks.partition(every, [a, b]) and not checks.partition(a, [a, b])


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    a, b, p, na, _ = (x for x, _ in forms(spark))
    key = c.save(a, "one")
    assert c.load_by_name("one").equals(a) and c.load_by_hash(key).equals(a) and c.get(key).equals(a)
    c.save(na, "two")
    assert c.load_by_name("two").equals(na)
    other = c.save(b, "one")  # the name moves on
    assert c.load_by_name("one").equals(b) and other != key
    assert c.vacuum() == [key]
    with pytest.raises(KeyError):
        c.load_by_hash(key)
    calls = []
    for _ in range(2):
        assert c.load_or_build("three", lambda: calls.append(1) or p).equals(p)
    assert len(calls) == 1
    with pytest.raises(KeyError):
        c.load_by_name("none")


def test_strings(spark):
    assert PositionSet.from_strings(spark, SHAPE, []).is_empty()
    assert PositionSet.from_strings(spark, SHAPE, [(0, 0, 0), (0, 0, 0)]).size() == 1
    with pytest.raises(ValueError):
        PositionSet.from_string(spark, SHAPE, (3, 0, 0))
    with pytest.raises(ValueError):
        PositionSet.accept(spark, SHAPE) & PositionSet.accept(spark, Shape((2,)))


def test_automata_of_predicates_and_changes(spark):
    import itertools

    from plyset.functions.predicates import count_character, fixed, some
    from plyset.operators.automaton import Automaton
    from plyset.operators.positions import PositionSet
    from plyset.shape import Shape

    shape = Shape((3, 2, 4, 2))
    for where in (count_character(shape, 0, 1, 2), some([fixed(shape, 0, 1) & fixed(shape, 2, 3), fixed(shape, 1, 0)]), ~fixed(shape, 3, 1), count_character(shape, 5, 0)):
        s = PositionSet.matching(spark, shape, where)
        a = Automaton.matching(spark, shape, where)
        assert a == Automaton.of(s) and a.states() == Automaton.of(s).states() and a.size() == s.size()
    a = Automaton.matching(spark, shape, count_character(shape, 0, 1, 2))
    every = {p for p in itertools.product(*map(range, shape.sizes)) if 1 <= p.count(0) <= 2}
    for changes in ({0: (0, 2)}, {1: (1, 1), 3: (0, 1)}, {2: (3, 0)}, {}):
        want = {tuple(dict(changes).get(i, (c, c))[1] if i in changes else c for i, c in enumerate(p)) for p in every if all(p[i] == b for i, (b, _) in changes.items())}
        got = a.change(changes)
        assert set(got.positions()) == want and got == Automaton.of(PositionSet.from_strings(spark, shape, want))


def test_null_slots_are_refused(spark):
    import pytest

    from plyset.operators.positions import PositionSet
    from plyset.shape import Shape

    df = spark.createDataFrame([(1, None)], "a int, b int")
    with pytest.raises(Exception, match="null slot"):
        PositionSet.from_frame(df, Shape((2, 2))).size()
