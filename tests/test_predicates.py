import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plyset.functions import predicates as P
from plyset.shape import Shape

SHAPE = Shape((3, 2, 4))
UNIVERSE = list(itertools.product(*(range(s) for s in SHAPE.sizes)))

tests = st.recursive(
    st.one_of(
        st.integers(0, 2).flatmap(lambda i: st.frozensets(st.integers(0, SHAPE.sizes[i] - 1)).map(lambda s: P.Among(i, s) if s else P.NEVER)),
        st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 2)).map(lambda t: P.count_character(SHAPE, t[0], min(t[1:]), max(t[1:]))),
        st.sampled_from([P.ALWAYS, P.NEVER]),
    ),
    lambda inner: st.one_of(st.lists(inner, max_size=3).map(P.every), st.lists(inner, max_size=3).map(P.some), inner.map(lambda p: ~p)),
    max_leaves=6,
)


def members(p):
    return {u for u in UNIVERSE if p.holds(u)}


@settings(max_examples=200, deadline=None)
@given(tests, tests)
def test_laws(a, b):
    assert members(a & b) == members(a) & members(b)
    assert members(a | b) == members(a) | members(b)
    assert members(~a) == set(UNIVERSE) - members(a)
    assert members(a & ~a) == set()


@settings(max_examples=100, deadline=None)
@given(tests, st.integers(0, 2))
def test_given_is_substitution(p, layer):
    for c in range(SHAPE.sizes[layer]):
        rest = p.given({layer: c})
        for u in UNIVERSE:
            if u[layer] == c:
                assert rest.holds(u) == p.holds(u)


def test_contradictions_fold():
    assert P.fixed(SHAPE, 0, 1) & P.fixed(SHAPE, 0, 2) is P.NEVER
    assert P.fixed(SHAPE, 0, 9) is P.NEVER


def test_bad_ranges():
    for bounds in ((2, 1), (0, 1, 2, 1), (0, 1, 0, 3)):
        with pytest.raises(ValueError):
            P.count_character(SHAPE, 0, *bounds)
    with pytest.raises(ValueError):
        SHAPE.check((0, 0, -1))
