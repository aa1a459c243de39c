import itertools
import random
import re

import pytest

from plyset.llm.near_dedup import near_duplicates


def shingle_set(text, n=2):
    fold = {i: i + 32 for i in range(65, 91)}
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(fold)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n=2):
    sets = {d: shingle_set(t, n) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_families_with_edits_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for size, length, most in ((150, 120, 14), (60, 60, 10), (40, 30, 6), (25, 12, 3), (20, 6, 2)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(30)]
    rng.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "Two  Words"), (8, "x " * 50_000), (9, "X " * 60_000), (10, "a b c d e")]
    assert result(spark, rows) == brute(rows)
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    out = near_duplicates(df.selectExpr("*", "1 as n_shingles", "'x' as component_id")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, False), (0, 2, 0, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert near_duplicates(df.limit(0)).collect() == []
