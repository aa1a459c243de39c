import itertools
import random
import zlib

import numpy as np
import pytest

from plyset.llm.packing import Effort, best_fit, complete, dominated, fillings, pack
from plyset.llm.queries import tokenizer_file
from plyset.llm.tokens import Encoder


def held(packing):
    total = {}
    for filling, n in packing:
        for length, k in filling.items():
            total[length] = total.get(length, 0) + k * n
    return total


def fewest(lengths, capacity):
    """Exact by exhaustive search over few pieces."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                go(k + 1, bins)
                bins[i] -= lengths[k]
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_small_packings_are_optimal(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 24, 60])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    found = complete(counts, capacity)
    assert held(found) == counts and all(sum(n * k for n, k in f.items()) <= capacity for f, _ in found)
    assert sum(n for _, n in found) == fewest(lengths, capacity)


def test_search_beats_best_fit_where_it_fails():
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 8: 1, 7: 1}
    rng = random.Random(3)
    better = 0
    for _ in range(60):
        counts = {}
        for _ in range(60):
            n = rng.choice([7, 11, 13, 17, 23, 29, 31, 37, 41, 43])
            counts[n] = counts.get(n, 0) + 1
        a, b = (sum(n for _, n in p) for p in (complete(counts, 100), best_fit(counts, 100)))
        assert a <= b
        better += a < b
    assert better
    assert complete({}, 10) == []


def test_dominance():
    assert dominated((2, 2), (4,)) and not dominated((4,), (2, 2)) and dominated((1, 3), (2, 3))


@pytest.mark.parametrize("seed", range(30))
def test_fillings_are_all_that_are_not_dominated(seed):
    rng = random.Random(100 + seed)
    room = rng.randint(5, 40)
    lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 7))))
    counts = np.array([rng.randint(0, 3) for _ in lengths])
    waste = rng.randint(0, room)
    got = list(fillings(room, lengths, counts, waste, Effort(10**7)))
    every = [tuple(int(v) for v, k in zip(lengths[::-1], n) for _ in range(k)) for n in itertools.product(*(range(c + 1) for c in counts[::-1]))]
    every = [f for f in every if sum(f) <= room]
    for f in got:
        assert f in every and len(got) == len(set(got))
    if got and sum(got[0]) == sum(int(v * c) for v, c in zip(lengths, counts) if v <= room):
        return  # all that is left fits
    # whatever may be left out is dominated by one that is there, or wastes more
    for f in every:
        assert room - sum(f) > waste or any(dominated(f, g) for g in got), (f, got)
    for k, f in enumerate(got):  # none is dominated by one before, wastes don't fall
        assert room - sum(f) <= waste and not any(dominated(f, g) for g in got[:k])
        assert k == 0 or sum(f) <= sum(got[k - 1])


def test_the_last_round_is_exact():
    rng = random.Random(11)
    harder = 0
    for _ in range(60):
        lengths = [rng.choice([21, 23, 26, 27, 29, 33, 34, 36, 41, 47, 48, 52]) for _ in range(rng.randint(9, 13))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        want = fewest(lengths, 100)
        assert sum(n for _, n in complete(counts, 100)) == want
        harder += sum(n for _, n in best_fit(counts, 100)) > want
    assert harder


TEXTS = ["Hello world, it's 12 o'clock!", "", None, "x" * 9000, " " * 5000 + "end", "a <|endoftext|> b", "héllo wörld ñ 漢字 🙂", "tab\tnew\n\n\nline  ", "word " * 3000]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    slow = Tokenizer.from_file(path)
    enc = Encoder(open(path, "rb").read())
    assert enc.fast is not None
    rng = random.Random(1)
    letters = "abcABC  éñ1'.,\n\t!漢🙂"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(200)) for _ in range(100)]:
        assert enc.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_file())
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", "x")]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, piece string"), tokenizer_file(), capacity=2048).collect()
    want = []
    for doc, text, _ in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).collect() == []


def test_effort_follows_the_distinct_lengths_and_bounds_the_search(monkeypatch):
    from plyset.llm import packing

    asked = []
    monkeypatch.setattr(packing, "steps_for", lambda n: asked.append(n) or 1)
    assert complete({n: 1 for n in range(30, 90)} | {7: 0}, 100) and asked == [60]
    monkeypatch.undo()
    assert packing.steps_for(2000) == 2 * packing.steps_for(1000) and packing.steps_for(3) >= 400_000
    counts = {n: 3 for n in range(200, 700)}
    for effort in (0, 1, 1000, 50_000):
        assert held(complete(counts, 1000, effort)) == counts


def test_many_pieces_of_one_length_keep_their_places(spark):
    rows = [(i, "a b c") for i in range(900)] + [(i, "same text") for i in [5] * 300] + [(None, "x") for _ in range(200)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), tokenizer_file(), capacity=64).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == len(rows)
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
