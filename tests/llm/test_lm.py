import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from plyset.llm.bloom import fill, levels_of
from plyset.llm.lm import bucket_of, score_by_fold, squeeze, unsqueeze
from plyset.llm.text import mix


def tokens(text):
    fold = {i: i + 32 for i in range(65, 91)}
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(fold)) if w] + [None]


def test_base_is_exact_and_the_model_learns(spark):
    rng = random.Random(2)
    follow = {}
    def text(n):  # each word has few followers, so bigrams tell much
        w, out = "w0", []
        for _ in range(n):
            w = rng.choice(follow.setdefault(w, [f"w{rng.randrange(300)}" for _ in range(3)]))
            out.append(w if rng.random() < 0.5 else w.upper())
        return " ".join(out)

    rows = [(i, text(rng.randint(1, 120))) for i in range(300)] + [(900, None), (901, ""), (902, " \n\t "), (903, "É é unseen"), (904, "big " * 400_000)]
    got = {r.doc_id: r for r in score_by_fold(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(w for i, t in rows if i not in held for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        own = tokens(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0
    some = [got[i] for i in held if i < 300]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_defined_results(spark):
    df = spark.createDataFrame([(None, "a b", 1), (5, "a", 2), (5, "a", 2)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in score_by_fold(df).collect())
    train = 3 + 2 * 2 * (zlib.crc32(b"5") % 7 != 2)
    assert got == [(0, 3, train), (5, 2, train), (5, 2, train)]
    assert score_by_fold(df.limit(0)).collect() == []


def test_filter_reads_levels_back():
    rng = np.random.default_rng(1)
    items = mix(np.arange(20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, size=20_000)
    region = np.frombuffer(fill(items, counts, 1 << 40), np.uint8)
    filter_ = (region, np.array([0, len(region)]))
    zero = np.zeros(20_000, np.int64)
    want = np.frexp(counts.astype(float))[1]
    got = levels_of(items, zero, filter_)
    assert (got >= want).all() and (got == want).mean() > 0.98
    assert (levels_of(mix(items + np.uint64(1 << 40)), zero, filter_) > 0).mean() < 0.03


def test_packing_of_arrays():
    for a in (np.arange(1000, dtype=np.uint64) << np.uint64(40), np.empty(0, np.int64), np.array([5], np.uint32)):
        assert (unsqueeze(squeeze(a), a.dtype, len(a)) == a).all()
    h = mix(np.arange(5000, dtype=np.uint64))
    own, _ = bucket_of(h, 37)
    assert (own == np.array([int(x) * 37 >> 64 for x in h])).all()


def test_what_the_model_keeps_has_no_bound(spark, monkeypatch):
    full = (np.full(64, 255, np.uint8), np.array([0, 64]))
    assert (levels_of(mix(np.arange(100, dtype=np.uint64)), np.zeros(100, np.int64), full, highest=3) == 3).all()

    def refuse(*_):
        raise AssertionError("the filter was broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    rows = [(i, f"a b c{i % 7} d{i}") for i in range(60)]
    got = {r.doc_id: r for r in score_by_fold(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == 60 and all(r.score < 0 for r in got.values())


def plain_model(rows, learnt, mu=30.0):
    """The docstring's model with exact levels, in plain Python."""
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if learnt(i):
            own = tokens(t)
            one.update(own)
            two.update(zip(["<begin>", *own], own))
    level = lambda c: math.floor(math.log2(c)) + 1 if c else 0
    mid = lambda q: math.sqrt(2 ** (q - 1) * (2**q - 1)) if q else 0.0
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        own, total = tokens(t), 0.0
        for h, w in zip(["<begin>", *own], own):
            ch = mid(level(one[None] if h == "<begin>" else one[h]))  # as many texts begin as end
            p1 = (mid(level(one[w])) + 1) / (n + v + 1)
            total += math.log10(min(1.0, (min(mid(level(two[h, w])), ch) + mu * p1) / (ch + mu)))
        out.append((i, total))
    return out


def test_score_against_plain_python(spark, monkeypatch):
    from plyset.llm import lm
    from plyset.llm.bloom import bits_at

    def wide(items, counts, most):  # so many bits that no probe hits by chance
        levels = np.frexp(counts.astype(np.float64))[1]
        size = max(1 << 16, 4096 * int(levels.sum())) // 8 * 8
        region = np.zeros(size // 8, np.uint8)
        for q in range(1, int(levels.max(initial=0)) + 1):
            own = items[levels >= q]
            at = bits_at(own, np.full(len(own), q, np.uint64), size).ravel()
            np.bitwise_or.at(region, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return region.tobytes()

    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice("ab cd ef G h ij K l mn op".split()) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(200, None), (201, "  "), (202, "never seen before"), (3, rows[3][1])]
    learnt = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "fill", wide)
    got = sorted((r.doc_id, r.score) for r in score_by_fold(df).collect())
    want = sorted(plain_model(rows, learnt))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)
    monkeypatch.undo()
    near = sorted((r.doc_id, r.score) for r in score_by_fold(df).collect())  # chance hits only raise what is read
    assert np.mean([abs(a - b) <= 0.05 * abs(b) + 0.1 for (_, a), (_, b) in zip(near, want)]) > 0.9

    def tiny(items, counts, most):  # every bit set
        return b"\xff" * 16

    monkeypatch.setattr(lm, "fill", tiny)
    full = {r.doc_id: r for r in score_by_fold(df).collect()}
    assert len(full) == len({i for i, _ in rows}) and all(math.isfinite(r.score) for r in full.values())
