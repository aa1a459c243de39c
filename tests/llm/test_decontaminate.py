import random

import pytest

from plyset.llm import decontaminate
from plyset.llm.decontaminate import leaks


def smith_waterman(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def word(rng):
    return rng.choice(["the", "of", "and", "to", *[f"w{i}" for i in range(600)]])


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(word(rng) if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append(word(rng))
    return out


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_matches_full_alignment(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(9)
    items = [(i, " ".join(word(rng) for _ in range(rng.randint(10, 50)))) for i in range(12)]
    items += [(50, items[0][1]), (51, "two words"), (52, None), (53, "")]
    docs = []
    for i in range(120):
        text = [word(rng) for _ in range(rng.randint(20, 200))]
        if i % 2:
            w = rng.choice(items[:12])[1].split()
            at = rng.randrange(len(text))
            text[at:at] = edited(rng, w, rng.choice([0, 0.1, 0.25]))
        if i % 10 == 0:  # a passage that many documents share
            text += items[3][1].upper().split()
        docs.append((i, " ".join(text)))
    docs += [(500, None), (501, ""), (502, items[1][1].replace(" ", "\n\t ")), (502, items[1][1]), (None, items[2][1])]
    got = {}
    rows = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in rows:
        got[r.doc_id, r.item_id] = r.score
    want = {}
    for d, t in docs:
        for i, x in items:
            a, b = (x or "").lower().split(), (t or "").lower().split()
            if len(a) >= 3 and (s := smith_waterman(a, b) / (2 * len(a))) >= 0.5:
                want[d, i] = max(s, want.get((d, i), 0))
    assert got == pytest.approx(want)
    assert len([r for r in rows if r.doc_id == 502]) == 2
    one = next(r for r in rows if r.doc_id == 502 and r.item_id == 1)
    assert (one.start_word, one.end_word) == (0, len(items[1][1].split()))


@pytest.mark.parametrize("block", [1 << 20, 0])
def test_clean_and_empty(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs = spark.createDataFrame([(1, "a b c d e f g h", 1), (2, "x y z", 2), (None, None, 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.clean(docs, items).collect()) == [2, 3]
    assert leaks(docs.limit(0), items).collect() == [] and leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.clean(docs, items.limit(0)).count() == 3


def test_a_large_benchmark_stays_off_the_driver(spark, monkeypatch):
    """Whatever its size: as many passes over the documents, and no item is collected."""
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    monkeypatch.setattr(decontaminate, "finder", None)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(word(rng) for _ in range(60))) for i in range(40)], "doc_id long, text string")
    plans = []
    for n in (20, 400):
        items = spark.createDataFrame([(i, " ".join(word(rng) for _ in range(12))) for i in range(n)], "item_id long, text string")
        plans.append(leaks(docs, items)._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("LogicalRDD") == plans[1].count("LogicalRDD") and plans[0].count("MapInArrow") == plans[1].count("MapInArrow")


@pytest.mark.parametrize("block", [1 << 20, 0])
def test_no_leak_is_missed(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(3)
    items = [(i, " ".join(f"i{i}x{rng.randrange(400)}" if rng.random() < 0.6 else word(rng) for _ in range(40))) for i in range(14)]
    docs, fresh = [], lambda: f"n{rng.randrange(10**6)}"

    def put(words, times=1):
        for _ in range(times):
            docs.append((len(docs), " ".join([fresh() for _ in range(30)] + words + [fresh() for _ in range(30)])))

    w = [t.split() for _, t in items]
    put(w[0])
    put(w[1][:21])  # half an item, alone
    put(w[2][19:])
    put([fresh() if k % 5 == 4 else x for k, x in enumerate(w[3])])
    put([fresh() if k % 3 == 2 else x for k, x in enumerate(w[4])])
    put([y for x in w[5] for y in (x, fresh())])  # a word after each word
    put([x for k, x in enumerate(w[6]) if k % 3])
    put(w[7][:21], 30)  # halves and variants copied many times
    put([fresh() if k % 5 == 4 else x for k, x in enumerate(w[8])], 30)
    put(w[9], 30)
    put(w[9][:20] + w[9][26:])
    for k in (10, 11, 12, 13):
        for _ in range(25):
            put(edited(rng, w[k], rng.choice([0.2, 0.3, 0.4, 0.5])))
    got = {(r.doc_id, r.item_id): r.score for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): s for d, t in docs for i, x in items if (s := smith_waterman(x.split(), t.split()) / 80) >= 0.5}
    assert len(want) > 130 and all((k, n) in want for k, n in ((1, 1), (2, 2), (3, 3), (5, 5), (6, 6)))
    assert got == pytest.approx(want)
