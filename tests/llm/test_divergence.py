import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plyset.llm import divergence
from plyset.llm.divergence import audit, share, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top=50):
    """The contract, read plainly with whole numbers of any size."""
    df, count, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(low(text or ""))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        terms, own = kept[lang], sorted(s for g, s in groups if g == lang)
        n = {s: sum(count[lang, s, t] for t in terms) for s in own}
        p = lambda s, t: 1 + 10**9 * (count[lang, s, t] + 5) // (n[s] + 5 * len(terms))  # noqa: B023, E731
        q = lambda t: 1 + 10**9 * (sum(count[lang, s, t] for s in own) + 5) // (sum(n.values()) + 5 * len(terms))  # noqa: B023, E731
        pairs = [(-sum(abs(p(source, t) - p(s, t)) for t in terms), s.encode()) for s in own if s != source]
        best = [(q(t) - p(source, t), t.encode()) for t in terms if count[lang, source, t] and p(source, t) > q(t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
            out += [(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


def corpus(seed, n, sources, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [rng.choice(["Über", "a", "B", "naïve", "日本", "x'y", "don3t", "Zoë"]) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(60)]
    rows = []
    for k in range(n):
        text = rng.choice([" ", "\n", "-", "\x00", "4"]).join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice([0, 1, 5, 40])))
        rows.append((k // 2 if k % 3 else None, rng.choice([text] * 20 + [None, "", "123 .."]), rng.choice(langs), rng.choice(sources)))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", term int").repartition(3)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in audit(df, **how).collect())


@pytest.mark.parametrize("seed,sources,least,top", [(1, ["s1", "s2", "s3", None, "é"], 30, 50), (2, ["a"], 3, 5), (3, [f"s{k}" for k in range(12)], 5, 3), (4, ["a", "b"], 10_000, 50)])
def test_against_a_plain_reading(spark, seed, sources, least, top):
    rows = corpus(seed, 300, sources)
    want = plain(rows, least, top)
    assert run(spark, rows, min_docs=least, top=top) == want and (want != [] or len(sources) == 1)  # a language's only source is like it


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Many flushes, salts and tiles, runs over several batches, and texts taken alone give the same rows."""
    rows = corpus(5, 300, [f"s{k}" for k in range(9)])
    for name, value in (("FLUSH", 40), ("CHUNK", 60), ("CELLS", 12), ("RUN_TERMS", 5)):
        monkeypatch.setattr(divergence, name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        assert run(spark, rows, min_docs=5, top=4) == plain(rows, 5, 4)
    finally:
        spark.conf.set(key, before)


def test_terms(monkeypatch):
    text = "ÀB c-d''É 12a\x00b Ⅻ éé " * 50
    monkeypatch.setattr(divergence, "CHUNK", 7)
    assert {t.decode(): n for t, n in terms_of(text.encode()).items()} == dict(Counter(TERM.findall(low(text))))


def test_shares_are_exact():
    rng = random.Random(6)
    a = [rng.randrange(5, 8 * 10**15) for _ in range(300)] + [5, 6, 7]
    b = [x + rng.randrange(0, 10**15) for x in a]
    assert share(np.array(a), np.array(b)).tolist() == [1 + 10**9 * x // y for x, y in zip(a, b)]


def test_defined_results(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).collect() == []
    assert run(spark, [(1, None, None, None)]) == []
    assert run(spark, [(1, None, "en", "a"), (1, "", "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    same = run(spark, [(1, "word " * 3, "en", s) for s in ("b", "a", "c") for _ in range(10)])
    assert [r[3] for r in same if r[1] == "a"] == ["b", "c"] and all(r[4] == 0 for r in same)
