import random
import zlib

import numpy as np

from plyset.llm import langid, quality

SYLLABLES = {
    "en": ("th er on an re he in ed nd ha at en es of or nt ea ti to it st".split(), "the of and to in is that was".split()),
    "de": ("ein sch ung ich keit ver be ge ü ß ä zu en er".split(), "der die und das ist nicht mit".split()),
    "fr": ("eau oi eux tion ment é è ê ou ai en".split(), "le la les de des et un une que".split()),
    "es": ("ción mente ado os as ñ ó ll rr ez".split(), "el la los de que y en un por".split()),
    "xx": ("qz zk vv wq kx".split(), "qzq vkx".split()),
}


def sentence(rng, lang, n):
    syllables, common = SYLLABLES[lang]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    return " ".join(word() for _ in range(n)).capitalize() + "."


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randint(5, 60)), lang, 1.0) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "en", 0.0), (1001, "", "en", 0.0), (1002, "12 !! €", "de", 0.0), (1003, "漢字", None, 0.0), (None, sentence(rng, "fr", 20), "fr", 0.0), (1004, sentence(rng, "es", 50_000), "es", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in langid.predict_by_fold(df).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i, *_ in held)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[None].lang_pred == "fr" and got[1004].lang_pred == "es" and got[1003].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_by_fold(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.predict_by_fold(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_features_are_per_text():
    import pyarrow as pa

    texts = ["abc def", "", "x", "é!!!é", "abc"]
    x = langid.features(pa.array(texts))
    assert np.allclose(np.concatenate([langid.features(pa.array([t])) for t in texts]), x)
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 0, 1, 1])  # one letter has no bigram


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.8
        text = "\n".join(sentence(rng, "en", rng.randint(5, 40)) for _ in range(rng.randint(1, 6)))
        if not good:
            text = rng.choice([text.upper() + "!!", " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 200)])
        rows.append((i, text, 0.5))
        labels.append((i, int(good), 0))
    rows += [(900, None, 0.0), (901, "", 0.0), (None, "some text", 0.0), (3, rows[3][1], 0.0), (902, "word " * 200_000, 0.0)]
    labels += [(4, None, 0), (None, 1, 0)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score_by_fold(df, known).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    held = [(i, q) for i, q, _ in labels[:500] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == q for i, q in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert got[900].score == got[901].score and got[902].predicted == 0
    assert quality.score_by_fold(df.limit(0), known).collect() == []
    assert {round(r.score, 6) for r in quality.score_by_fold(df, known.limit(0)).collect()} == {0.5}


def test_compiled_rules_say_what_the_rules_say(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit(x, y)
    b, rules = model
    want = 1 / (1 + np.exp(-(b + sum(w * quality.holds(r, x) for r, w in rules))))
    df = spark.createDataFrame(x.tolist(), list(quality.STATISTICS))
    got = [r[0] for r in df.select(quality.compiled(model)).collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.97
    assert len(rules) < len(quality.extract(x, y))
    assert quality.fit(x, np.ones(400))[1] == [] and quality.fit(x[:0], y[:0]) == (0.0, [])


def plain_statistics(text):
    import regex

    t = text or ""
    words = [w for w in regex.split(r"[\x09-\x0D\x20]+", t.lower()) if w]
    lines = t.split("\n") if t else []
    part = lambda a, b: a / b if b else 0.0
    space = sum(c in "\t\n\x0b\x0c\r " for c in t)
    kinds = (len(regex.findall(p, t)) for p in (r"\p{Lu}", r"[^\p{L}\p{N}\x09-\x0D\x20.,]", r"\p{N}", "[.,]"))
    return (
        float(len(t)), float(len(words)), part(len(t) - space, len(words)), part(len(set(words)), len(words)), float(len(lines)), part(len(set(lines)) if t else 0, len(lines)),
        part(len(words), len(lines)), *(part(k, len(t)) for k in kinds),
    )


def test_statistics_against_plain_python(spark):
    rng = random.Random(12)
    alphabet = "abcXYZ ÄÖß0129.,;:#\n\t\r\x0b\u4e2d\U0001f600-é "
    texts = [None, "", " ", "\n", "\n\n", "a", "A.\nA.", "word " * 3000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in quality.with_statistics(df, "doc_id").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_statistics(t)), (t, got[i], plain_statistics(t))


def test_samples_are_bounded_and_never_empty(spark):
    rng = random.Random(3)
    rows = [(7, sentence(rng, "en", 5), "en")] * 3000 + [(i, sentence(rng, lang, 9), lang) for i in range(2000) for lang in [("en", "de")[i % 2]]] + [(None, sentence(rng, "de", 4), "de")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    vectors = langid.vectors
    langid.vectors = lambda some: seen.append(some.count()) or vectors(some)
    try:
        assert langid.learn(df, sample=100) is not None and langid.learn(df, most=10) is not None
    finally:
        langid.vectors = vectors
    assert seen[0] <= 350 and seen[1] <= 40
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, label int")
    bounds = []
    fit = quality.fit
    quality.fit = lambda x, y: bounds.append(len(y)) or fit(x, y)
    try:
        quality.learn(df, labels, sample=200)
    finally:
        quality.fit = fit
    assert 100 < bounds[0] < 320


def test_sampling_rates_do_not_vanish(spark):
    from pyspark.sql import functions as F

    from plyset.llm.common import drawn

    some = spark.range(4_000_000).filter(drawn(F.xxhash64("id"), F.lit(8_000 / 1e11)))  # as with 1e11 rows: nothing here, but not by rounding
    assert some.count() <= 3
    assert 20 < spark.range(4_000_000).filter(drawn(F.xxhash64("id"), F.lit(1e-5))).count() < 70
    assert spark.range(1000).filter(drawn(F.xxhash64("id"), F.lit(1.0))).count() == 1000
    # the rate itself is kept down to 52 bits: a hash below 8000 / 1e11 * 2**52 is drawn
    at = int(8_000 / 1e11 * 2**52)
    got = spark.createDataFrame([(at - 1,), (at + 1,)], "h long").select(drawn(F.col("h"), F.lit(8_000 / 1e11)).alias("d")).collect()
    assert [r.d for r in got] == [True, False]


def plain_features(text):
    code = {**{c: c - 96 for c in range(97, 123)}, **{c: c - 64 for c in range(65, 91)}, **{c: c - 101 for c in range(128, 256)}}
    seq = []
    for b in (text or "").encode():
        c = code.get(b, 0)
        if c or not seq or seq[-1]:
            seq.append(c)
    out = np.zeros(langid.DIMENSIONS)
    for order, seed in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        for k in range(len(seq) - order + 1):
            h = 0
            for c in seq[k : k + order]:
                h = (h * 155 + c) % 2**32
            out[(h * seed % 2**32) >> 19] += 1
    out = np.sqrt(out)
    return out / max(np.linalg.norm(out), 1e-9)


def test_features_and_votes_against_plain_python():
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["", "a", "  ab  cd", "ÄÖ! 漢字", "..."] + [sentence(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 30)) for _ in range(60)]
    x = langid.features(pa.array(texts))
    assert np.allclose(x, [plain_features(t) for t in texts], atol=1e-6)
    langs = np.array([rng.choice(list(SYLLABLES)) for _ in texts])
    model = langid.Model(x, langs)
    got, score = model.predict(x)
    margins = x @ model.weights
    names, sure = list(model.families), lambda m: 1 / (1 + np.exp(-langid.SHARPNESS * m))
    for i in range(len(texts)):
        ranked = sorted(range(len(names)), key=lambda k: -margins[i, k])
        own, column = model.families[names[ranked[0]]], len(names)
        for f in names[: ranked[0]]:
            column += len(model.pairs[f])
        votes, weakest = [0.0] * len(own), [np.inf] * len(own)
        for a, b in model.pairs[names[ranked[0]]]:
            m = margins[i, column]
            column += 1
            votes[a if m >= 0 else b] += 1
            for who, side in ((a, 1), (b, -1)):
                votes[who] += side * 1e-3 * np.tanh(m)
                weakest[who] = min(weakest[who], side * m)
        best = int(np.argmax(votes))
        want = sure(margins[i, ranked[0]] - margins[i, ranked[1]]) * (sure(weakest[best]) if len(own) > 1 else 1)
        assert model.langs[got[i]] == own[best] and abs(score[i] - want) < 1e-6


def test_vectors_to_learn_from_are_collected_without_their_zeros(spark):
    import pyarrow as pa

    texts = ["the cat sat on the mat", "der hund und die katze", "", "a"]
    x = langid.features(pa.array(texts))
    rows = sorted(langid.vectors(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")).collect())
    assert [len(r.x) for r in rows] == [6 * np.count_nonzero(v) for v in x]  # not a whole row of the matrix for each
    held = langid.Rows([bytes(r.x) for r in rows])
    assert all(np.allclose(held.whole(k), v) for k, v in [*enumerate(x), *reversed(list(enumerate(x)))])
    many, langs = np.tile(x, (5, 1)), np.array(["en", "de", "en", "fr"] * 5)
    assert (langid.Model(many, langs).weights == langid.Model(langid.Rows(langid.Rows.packed(many)), langs).weights).all()
