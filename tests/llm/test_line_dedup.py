import random

import pyarrow as pa
import pytest

from plyset.llm.line_dedup import MIN_WORDS, chunks, dedup


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


def maker(rng):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_passages_go_and_the_rest_stays(spark, rng):
    para = maker(rng)
    line, lines, inside = para(60), "\n".join(para(9) for _ in range(7)), para(80)
    rows = []
    for i in range(60):
        text = (para(80) + "\n" + line + "\n" + para(30), para(9) + "\n" + lines + "\n" + para(12), para(40) + " " + inside + " " + para(50))[i % 3]
        rows.append((i, text, "x"))
    rows += [(i, "\n".join(para(30) for _ in range(5)), "x") for i in range(60, 100)]
    rows += [(200, rows[70][1], "copy"), (201, None, "y"), (202, "", "y"), (None, rows[0][1], "no id"), (203, "short line", "y"), (204, "short line", "y"), (205, "same " * 30_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_note string").repartition(5)
    got = {r.doc_id: r for r in dedup(df).collect()}
    source = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for i in (0, 1, 2):  # the first keeps its text
        assert got[i].text == source[i] and got[i].removed_words == 0
    for i in range(3, 60):
        if i % 3 == 0:
            assert got[i].text == source[i].replace(line + "\n", "") and got[i].removed_words == 60
        elif i % 3 == 1:
            assert got[i].text == source[i].replace(lines + "\n", "")
        else:
            assert got[i].removed_words >= 30 and inside not in got[i].text
            assert got[i].text.startswith(source[i][:60]) and got[i].text.endswith(source[i][-60:])
    for i in [*range(60, 100), 201, 202, None, 203, 204, 205]:
        assert got[i].text == source[i] and got[i].removed_words == 0
    assert got[200].text == "" and got[200].removed_words == 150
    assert dedup(df.limit(0)).collect() == []


def test_chunks_do_not_depend_on_neighbours(rng):
    para = maker(rng)
    texts = [para(rng.randint(1, 60)) + "\n" * rng.randint(0, 2) + para(5) for _ in range(40)] + ["", "\n\n", "one"]
    def cut(some):
        data, doc, lo, hi, n, key = chunks(pa.array(some))
        return [(int(d), data[a:b].tobytes(), int(k)) for d, a, b, k in zip(doc, lo, hi, key)], n
    together, n = cut(texts)
    assert [(b, k) for i, t in enumerate(texts) for _, b, k in cut([t])[0]] == [(b, k) for _, b, k in together]
    assert sum(n) == sum(len(t.split()) for t in texts)
    assert MIN_WORDS <= 50


def test_repeats_within_one_document_stay(spark, rng):
    para = maker(rng)
    p = para(60)
    df = spark.createDataFrame([(1, p + "\n" + p), (1, p + "\n" + p), (2, para(50))], "doc_id long, text string")
    assert all(r.removed_words == 0 for r in dedup(df).collect())


def test_a_variant_in_white_space_holds_no_copy_back(spark, rng):
    para = maker(rng)
    p, lines = para(70), "\n".join(para(6) for _ in range(12))
    half = p.split(" ", 35)[:35]
    spaces = [p, *["  ".join([" ".join(half), p[len(" ".join(half)) + 1 :]])], p.replace(" ", "\t"), lines.replace("\n", "\r\n"), lines.replace("\n", "\n\n")]
    rows = [(i, para(30) + "\n" + (p, lines)[i % 2] + "\n" + para(30)) for i in range(40)]
    rows += [(100 + i, para(30) + "\n" + x + "\n" + para(30)) for i, x in enumerate(spaces)]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows[2:41]:
        assert got[i].text == t.replace((p, lines)[i % 2] + "\n", ""), i
    for i in (102, 103, 104):  # variants through and through
        assert got[i].text == dict(rows)[i]


def test_passages_of_51_to_80_words_go_whole(spark, rng):
    para = maker(rng)
    rows, want = [], {}
    for i in range(120):  # somewhere in paragraphs, among short lines, or both
        n = rng.randint(51, 80)
        passage = para(n)
        if i % 3:
            w = passage.split()
            passage = "".join(x + ("\n" if k % 8 == 7 and (i % 3 == 1 or k > 30) else " ") for k, x in enumerate(w)).rstrip()
        for j in (i, 1000 + i):
            before, after = (para(rng.randint(1, 60)).replace(" ", "\n" if i % 5 == 0 else " ") for _ in range(2))
            rows.append((j, f"{before} {passage} {after}"))
        want[1000 + i] = (f"{before}  {after}", n)
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    exact = 0
    for i, (text, n) in want.items():
        assert n - 1 <= got[i].removed_words <= n + 2, (i, n, got[i].removed_words)  # a word beyond a line break stays; one beside may be the same by chance
        assert got[i].removed_chunks > 0 and got[i - 1000].removed_words == 0
        exact += got[i].text == text
    assert exact >= 100


def test_against_brute_force(spark):
    """Every word is unique but for copies, so a removed word tells its place; matches are found by comparing all documents."""
    rng = random.Random(17)
    fresh = iter(f"w{k:x}" for k in rng.sample(range(1 << 24), 60_000))
    gap = lambda k: "\n" if k % 11 == 10 else " "

    def text_of(words):
        return "".join(w + gap(rng.randint(0, 40)) for w in words).rstrip()

    pool = [text_of([next(fresh) for _ in range(rng.randint(8, 90))]) for _ in range(40)]
    rows = []
    for i in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.5 else text_of([next(fresh) for _ in range(rng.randint(1, 60))]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(parts) if rng.random() < 0.5 else " ".join(parts)))
    rows += [(300, None), (301, ""), (None, rows[5][1]), (7, rows[7][1])]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    source = dict(rows[:150])
    first = {}  # the smallest id that holds each whole pool passage
    for p in pool:
        first[p] = min((i for i, t in source.items() if p in t), default=None)
    for i, text in source.items():
        left, words = set(got[i].text.split()), text.split()
        gone = [w for w in dict.fromkeys(words) if w not in left]
        # nothing goes that doesn't stand, with at least MIN_WORDS words around it, byte for byte in an earlier document
        earlier = [t for j, t in source.items() if j < i]
        for w in gone[:: max(1, len(gone) // 12)]:
            at = text.index(w)
            assert any(_match(text, at, t) >= MIN_WORDS for t in earlier if w in t), (i, w)
        # whole passages of over 50 words that an earlier document holds go, but for a word beside a line break
        for p in pool:
            if len(p.split()) > 50 and p in text and first[p] < i:
                assert len(left & set(p.split())) <= 2, (i, p)
    assert got[300].text is None and got[301].text == "" and got[None].text == rows[5][1]


def _match(text, at, other):
    """Words of the longest stretch around ``at`` that the other text holds as well."""
    best = 0
    place = other.find(text[at : at + len(text[at:].split(None, 1)[0])])
    while place >= 0:
        a = 0
        while at - a > 0 and place - a > 0 and text[at - a - 1] == other[place - a - 1]:
            a += 1
        b = 0
        while at + b < len(text) and place + b < len(other) and text[at + b] == other[place + b]:
            b += 1
        best = max(best, len(text[at - a : at + b].split()))
        place = other.find(text[at : at + 6], place + 1)
    return best


def test_columns_of_any_name_are_kept(spark, rng):
    para = maker(rng)
    p = para(60)
    names = ["row", "id", "th", "key", "may", "shared", "around", "runs", "bad", "_id", "_th", "_may", "_shared", "_keep", "_key", "removed_words", "Removed_Chunks", "doc", "h"]
    rows = [(i, para(20) + "\n" + p, *(f"{n}{i}" for n in names)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    got = dedup(df).orderBy("doc_id").collect()
    assert [r.removed_words for r in got] == [0, 60, 60, 60]
    for r, want in zip(got, rows):
        for n, v in zip(names, want[2:]):
            assert n.lower().startswith("removed") or r[n] == v


def test_unlike_chunks_of_one_hash_are_held_back(spark, rng, monkeypatch):
    from plyset.llm import line_dedup

    para = maker(rng)
    p, q = para(60), para(60)
    rows = [(i, para(20) + "\n" + (p, q)[i % 2]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.removed_words for r in dedup(df).collect()) == 6 * 60
    real = line_dedup.told_apart

    def lying(data, h, lo, hi):  # as if every chunk's bytes had been met in two forms
        h, lo, hi = real(data, h, lo, hi)
        import numpy as np

        return np.r_[h, h], np.r_[lo, lo], np.r_[hi, hi - 1]

    monkeypatch.setattr(line_dedup, "told_apart", lying)
    assert all(r.removed_words == 0 and r.text == rows[r.doc_id][1] for r in dedup(df).collect())


@pytest.mark.parametrize("lines,words", [(5, 4), (6, 4), (7, 3), (5, 8), (20, 1), (3, 9), (2, 12)])
def test_blocks_of_lines_are_always_found(spark, rng, lines, words):
    """Blocks of 2 * LINES + 1 short lines at least, among others: every later copy goes."""
    para = maker(rng)
    block = "\n".join(para(words) for _ in range(lines))
    around = lambda: "\n".join(para(rng.randint(1, 8)) for _ in range(rng.randint(1, 9)))
    rows = [(i, f"{around()}\n{block}\n{around()}") for i in range(40)]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].removed_words == 0
    for i, text in rows[1:]:
        assert got[i].text == text.replace(block + "\n", ""), i


@pytest.mark.parametrize("words", [33, 36, 45])
def test_passages_within_a_paragraph_are_always_found(spark, rng, words):
    para = maker(rng)
    passage = para(words)
    rows = [(i, f"{para(rng.randint(1, 60))} {passage} {para(rng.randint(1, 60))}") for i in range(60)]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(passage not in got[i].text and words - 1 <= got[i].removed_words <= words + 2 for i in range(1, 60))


def test_lines_are_hashed_whole(rng):
    """A boundary in a block of short lines begins a line, and a changed word moves only the boundaries beside its line."""
    para = maker(rng)
    lines = [para(rng.randint(2, 8)) for _ in range(60)]
    cut = lambda own: {bytes(d[a:b]) for d, a, b in [(x[0], lo, hi) for x in [chunks(pa.array(["\n".join(own)]))] for lo, hi in zip(x[2], x[3])]}
    whole = cut(lines)
    assert all(set(c.decode().split("\n")) <= set(lines) for c in whole)
    other = cut([*lines[:30], "changed " + lines[30], *lines[31:]])
    assert len(whole - other) <= 3 and len(other - whole) <= 3


def test_hot_hashes_are_dealt_out(spark, rng, monkeypatch):
    """Results are the same where every shared hash is hot."""
    from plyset.llm import line_dedup

    para = maker(rng)
    p = para(70)
    df = spark.createDataFrame([(i, f"{para(30)}\n{p}\n{para(20)} {p if i % 2 else para(9)}") for i in range(30)], "doc_id long, text string").repartition(6)
    want = sorted(map(tuple, dedup(df).collect()))
    for name, value in (("HOT", 1), ("SALTS", 3)):
        monkeypatch.setattr(line_dedup, name, value)
    assert sorted(map(tuple, dedup(df).collect())) == want


def test_told_apart_compares_bytes():
    import numpy as np

    from plyset.llm.line_dedup import told_apart

    data = np.frombuffer(b"abcdabceabcdxx", np.uint8)
    h = np.array([5, 5, 5, 9, 5])
    lo, hi = np.array([0, 4, 8, 0, 12]), np.array([4, 8, 12, 2, 14])
    got = told_apart(data, h, lo, hi)
    assert [(int(x), bytes(data[a:b])) for x, a, b in zip(*got)] == [(5, b"abcd"), (5, b"abce"), (5, b"xx"), (9, b"ab")]
