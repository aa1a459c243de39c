import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_decontaminate import smith_waterman
from test_near_dedup import brute


def test_registry():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    base = tmp_path_factory.mktemp("sf")
    item, passage = words(rng, 30), words(rng, 60)
    docs = [(i, words(rng, rng.randint(30, 90)), "en", "s", 0) for i in range(40)]
    near = words(rng, 100).split()
    for k in range(3):
        w = list(near)
        w[10 * k + 5] = "changed"
        docs.append((100 + k, " ".join(w), "en", "s", 0))
    short = words(rng, 15)  # too short for line dedup to cut
    docs += [(510, short, "en", "s", 0), (511, short + " end", "en", "s", 0)]
    docs += [(200, docs[5][1], "en", "s", 0)]
    docs += [(210 + k, words(rng, 40) + "\n" + passage + "\n" + words(rng, 30), "en", "s", 0) for k in range(3)]
    docs += [(300, words(rng, 20) + " " + item + " " + words(rng, 20), "en", "s", 0), (400, "123 !!!", "en", "s", 0), (401, None, "en", "s", 0)]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), docs, passage


def test_stages_take_effect(spark, folder):
    base, docs, passage = folder
    now = spark.read.parquet(f"{base}/documents.parquet")
    columns = now.columns
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, base)
        assert now.columns == columns and now.schema == spark.read.parquet(f"{base}/documents.parquet").schema
        rows = now.collect()
        after.append({r.doc_id: r for r in rows})
        now = spark.createDataFrame(rows, now.schema)
    every = {d[0] for d in docs}
    assert set(after[0]) == every - {400, 401}
    assert set(after[1]) == every - {400, 401, 200}
    assert passage in after[1][210].text and passage not in after[1][211].text and after[1][211].n_chars == len(after[1][211].text)
    groups = brute([(i, r.text) for i, r in after[1].items()], corpus_pipeline.WORDS)
    assert set(after[2]) == {i for i, (_, component) in groups.items() if component == i}
    assert 511 not in after[2] and 510 in after[2]
    assert set(after[3]) == set(after[2]) - {300}


def test_stages_against_brute_force(spark, folder):
    """What each stage keeps of the same documents, by plain readings: leaks by full alignment, line dedup by shared words, pieces by the tokenizer."""
    from tokenizers import Tokenizer

    from plyset.llm.queries import tokenizer_file

    base, docs, _ = folder
    source, stages = spark.read.parquet(f"{base}/documents.parquet"), dict(corpus_pipeline.STAGES)
    texts = {d[0]: d[1] for d in docs}
    item = spark.read.parquet(f"{base}/benchmark.parquet").first().text.lower().split()
    kept = {r.doc_id for r in stages["benchmark decontamination"](spark, source, base).collect()}
    assert kept == {i for i, t in texts.items() if smith_waterman(item, (t or "").lower().split()) < len(item)}

    letters = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in stages["language ID"](spark, source, base).collect()} == letters

    cleaned = {r.doc_id: r.text for r in stages["line dedup"](spark, source, base).collect()}
    for i, t in texts.items():
        own, left = (t or "").split(), (cleaned.get(i) or "").split()
        runs = {k for k in range(len(own) - 32) for j, o in texts.items() if j < i and o and " ".join(own[k : k + 33]) in " ".join(o.split())}
        if t and not runs:
            assert len(left) >= len(own) - 32, i  # nothing of 33 words in a row stands in an earlier document
        for k in runs:
            assert " ".join(own[k : k + 33]) not in " ".join(left), i

    slow = Tokenizer.from_file(tokenizer_file())
    pieces = stages["best-fit packing"](spark, source, base).collect()
    for i, t in texts.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(slow.encode(t or "", add_special_tokens=False).ids) + 1
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for s in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_run(spark, folder):
    base, _, _ = folder
    out = corpus_pipeline.run(spark, base).collect()
    assert {r.doc_id for r in out} >= set(range(40)) and 300 not in {r.doc_id for r in out}


def test_empty(spark, folder, tmp_path):
    base, _, _ = folder
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{base}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_of_any_name_pass_every_stage(spark, folder):
    base, docs, _ = folder
    names = ["score", "lang_pred", "_lower", "_kept", "_th", "th", "row", "key", "may", "id", "removed_words", "removed_chunks", "_shared", "_keep", "shared", "runs", "ends", "bad", "letters", "lower", "component_id", "kept", "item_id", "length", "task", "nth", "task_id"]
    wide = spark.createDataFrame([(*d, *(f"{n}{d[0]}" for n in names)) for d in docs], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` string" for n in names)]))
    plain, now = spark.read.parquet(f"{base}/documents.parquet"), wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, rows = stage(spark, now, base).collect(), stage(spark, plain, base).collect()
        assert {r.doc_id for r in got} == {r.doc_id for r in rows}, name
        for r in got:
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
        now, plain = spark.createDataFrame(got, wide.schema), spark.createDataFrame(rows, plain.schema)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, base).collect()} == {r.doc_id for r in plain.collect()}


def test_repeated_rows_and_null_ids(spark, folder):
    base, docs, _ = folder
    rows = [(None, docs[0][1], "en", "s", 0), (None, docs[0][1], None, None, None), docs[3], docs[3], (None, None, None, None, None)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, base).collect(), now.schema)
        assert sorted((r.doc_id is None, r.text) for r in now.collect()) == sorted([(True, docs[0][1])] * 2 + [(False, docs[3][1])] * 2), name
