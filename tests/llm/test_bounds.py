"""What happens past the bounds of what is broadcast, and columns that clash."""

import random

import numpy as np
import pytest

from plyset.llm import bloom, embedding_dedup, line_dedup, near_dedup, warc
from plyset.llm.bloom import KeyFilter, Same, key_filter


def words(rng, n):
    return " ".join(rng.choice(["th", "er", "on", "an"]) + str(rng.randrange(500)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    passage, base = words(rng, 60), words(rng, 80)
    rows = [(i, words(rng, 40)) for i in range(30)] + [(100 + i, words(rng, 30) + "\n" + passage + "\n" + words(rng, 30)) for i in range(5)] + [(200 + i, base + f" end{i}") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_a_filter_knows_when_it_is_none(spark):
    keys = spark.range(1000).selectExpr("id as key")
    assert isinstance(key_filter(keys), KeyFilter) and isinstance(key_filter(keys, 500), KeyFilter)
    plain = key_filter(keys, 499)
    assert isinstance(plain, Same) and plain.test(np.arange(5)).all() and not key_filter(keys, 0, beyond=False).test(np.arange(5)).any()
    assert isinstance(key_filter(keys.limit(0), 0), KeyFilter)


@pytest.mark.parametrize("apply", [lambda d: near_dedup.near_duplicates(d, n=2), line_dedup.dedup, lambda d: warc.round_trip(d.selectExpr("doc_id as page_id", "'u' as url", "text as html"))], ids=["near dedup", "line dedup", "warc"])
def test_without_filters_results_are_the_same(spark, docs, apply, monkeypatch):
    want = sorted(map(repr, apply(docs).collect()))
    monkeypatch.setattr(bloom, "MAX_FILTER", 0)
    assert sorted(map(repr, apply(docs).collect())) == want


def test_hubs_are_dealt_out(spark, monkeypatch):
    """Many near copies of one text: the same classes where every centre is a hub, and each salt has pairs."""
    rng = random.Random(9)
    base = words(rng, 100).split()
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(60) for k in [rng.randrange(100)]] + [(100 + i, words(rng, 50)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, near_dedup.near_duplicates(df, n=2).collect()))
    assert sum(r[2] == 0 for r in want) == 60
    monkeypatch.setattr(near_dedup, "SPREAD", 2)
    monkeypatch.setattr(near_dedup, "HUB_SALTS", 3)
    assert sorted(map(tuple, near_dedup.near_duplicates(df, n=2).collect())) == want


def test_clashing_columns_of_pages(spark):
    names = ["payload_bytes", "payload_digest", "record_type", "refers_to", "digest", "key", "may", "row", "first"]
    pages = spark.createDataFrame([(k, "u", "x" * 150, *names) for k in (3, 1, 2)], ", ".join(["page_id long, url string, html string", *(f"`{n}` string" for n in names)]))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(1, 150, "response", None), (2, 150, "revisit", 1), (3, 150, "revisit", 1)]


def test_clashing_columns_of_vectors(spark):
    names = ["n_links", "component_id", "kept", "k1", "x", "y", "block", "tile", "key", "norm"]
    rows = [(k, [1.0, 0.01 * k], 1, *names) for k in (5, 4)] + [(9, [0.0, 1.0], 1, *names)]
    df = spark.createDataFrame(rows, ", ".join(["vec_id long, embedding array<float>, label int", *(f"`{n}` string" for n in names)]))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(4, 1, 4, True), (5, 1, 4, False), (9, 0, 9, True)]
