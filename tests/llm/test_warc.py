import hashlib
import random
import struct

import pytest

from plyset.llm import warc


def rows(n=80):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    page = lambda: "<html><head><title>t</title></head><body>" + " ".join(rng.choice(words) for _ in range(900)) + "</body></html>"
    out = [(i, f"http://a.example/{i} x\n", page()) for i in range(n)]
    out += [(100, "http://b.example/", out[3][2]), (1, None, out[3][2]), (101, "u", "short"), (102, "u", "short"), (103, "u", None), (104, "u", "é" * 60), (105, "u", "é" * 60)]
    out += [(106, "u", "z" * 99), (107, "u", "z" * 99), (108, "u", "big " * 300_000), (None, "u", out[5][2]), (None, "u", "only without an id " * 20)]
    return out


def expected(pages):
    first = {}
    for i, _, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def test_round_trip(spark, tmp_path):
    pages = rows()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    index = warc.write(df, f"file://{tmp_path}/out")
    got = warc.read(index, f"file://{tmp_path}/out").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=KEY) == sorted(expected(pages), key=KEY)
    html = {(i, (h or "").encode()) for i, _, h in pages}
    for r in got:
        assert (r.record_type == "revisit") == (r.payload is None)
        assert r.payload is None or (r.page_id, bytes(r.payload)) in html
    # any record can be read alone, at its place
    import zstandard

    one = index.filter("page_id = 7").first()
    raw = (tmp_path / "out" / one.file).read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.SKIPPABLE
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    record = press.decompressobj().decompress(raw[one.offset : one.offset + one.length])
    assert record.startswith(b"WARC/1.1\r\n") and warc.parse_record(record)[0] == 7
    # the dictionary pays
    bare = sum(len(zstandard.compress(warc.build_record(i, u, (h or "").encode(), len((h or "").encode()), "", None))) for i, u, h in pages)
    assert index.agg({"length": "sum"}).first()[0] < bare


def test_few_records_and_none(spark):
    df = spark.createDataFrame([(2, "u", "a" * 200, 1), (1, "u", "a" * 200, 1)], "page_id long, url string, html string, digest int")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(1, "response", None), (2, "revisit", 1)]
    assert warc.round_trip(df.limit(0)).collect() == []


def test_damage_is_noticed():
    record = warc.build_record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(record)[6] == b"payload"
    for bad in (record.replace(b"payload\r\n", b"paYload\r\n"), record[:-1], b"x" + record):
        with pytest.raises((ValueError, KeyError)):
            warc.parse_record(bad)


def test_short_records_have_a_dictionary_too(spark):
    schema = "page_id long, url string, html string"
    many = spark.createDataFrame([(i, f"http://a.example/{i}", f"<p>page {i * 7919}</p>") for i in range(2000)], schema)
    assert len(warc.train(many)) > 40_000
    few = spark.createDataFrame([(i, f"http://a.example/{i}", f"<p>page {i * 7919}</p>") for i in range(20)], schema)
    assert 256 <= len(warc.train(few)) <= 4096
    assert warc.train(spark.createDataFrame([(None, "u", "same")] * 20, schema))
    assert warc.round_trip(few).count() == 20


def test_pages_that_the_filter_holds_by_chance_come_back(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    html = ["<p>" + "".join(rng.choice("abcdef ") for _ in range(rng.choice([20, 150, 400]))) + "</p>" for _ in range(60)]
    rows = [(i, f"u{i}", html[rng.randrange(60)] if i % 3 else html[1] + "x" * 200) for i in range(300)] + [(None, "n", html[4]), (7, "u", html[9]), (None, "m", html[1] + "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    plain = sorted(map(repr, warc.round_trip(df, f"file://{tmp_path}/a", payloads=True).collect()))
    whole = warc.key_filter
    monkeypatch.setattr(warc, "key_filter", lambda keys: whole(keys, max_filter=2))  # holds nearly everything
    assert sorted(map(repr, warc.round_trip(df, f"file://{tmp_path}/b", payloads=True).collect())) == plain
    assert len(plain) == len(rows)


def test_a_few_records_have_a_plain_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>page {i} of a small site</p>") for i in range(5)], "page_id long, url string, html string")
    assert 500 < len(warc.train(df)) <= warc.DICTIONARY
    folder = f"file://{tmp_path}/few"
    assert {r.page_id for r in warc.read(warc.write(df, folder), folder).collect()} == set(range(5))
    assert warc.train(df.limit(0)) == b""
