"""WARC archives, each record a Zstandard frame of its own under a dictionary that the file carries.

A file begins with a skippable frame that holds the dictionary, as the public ``.warc.zst``
convention has it; each record follows as one frame, so that any record can be read alone. The
dictionary is trained once per write on a bounded sample of the records (``SAMPLE`` of them
or as many as make ``ENOUGH`` bytes, at most ``SAMPLE_BYTES`` of each; a fixed rule over hashes of ids chooses them) and sent to the
writers; its size is ``DICTIONARY`` bytes at most, and less for small input. Where the library has too little to train on
(fewer than 16 records, or records that share nothing), the dictionary is plain content: the sample's own bytes.

Payloads of at least ``REVISIT_FROM`` bytes that occur again are written once: the record with the
smallest page id is the response, the others are revisits that keep its HTTP header. What is decided
is decided on ids, digests and sizes, in a table of their own; revisits are written from it. Payloads
aren't shuffled: a Bloom filter of the revisits' keys leaves their pages out where they are read, and a
second one of the few pages that the first holds by chance brings those back, through a join of few rows.

Tasks write through ``pyarrow.fs`` to the folder given as a URI. A file's name holds the task
attempt, and only files whose task ended well are listed in the index, so a lost executor or a
second attempt leaves nothing that a reader would take for a record.

Defined results: null html is an empty payload; a null page id comes after all others, and is a
response where no other record of the payload has an id; records equal in id and payload are
responses alike; null urls leave the target header out; an empty table writes no file.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.bloom import key_filter
from plyset.llm.common import drop_staged, new_folder, staged

SAMPLE, SAMPLE_BYTES, DICTIONARY = 256, 16_384, 65_536
ENOUGH = 100 * DICTIONARY
REVISIT_FROM = 100
FILE_BYTES = 1 << 30
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, page_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def build_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response, or a revisit where there is no payload."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """A row of RECORDS; a response's digest is taken from its payload and must agree with its header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload differs from its digest")

    def page(name: str):
        v = fields[name][len("<urn:page:") : -1] if name in fields else "None"
        return None if v == "None" else int(v)

    return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], page("WARC-Refers-To"), None if revisit else payload


DECIDED = ("page_id", "url", "html", "digest", "size", "refers_to")


def decide(pages: DataFrame) -> DataFrame:
    """DECIDED: a row for each page; html is null for those that revisit ``refers_to``."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    meta = staged(p.drop("html"), "meta")
    again = meta.filter(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    again = staged(again.filter("n > 1 and refers_to is not null").drop("n"), "again")
    revisits = meta.join(again.hint("shuffle_hash"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = staged(revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size", "refers_to"), "revisits")
    key = F.xxhash64("page_id", "digest")
    may = key_filter(revisits.select(key.alias("key")).distinct())
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
    only = lambda df: df.select("page_id", "digest").distinct().hint("shuffle_hash").alias("b")
    chance = staged(meta.filter(may.column(key)).alias("a").join(only(revisits), same, "left_anti").select("page_id", "digest"), "chance")
    responses = p.withColumn("refers_to", F.lit(None).cast("long")).select(*DECIDED)
    found = responses.filter(~may.column(key))
    if not chance.isEmpty():
        back = key_filter(chance.select(key.alias("key")).distinct())
        found = found.unionByName(responses.filter(may.column(key) & back.column(key)).alias("a").join(only(chance), same, "left_semi"))
    drop_staged(meta, again)
    return found.unionByName(revisits)


def train(pages: DataFrame) -> bytes:
    """The dictionary: trained, of a quarter of the sample at most, or else plain content; nothing for no records."""
    import zstandard

    chosen = F.xxhash64(F.col("page_id").cast("long"))
    n = SAMPLE
    while True:
        smallest = pages.select(chosen.alias("h")).distinct().orderBy("h").limit(n).collect()  # numbers alone are sorted
        if not smallest:
            return b""
        sample = pages.filter(chosen <= smallest[-1].h).select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"))
        rows = sample.orderBy(chosen).limit(2 * n).collect()
        records = []
        for r in rows:
            payload = r.html.encode()[:SAMPLE_BYTES]
            records.append(build_record(r.page_id, r.url, payload, len(payload), hashlib.sha256(payload).hexdigest(), None))
        size = sum(map(len, records))
        if size >= ENOUGH or len(smallest) < n and len(rows) < 2 * n:  # or all pages are in
            break
        n = max(2 * n, n * ENOUGH // size)
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, size // 4), records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # the library finds no segments to share
            pass
    return b"".join(records)[:DICTIONARY]


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:(?!//)", "file://", uri))


def write(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write one record per page below ``folder`` (a URI); return the index: file, offset, length, page_id."""
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train(pages))

    def archive(stream):
        import zstandard

        made = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
        lead = struct.pack("<II", SKIPPABLE, len(dictionary.value)) + dictionary.value if made else b""
        system, base = open_folder(folder)
        task = TaskContext.get()
        out, name, at, part = None, "", 0, 0
        try:
            for batch in stream:
                rows = []
                for page, url, html, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:03d}.warc.zst"
                        if part == 0:
                            system.create_dir(base, recursive=True)
                        out, part = system.open_output_stream(f"{base}/{name}", compression=None), part + 1
                        at = out.write(lead) if lead else 0
                    frame = press.compress(build_record(page, url, None if html is None else html.encode(), size, digest, refers))
                    out.write(frame)
                    rows.append((name, at, len(frame), page))
                    at += len(frame)
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "offset", "length", "page_id"])
        finally:
            if out is not None:
                out.close()

    return staged(decide(pages).mapInArrow(archive, INDEX), "warc-index")


def read_file(system, path: str, chunk: int = 1 << 20):
    """The records of one archive, in order; memory for one record at a time."""
    import zstandard

    with system.open_input_stream(path, compression=None) as f:
        data = f.read(8)
        made = None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
            made = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", data[4:])[0]))
            data = b""
        press = zstandard.ZstdDecompressor(dict_data=made)
        while True:
            data = data or f.read(chunk)
            if not data:
                return
            frame, parts = press.decompressobj(), []
            while not frame.eof:
                if not data and not (data := f.read(chunk)):
                    raise ValueError(f"{path} ends inside a record")
                parts.append(frame.decompress(data))
                data = b""
            data = frame.unused_data
            yield b"".join(parts)


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that the index lists, read from the archives themselves."""
    n = max(1, index.rdd.getNumPartitions())
    files = index.select("file").distinct().repartition(n, "file")

    def load(stream):
        system, base = open_folder(folder)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in stream:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for record in read_file(system, f"{base}/{name}"):
                    row = parse_record(record)
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(record)
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return files.mapInArrow(load, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write the archives, then read them back."""
    folder = folder or new_folder(pages.sparkSession, f"warc-{uuid.uuid4().hex[:6]}")
    return read(write(pages, folder), folder, payloads)
