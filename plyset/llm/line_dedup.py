"""Line dedup by content-defined chunks of lines.

Lines of at most ``LONG`` words are hashed whole; of a block of such lines, chunks begin where the
rolling hash over two line hashes is the least of some ``LINES`` in a row, and at the block's ends. A
longer line is a paragraph of its own, in which passages begin and end anywhere: there each word is
taken for a line, with ``WINDOW`` rolling hashes in a row. Insertions therefore shift no boundary but
those beside them, and of a passage that two documents share, 2 * LINES + 1 lines of a block, or
2 * WINDOW + 1 words within a paragraph, are enough for a chunk that both have. A chunk's hash covers
``COVER`` words of its block or paragraph at least, so that a short chunk is no chance hit.

1. A pass over whole texts gives each document's chunks: hashes and byte ranges. Grouped by hash, their
   smallest and largest document ids tell which chunks several documents hold; ids are aggregated before
   they are shuffled, so a chunk that a third of all documents hold is no hot key. A Bloom filter of the
   shared hashes (of at most ``bloom.MAX_FILTER`` bytes) keeps most others out of the next join.
2. Consecutive chunks that the same earlier document had first are a run; its first and last chunk
   ask that document for the ``AROUND`` words before and after them.
3. Only documents with such runs, or asked by one, meet their lists in a join: a Bloom filter of their
   keys lets the others pass where they are.
4. Byte comparison: a chunk's hash takes in the white space between its words, so a variant with
   other spacing is another chunk. The joined documents' shared chunks are grouped by hash and bytes,
   and a run with a hash that stands for two different chunks removes nothing.
5. Each run is extended word by word on both sides as far as its bytes equal the first document's.
   No match goes on beyond ``AROUND`` words without another shared chunk. Runs of at least
   ``min_words`` words then are dropped; the document with the smallest id keeps its text.

Texts are hashed once; the later passes slice them at the byte ranges of the first.

Defined results: null texts stay null, empty ones empty. A document with a null id is neither
changed nor counted. Rows of one id are one document: what only they share stays. A document may end up
empty; ``removed_words`` tells, and ``removed_chunks`` how many shared chunks went. Extra columns are
kept as they are, under any name: they travel as one struct, which ``cleaned`` returns as ``row``.
``dedup`` spreads it out again; there, columns that are called like its own two are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.bloom import KeyFilter, key_filter
from plyset.llm.common import as_row, drop_staged, staged
from plyset.llm.text import _BYTE, SEGMENT, SPACE, batches, mix, owners, range_hash, string_bytes, words

LONG, LINES, WINDOW, COVER, AROUND, MIN_WORDS = 8, 2, 16, 12, 40, 20
#: A hash that so many batches of documents hold is dealt to ``SALTS`` tasks instead of one.
HOT, SALTS = 64, 64
BLANK = bytes([9, 10, 11, 12, 13, 32])


def ranges(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``range_hash`` of ascending ranges, in segments, so that many need little memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = range_hash(codes[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The words' hashes, each with the white space before it where that isn't one blank."""
    out = hashes.copy()
    plain = (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 32)
    at = np.flatnonzero(~plain) + 1
    size = starts[at] - ends[at - 1]
    last = np.cumsum(size)
    gaps = _BYTE[data[np.repeat(ends[at - 1] - last + size, size) + np.arange(size.sum())]]
    out[at] = mix(out[at] ^ ranges(gaps, last - size, last))
    return out


def least(hashes: np.ndarray, part: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Lines whose rolling hash with the next is the least (the last such) of some ``window`` (a power of two) in a row within a part that begins at first."""
    n = len(hashes) - window
    if n <= 0:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFF)
    place = (np.arange(len(hashes)) - first).astype(np.uint64) & low
    value = (mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:]) & ~low) | (low - place[:-1])
    size = 1
    while size < window:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    whole = np.flatnonzero(part[:n] == part[window:])
    back = (low - (value[whole] & low) - place[whole]) & low
    chosen = np.zeros(len(hashes), bool)
    chosen[whole + back.astype(np.int64)] = True
    return np.flatnonzero(chosen)


def chunks(column, long: int = LONG):
    """Of all chunks in a column of texts: text, first and last byte, words, hash; and the bytes."""
    data, offsets = string_bytes(column)
    starts, ends, hashes = words(data, offsets, fold=False)
    n = len(starts)
    if n == 0:
        none = np.empty(0, np.int64)
        return data, none, none, none, none, none.astype(np.uint64)
    at = np.unique(np.searchsorted(starts, np.r_[offsets[:-1], np.flatnonzero(data == 10)]))  # where a line begins
    at = at[at < n]
    size = np.diff(np.r_[at, n])
    doc = owners(starts[at], offsets)
    is_long = size > long
    hard = np.r_[doc[1:] != doc[:-1], True] | is_long | np.r_[is_long[1:], False]  # a block has lines of one kind
    part = np.cumsum(hard) - hard
    part_ends = (at + size)[hard]
    part_starts = np.r_[0, part_ends[:-1]]
    cut = np.zeros(n, bool)
    cut[part_starts] = True
    short = np.flatnonzero(~is_long)
    if len(short):
        own = part[short]
        cut[at[short[least(ranges(hashes, at[short], (at + size)[short]), own, np.searchsorted(own, own), LINES)]]] = True
    if len(short) < len(at):
        size = size[is_long]
        words_of = np.arange(n) if not len(short) else np.flatnonzero(np.repeat(is_long, np.diff(np.r_[at, n])))
        begin = np.repeat(np.cumsum(size) - size, size)
        cut[words_of[least(hashes[words_of], begin, begin, WINDOW)]] = True
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], n]
    own = np.searchsorted(part_ends, first, "right")
    to = np.minimum(part_ends[own], np.maximum(last, first + COVER))
    since = np.where(to - first < COVER, np.maximum(part_starts[own], to - COVER), first)
    # boundaries depend on words alone, hashes on the white space between a chunk's words as well
    key = ranges(spaced(data, starts, ends, hashes), since + 1, to)
    key = mix(hashes[since] * np.uint64(0x9FB21C651E98DF25) + key)
    key = mix(key + ((first - since) << 32 | (last - first)).astype(np.uint64))
    return data, owners(starts[first], offsets), starts[first], ends[last - 1], last - first, key


MARKED = "doc_id long, th long, h binary, at binary"


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, th and the chunks of each text, in order: 64-bit hashes, and pairs of 32-bit numbers (first byte, end)."""

    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            _, doc, lo, hi, _, key = chunks(part.column("text"))
            _, offsets = string_bytes(part.column("text"))
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            at = np.stack([lo - offsets[doc], hi - offsets[doc]], axis=1).astype("<i4")
            packed = [pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends * 8), pa.py_buffer(np.ascontiguousarray(x))]) for x in (key.astype("<u8"), at)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), part.column("th").combine_chunks(), *packed], names=["doc_id", "th", "h", "at"])

    return docs.mapInArrow(run, MARKED)


def unpacked(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and (first byte, end) of all chunks in a batch of marks."""
    row = np.repeat(np.arange(batch.num_rows), np.array([len(x) // 8 for x in (y.as_buffer() for y in batch.column("h"))], np.int64)) if batch.num_rows else np.empty(0, np.int64)
    join = lambda c: b"".join(batch.column(c).to_pylist())
    return row, np.frombuffer(join("h"), "<i8"), np.frombuffer(join("at"), "<i4").reshape(-1, 2)


def holders(marked: DataFrame) -> DataFrame:
    """h and the smallest and largest id of the documents that hold it, a row for each batch that does."""

    def run(stream):
        for batch in stream:
            row, h, _ = unpacked(batch)
            if not len(h):
                continue
            doc = batch.column("doc_id").to_numpy()[row]
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(np.minimum.reduceat(doc, at)), pa.array(np.maximum.reduceat(doc, at))], names=["h", "first", "last"])

    return marked.select("doc_id", "h").withColumn("at", F.lit(b"")).mapInArrow(run, "h long, first long, last long")


PLACES = ("doc_id", "th", "k", "h", "a", "b")


def copied(df: DataFrame, hot: KeyFilter) -> DataFrame:
    """Rows by hash, those of hot hashes once for each salt; the filter says on both sides of a join which are hot, so a false hit does no harm."""
    salts = F.when(hot.column(F.col("h")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("salt", F.explode(salts))


def salted(df: DataFrame, hot: KeyFilter) -> DataFrame:
    return df.withColumn("salt", F.when(hot.column(F.col("h")), F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")).otherwise(0))


def places(marked: DataFrame, among: KeyFilter, hot: KeyFilter) -> DataFrame:
    """A row for each chunk whose hash the filter holds: its document, number and bytes, and its salt."""

    def run(stream):
        for batch in stream:
            row, h, at = unpacked(batch)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            some = np.flatnonzero(among.test(h))
            own = row[some]
            doc, th = (batch.column(n).to_numpy()[own] for n in ("doc_id", "th"))
            salt = np.where(hot.test(h[some]), th % SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array((some - first[own]).astype(np.int32)), pa.array(h[some]), *(pa.array(at[some, i]) for i in (0, 1)), pa.array(salt)], names=[*PLACES, "salt"])

    return marked.mapInArrow(run, "doc_id long, th long, k int, h long, a int, b int, salt int")


#: How lists are packed into one binary value each: a document's shared chunks, and its runs.
OWN = np.dtype([("h", "<i8"), ("a", "<i4"), ("b", "<i4"), ("later", "?")])
RUN = np.dtype([("a", "<i4"), ("b", "<i4"), ("first_h", "<i8"), ("last_h", "<i8")])
LISTS = "doc_id long, th long, shared binary, runs binary"


def packed(kind: np.dtype, ends: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """One binary value for each list; ``ends`` are the lists' borders."""
    rows = np.empty(len(columns[0]), kind)
    for name, values in zip(kind.names, columns):
        rows[name] = values
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def loaded(column, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The row of each packed item, and the items; null lists are empty."""
    lists = column.to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x or b"") // kind.itemsize for x in lists])
    return row, np.frombuffer(b"".join(x for x in lists if x), kind)


def by_document(found: DataFrame) -> DataFrame:
    """Per document its shared chunks, and its runs: consecutive ones that one earlier document had first, as bytes a to b
    with the hashes of the chunks at both ends. Rows arrive sorted; a document can go on from one batch to the next."""
    names = ("doc_id", "th", "k", "h", "a", "b", "first")

    def listed(c):
        doc, th, k = c[:3]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (k[1:] != k[:-1])]  # equal rows of a document give equal chunks
        doc, th, k, h, a, b, first = (x[new] for x in c)
        starts = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
        at, later = np.flatnonzero(starts), doc > first
        apart = starts[1:] | (first[1:] != first[:-1]) | (k[1:] != k[:-1] + 1)
        begins = np.flatnonzero(later & np.r_[True, apart | ~later[:-1]])
        stops = np.flatnonzero(later & np.r_[apart | ~later[1:], True])
        shared = packed(OWN, np.r_[at, len(doc)], h, a, b, later)
        runs = packed(RUN, np.r_[np.searchsorted(begins, at), len(begins)], a[begins], b[stops], h[begins], h[stops])
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(th[at]), shared, runs], names=["doc_id", "th", "shared", "runs"])

    def run(stream):
        held = None
        for batch in stream:
            own = [batch.column(n).to_numpy() for n in names]
            held = own if held is None else [np.r_[x, y] for x, y in zip(held, own)]
            doc, th = held[:2]
            if not len(doc):
                continue
            whole = int(np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])[-1])  # where the last document begins
            if whole:
                yield listed([x[:whole] for x in held])
                held = [x[whole:].copy() for x in held]
        if held is not None and len(held[0]):
            yield listed(held)

    dealt = found.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "k").select(*names)
    return dealt.mapInArrow(run, LISTS)


def ends_of(lists: DataFrame) -> DataFrame:
    """Two rows for each run: its document, bytes a to b, the side and the chunk there."""

    def run(stream):
        for batch in stream:
            row, runs = loaded(batch.column("runs"), RUN)
            for side, h in enumerate(("first_h", "last_h")):
                ids = [pa.array(batch.column(n).to_numpy()[row]) for n in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(runs[n]) for n in ("a", "b")), pa.array(np.full(len(row), side, np.int32)), pa.array(runs[h])], names=["doc_id", "th", "a", "b", "side", "h"])

    return lists.filter("octet_length(runs) > 0").select("doc_id", "th", "runs").mapInArrow(run, "doc_id long, th long, a int, b int, side int, h long")


def rows_of(lists: DataFrame, among: KeyFilter, later: bool) -> DataFrame:
    """A row for each shared chunk whose hash the filter holds; of later copies too only if asked for."""

    def run(stream):
        for batch in stream:
            row, own = loaded(batch.column("shared"), OWN)
            some = np.flatnonzero(~own["later"] | later)
            some = some[among.test(own["h"][some])]
            ids = [pa.array(batch.column(n).to_numpy()[row[some]]) for n in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(own[n][some]) for n in ("h", "a", "b"))], names=["doc_id", "th", "h", "a", "b"])

    return lists.select("doc_id", "th", "shared").mapInArrow(run, "doc_id long, th long, h long, a int, b int")


def shared_chunks(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, KeyFilter]:
    """``by_document``; per run's end its document, bytes a to b, side (0: before, 1: after) and the chunk that asks what lies
    beside it; per document that had chunks first those that are asked so; and a filter of the hashes that many batches hold."""
    ends = holders(marked).groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))
    again = staged(ends.filter("first <> last").select("h", "first", "n"), "again")
    among = key_filter(again.select(F.col("h").alias("key")))
    hot = key_filter(again.filter(F.col("n") >= HOT).select(F.col("h").alias("key")), beyond=False)
    found = places(marked, among, hot).join(copied(again.select("h", "first"), hot).hint("shuffle_hash"), ["h", "salt"]).select(*PLACES, "first")
    lists = staged(by_document(found), "lists")
    asked = staged(ends_of(lists), "asked")
    which = staged(asked.select("h", "side").distinct(), "which")
    among = key_filter(which.select(F.col("h").alias("key")))
    wanted = rows_of(lists, among, False).join(which.hint("shuffle_hash"), "h")
    wanted = staged(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "a", "b", "side")).alias("around")), "wanted")
    drop_staged(again, which)
    return lists, asked, wanted, hot


def gathered(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges in a row, and where each ends."""
    size = hi - lo
    last = np.cumsum(size)
    at = np.repeat(lo - last + size, size)
    at += np.arange(len(at))
    return data[at], last


def told_apart(data: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Of chunks with equal hash and equal bytes one each: hashes, first bytes, ends. Compares bytes, not hashes alone."""
    order = np.argsort(h, kind="stable")
    h, lo, hi = h[order], lo[order], hi[order]
    new = np.r_[True, h[1:] != h[:-1]]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    alike = hi - lo == hi[lead] - lo[lead]
    at = np.flatnonzero(alike & ~new)
    own, last = gathered(data, lo[at], hi[at])
    other, _ = gathered(data, lo[lead[at]], hi[lead[at]])
    wrong = np.r_[0, np.cumsum(own != other)]
    alike[at] = wrong[last] == wrong[np.r_[0, last[:-1]]] if len(at) else True
    keep = new | ~alike
    return h[keep], lo[keep], hi[keep]


def bytes_of(joined: DataFrame) -> DataFrame:
    """Hash, side and bytes: of the shared chunks of joined documents once for each batch (side -1), and of what lies beside those asked for."""
    types = (pa.int64(), pa.int32(), pa.large_binary())

    def run(stream):
        for part in batches(stream, "text", 4 << 20):
            data, offsets = string_bytes(part.column("text"))
            row, own = loaded(part.column("shared"), OWN)
            if len(own):
                h, lo, hi = told_apart(data, own["h"], offsets[row] + own["a"], offsets[row] + own["b"])
                own, last = gathered(data, lo, hi)
                found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(np.r_[0, last].astype(np.int64)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), -1, np.int32)), found.cast(pa.binary())], names=["h", "side", "bytes"])
            lists = part.column("around").combine_chunks()
            items = lists.flatten()
            if not len(items):
                continue
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            h, a, b, side = (items.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "a", "b", "side"))
            lo, hi = offsets[row] + a, offsets[row] + b
            inside = ~SPACE[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
            ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
            begin, end = np.searchsorted(starts, offsets[row]), np.searchsorted(starts, offsets[row + 1])
            left = starts[np.maximum(begin, np.searchsorted(starts, lo) - AROUND)]
            right = ends[np.minimum(end, np.searchsorted(starts, hi) + AROUND) - 1]
            seen = {(int(x), int(s), data[a:b].tobytes()) for x, s, a, b in zip(h, side, np.where(side, hi, left), np.where(side, right, lo))}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen), (pa.int64(), pa.int32(), pa.binary()))], names=["h", "side", "bytes"])

    return joined.filter("shared is not null").select("text", "shared", "around").mapInArrow(run, "h long, side int, bytes binary")


def common(own: bytes, other: bytes) -> int:
    """Bytes of the whole words (with the white space before them) with which both begin.

    One word alone beyond a line break may be alike by chance and isn't counted, unless it is the whole line.
    """
    n, to = 0, min(len(own), len(other))
    if own[:1] != other[:1]:
        return 0
    if own[:to] == other[:to]:
        n = to
    while n < to:  # the longest common beginning, by halves
        half = (n + to + 1) // 2
        n, to = (half, to) if own[n:half] == other[n:half] else (n, half - 1)
    if own[n : n + 1].strip(BLANK) or other[n : n + 1].strip(BLANK):  # within a word of one of them
        while n and other[n - 1] not in BLANK:
            n -= 1
    n = len(other[:n].rstrip(BLANK))
    p = other.rfind(b"\n", 0, n)
    if p >= 0 and len(other[p:n].split()) == 1 and (own[n : n + 1].strip(b"\r\n") or other[n : n + 1].strip(b"\r\n")):
        n = len(other[:p].rstrip(BLANK))
    return n


def extended(text: bytes, s: int, e: int, before: list[bytes], after: list[bytes]) -> tuple[int, int]:
    """The range with the words on both sides that also lie there in the first document."""
    left = max((common(text[max(0, s - len(x) - 1) : s][::-1], x[::-1]) for x in before), default=0)
    right = max((common(text[e : e + len(x) + 1], x) for x in after), default=0)
    return s - left, e + right


def joined_up(text: bytes, drop: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Ranges to drop, in order, joined where only white space lies between; whole lines go with their break."""
    whole: list[list[int]] = []
    for s, e in sorted(drop):
        if whole and (s <= whole[-1][1] or not text[whole[-1][1] : s].strip(BLANK)):
            whole[-1][1] = max(e, whole[-1][1])
        else:
            whole.append([s, e])
    return whole


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (all columns but ``text``), text, removed_words, removed_chunks per row of ``docs``."""
    tagged = docs.select(as_row(docs, "text").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    tagged = tagged.withColumn("th", F.xxhash64("text"))
    known = tagged.filter("id is not null and text is not null").select(F.col("id").alias("doc_id"), "text", "th")
    marked = staged(marks(known), "marks")
    shared, asked, wanted, hot = shared_chunks(marked)
    drop_staged(marked)
    may = key_filter(shared.select(F.xxhash64("doc_id", "th").alias("key")))
    tagged = tagged.withColumn("may", may.column(F.xxhash64("id", "th")))
    named = lambda df: df.withColumnRenamed("doc_id", "id").hint("shuffle_hash")
    joined = tagged.filter("may").join(named(shared), ["id", "th"], "left").join(named(wanted), ["id", "th"], "left")
    joined = staged(joined.select("row", "text", "id", "th", "shared", "runs", "around"), "joined")
    compared = staged(bytes_of(joined), "bytes")
    # hashes of 64 bits that unlike chunks share: next to none, and held back as rows are
    unlike = compared.filter("side < 0").select("h", "bytes").distinct().groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    apart = staged(unlike, "unlike")
    beside = staged(compared.filter("side >= 0").groupBy("h", "side").agg(F.collect_set("bytes").alias("beside")), "beside")
    ends = salted(asked, hot).join(copied(beside, hot), ["h", "side", "salt"], "left").select(F.col("doc_id").alias("id"), "th", F.struct("a", "b", "side", "beside").alias("end"))
    ends = staged(ends.groupBy("id", "th").agg(F.collect_list("end").alias("ends")), "ends")
    none = F.array().cast("array<int>")
    # a document without runs was only compared: it passes
    passed = joined.filter("runs is null or octet_length(runs) = 0").select("row", "text")
    todo = joined.filter("octet_length(runs) > 0").select("row", "text", "id", "th", "shared").join(ends.hint("shuffle_hash"), ["id", "th"], "left").withColumn("bad", none)
    if not apart.isEmpty():
        held = rows_of(shared, key_filter(apart.select(F.col("h").alias("key"))), True).join(apart, "h")
        held = staged(held.groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_list("a").alias("held")), "held")
        todo = todo.join(held, ["id", "th"], "left").withColumn("bad", F.coalesce("held", "bad"))
    drop_staged(shared, asked, wanted, compared, apart, beside)
    todo = todo.select("row", "text", "shared", "ends", "bad")
    nothing = [F.lit(0).cast("long").alias(c) for c in ("removed_words", "removed_chunks")]
    rest = tagged.filter("not may").select("row", "text").unionByName(passed).select("row", "text", *nothing)

    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            data, offsets = string_bytes(part.column("text"))
            lists = part.column("ends").combine_chunks()
            of = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            ends = lists.flatten()
            begin, end, side = (ends.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("a", "b", "side"))
            near = ends.field("beside")
            of_near = np.r_[0, np.cumsum(near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].tolist()
            near = near.flatten().to_pylist()
            of_shared, shared = loaded(part.column("shared"), OWN)
            first, last = (offsets[of_shared] + shared[c] for c in "ab")  # ascending: chunks lie in order
            bads = part.column("bad").to_pylist()
            gone, pieces = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            kept: list[tuple[int, int]] = []
            cuts: list[tuple[int, int, int]] = []
            sizes = np.diff(offsets)
            for row in range(part.num_rows):
                lo, hi = int(offsets[row]), int(offsets[row + 1])
                text = data[lo:hi].tobytes()
                bad = bads[row]
                found: dict[tuple, list] = {}
                for r in range(of[row], of[row + 1]):
                    found.setdefault((begin[r], end[r]), [[], []])[side[r]] += near[of_near[r] : of_near[r + 1]]
                drop = {}
                for (a, b), sides in found.items():
                    s, e = extended(text, a, b, *sides)
                    size = len(text[s:e].split())
                    if size >= min_words and not any(a <= x < b for x in bad):
                        drop[s, e] = size
                at = 0
                if drop:
                    whole = joined_up(text, drop)
                    gone[row] = sum(drop[s, e] if (s, e) in drop else len(text[s:e].split()) for s, e in whole)
                    for s, e in whole:
                        cuts.append((row, lo + s, lo + e))
                        kept.append((lo + at, lo + s))
                        line = (s == 0 or text[s - 1 : s] == b"\n") and text[e : e + 1] == b"\n"
                        sizes[row] -= e + line - s
                        at = e + line
                kept.append((lo + at, hi))
            row, s, e = np.array(cuts, np.int64).reshape(-1, 3).T
            np.add.at(pieces, row, np.searchsorted(first, e) - np.searchsorted(last, s, "right"))  # chunks of rows before count on both sides
            a, b = np.array(kept, np.int64).reshape(-1, 2).T
            left, _ = gathered(data, a, b)
            text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(left))
            yield pa.RecordBatch.from_arrays([part.column("row").combine_chunks(), text.cast(pa.string()), pa.array(gone), pa.array(pieces)], names=["row", "text", "removed_words", "removed_chunks"])

    return todo.mapInArrow(run, rest.schema).unionByName(rest)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with cleaned ``text`` and the columns ``removed_words`` and ``removed_chunks``."""
    own = ("removed_words", "removed_chunks")
    out = cleaned(docs, min_words)
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in own]
    return out.select(*kept, *own)
