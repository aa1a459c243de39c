"""Source divergence audit: how far the word use of a language's sources lies apart, and which terms tell a source.

Sort-based streaming, in two rounds of the same kind:

1. Every document's terms are counted where it is read and pre-aggregated in its task (``FLUSH``
   rows are held at most), so that a term that stands everywhere arrives about once for each task and
   source. The partial counts are dealt by (lang, term) and sorted by (lang, term, source, document);
   one scan over the runs adds up document frequency and counts, and passes on the terms in at least
   ``MIN_DOCS`` documents with their counts by source.
2. The kept terms are dealt by (lang, salt), with the language's list of sources, totals and V as the
   first record of each such run, and scanned again: each run emits partial sums for its pairs of
   sources and its best terms of each source. Spark adds the pairs up and ranks.

Nothing is broadcast. A language with many sources is cut into tiles of pairs, so that a task holds
at most ``CELLS`` sums; work and rows grow with the square of a language's sources, as the result does.

Terms are runs of ASCII letters and non-ASCII characters, in bytes, with only A-Z lower-cased. All
numbers are integers; 10**9 * a // b is divided in three steps and is exact to totals of 9 * 10**15.

Defined results: null text, lang and source count as ''; every row is a document, whatever its id, so
repeated rows count twice; a language without kept terms has V = 0 and pairs of value 0; a source
alone in its language has no pairs; ties rank by item in UTF-8; no rows give none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyset.llm.common import Scratch, bounded_batches
from plyset.llm.text import batches, release, string_bytes

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
SCALE = 1_000_000_000
FLUSH = 1_500_000
CHUNK = 1 << 22
CELLS = 1 << 21
RUN_TERMS = 4_000

#: Bytes that belong to a term, A-Z lower-cased; all others become blanks.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``CHUNK`` bytes that end between terms."""
    at = 0
    while len(data) - at > CHUNK:
        end = data.find(b" ", at + CHUNK)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def terms_of(text: bytes) -> Counter:
    found: Counter = Counter()
    for part in pieces(text.translate(TERM)):
        found.update(part.split())
    return found


PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("doc", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray) -> pa.Table:
    """(group, term, doc, docs, n) of many texts, given as bytes: by each group of texts its terms, with the first text that has one."""
    mapped = np.frombuffer(TERM, np.uint8)[data]
    inside = mapped != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(mapped[inside].tobytes())]).dictionary_encode()
    code, width = tokens.indices.to_numpy().astype(np.int64), max(1, len(tokens.dictionary))
    owner = np.searchsorted(offsets, starts, "right") - 1
    held, n = np.unique(owner * width + code, return_counts=True)  # by document and term
    owner, code = held // width, held % width
    key, first, back = np.unique(group[owner] * width + code, return_index=True, return_inverse=True)
    return pa.table(
        {
            "group": pa.array(key // width), "term": tokens.dictionary.take(pa.array(key % width)), "doc": pa.array(doc[owner[first]]),
            "docs": pa.array(np.bincount(back, minlength=len(key)).astype(np.int64)), "n": pa.array(np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)),
        }
    )


def long_counted(text: bytes, group: int, doc: int) -> pa.Table:
    """The same of one very long text, piece by piece."""
    found = terms_of(text)
    k = len(found)
    return pa.table({"group": pa.array([group] * k, pa.int64()), "term": pa.array(list(found), pa.binary()), "doc": pa.array([doc] * k, pa.int64()), "docs": pa.array([1] * k, pa.int64()), "n": pa.array(list(found.values()), pa.int64())})


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False).aggregate([("doc", "min"), ("docs", "sum"), ("n", "sum")])
    return out.select(["group", "term", "doc_min", "docs_sum", "n_sum"]).rename_columns(["group", "term", "doc", "docs", "n"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, first document, documents, occurrences): about one row for each task, source and term."""
    typed = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("doc"),
    )

    def run(stream):
        groups: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def out(t: pa.Table):
            names = [pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)]
            own = t.column("group").combine_chunks()
            columns = [names[0].take(own), t.column("term").combine_chunks().cast(pa.string()), names[1].take(own), *(t.column(c).combine_chunks() for c in ("doc", "docs", "n"))]
            whole = pa.RecordBatch.from_arrays(columns, schema=PARTIAL)
            for k in range(0, len(whole), 1 << 14):
                yield whole.slice(k, 1 << 14)

        for part in batches(stream, "text", CHUNK):
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
            doc = part.column("doc").to_numpy()
            data, offsets = string_bytes(part.column("text"))
            if len(data) > 2 * CHUNK:  # one text alone
                found = [long_counted(data[offsets[k] : offsets[k + 1]].tobytes(), int(group[k]), int(doc[k])) for k in range(len(doc))]
            else:
                found = [counted(data, offsets, group, doc)]
            held += [t for t in found if len(t)]
            if sum(map(len, held)) >= FLUSH:
                held = [merged(held)]
                if len(held[0]) >= FLUSH // 2:
                    yield from out(held.pop())
        if held:
            yield from out(merged(held))

    return typed.mapInArrow(run, "lang string, term string, source string, doc long, docs long, n long")


def changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def kept_terms(partial: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, sources, counts) of the terms in at least ``min_docs`` of the language's documents."""

    def run(stream):
        """Runs of equal (lang, term), and in them of equal source; the last run of a batch may go on in the next."""
        open_: tuple[tuple[str, str], int, list[str], list[int]] | None = None
        done: list[tuple] = []

        def close(run_):
            if run_ is not None and run_[1] >= min_docs:
                done.append((*run_[0], run_[2], run_[3]))

        def flush():
            columns = list(zip(*done)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "term", "sources", "counts"])

        for batch in stream:
            if batch.num_rows == 0:
                continue
            lang, term, source = (batch.column(c) for c in ("lang", "term", "source"))
            new = changes(lang, term)
            runs = np.flatnonzero(new)
            parts = np.flatnonzero(new | changes(source))
            docs = np.add.reduceat(batch.column("docs").to_numpy(), runs)
            n = np.add.reduceat(batch.column("n").to_numpy(), parts)
            bounds = np.append(np.searchsorted(parts, runs), len(parts))
            last = len(runs) - 1
            for k in dict.fromkeys([0, *np.flatnonzero(docs >= min_docs).tolist(), last]):
                a, b = bounds[k], bounds[k + 1]
                now = ((lang[runs[k]].as_py(), term[runs[k]].as_py()), int(docs[k]), source.take(pa.array(parts[a:b])).to_pylist(), n[a:b].tolist())
                if k == 0 and open_ is not None:
                    if open_[0] == now[0]:
                        (_, d, sources, counts), own, ns = open_, now[2], now[3]
                        if sources[-1] == own[0]:
                            counts[-1] += ns[0]
                            own, ns = own[1:], ns[1:]
                        now = (now[0], d + now[1], sources + own, counts + ns)
                    else:
                        close(open_)
                    open_ = None
                if k == last:
                    open_ = now
                else:
                    close(now)
            if len(done) >= 1000:
                yield flush()
                done = []
        close(open_)
        yield flush()
        release()

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "doc")
    return dealt.select("lang", "term", "source", "docs", "n").mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), three digits at a time."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64), count
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


class Tile:
    """Sums of one language's pairs (i, j > i) for the sources ``lo <= i < hi``, and those sources' best terms."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], v: int, tile: int, tiles: int, top: int):
        self.lang, self.sources, self.v, self.top = lang, sources, v, top
        s = len(sources)
        self.lo, self.hi = s * tile // tiles, s * (tile + 1) // tiles
        self.index = {name: i for i, name in enumerate(sources)}
        n = np.array(totals, np.int64)
        self.base, self.whole = n + SMOOTH * v, np.int64(n.sum() + SMOOTH * v)
        self.sums = np.zeros((self.hi - self.lo, s), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in range(self.lo, self.hi)]
        self.terms: list[str] = []
        self.cells: list[tuple[np.ndarray, list[int]]] = []
        self.room = max(1, CELLS // max(1, s))

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.terms.append(term)
        self.cells.append((np.array([self.index[x] for x in sources], np.int64), counts))
        if len(self.terms) >= self.room:
            self.settle()

    def settle(self) -> None:
        """The held terms' shares of every source, their differences and the terms above the language's share."""
        if not self.terms or self.lo == self.hi:
            self.terms, self.cells = [], []
            return
        counts = np.zeros((len(self.sources), len(self.terms)), np.int64)
        for k, (at, own) in enumerate(self.cells):
            counts[at, k] = own
        p = share(counts + SMOOTH, self.base[:, None])
        q = share(counts.sum(axis=0) + SMOOTH, self.whole)
        for i in range(self.lo, self.hi):
            if i + 1 < len(self.sources):
                self.sums[i - self.lo, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = (p[i] - q)[over]
            if len(over) > self.top:  # ties with the last one stay until they are sorted by item
                least = np.partition(value, len(value) - self.top)[len(value) - self.top]
                over, value = over[value >= least], value[value >= least]
            own = self.best[i - self.lo] + [(-int(x), self.terms[k].encode()) for k, x in zip(over, value)]
            self.best[i - self.lo] = sorted(own)[: self.top]
        self.terms, self.cells = [], []

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for i in range(self.lo, self.hi):
            later = self.sources[i + 1 :]
            best = [(t.decode(), -x) for x, t in self.best[i - self.lo]]
            items = later + [t for t, _ in best]
            values = self.sums[i - self.lo, i + 1 :].tolist() + [x for _, x in best]
            parts = ["pair"] * len(later) + ["term"] * len(best)
            n = len(items)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.lang] * n, pa.string()), pa.array([self.sources[i]] * n, pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())],
                    names=["lang", "source", "part", "item", "value"],
                )


def scan_terms(records: DataFrame, top: int) -> DataFrame:
    """Partial pairs and terms of each run of (lang, salt, tile), whose first record names the language's sources."""

    def run(stream):
        tile = None
        for batch in stream:
            for r in batch.to_pylist():
                if r["head"]:
                    if tile is not None:
                        yield from tile.rows()
                    tile = Tile(r["lang"], r["sources"], r["counts"], r["v"], r["tile"], r["tiles"], top)
                else:
                    tile.add(r["term"], r["sources"], r["counts"])
        if tile is not None:
            yield from tile.rows()
        release()

    return records.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch()
    kept = scratch.staged(kept_terms(partial_counts(docs), min_docs), "kept-terms")
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.lit(0).cast("long").alias("n"))
    held = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    # two levels: the partial sums of a source, then one row for each source of a language
    groups = named.unionByName(held).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    heads = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s")).join(terms, "lang", "left")
    heads = scratch.staged(heads.select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("counts"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "languages")
    most, all_terms = heads.agg(F.max(F.size("sources")), F.sum("v")).first()
    tiles = max(1, -(-(most or 0) ** 2 // CELLS))
    salts = max(1, -(-(all_terms or 0) // RUN_TERMS))

    def spread(salt):
        return [F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(tiles).alias("tiles"), salt]

    head = heads.select("lang", F.lit("").alias("term"), "sources", "counts", "v", F.lit(True).alias("head"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    head = head.select("lang", "term", "sources", "counts", "v", "head", *spread(F.col("salt")))
    body = kept.select("lang", "term", "sources", "counts", F.lit(0).cast("long").alias("v"), F.lit(False).alias("head"), *spread(F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt")))
    records = head.unionByName(body).repartition("lang", "salt", "tile").sortWithinPartitions("lang", "salt", "tile", F.desc("head"), "term")
    found = scratch.staged(scan_terms(records, top), "divergence")
    scratch.drop(found)

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best)
