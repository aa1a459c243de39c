"""Benchmark decontamination: seeds of two words, then Smith-Waterman alignment of words.

The score of an alignment (match +2, mismatch and gap -1) is its share of the item's full score; a
document leaks an item from ``threshold`` on. Edits, insertions and losses of up to about a third
of the words stay above 0.5, and so does half of an item word for word.

Seeds lose no such alignment. Say it has m matches and e edits, 2m - e >= 2tn for an item of n words
and the threshold t. Of its m - 1 steps from a match to the next at most e/2 <= m - tn hold two edits
or more, so at least T = ceil(tn) - 1 steps hold one edit at most: both words are one or two places
apart in the item, and one or two in the text. Such pairs are hashed alike whatever their distance.

1. Of an item's n - 1 places where a pair starts, the T // 2 whose pairs are most frequent among the
   items may be left out: T - T // 2 of the others are still met by each alignment (a common pair
   would be looked up for nearly every item).
2. One pass looks the pairs up in each text. Where so many hits of an item lie within the longest
   stretch that an alignment can take (3n - 2tn words), the words around are a window; each window
   is aligned with the item, all windows of a batch at once.

A benchmark of at most ``BLOCK`` bytes of text is sent to the workers whole, and the pass reads the
documents in place, without a shuffle. Beyond that nothing of it goes through the driver: seeds are a
table, the pairs of the texts that a key filter lets through meet them in a join, windows are found where
the hits of a text and an item meet, and only the windows' words go on to the alignment. The number of
passes over the documents is three at any size of the benchmark. Joins whose side of the documents can
have a popular key (a pair, an item, a text) are dealt by salts.

Defined results: null and empty texts, and items of fewer than ``SEED`` words, leak nothing;
repeated rows are reported each, as are items of equal text; ids may be null; empty tables give no
rows; extra columns are ignored. A threshold must ask for more than one word of an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyset.llm.bloom import key_filter
from plyset.llm.common import Scratch, as_row, bounded_batches, drop_staged, without
from plyset.llm.text import batches, mix, owners, string_bytes, words

SEED, BLOCK = 3, 8 << 20
HITS = 1 << 20
SALTS = 16
MATCH, MISS, GAP = 2, -1, -1
LEAKS = "doc_id long, item_id long, score double, start_word long, end_word long"


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of items[k] with windows[k], and where in the window each ends."""
    n, longest, width = len(items), max(map(len, items)), max(map(len, windows))
    a = np.zeros((n, longest), np.uint64)
    b = np.ones((n, width), np.uint64)  # padding never matches; real hashes are made odd or even below
    for k in range(n):
        a[k, : len(items[k])] = items[k] | np.uint64(2)
        b[k, : len(windows[k])] = windows[k] | np.uint64(2)
    best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((n, width + 1), np.int32)
    for i in range(longest):
        row = np.maximum(above[:, :-1] + np.where(a[:, i : i + 1] == b, MATCH, MISS), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + step, axis=1) - step  # gaps along the window
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], at[better] = value[better], top[better] + 1
        above[:, 1:] = row
    return best, at


class Seeds:
    """Sorted hashes of pairs with the items that hold each, and a table that rules most hashes out."""

    def __init__(self, grams: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, grams))
        grams, item = grams[order], item[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])] if len(grams) else np.empty(0, bool)
        grams, self.item = grams[new], item[new]
        self.grams, self.first = np.unique(grams, return_index=True)
        self.last = np.r_[self.first[1:], len(grams)]
        self.mask = np.uint64((1 << max(20, (8 * len(grams)).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(self.grams & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are seeds, and which."""
        near = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, hashes[near]), len(self.grams) - 1)
        same = self.grams[at] == hashes[near]
        return near[same], at[same]


def words_of(column):
    """Word hashes, the text that each lies in, and each text's first word."""
    data, offsets = string_bytes(column)
    starts, _, hashes = words(data, offsets)
    return hashes, owners(starts, offsets), np.searchsorted(starts, offsets)


def pairs_of(hashes: np.ndarray, doc: np.ndarray):
    """Of words one and two places apart in a text: the first one's place, and a hash of both in order."""
    once = mix(hashes) * np.uint64(0x9FB21C651E98DF25)
    for apart in (1, 2):
        at = np.flatnonzero(doc[:-apart] == doc[apart:])
        yield at, mix(once[at] + hashes[at + apart])


def needed(lengths: np.ndarray, threshold: float) -> np.ndarray:
    """Steps of one edit at most in any alignment that reaches the threshold."""
    return np.maximum(np.ceil(threshold * lengths - 1e-9).astype(np.int64) - 1, 1)


def seeds_of(hashes: np.ndarray, item: np.ndarray, lengths: np.ndarray, threshold: float) -> Seeds:
    """The pairs of all items without each item's most frequent starts."""
    at, grams = map(np.concatenate, zip(*pairs_of(hashes, item)))
    which, held = np.unique(grams, return_inverse=True)
    often = np.bincount(held, minlength=len(which))[held]
    most = np.zeros(len(hashes), np.int64)
    np.maximum.at(most, at, often)
    starts = np.unique(at)
    order = starts[np.lexsort((-most[starts], item[starts]))]
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    keep = np.zeros(len(hashes), bool)
    keep[order] = (rank >= needed(lengths, threshold)[item[order]] // 2) & (lengths[item[order]] >= SEED)
    return Seeds(grams[keep[at]], item[at[keep[at]]])


def windows_of(item: np.ndarray, doc: np.ndarray, at: np.ndarray, need: np.ndarray, span: np.ndarray):
    """Where ``need`` hits of an item lie within its span of a text: (doc, item, from, to), in places of the batch."""
    order = np.lexsort((at, item, doc))
    item, doc, at = item[order], doc[order], at[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (item[1:] != item[:-1])]  # a place counts once
    item, doc, at = item[new], doc[new], at[new]
    last = np.arange(len(at)) + need[item] - 1
    inside = np.minimum(last, len(at) - 1)
    good = (last < len(at)) & (item[inside] == item) & (doc[inside] == doc) & (at[inside] - at < span[item])
    item, doc, at = item[good], doc[good], at[good]
    if not len(at):
        return []
    apart = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * span[item[1:]])]
    a = np.flatnonzero(apart)
    b = np.r_[a[1:], len(at)] - 1
    return list(zip(doc[a].tolist(), item[a].tolist(), (at[a] - span[item[a]]).tolist(), (at[b] + span[item[b]]).tolist()))


def judged(todo: list[tuple], threshold: float):
    """Of windows (document, item, the item's words, the window's words, the window's place): (document, item, score, first and last word) of those that reach the threshold."""
    todo = sorted(todo, key=lambda w: (len(w[2]), len(w[3])))
    k = 0
    while k < len(todo):  # windows of like size together, in bounded memory
        n = k
        while n < len(todo) and n - k < 2048 and (n == k or (n - k + 1) * len(todo[n][3]) <= 1 << 20):
            n += 1
        some = todo[k:n]
        k = n
        scores, ends = align([w[2] for w in some], [w[3] for w in some])
        good = [x for x in range(len(some)) if scores[x] >= threshold * MATCH * len(some[x][2])]
        if good:  # where it begins: the same alignment backwards
            _, begins = align([some[x][2][::-1] for x in good], [some[x][3][: ends[x]][::-1] for x in good])
        for x, back in zip(good, begins if good else ()):
            d, i, own, _, lo = some[x]
            yield d, i, int(scores[x]) / (MATCH * len(own)), lo + int(ends[x]) - int(back), lo + int(ends[x])


def finder(spark, items: list, threshold: float):
    """A function of batches of texts that gives each with its leaks (row, item_id, score, start_word, end_word); or nothing, if no item is long enough."""
    hashes, item, first = words_of(pa.array([r.text for r in items], pa.large_string()))
    texts = [hashes[first[i] : first[i + 1]] for i in range(len(items))]
    lengths = np.diff(first)
    if not (lengths >= SEED).any():
        return None
    held = spark.sparkContext.broadcast((seeds_of(hashes, item, lengths, threshold), texts, [r.item_id for r in items]))

    def search(parts):
        seeds, texts, ids = held.value
        lengths = np.array([len(t) for t in texts])
        need = needed(lengths, threshold)
        need -= need // 2
        span = np.floor((3 - 2 * threshold) * lengths + 1e-9).astype(np.int64)
        for part in parts:
            words_, doc, first = words_of(part.column("text"))
            if not len(words_):
                yield part, []
                continue
            at, gram = [], []
            for places, found in pairs_of(words_, doc):
                hit, which = seeds.find(found)
                at.append(places[hit])
                gram.append(which)
            at, gram = np.concatenate(at), np.concatenate(gram)
            order = np.argsort(at, kind="stable")
            at, gram = at[order], gram[order]
            times = seeds.last[gram] - seeds.first[gram]
            total = np.r_[0, np.cumsum(times)]
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(doc[at]) != 0]), len(at)] if len(at) else np.zeros(1, np.int64)
            todo, i = [], 0
            while i < len(edges) - 1:  # whole texts, of about HITS hits together
                j = max(i + 1, int(np.searchsorted(total[edges], total[edges[i]] + HITS, "right")) - 1)
                lo, hi = edges[i], edges[j]
                many = times[lo:hi]
                posting = np.repeat(seeds.first[gram[lo:hi]] - total[lo:hi] + total[lo], many) + np.arange(many.sum())
                where = np.repeat(at[lo:hi], many)
                for d, n, a, b in windows_of(seeds.item[posting], doc[where], where, need, span):
                    todo.append((d, n, max(0, a - int(first[d])), min(int(first[d + 1]), b) - int(first[d])))
                i = j
            best: dict[tuple[int, int], tuple] = {}
            for d, i, score, begin, end in judged([(d, i, texts[i], words_[first[d] + lo : first[d] + hi], lo) for d, i, lo, hi in todo], threshold):
                if (d, i) not in best or score > best[d, i][0]:
                    best[d, i] = (score, begin, end)
            yield part, [(d, ids[i], *row) for (d, i), row in best.items()]

    return search


def listed(items: DataFrame) -> tuple[DataFrame, list | None]:
    """The items without repeated rows, and as a list, if they have at most ``BLOCK`` bytes of text."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BLOCK:
        return items, None
    return items, sorted(items.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row (doc_id, item_id, score, start_word, end_word) per document and item that it leaks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items, own = listed(items)
    if own is None:
        found = leaking_texts(docs, items, threshold)
        may = key_filter(found.select("key").distinct())
        named = docs.select("doc_id", F.xxhash64("text").alias("key")).filter(may.column(F.col("key"))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        return named.join(copies(found), ["key", "salt"]).select("doc_id", "item_id", "score", "start_word", "end_word")
    find = finder(spark, own, threshold)
    return spark.createDataFrame([], LEAKS) if find is None else docs.mapInArrow(rows_of(find), LEAKS)


def copies(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def item_pairs(items: DataFrame) -> DataFrame:
    """(item, n, at, gram) of all pairs of the items of at least ``SEED`` words, and their words as hashes."""

    def run(stream):
        for part in batches(stream, "text", 1 << 20):
            hashes, item, first = words_of(part.column("text"))
            lengths, keys = np.diff(first), part.column("item").to_numpy()
            at, grams = map(np.concatenate, zip(*pairs_of(hashes, item)))
            some = lengths[item[at]] >= SEED
            at, grams = at[some], grams[some]
            own = item[at]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(lengths[own]), pa.array(at - first[own]), pa.array(grams.view(np.int64))], names=["item", "n", "at", "gram"])

    return items.select("item", "text").mapInArrow(run, "item long, n long, at long, gram long")


def item_words(items: DataFrame) -> DataFrame:
    def run(stream):
        for part in batches(stream, "text", 1 << 20):
            hashes, _, first = words_of(part.column("text"))
            words_ = [hashes[first[k] : first[k + 1]].tobytes() for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("item").combine_chunks(), part.column("item_id").combine_chunks(), pa.array(words_, pa.binary())], names=["item", "item_id", "words"])

    return items.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, words binary")


def seed_table(items: DataFrame, threshold: float) -> DataFrame:
    """(gram, item, n): the pairs of all items without each item's most frequent starts, as ``seeds_of`` chooses them."""
    pairs = item_pairs(items)
    often = pairs.groupBy("gram").agg(F.count("*").alias("often"))
    starts = pairs.join(often, "gram").groupBy("item", "n", "at").agg(F.max("often").alias("often"), F.collect_set("gram").alias("grams"))
    need = F.greatest(F.ceil(F.lit(threshold) * F.col("n") - 1e-9) - 1, F.lit(1))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("often"), "at")) - 1
    return starts.withColumn("rank", rank).filter(F.col("rank") >= F.floor(need / 2)).select(F.explode("grams").alias("gram"), "item", "n").distinct()


def hits_of(texts: DataFrame, among) -> DataFrame:
    """(key, gram, at) of the pairs in the texts that the filter lets through."""

    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            words_, doc, first = words_of(part.column("text"))
            keys = part.column("key").to_numpy()
            for at, grams in pairs_of(words_, doc):
                grams = grams.view(np.int64)
                for k in range(0, len(at), 1 << 18):
                    some = np.flatnonzero(among.test(grams[k : k + (1 << 18)])) + k
                    own = doc[at[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(grams[some]), pa.array(at[some] - first[own])], names=["key", "gram", "at"])

    return texts.mapInArrow(run, "key long, gram long, at long")


def window_table(hits: DataFrame, threshold: float) -> DataFrame:
    """(key, item, lo, hi): where enough hits of an item lie close together in a text. Runs of a text and an item may go on from batch to batch."""
    names = ("key", "item", "n", "at")

    def found(c):
        key, item, n, at = c
        run_ = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])]) - 1
        first = np.searchsorted(run_, np.arange(run_[-1] + 1))
        need = needed(n[first], threshold)
        span = np.floor((3 - 2 * threshold) * n[first] + 1e-9).astype(np.int64)
        rows = windows_of(run_, run_, at, need - need // 2, span)
        g, _, lo, hi = map(np.array, zip(*rows)) if rows else [np.empty(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first][g], item[first][g], np.maximum(lo, 0), hi)], names=["key", "item", "lo", "hi"])

    def run(stream):
        held = None
        for batch in stream:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in names]
            held = own if held is None else [np.r_[x, y] for x, y in zip(held, own)]
            key, item = held[:2]
            whole = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])])[-1])
            if whole:
                yield found([x[:whole] for x in held])
                held = [x[whole:].copy() for x in held]
        if held is not None:
            yield found(held)

    dealt = hits.select(*names).repartition("key", "item").sortWithinPartitions("key", "item", "at")
    return dealt.mapInArrow(run, "key long, item long, lo long, hi long")


def window_words(texts: DataFrame) -> DataFrame:
    """(key, item, lo, words) of the windows listed with each text."""

    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            words_, _, first = words_of(part.column("text"))
            lists, keys = part.column("windows").to_pylist(), part.column("key").to_pylist()
            rows = [(keys[k], w["item"], w["lo"], words_[first[k] + w["lo"] : min(first[k] + w["hi"], first[k + 1])].tobytes()) for k, own in enumerate(lists) for w in own]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096]), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "item", "lo", "words"])

    return texts.select("key", "text", "windows").mapInArrow(run, "key long, item long, lo long, words binary")


def leaking_texts(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(key, item_id, score, start_word, end_word), staged: the texts, by their hash, that leak an item, all in joins."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    seeds = scratch.staged(seed_table(items, threshold), "seeds")
    among = key_filter(seeds.select(F.col("gram").alias("key")).distinct())
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("key"), "text")
    hits = hits_of(texts, among).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    met = hits.join(copies(seeds), ["gram", "salt"]).select("key", "item", "n", "at")
    windows = scratch.staged(window_table(met, threshold), "windows")
    may = key_filter(windows.select("key").distinct())
    listed_ = windows.groupBy("key").agg(F.collect_set(F.struct("item", "lo", "hi")).alias("windows"))
    once = texts.filter(may.column(F.col("key"))).dropDuplicates(["key"]).join(listed_, "key")
    sliced = window_words(once).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    sides = sliced.join(copies(item_words(items).withColumnRenamed("words", "own")), ["item", "salt"]).select("key", "item_id", "lo", "words", "own")

    def run(stream):
        for batch in stream:
            columns = [batch.column(c).to_pylist() for c in ("key", "item_id", "own", "words", "lo")]
            todo = [(k, i, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), lo) for k, i, a, b, lo in zip(*columns) if b]
            rows = list(judged(todo, threshold))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["key", "item_id", "score", "start_word", "end_word"])

    scored = sides.mapInArrow(run, "key long, item_id long, score double, start_word long, end_word long")
    best = scored.groupBy("key", "item_id").agg(F.max(F.struct("score", F.negative("start_word").alias("s"), F.negative("end_word").alias("e"))).alias("b"))
    out = scratch.staged(best.select("key", "item_id", "b.score", F.negative("b.s").alias("start_word"), F.negative("b.e").alias("end_word")), "leaks")
    scratch.drop(out)
    return out


def rows_of(find):
    def run(stream):
        for part, found in find(batches(stream, "text", 2 << 20)):
            if found:
                rows, *rest = zip(*found)
                columns = [part.column("doc_id").combine_chunks().take(pa.array(rows))]
                columns += [pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that leak no item, all columns kept under any name; each row is judged by its own text.

    One pass without a shuffle for a benchmark that is sent to the workers. Of a larger one, the texts that
    leak are found first and then left out.
    """
    items, own = listed(items)
    if own is None:
        found = leaking_texts(docs.select(F.col("text").cast("string")), items, threshold)
        bad = Scratch().staged(found.select("key").distinct(), "leaking")
        drop_staged(found)
        return without(docs, F.xxhash64(F.col("text").cast("string")), bad)
    left = docs.select(as_row(docs, "text").alias("row"), F.col("text").cast("string").alias("text"))
    find = finder(docs.sparkSession, own, threshold)
    if find is not None:
        left = left.mapInArrow(clean_of(find), left.schema)
    kind = docs.schema["text"].dataType
    return left.select(*(F.col("text").cast(kind).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def clean_of(find):
    def run(stream):
        for part, found in find(batches(stream, "text", 2 << 20)):
            clean_ = np.ones(part.num_rows, bool)
            clean_[[row for row, *_ in found]] = False
            yield from part.filter(pa.array(clean_)).combine_chunks().to_batches()

    return run
