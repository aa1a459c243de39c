"""Language-model scores from a log-frequency Bloom filter, beside an exact unigram score.

Texts are taken in batches of about ``BATCH`` bytes. A batch numbers its distinct tokens and sends
each to the bucket of its hash, once, with its count in the batch's training texts; its distinct
bigrams go the same way. So a token that every document holds is one entry per batch, and
no key can be hot. A bucket merges all batches' counts and fills its own region of the Bloom filter;
it answers each batch with the exact counts of the tokens that it asked for, and with the levels that
the region gives for its tokens and bigrams. Buckets are as many as the corpus needs for ``BUCKET``
bytes of text each, so their memory stays the same at any size, and no filter is sent around.

Log-frequency filter: an n-gram seen c times is inserted at the levels 1 .. 1 + floor(log2 c). Its
count is read back by probing level after level until one is missing; errors are one-sided, and
reading one level too high costs as many false hits in a row. A region takes ``bloom.BITS`` bits for each
insertion, however many there are, so what the model keeps grows with the input.

Model: P(w | h) = (c(h, w) + MU * P(w)) / (c(h) + MU) with P(w) = (c(w) + 1) / (N + V + 1), all
counts as the filter returns them (the middle of the level's range), c(h, w) at most c(h); h is the
token before, or the begin of the text. The score sums log10 P over the tokens with the end.

Defined results: null and empty texts are the end token alone; ids may be null (they train) and
repeat, each row is scored; with no training text at all N = V = 0, every probability is 1; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.bloom import fill, levels_of
from plyset.llm.common import crc_mod, drop_folder, new_folder, staged
from plyset.llm.text import batches, mix, string_bytes, words

BATCH, BUCKET = 6 << 20, 16 << 20
MU = 30.0
MOST_BITS = (1 << 32) - 64  # bit positions have 32 bits: some 25 times what a bucket's text can need
END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x632BE59BD9B4E019)
ONE, TWO = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as Zstandard over its byte planes."""
    import zstandard

    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return zstandard.compress(raw, 1) if len(raw) > 64 else raw


def unsqueeze(raw: bytes, kind, n: int) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = zstandard.decompress(raw) if n * size > 64 else raw
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def bucket_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash (in the order of hashes) and 32 bits that tell hashes of a bucket apart."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    n = np.uint64(buckets)
    middle = high * n + ((low * n) >> np.uint64(32))  # hash * buckets, without its lowest 32 bits
    return (middle >> np.uint64(32)).astype(np.int64), (middle & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def token_sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and how many each text has."""
    data, offsets = string_bytes(column)
    starts, _, hashes = words(data, offsets)
    n = np.diff(np.searchsorted(starts, offsets))
    ends = np.cumsum(n + 1) - 1
    sequence = np.full(len(hashes) + len(n), END, np.uint64)
    word = np.ones(len(sequence), bool)
    word[ends] = False
    sequence[word] = hashes
    return sequence, n + 1


def bigrams(sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.empty_like(sequence)
    before[1:] = sequence[:-1]
    before[np.cumsum(lengths) - lengths] = BEGIN
    return mix(mix(before) * np.uint64(0x9FB21C651E98DF25) + sequence)


def counted(a: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an array, and how many of each there are where ``learn`` is true."""
    order = np.argsort(a)
    a = a[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    total = np.r_[0, np.cumsum(learn[order])]
    return a[first], np.diff(total[np.r_[first, len(a)]]).astype(np.uint32)


# -- counts and items ---------------------------------------------------------------------------


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0, 1, and then the geometric middle of [2**(q-1), 2**q - 1]."""
    low = np.exp2(level - 1.0)
    return np.where(level == 0, 0.0, np.sqrt(low * (2 * low - 1)))


# -- the three passes -------------------------------------------------------------------------

ASKED = "kind int, key long, batch long, n long, a binary, b binary"


def ask(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each batch: a row for itself (kind 2), and for each bucket its tokens (0) and bigrams (1), with their training counts."""

    def run(stream):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for part in batches(stream, "text", BATCH):
            batch = (task << 32) + seq
            seq += 1
            sequence, lengths = token_sequence(part.column("text"))
            train = part.column("train").to_numpy()
            rows: list[tuple] = []
            tokens, inverse = np.unique(sequence, return_inverse=True)
            learn = np.repeat(train, lengths)
            counts = np.bincount(inverse[learn], minlength=len(tokens)).astype(np.uint32)
            own, _ = bucket_of(tokens, buckets)
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for i, j in zip(edges, np.r_[edges[1:], len(own)]):
                rows.append((0, int(own[i]), batch, j - i, squeeze(gaps(tokens[i:j])), squeeze(counts[i:j])))
            pairs, counts = counted(bigrams(sequence, lengths), learn)
            own, rest = bucket_of(pairs, buckets)
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for i, j in zip(edges, [*edges[1:], len(own)]):
                rows.append((1, int(own[i]), batch, j - i, squeeze(gaps(rest[i:j])), squeeze(counts[i:j])))
            ids = part.column("doc_id").combine_chunks()
            held = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), train.astype(np.int64), lengths])
            rows.append((2, batch, batch, len(sequence), squeeze(inverse.astype(np.uint32)), held.astype("<i8").tobytes()))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "key", "batch", "n", "a", "b"])

    return docs.mapInArrow(run, ASKED)


ANSWERED = "kind int, bucket long, batch long, n long, a binary, b binary, c binary"


def answer(asked: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket: a row for itself (kind 2: tokens, types), and for each batch its tokens' counts and levels (0) and its bigrams' levels (1)."""

    def run(key, t):
        bucket = key[0].as_py()
        kind, n = t.column("kind").to_numpy(), t.column("n").to_numpy()
        a, b, batch = t.column("a"), t.column("b"), t.column("batch").to_numpy()

        def load(which, dtype):
            of = np.flatnonzero(kind == which)
            values = [np.cumsum(unsqueeze(a[int(i)].as_py(), dtype, int(n[i])), dtype=dtype) for i in of]
            counts = [unsqueeze(b[int(i)].as_py(), np.uint32, int(n[i])) for i in of]
            return of, values, np.concatenate([*values, np.empty(0, dtype)]), np.concatenate([*counts, np.empty(0, np.uint32)])

        of, values, tokens, counts = load(0, np.uint64)
        distinct, inverse = np.unique(tokens, return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        seen = total > 0
        _, rest = bucket_of(distinct, buckets)
        base = np.uint64(bucket) << np.uint64(32)
        ones = mix(base + rest ^ ONE)
        of2, values2, pairs, counts = load(1, np.uint32)
        pairs, inverse2 = np.unique(pairs, return_inverse=True)
        twos = mix(base + pairs ^ TWO)
        total2 = np.bincount(inverse2, counts, len(pairs)).astype(np.int64)
        items, many = np.concatenate([ones[seen], twos[total2 > 0]]), np.concatenate([total[seen], total2[total2 > 0]])
        region = np.frombuffer(fill(items, many, MOST_BITS), np.uint8)
        filter_, highest = (region, np.array([0, len(region)])), int(many.max(initial=0)).bit_length()
        level = levels_of(ones, np.zeros(len(ones), np.int64), filter_, highest).astype(np.uint8)
        level2 = levels_of(twos, np.zeros(len(twos), np.int64), filter_, highest).astype(np.uint8)
        rows, at = [(2, bucket, None, int(total.sum()), None, int(seen.sum()).to_bytes(8, "little"), None)], 0
        for i, v in zip(of, values):
            own = inverse[at : at + len(v)]
            rows.append((0, bucket, int(batch[i]), len(v), squeeze(total[own]), squeeze(v), squeeze(level[own])))
            at += len(v)
        at = 0
        for i, v in zip(of2, values2):
            rows.append((1, bucket, int(batch[i]), len(v), None, None, squeeze(level2[inverse2[at : at + len(v)]])))
            at += len(v)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=["kind", "bucket", "batch", "n", "a", "b", "c"])

    return asked.filter("kind < 2").groupBy(F.col("key").alias("bucket")).applyInArrow(run, ANSWERED)


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, train: F.col, mu: float = MU) -> DataFrame:
    """A row per document; ``train`` is a boolean column: which documents to learn from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), train.alias("train"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not rows:
        return spark.createDataFrame([], SCORED)
    buckets = max(16, size // BUCKET)
    folder = new_folder(spark, "asked")
    ask(docs, buckets).write.partitionBy("kind").parquet(folder)
    asked = spark.read.schema(ASKED).parquet(folder)
    answered = staged(answer(asked, buckets), "answered")
    for kind in (0, 1):  # answered: only the batches themselves are read again
        drop_folder(spark, f"{folder}/kind={kind}")
    asked = spark.read.schema(ASKED.removeprefix("kind int, ")).parquet(f"{folder}/kind=2")

    n = v = 0
    for r in answered.filter("kind = 2").select("n", "b").toLocalIterator():  # two counts a bucket
        n, v = n + r.n, v + int.from_bytes(r.b, "little")
    starts = asked.select(F.lit(2).alias("kind"), F.col("batch"), F.lit(-1).cast("long").alias("bucket"), "n", "a", "b", F.lit(None).cast("binary").alias("c"))
    replies = answered.filter("kind < 2").select("kind", "batch", "bucket", "n", "a", "b", "c")
    total = float(n + v + 1)

    def run(key, t):
        kind, bucket, size = (t.column(x).to_numpy() for x in ("kind", "bucket", "n"))
        a, b, c = (t.column(x) for x in ("a", "b", "c"))
        own = int(np.flatnonzero(kind == 2)[0])
        inverse = unsqueeze(a[own].as_py(), np.uint32, int(size[own]))
        ids, valid, train, lengths = np.frombuffer(b[own].as_py(), "<i8").reshape(4, -1)
        order, order2 = ([int(i) for i in np.argsort(bucket) if kind[i] == which] for which in (0, 1))
        counts = np.concatenate([unsqueeze(a[i].as_py(), np.int64, int(size[i])) for i in order])
        tokens = np.concatenate([unsqueeze(b[i].as_py(), np.uint64, int(size[i])) for i in order])
        first = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10((counts + 1) / total)[inverse], first)
        known = np.add.reduceat((counts > 0)[inverse].astype(np.int64), first)
        # the model: counts from levels
        c1 = middle(np.concatenate([unsqueeze(c[i].as_py(), np.uint8, int(size[i])) for i in order]))
        sequence = tokens[inverse]
        _, at = np.unique(bigrams(sequence, lengths), return_inverse=True)  # in the order of buckets, as sent
        c2 = middle(np.concatenate([unsqueeze(c[i].as_py(), np.uint8, int(size[i])) for i in order2]))[at]
        history = np.empty(len(sequence))
        history[1:] = c1[inverse[:-1]]
        history[first] = c1[np.searchsorted(tokens, END)]  # as many texts begin as end
        p1 = (c1[inverse] + 1) / total
        p = np.minimum((np.minimum(c2, history) + mu * p1) / (history + mu), 1.0)
        model = np.add.reduceat(np.log10(p), first)
        columns = [pa.array(ids, mask=valid == 0), pa.array(train == 1), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(model)]
        return pa.Table.from_arrays(columns, names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return starts.unionByName(replies).groupBy("batch").applyInArrow(run, SCORED)


def score_by_fold(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """Learn from the documents whose crc32(id) mod ``mod`` isn't ``held``; score all."""
    out = score(docs, crc_mod("doc_id", mod) != held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
