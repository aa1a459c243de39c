"""Language identification in two steps: the family first, then one-versus-one machines within it.

Features are hashed byte bigrams and trigrams of the lower-cased text (runs of anything but letters
are one space), as square roots of counts at unit length. Families are told apart by linear support
vector machines one against the rest; the languages of a family by one for each pair, whose votes
(then margins) decide. All machines minimise the squared hinge loss by dual coordinate descent.

Learning takes a bounded sample: about ``SAMPLE`` documents of each language (fewer, where more than
``MOST / SAMPLE`` languages share ``MOST``), chosen by a hash of their rows at a rate that follows
the count, equal rows once; their feature vectors (without zeros) are collected, not their texts. Scoring is one pass
over whole texts in batches: a histogram and a product with a matrix of all machines' weights. The
model is a matrix of ``DIMENSIONS`` by the number of machines.

The score is the family's probability times the weakest pair's, as logistic functions of margins.

Defined results: ``und`` with score 0 for null texts and texts without any letter, and for all if
nothing could be learnt; ids may be null and repeat, rows may be equal; extra columns are ignored, or
carried along under any name as one struct (``predict``).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.common import as_row, crc_mod, drawn
from plyset.llm.text import batches, string_bytes

SAMPLE, MOST, DIMENSIONS = 350, 8_000, 8192
SHARPNESS = 4.0
UNKNOWN = "und"

#: Families by language code: fixed values. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"), "semitic": ("ar", "he", "mt", "am"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

# letters by byte: 0 is no letter, a-z (either case) 1-26, bytes of other characters 27 and up
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)


def features(column: pa.Array) -> np.ndarray:
    """One row of unit length per text."""
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if not len(data):
        return out
    code = _CODE[data]
    # one space between texts and for each run of other bytes
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = (code > 0) | np.r_[True, code[:-1] > 0] | first[:-1]
    code, at = code[keep], np.flatnonzero(keep)
    doc = np.searchsorted(offsets, at, "right") - 1
    for order, seed in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(code) < order:
            continue
        h = np.zeros(len(code) - order + 1, np.uint32)
        same = doc[: len(h)] == doc[order - 1 :]
        for k in range(order):
            h = h * np.uint32(155) + code[k : len(h) + k]
        h = (h * np.uint32(seed)) >> np.uint32(19)
        np.add(out, np.bincount(doc[: len(h)][same] * DIMENSIONS + h[same].astype(np.int64), minlength=n * DIMENSIONS).reshape(n, -1), out=out, casting="unsafe")
    np.sqrt(out, out=out)
    size = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(size, 1e-9)[:, None]
    return out


class Rows:
    """Feature vectors without their zeros: a sample takes a fraction of its matrix, and one row at a time is whole."""

    def __init__(self, parts: list[bytes]):
        sizes = [len(b) // 6 for b in parts]
        self.of = [np.frombuffer(b, np.float32, n) for b, n in zip(parts, sizes)]
        self.at = [np.frombuffer(b, np.uint16, n, 4 * n) for b, n in zip(parts, sizes)]
        self.row, self.last = np.zeros(DIMENSIONS, np.float32), 0

    def __len__(self) -> int:
        return len(self.at)

    def whole(self, i: int) -> np.ndarray:
        """Row ``i``, until the next one is asked for."""
        self.row[self.at[self.last]] = 0
        self.row[self.at[i]] = self.of[i]
        self.last = i
        return self.row

    @staticmethod
    def packed(x: np.ndarray) -> list[bytes]:
        """Each row of a matrix as bytes: its values but zeros, then their columns."""
        return [row[k].tobytes() + k.astype(np.uint16).tobytes() for row in x for k in (np.flatnonzero(row),)]


def machine(x: Rows, rows: np.ndarray, y: np.ndarray, cost: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine on some rows (y: -1 or 1 for each), classes weighted alike."""
    w = np.zeros(DIMENSIONS, np.float32)
    alpha = np.zeros(len(y))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * weight)
    square = diagonal.copy()
    for i, k in enumerate(rows):
        own = x.whole(k)[None]
        square[i] += np.einsum("ij,ij->i", own, own)[0].astype(np.float64)
    order = np.random.default_rng(11)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            k = rows[i]
            gradient = y[i] * float(x.whole(k) @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w[x.at[k]] += np.float32((new - alpha[i]) * y[i]) * x.of[k]
                alpha[i] = new
    return w


class Model:
    """Families with their languages, and the weights of all machines as the columns of one matrix."""

    def __init__(self, x: Rows | np.ndarray, langs: np.ndarray):
        x = x if isinstance(x, Rows) else Rows(Rows.packed(x))
        self.langs = sorted(set(langs.tolist()))
        of = np.array([FAMILY.get(v, v) for v in langs])
        self.families = {f: [v for v in self.langs if FAMILY.get(v, v) == f] for f in sorted(set(of.tolist()))}
        columns = []
        names = list(self.families)
        if len(names) > 1:
            columns += [machine(x, np.arange(len(x)), np.where(of == f, 1.0, -1.0)) for f in names]
        self.pairs: dict[str, list[tuple[int, int]]] = {}
        for f, own in self.families.items():
            self.pairs[f] = list(itertools.combinations(range(len(own)), 2))
            for a, b in self.pairs[f]:
                some = np.flatnonzero((langs == own[a]) | (langs == own[b]))
                columns.append(machine(x, some, np.where(langs[some] == own[a], 1.0, -1.0)))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``langs`` and scores."""
        margins = (x @ self.weights).astype(np.float64)
        sure = lambda m: 1 / (1 + np.exp(-SHARPNESS * m))
        names = list(self.families)
        n, at = len(x), len(names) if len(names) > 1 else 0
        family, score = np.zeros(n, np.int64), np.ones(n)
        if at:
            family = margins[:, :at].argmax(axis=1)
            ranked = np.sort(margins[:, :at], axis=1)
            score = sure((ranked[:, -1] - ranked[:, -2]).astype(np.float64))
        lang = np.zeros(n, np.int64)
        for k, (f, own) in enumerate(self.families.items()):
            rows = np.flatnonzero(family == k)
            votes, weakest = np.zeros((len(rows), len(own))), np.full((len(rows), len(own)), np.inf)
            for a, b in self.pairs[f]:
                m = margins[rows, at]
                at += 1
                votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
                votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
                weakest[:, a], weakest[:, b] = np.minimum(weakest[:, a], m), np.minimum(weakest[:, b], -m)
            best = votes.argmax(axis=1)
            lang[rows] = np.array([self.langs.index(v) for v in own])[best]
            if len(own) > 1:
                score[rows] *= sure(weakest[np.arange(len(rows)), best])
        return lang, score


def vectors(docs: DataFrame) -> DataFrame:
    def run(stream):
        for part in batches(stream, "text", 1 << 20):
            for lo in range(0, part.num_rows, 128):
                some = part.slice(lo, 128)
                x = features(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("doc_id").combine_chunks(), some.column("lang").combine_chunks(), pa.array(Rows.packed(x), pa.binary())], names=["doc_id", "lang", "x"])

    return docs.select("doc_id", "lang", F.lower("text").alias("text")).mapInArrow(run, "doc_id long, lang string, x binary")


def learn(docs: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Model | None:
    """Fit on about ``sample`` documents of each language in ``docs`` (doc_id, text, lang), about ``most`` in all."""
    docs = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    each = min(sample, max(1, most // len(counts)))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, rate double")
    some = docs.join(F.broadcast(rates), "lang").filter(drawn(F.xxhash64("doc_id", "lang", "text"), F.col("rate")))
    some = vectors(some.select("doc_id", "text", "lang").distinct())
    rows = some.collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.x))
    if not rows:
        return None
    return Model(Rows([bytes(r.x) for r in rows]), np.array([r.lang for r in rows]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (all columns of ``docs`` as one struct), lang_pred and score."""
    source = docs.select(as_row(docs).alias("row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.lower("text").alias("lower"))
    if model is None:
        return source.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = source.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(stream):
        model = held.value
        for part in batches(stream, "lower", 1 << 20):
            for lo in range(0, part.num_rows, 128):
                some = part.slice(lo, 128)
                lang, score = model.predict(features(some.column("lower")))
                letters = some.column("letters").to_numpy()
                names = np.where(letters, np.array([*model.langs], object)[lang], UNKNOWN)
                columns = [some.column("row").combine_chunks(), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def predict_by_fold(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; text and lang of the held-out fold are never learnt from."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = learn(docs.filter(crc_mod("doc_id", mod) != held))
    out = predict(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "lang_pred", "score")
