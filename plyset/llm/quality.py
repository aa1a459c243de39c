"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

1. ``statistics``: counts and ratios of whole texts, all Spark expressions.
2. Small trees are boosted on the statistics of a sample of labelled documents (at most about
   ``SAMPLE`` rows, chosen by a hash of their ids); every path from a root to a node becomes a rule,
   a conjunction of bounds on statistics.
3. Weights of the rules are fitted by logistic regression with a lasso penalty (proximal gradient
   with momentum); most become zero.
4. ``compiled`` writes the remaining rules as one Spark expression, so that scoring is a projection
   over the documents: no shuffle, no Python, nothing broadcast.

Labels, languages, sources and ids are never inputs of a score.

Defined results: null texts are scored as empty ones, whose statistics are all 0; rows without a
label aren't learnt from, and of several rows of one labelled id one (that with the least statistics) is; if labels of one kind only (or none) are known, every score is that
kind's share with one example of each added; repeated rows are scored each; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyset.llm.common import crc_mod, drawn

SAMPLE = 8_000
TREES, DEPTH, RATE, LEAST, BINS = 24, 3, 0.3, 8, 32
LASSO, STEPS = 0.002, 300

STATISTICS = ("chars", "words", "word_length", "distinct_words", "lines", "distinct_lines", "words_per_line", "upper", "symbols", "digits", "points")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text as Spark columns, by name; counts first, then ratios of counts."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(t), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    return {
        "chars": F.char_length(t).cast("double"), "_words": F.size(words).cast("double"), "_distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "_lines": F.when(t == "", 0).otherwise(F.size(lines)).cast("double"), "_distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "_space": F.regexp_count(t, F.lit(r"[\x09-\x0D\x20]")).cast("double"), "_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"),
        "_symbols": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")).cast("double"), "_digits": F.regexp_count(t, F.lit(r"\p{N}")).cast("double"),
        "_points": F.regexp_count(t, F.lit("[.,]")).cast("double"),
    }


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    counts = docs.select(*keep, *(c.alias(n) for n, c in statistics(F.col("text")).items()))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select(
        *keep, "chars", F.col("_words").alias("words"), F.when(F.col("_words") > 0, (F.col("chars") - F.col("_space")) / F.col("_words")).otherwise(0.0).alias("word_length"),
        part("_distinct_words", "_words").alias("distinct_words"), F.col("_lines").alias("lines"), part("_distinct_lines", "_lines").alias("distinct_lines"),
        part("_words", "_lines").alias("words_per_line"), *(part(f"_{n}", "chars").alias(n) for n in ("upper", "symbols", "digits", "points")),
    )


# -- rules ------------------------------------------------------------------------------------

#: A rule: for some statistics, a lower bound (exclusive) and an upper bound (inclusive).
Rule = tuple[tuple[int, float, float], ...]


def grow(codes: np.ndarray, edges: list[np.ndarray], target: np.ndarray, hess: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on binned statistics: the rules of all its nodes, and its prediction."""
    n, p = codes.shape
    rules: list[Rule] = []
    value = np.zeros(n)
    nodes: list[tuple[np.ndarray, dict[int, tuple[float, float]], int]] = [(np.arange(n), {}, 0)]
    while nodes:
        rows, path, level = nodes.pop()
        if level:
            rules.append(tuple((f, *b) for f, b in sorted(path.items())))
        total, weight = target[rows].sum(), hess[rows].sum()
        value[rows] = total / (weight + 1.0)
        if level == depth or len(rows) < 2 * LEAST:
            continue
        best, gain = None, 1e-6
        for f in range(p):
            size = len(edges[f]) + 1
            g = np.cumsum(np.bincount(codes[rows, f], target[rows], size))[:-1]
            h = np.cumsum(np.bincount(codes[rows, f], hess[rows], size))[:-1]
            k = np.cumsum(np.bincount(codes[rows, f], minlength=size))[:-1]
            score = g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
            score[(k < LEAST) | (len(rows) - k < LEAST)] = 0
            if len(score) and score.max() > gain:
                best, gain = (f, int(score.argmax())), score.max()
        if best:
            f, cut = best
            low, high = path.get(f, (-np.inf, np.inf))
            below = codes[rows, f] <= cut
            at = float(edges[f][cut])
            nodes += [(rows[below], path | {f: (low, min(high, at))}, level + 1), (rows[~below], path | {f: (max(low, at), high)}, level + 1)]
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, high in rule:
        out &= (x[:, f] > low) & (x[:, f] <= high)
    return out


def extract(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules of boosted trees, without repeats."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    score = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        found, value = grow(codes, edges, y - p, p * (1 - p), DEPTH)
        rules.update(dict.fromkeys(found))
        score += RATE * np.clip(value, -4, 4)
    return list(rules)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty on standardised columns."""
    share = a.mean(axis=0)
    spread = np.maximum(np.sqrt(share * (1 - share)), 1e-3)
    z = ((a - share) / spread).astype(np.float32)
    v = np.random.default_rng(0).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * float(np.linalg.norm(z @ v) ** 2) / len(y) + 0.25)
    w, b = np.zeros(z.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    past_w, past_b = w, b
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - past_w), b + m * (b - past_b)
        past_w, past_b = w, b
        r = (1 / (1 + np.exp(-(z @ vw.astype(np.float32) + vb))) - y) / len(y)
        step = vw - rate * (z.T @ r.astype(np.float32))
        w, b = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), vb - rate * float(r.sum())
    w = w / spread
    return b - float(share @ w), w


Model = tuple[float, list[tuple[Rule, float]]]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    rules = extract(x, y)
    if not rules:
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    b, w = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32), y)
    return b, [(r, float(v)) for r, v in zip(rules, w) if v != 0]


def compiled(model: Model) -> Column:
    """The model's probability as a column over the statistics."""
    b, rules = model
    total = F.lit(float(b))
    for rule, weight in rules:
        test = F.lit(True)
        for f, low, high in rule:
            c = F.col(STATISTICS[f])
            test = test & (c > low) if np.isfinite(low) else test
            test = test & (c <= high) if np.isfinite(high) else test
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a sample of labelled rows: (doc_id, label) with label 0 or 1."""
    labels = labels.select("doc_id", "label").filter("doc_id is not null and label is not null")
    n = labels.count()
    # about ``sample`` rows of two numbers: a fixed bound, so they may be broadcast; equal rows count once
    some = labels.filter(drawn(F.xxhash64("doc_id", "label"), F.lit(min(1.0, sample / max(1, n))))).distinct()
    found = with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "doc_id", "label")
    # an id can have many rows: one of them is learnt from, so that no more than the sample is collected
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "label", "s.*")
    rows = found.orderBy("doc_id", "label").collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.label for r in rows], np.float64))


def score_by_fold(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never read."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter(crc_mod("doc_id", mod) != held)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = learn(docs, known)
    out = with_statistics(docs, "doc_id").select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), compiled(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
