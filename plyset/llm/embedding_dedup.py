"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors that are equal (label and components) form a class with a multiplicity; classes of a label
are dealt by a hash of their id into blocks of about ``block`` (and ``BLOCK_BYTES`` at most). Up to ``SIDE`` blocks make a side,
and every two sides of a label one unit of work: a unit holds the blocks of two sides, compares
every two of them as a tile, and each block is sent once for each side, not for each tile. So a label
that holds a third of all vectors becomes many units, each of bounded memory. Within a tile, unit
vectors quantised to int8 (one scale per vector) are multiplied first.
With ``u = s*q + e`` the exact cosine lies within ``|s*q| |e'| + |e| |s'*q'| + |e| |e'|`` of the
quantised one (Cauchy-Schwarz, from the measured residual norms); pairs surely below the threshold
are dropped, pairs surely above are links, and only those between are recomputed from the vectors
in double precision. The integer products are exact: they are done in float32 while
``127*127*dimension`` stays below 2**24, else in float64. Components keep the input's precision
(float or double) and are scaled by powers of two first, so that no square overflows.

A unit returns, for each class with a link, how many vectors it links with there and the smallest
class in its part of the unit's graph: rows in proportion to the unit's vectors, never its pairs.
A class is known by its smallest id and a hash of its content, since ids may repeat.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label or id, link with nothing (n_links 0, component: their own id); vectors of
unlike dimension don't link. A null id has a null component and isn't kept. Repeated rows count as
vectors of their own, and so do unlike vectors of one id: each has its own links and component. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.common import drop_staged, staged
from plyset.llm.graph import components

BLOCK, BLOCK_BYTES, SIDE = 2048, 8 << 20, 8
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, and norms of what they leave out; rows are scaled already."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    held = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(held, axis=1), np.linalg.norm(unit - held, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, side: int = 512):
    """Index pairs of linked rows, part by part: of x with y, or within x (i < j) where y is None."""
    exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
    qx, sx, hx, ex = quantise(x)
    qy, sy, hy, ey = (qx, sx, hx, ex) if y is None else quantise(y)
    other = x if y is None else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(other, axis=1)
    for i in range(0, len(x), side):
        for j in range(i if y is None else 0, len(other), side):
            a, b = slice(i, i + side), slice(j, j + side)
            near = (qx[a].astype(exact) @ qy[b].astype(exact).T).astype(np.float64) * sx[a, None] * sy[None, b]
            off = hx[a, None] * ey[None, b] + ex[a, None] * (hy[b] + ey[b])[None, :] + SLACK
            if y is None and i == j:
                near[np.tri(*near.shape, dtype=bool)] = -np.inf
            sure = near - off >= threshold
            left, right = np.nonzero((near + off >= threshold) & ~sure)
            keep = np.empty(len(left), bool)
            for k in range(0, len(left), 1 << 14):
                l, r = left[k : k + (1 << 14)] + i, right[k : k + (1 << 14)] + j
                keep[k : k + (1 << 14)] = np.einsum("ij,ij->i", x[l], other[r]) / (nx[l] * ny[r]) >= threshold
            l, r = np.nonzero(sure)
            yield np.concatenate([l, left[keep]]) + i, np.concatenate([r, right[keep]]) + j


def smallest_reach(n: int, l: np.ndarray, r: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Merge the links into ``root`` (a forest of smaller indices); returns it flattened."""
    while len(l):
        a, b = root[l], root[r]
        differ = a != b
        l, r, a, b = l[differ], r[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles times powers of two, with a largest component between a half and one: cosines don't change."""
    x = x.astype(np.float64)
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -power[:, None])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors``; see the module."""
    double = vectors.schema["embedding"].dataType.simpleString() not in ("array<float>",)
    kind, number = ("array<double>", "<f8") if double else ("array<float>", "<f4")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast(kind))
    # 0.0 and -0.0 are equal and become one class
    v = v.withColumn("embedding", F.transform("embedding", lambda c: F.when(c == 0, F.lit(0.0).cast("double" if double else "float")).otherwise(c)))
    finite = F.expr("forall(embedding, c -> c is not null and not isnan(c) and abs(c) < float('inf')) and exists(embedding, c -> c <> 0)")
    v = v.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False)))
    key = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding", "label").alias("k2")]
    ids = v.select("vec_id", "ok", *key)
    classes = v.filter("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = staged(classes.select("label", "embedding", F.size("embedding").alias("dim"), "rep", "m", *key), "classes")

    # blocks: a label's classes by a hash of their content; sides of blocks, fewer to a side while a label has few
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * int(number[-1])))))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / most)).drop("n")
    sizes = sizes.withColumn("per", F.least(F.lit(side), F.ceil(F.col("blocks") / 16)).cast("long")).withColumn("sides", F.ceil(F.col("blocks") / F.col("per")).cast("long"))
    sizes = staged(sizes, "sizes")
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("blk", F.pmod(F.xxhash64("rep", "k1"), "blocks"))
    label_type = dict(classes.dtypes)["label"]

    def bundle(keys, t):
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        fields = [flat.astype(number).tobytes(), *(t.column(c).to_numpy().astype("<i8").tobytes() for c in ("rep", "k1", "m"))]
        columns = [pa.array([k.as_py()], k.type) for k in keys] + [pa.array([f], pa.binary()) for f in fields]
        return pa.Table.from_arrays(columns, names=["label", "dim", "blk", "per", "sides", "x", "rep", "k", "m"])

    shape = f"label {label_type}, dim int, blk long, per long, sides long, x binary, rep binary, k binary, m binary"
    bundled = dealt.select("label", "dim", "blk", "per", "sides", "embedding", "rep", "k1", "m").groupBy("label", "dim", "blk", "per", "sides").applyInArrow(bundle, shape)
    blocks = staged(bundled, "blocks")
    # each block goes to the units of its side with every side
    own = F.floor(F.col("blk") / F.col("per"))
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    sent = blocks.withColumn("own", own).withColumn("other", to)
    sent = sent.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "blk", "x", "rep", "k", "m")
    n_tasks = max(8, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = sent.repartition(n_tasks, "label", "dim", "i", "j")

    def run(keys, t):
        d, i, j = (k.as_py() for k in keys[1:])
        t = t.sort_by("blk")
        sides = t.column("own").to_pylist()
        load = lambda name, kind: [np.frombuffer(b.as_py(), kind) for b in t.column(name)]
        xs, reps, ks, ms = load("x", number), load("rep", "<i8"), load("k", "<i8"), load("m", "<i8")
        rep, k, m = (np.concatenate(a) for a in (reps, ks, ms))
        first = np.concatenate([[0], np.cumsum([len(r) for r in reps])])
        order = np.lexsort((k, rep))
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root, count = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        for a in range(len(xs)):
            if sides[a] != i:
                continue
            x = scaled(xs[a].reshape(-1, d))
            # within a side every two blocks, a block with itself included; between sides each with each
            for b in range(a, len(xs)) if i == j else [b for b in range(len(xs)) if sides[b] == j]:
                y = None if b == a else scaled(xs[b].reshape(-1, d))
                for l, r in tile_links(x, y, threshold):
                    l, r = l + first[a], r + first[b]
                    count += np.bincount(l, m[r], len(rep)).astype(np.int64) + np.bincount(r, m[l], len(rep)).astype(np.int64)
                    root = smallest_reach(len(rep), place[l], place[r], root)
        hit = np.flatnonzero(count)
        top = order[root[place[hit]]]
        columns = [pa.array(rep[hit]), pa.array(k[hit]), pa.array(count[hit]), pa.array(rep[top]), pa.array(k[top])]
        return pa.Table.from_arrays(columns, names=["rep", "k", "n", "root", "rk"])

    found = staged(sent.groupBy("label", "dim", "i", "j").applyInArrow(run, "rep long, k long, n long, root long, rk long"), "found")
    node = lambda a, b: F.struct(F.col(a).alias("rep"), F.col(b).alias("k"))
    counted = found.groupBy("rep", "k").agg(F.sum("n").alias("n"))
    comp = components(found.select(node("rep", "k").alias("a"), node("root", "rk").alias("b")))
    comp = comp.select("node.rep", "node.k", F.col("component.rep").alias("component"))
    of_class = classes.select("k1", "k2", "rep", F.col("k1").alias("k"), "m").join(counted, ["rep", "k"], "left").join(comp, ["rep", "k"], "left")
    of_class = of_class.select("k1", "k2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    held = staged(of_class, "of_class").withColumn("ok", F.lit(True))
    drop_staged(classes, sizes, blocks, found)
    out = ids.join(held, ["k1", "k2", "ok"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
