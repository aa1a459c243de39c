import math

import numpy as np

from plyset.llm.embedding_dedup import near_duplicates, quantise, tile_links


def brute(rows, threshold=0.93, kind=np.float32):
    """Every row is a node of its own, whatever its id."""
    ok = [k for k, (i, e, label) in enumerate(rows) if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    v = {k: np.array(rows[k][1], kind).astype(np.float64) for k in ok}
    unit = {k: (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()) for k, x in v.items()}
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(v[a]) == len(v[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for k in ok:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [(i, links[k], least.get(find(k), i), i is not None and least.get(find(k), i) == i) for k, (i, _, _) in enumerate(rows)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def run(df, **how):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **how).collect()), key=key)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        label = 0 if rng.random() < 0.5 else int(rng.integers(1, 4))
        if rows and rng.random() < 0.6:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.2, 0.28, 0.4]) * np.abs(base).mean()
        else:
            v = rng.normal(size=12)
        rows.append((i, [float(np.float32(x)) for x in v], label))
    copy = rows[5][1]
    rows += [(300 + i, copy, rows[5][2]) for i in range(20)]
    rows += [(i, rows[k][1], rows[k][2]) for i, k in ((7, 90), (7, 91), (8, 90), (8, 8), (250, 3))]  # ids that repeat, with other vectors
    rows += [(400, None, 0), (401, [0.0] * 12, 0), (402, [float("nan")] * 12, 0), (403, [None, 1.0], 0), (404, copy, None), (405, [], 0), (406, copy[:3], rows[5][2]), (407, [float("inf")] + copy[1:], 0), (None, copy, rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    want = sorted(brute(rows), key=key)
    for block, side in ((16, 8), (3, 2), (2048, 8)):
        assert run(df, block=block, side=side) == want
    assert near_duplicates(df.limit(0)).collect() == []


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(-200, 200)).tolist(), 1) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i][1]) * (1 + rng.normal(size=5) * 0.2)).tolist(), 1) for i in range(40)]
    rows += [(200, [1e60, 0.0], 1), (201, [1e60, 0.0], 1), (202, [1e60, 1e50], 1), (203, [1e308, -0.0], 1), (204, [-1e308, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = run(df, block=16)
    assert got == sorted(brute(rows, kind=np.float64), key=key)
    assert [r[1] for r in got if r[0] in (200, 201, 202, 203, 204)] == [3, 3, 3, 3, 0]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24)) * rng.lognormal(size=(200, 1))
    codes, scale, held, off = quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (codes.astype(int) @ codes.astype(int).T) * scale[:, None] * scale[None, :]
    bound = held[:, None] * off[None, :] + off[:, None] * (held + off)[None, :]
    assert (np.abs(near - unit @ unit.T) <= bound + 1e-12).all()
    for threshold in (0.2, 0.5):
        pairs = {(int(a), int(b)) for l, r in tile_links(x, None, threshold, side=64) for a, b in zip(l, r)}
        c = unit @ unit.T
        assert pairs == {(a, b) for a in range(200) for b in range(a + 1, 200) if c[a, b] >= threshold}
