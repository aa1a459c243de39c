"""Best-fit packing by bin completion: documents as pieces of token sequences of fixed capacity.

A document's pieces have at most ``capacity`` tokens, so all that the search needs is how many
pieces there are of each length: at most ``capacity`` numbers, whatever the corpus. The driver
searches on these counts; rows never leave the executors. The best-fit decreasing solution is the
first incumbent. The search takes the longest length left and enumerates the undominated fillings of
the rest of its sequence, all those whose waste an improvement could still afford, least waste first
(lazily, so only those that are tried are made); it prunes by lower bounds on the sequences needed.

The search broadens: rounds that try at most 1, 2, 4 .. fillings at each node, each as often as the
counts allow, and a last one that tries every filling once at a time, which is exact. ``effort``
bounds the steps of all rounds together (by default in proportion to the number of distinct lengths);
when it runs out, the best packing met stands: best-fit decreasing at worst, optimal if it reaches
the lower bound. A found packing is at most a few thousand different fillings (each uses up a length
or splits a group), again a bound by ``capacity`` alone, and is broadcast as ranges of ranks: the k-th
piece of a length finds its sequence by binary search.

Defined results: null text is empty and gives one piece (the closing token); repeated rows are
packed each; ids may be null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyset.llm.common import staged
from plyset.llm.text import batches
from plyset.llm.tokens import encoder

#: Steps of the search (a node counts ``NODE`` of them): so many for each distinct length, and at least so many.
STEPS, LEAST_STEPS, NODE = 1000, 400_000, 40
#: Fillings of more pieces aren't tested for dominance: they stay, which costs steps and loses nothing.
TESTED = 10
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBERED = PIECES + ", task int, nth long"


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: (filling, how many sequences have it)."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # room left -> fillings with that room

    def put(room: int, filling: tuple, n: int) -> None:
        if n:
            groups.setdefault(room, []).append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in groups if r >= length):
            if not left:
                break
            each = room // length
            kept = []
            for filling, n in groups.pop(room):
                full = min(n, left // each)
                put(room - each * length, (*filling, (length, each)), full)
                left -= full * each
                n -= full
                if n and left:  # fewer than a whole share are left
                    put(room - left * length, (*filling, (length, left)), 1)
                    n, left = n - 1, 0
                if n:
                    kept.append((filling, n))
            if kept:
                groups.setdefault(room, []).extend(kept)
        each = capacity // length
        put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each),), 1)
    return [(dict(filling), n) for found in groups.values() for filling, n in found]


def dominated(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the pieces of ``small`` can be laid into the pieces of ``large``, several into one."""

    def lay(k: int, room: list[int]) -> bool:
        if k == len(small):
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= small[k] and r not in tried:
                tried.add(r)
                room[i] -= small[k]
                if lay(k + 1, room):
                    return True
                room[i] += small[k]
        return False

    return sum(small) <= sum(large) and lay(0, list(large))


class Effort:
    """Steps that are left to a search."""

    def __init__(self, steps: int):
        self.left = steps

    def take(self, n: int = 1) -> bool:
        self.left -= n
        return self.left >= 0


def summing(total: int, values: list[int], have: list[int], effort: Effort):
    """All multisets of values (ascending, each at most as often as it is there) with that sum, longest pieces first."""
    dead: set[tuple[int, int]] = set()  # sums that the first so many values can't make

    def walk(rest: int, top: int, taken: tuple[int, ...]):
        top = min(top, bisect.bisect_right(values, rest) - 1)
        if top < 0 or (rest, top) in dead:
            return
        found = False
        for k in range(top, -1, -1):
            v = values[k]
            for m in range(min(have[k], rest // v), 0, -1):
                if not effort.take():
                    return
                if m * v == rest:
                    found = True
                    yield (*taken, *[v] * m)
                elif k:
                    for f in walk(rest - m * v, k - 1, (*taken, *[v] * m)):
                        found = True
                        yield f
        if not found and effort.left >= 0:
            dead.add((rest, top))

    yield from walk(total, len(values) - 1, ())


def fillings(room: int, lengths: np.ndarray, counts: np.ndarray, waste: int, effort: Effort):
    """The undominated ways to fill ``room`` but for ``waste``, least waste first. ``lengths`` ascend; counts are what is left."""
    alive = np.flatnonzero((counts > 0) & (lengths <= room))
    values, have = lengths[alive].tolist(), counts[alive].tolist()
    if sum(v * n for v, n in zip(values, have)) <= room:  # all that is left fits
        yield tuple(v for v, n in zip(reversed(values), reversed(have)) for _ in range(n))
        return
    kept: list[tuple[int, ...]] = []
    for total in range(room, max(room - waste, 0) - 1, -1):
        for f in summing(total, values, have, effort) if total else [()]:
            used = Counter(f)
            if any(used[v] < n for v, n in zip(values, have) if v <= room - total):
                continue  # another piece fits
            if len(f) > TESTED or not any(len(g) <= TESTED and dominated(f, g) for g in kept):
                kept.append(f)
                yield f
        if effort.left < 0:
            return


def bound(lengths: np.ndarray, left: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: by volume, or by pieces over half with what fits beside none."""
    total = int((lengths * left).sum())
    volume, most_of = -(-total // capacity), 0
    big = lengths * 2 > capacity
    n_big = int(left[big].sum())
    for k in {0, *np.linspace(0, capacity // 2, 9).astype(int).tolist()}:
        alone = lengths > capacity - k
        mid = big & ~alone
        small = (lengths >= k) & ~big
        spare = int(((capacity - lengths) * left)[mid].sum())
        rest = int((lengths * left)[small].sum())
        most_of = max(most_of, n_big + max(0, -(-(rest - spare) // capacity)))
    return max(volume, most_of)


def steps_for(lengths: int) -> int:
    return max(LEAST_STEPS, STEPS * lengths)


Packing = list[tuple[dict[int, int], int]]


def complete(counts: dict[int, int], capacity: int, effort: int | None = None) -> Packing:
    """Bin completion: fillings with multiplicities that hold all pieces, in few sequences; see the module."""
    counts = {n: k for n, k in counts.items() if k}
    left = Effort(steps_for(len(counts)) if effort is None else effort)
    best = best_fit(counts, capacity)
    lengths = np.array(sorted(counts), np.int64)
    pieces = np.array([counts[int(n)] for n in lengths], np.int64)
    least = bound(lengths, pieces, capacity) if counts else 0
    width: int | None = 1
    while sum(n for _, n in best) > least and left.left > 0:
        best, cut = search(lengths, pieces, capacity, best, least, width, left)
        if width is None:
            break
        width = 2 * width if cut else None
    return best


def search(lengths: np.ndarray, pieces: np.ndarray, capacity: int, best: Packing, least: int, width: int | None, effort: Effort) -> tuple[Packing, bool]:
    """One round, depth first: the best packing met, and whether a node had more fillings than ``width``."""
    fewest = sum(n for _, n in best)
    left, used, path, cut = pieces, 0, [], False
    # without recursion: each level keeps what it has not tried yet
    stack: list[tuple] = []
    while fewest > least and effort.take(NODE):
        pending = iter(())
        if not left.any():
            if used < fewest:
                fewest, best = used, path
        elif used + bound(lengths, left, capacity) < fewest:
            top = int(np.flatnonzero(left)[-1])
            rest = left.copy()
            rest[top] -= 1
            waste = (fewest - 1 - used) * capacity - int((lengths * left).sum())
            pending = fillings(capacity - int(lengths[top]), lengths, rest, waste, effort)
        stack.append((left, used, path, pending, 0))
        filling = None
        while stack and filling is None:
            left, used, path, pending, tried = stack.pop()
            filling = next(pending, None)
            if filling is not None and width is not None and tried == width:
                cut, filling = True, None
        if filling is None:
            break
        stack.append((left, used, path, pending, tried + 1))
        filling = Counter((int(lengths[np.flatnonzero(left)[-1]]), *filling))
        at = {v: int(np.searchsorted(lengths, v)) for v in filling}
        times = 1 if width is None else min(int(left[at[v]]) // m for v, m in filling.items())
        left = left.copy()
        for v, m in filling.items():
            left[at[v]] -= m * times
        used, path = used + times, [*path, (dict(filling), times)]
    return best, cut


def slots(packing: list[tuple[dict[int, int], int]], capacity: int, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: from rank ``lo`` on, ``each`` pieces go to each sequence from ``base`` on, at ``offset``."""
    rows, base, rank = [], 0, dict.fromkeys(counts, 0)
    for pieces, times in packing:
        offset = 0
        for length in sorted(pieces, reverse=True):
            rows.append((length, rank[length], pieces[length], base, offset))
            rank[length] += pieces[length] * times
            offset += length * pieces[length]
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {k: a[:, i].copy() for i, k in enumerate(("length", "lo", "each", "base", "offset"))}


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, close: int = 0) -> DataFrame:
    """Pieces of each document with their ids' crc32, each with its task and its number among the task's pieces of that length.

    Only a document's first piece can be shorter than the capacity.
    """
    with open(tokenizer, "rb") as f:  # a few MB at most; the executors get its content
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(stream):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for part in batches(stream, "text", 2 << 20):
            enc = encoder(spec.value)
            ids_of, texts = part.column("doc_id").to_pylist(), part.column("text")
            out: list[tuple] = []
            for doc, text in zip(ids_of, texts):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(close)).astype("<u4")
                at = 0
                end = (len(ids) - 1) % capacity + 1
                k = 0
                while at < len(ids):
                    nth = seen[end - at] = seen.get(end - at, -1) + 1
                    out.append((doc, k, at, end - at, zlib.crc32(ids[at:end].tobytes()), task, nth))
                    at, end, k = end, end + capacity, k + 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, NUMBERED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, close: int = 0, effort: int | None = None) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``; see the module."""
    spark = docs.sparkSession
    # A piece's rank among those of its length: its number within the task that cut it, after the tasks before.
    # So nothing is sorted, and what meets in a join is one task's pieces of a length, however many have that length.
    pieces = staged(pieces_of(docs, tokenizer, capacity, close), "pieces")
    of_task = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "of_task")
    by_length = {r[0]: r[1] for r in of_task.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    held = spark.sparkContext.broadcast(slots(complete(by_length, capacity, effort), capacity, by_length))
    before = of_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before.hint("shuffle_hash"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("_rank"))

    def place(stream):
        s = held.value
        first = np.flatnonzero(np.r_[True, s["length"][1:] != s["length"][:-1]]) if len(s["length"]) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(s["length"])]
        of = {int(s["length"][i]): (int(i), int(j)) for i, j in zip(first, last)}
        for b in stream:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for v in np.unique(length):
                i, j = of[int(v)]
                own = length == v
                at[own] = i + np.searchsorted(s["lo"][i:j], rank[own], "right") - 1
            k = rank - s["lo"][at]
            columns = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(s["base"][at] + k // s["each"][at]), pa.array(s["offset"][at] + k % s["each"][at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
