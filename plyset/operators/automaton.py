"""Layered automata of sets, as tables: sizes, state counts and products without enumerating positions.

``layers[i]`` has a row per state of layer i: ``state`` and ``next``, the array of states that the
characters lead to. Two constants, REJECT and ACCEPT, stand in every layer. A state's id is a hash of
its ``next`` array (uniform constant rows collapse to the constant), so automata of equal sets have
equal roots: comparing roots compares sets. Every state of a layer is met on some path from the root,
and, not being REJECT, leads to some accepted position.

What reads an automaton works on whole tables, a join for each layer: membership of many positions, the
ranks of positions and the positions at ranks (counts of rests by state say where to go), bounds. All
rows begin at one state, so a layer is broadcast if it is small (``BROADCAST_CELLS``), and salted otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.functions import predicates as P
from plyset.operators.positions import PositionSet
from plyset.shape import Shape
from plyset.storage import materialise, materialise_once

REJECT, ACCEPT = "0", "1"
#: Rests of a predicate at one slot that the driver holds while it builds an automaton from it.
MOST_RESTS = 1_000_000
#: A layer with at most so many arrows is broadcast to the rows that walk through it; some 70 bytes each.
BROADCAST_CELLS = 200_000
#: Copies of a larger layer, so that rows at one state spread.
SALTS = 16
#: Ranks and sizes are exact below.
EXACT = 10**37


def _state_of(next_: str = "next"):
    first = F.element_at(next_, 1)
    uniform = first.isin(REJECT, ACCEPT) & F.forall(next_, lambda s: s == first)
    return F.when(uniform, first).otherwise(F.sha2(F.concat_ws(",", next_), 256))


class Automaton:
    def __init__(self, spark: SparkSession, shape: Shape, root: str, layers: list[DataFrame]):
        self.spark, self.shape, self.root, self.layers = spark, shape, root, layers
        self._sizes: list[int] | None = None
        self._ranked: list[DataFrame] | None = None

    @classmethod
    def of(cls, s: PositionSet) -> Automaton:
        """Bottom up: rows with equal prefixes meet, and equal rests become one state. Complements swap the constants."""
        rows = s.rows if s.where is None else s.frame()
        names = s.shape.columns
        level = rows.withColumn("_state", F.lit(ACCEPT))
        layers: list[DataFrame] = []
        for i in range(len(names) - 1, -1, -1):
            pairs = F.map_from_entries(F.collect_list(F.struct(F.col(names[i]).cast("int"), "_state")))
            grouped = level.groupBy(*names[:i]).agg(pairs.alias("_to")) if i else level.agg(pairs.alias("_to"))
            next_ = F.transform(F.sequence(F.lit(0), F.lit(s.shape.sizes[i] - 1)), lambda c: F.coalesce(F.try_element_at("_to", c), F.lit(REJECT)))
            level = materialise(grouped.withColumn("next", next_).withColumn("_state", _state_of()).drop("_to"), f"layer{i:03d}")
            layers.insert(0, level.filter(~F.col("_state").isin(REJECT, ACCEPT)).select(F.col("_state").alias("state"), "next").distinct())
            level = level.drop("next")
        root = level.first()["_state"] if names else (REJECT if rows.isEmpty() else ACCEPT)
        out = cls(s.spark, s.shape, root, layers)
        return out.complement() if s.where is None and s.negated else out

    @classmethod
    def matching(cls, spark: SparkSession, shape: Shape, where: P.Predicate) -> Automaton:
        """From a predicate, without a position: top down what is left to test after each slot, bottom up the states."""
        levels, now = [], [where.given({})]
        for i, size in enumerate(shape.sizes):
            steps = {p: [p.given({i: c}) for c in range(size)] for p in now}
            levels.append(steps)
            now = list(dict.fromkeys(q for to in steps.values() for q in to))
            if len(now) > MOST_RESTS:
                raise ValueError(f"more than {MOST_RESTS} different rests of the predicate at slot {i}")
        names = {P.ALWAYS: ACCEPT, P.NEVER: REJECT}
        layers: list[DataFrame] = []
        for i in range(len(shape) - 1, -1, -1):
            rows, own = {}, {P.ALWAYS: ACCEPT, P.NEVER: REJECT}
            for p, to in levels[i].items():
                next_ = [names[q] for q in to]
                uniform = next_[0] in (REJECT, ACCEPT) and len(set(next_)) == 1
                own[p] = next_[0] if uniform else hashlib.sha256(",".join(next_).encode()).hexdigest()
                if not uniform:
                    rows[own[p]] = next_
            layers.insert(0, spark.createDataFrame(list(rows.items()), "state string, next array<string>"))
            names = own
        return cls(spark, shape, names[where.given({})], layers)

    def change(self, changes: dict[int, tuple[int, int]]) -> Automaton:
        """Positions whose listed slots hold ``before``, with ``after`` written there: from the deepest listed slot upward
        each state becomes another; what lies below stays."""
        if not changes:
            return self
        for layer, (before, after) in changes.items():
            if not (0 <= before < self.shape.layer(layer) and 0 <= after < self.shape.layer(layer)):
                raise ValueError("a change is out of the shape's range")
        changes = {i: c for i, c in changes.items() if self.shape.sizes[i] > 1}
        if not changes:
            return self
        bound = self.bound()
        if any(before not in bound[layer] for layer, (before, _) in changes.items()):
            return Automaton(self.spark, self.shape, REJECT, [layer.limit(0) for layer in self.layers])
        # nothing is lost where every listed slot holds its ``before`` in all positions: all states stay in reach
        whole = all(bound[layer] == {before} for layer, (before, _) in changes.items())
        layers = list(self.layers)
        become: DataFrame | None = None  # old and new names of the layer below
        for i in range(max(changes), -1, -1):
            rows = self._full(i)
            if whole:  # a slot with one character in use is free nowhere, so that ACCEPT isn't met this high
                rows = rows.filter(F.col("state") != ACCEPT)
            if become is not None:
                each = rows.select("state", F.posexplode("next").alias("c", "old")).join(become, "old")
                rows = each.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("c", "new"))).alias("o")).select("state", F.transform("o", lambda x: x["new"]).alias("next"))
            if i in changes:
                before, after = changes[i]
                kept = F.element_at("next", before + 1)
                spots = F.array(*(kept if c == after else F.lit(REJECT) for c in range(self.shape.sizes[i])))
                rows = rows.select("state", spots.alias("next"))
            rows = materialise(rows.select("state", "next", _state_of().alias("new")), f"change{i:03d}")
            layers[i] = rows.filter(~F.col("new").isin(REJECT, ACCEPT)).select(F.col("new").alias("state"), "next").distinct()
            become = rows.select(F.col("state").alias("old"), "new")
        root = become.filter(F.col("old") == self.root).first()["new"]
        out = Automaton(self.spark, self.shape, root, layers)
        return out if whole else out._reached()

    def _reached(self) -> Automaton:
        """Without states that no path from the root meets."""
        layers, now = [], self.spark.createDataFrame([(self.root,)], "state string")
        for i, layer in enumerate(self.layers):
            kept = materialise(layer.join(now, "state", "left_semi"), f"reached{i:03d}")
            layers.append(kept)
            now = kept.select(F.explode("next").alias("state")).distinct()
        return Automaton(self.spark, self.shape, self.root, layers)

    def _constants(self, layer: int) -> DataFrame:
        rows = [(k, [k] * self.shape.sizes[layer]) for k in (REJECT, ACCEPT)]
        return self.spark.createDataFrame(rows, "state string, next array<string>")

    def _full(self, layer: int) -> DataFrame:
        return self.layers[layer].unionByName(self._constants(layer))

    def states(self) -> int:
        """All states, with the two constants of every layer."""
        return sum(self.layer_sizes())

    def layer_sizes(self) -> list[int]:
        """States by layer, with the two constants, counted in one job."""
        if self._sizes is None:
            rows = [layer.select(F.lit(i).alias("i")) for i, layer in enumerate(self.layers)]
            found = dict(functools.reduce(DataFrame.union, rows).groupBy("i").count().collect()) if rows else {}
            self._sizes = [found.get(i, 0) + 2 for i in range(len(self.layers))]
        return self._sizes

    def _rest(self, layer: int) -> int:
        """How many rests there are from a layer on."""
        return math.prod(self.shape.sizes[layer:])

    def _counted(self, kind: str) -> list[DataFrame]:
        """Per layer, bottom up: ``state``, ``next``, ``n`` (accepted rests) and ``before`` (by character, how many rests begin with a smaller one)."""
        out: list[DataFrame] = []
        below = self.spark.createDataFrame([], f"to string, n {kind}")
        for i in range(len(self.shape) - 1, -1, -1):
            to = F.col("to")
            each = self.layers[i].select("state", "next", F.posexplode("next").alias("c", "to"))
            # arrows to constants are counted where they are, and spread so that they meet nothing
            each = each.withColumn("key", F.when(to.isin(REJECT, ACCEPT), F.concat(F.lit("-"), "state")).otherwise(to)).join(below.withColumnRenamed("to", "key"), "key", "left")
            n = F.when(to == REJECT, F.lit("0")).when(to == ACCEPT, F.lit(str(self._rest(i + 1)))).otherwise(F.col("n").cast("string")).cast(kind)
            rows = each.groupBy("state", "next").agg(F.sort_array(F.collect_list(F.struct("c", n.alias("n")))).alias("o")).withColumn("ns", F.transform("o", lambda x: x["n"]))
            zero = F.lit(0).cast(kind)
            sums = F.transform(F.sequence(F.lit(0), F.lit(self.shape.sizes[i])), lambda c: F.aggregate(F.slice("ns", F.lit(1), c), zero, lambda x, y: (x + y).cast(kind)))  # noqa: B023
            rows = rows.withColumn("sums", sums).select("state", "next", F.slice("sums", 1, self.shape.sizes[i]).alias("before"), F.element_at("sums", -1).alias("n"))
            out.insert(0, materialise(rows, f"counts{i:03d}"))
            below = out[0].select(F.col("state").alias("to"), "n")
        return out

    def ranked(self) -> list[DataFrame]:
        """The layers with exact counts; made once."""
        if self._ranked is None:
            if self.shape.universe >= EXACT and self.size() >= EXACT:
                raise ValueError("ranks are exact below 10**37 positions only")
            self._ranked = self._counted("decimal(38,0)")
        return self._ranked

    def size(self) -> int:
        """How many positions are accepted, exactly at any size below 10**37: counts go bottom up as decimals, or as doubles past that."""
        if self.root in (REJECT, ACCEPT):
            return self.shape.universe if self.root == ACCEPT else 0
        rows = self.ranked() if self.shape.universe < EXACT else self._counted("double")
        return int(rows[0].filter(F.col("state") == self.root).first()["n"])

    def _met(self, rows: DataFrame, layer: int, table: DataFrame) -> DataFrame:
        """Rows with a ``state`` meet the layer's table; those at constants get nulls."""
        if (self.layer_sizes()[layer] - 2) * self.shape.sizes[layer] <= BROADCAST_CELLS:
            return rows.join(F.broadcast(table), "state", "left")
        spread = F.xxhash64(*rows.columns)
        salted = rows.withColumn("_salt", F.when(F.col("state").isin(REJECT, ACCEPT), spread).otherwise(F.pmod(spread, F.lit(SALTS))))
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return salted.join(copies, ["state", "_salt"], "left").drop("_salt")

    def _step(self, slot: str):
        """The state after a character; one out of range leads nowhere."""
        return F.when(F.col("next").isNull(), F.col("state")).otherwise(F.coalesce(F.try_element_at("next", F.col(slot).cast("int") + 1), F.lit(REJECT)))

    def accepts(self, rows: DataFrame, name: str = "accepted") -> DataFrame:
        """``rows``, which has the slots as columns, with whether each is accepted; a null slot or one out of range is not."""
        fits = functools.reduce(lambda a, b: a & b, ((F.col(c) >= 0) & (F.col(c) < s) for c, s in zip(self.shape.columns, self.shape.sizes)), F.lit(True))
        keep = rows.columns
        now = rows.withColumn("state", F.when(F.coalesce(fits, F.lit(False)), F.lit(self.root)).otherwise(F.lit(REJECT)))
        for i, slot in enumerate(self.shape.columns):
            now = self._met(now, i, self.layers[i]).withColumn("state", self._step(slot)).select(*keep, "state")
        return now.select(*keep, (F.col("state") == ACCEPT).alias(name))

    def contains_batch(self, others: PositionSet) -> PositionSet:
        """Those of ``others`` that this automaton accepts."""
        rows = self.accepts(others.frame(), "_accepted").filter("_accepted").drop("_accepted")
        return PositionSet.from_frame(rows, self.shape, distinct=False)

    def ranks(self, rows: DataFrame, name: str = "rank") -> DataFrame:
        """``rows`` with the place of each position among the accepted ones in order, from 0; null if it isn't accepted."""
        fits = functools.reduce(lambda a, b: a & b, ((F.col(c) >= 0) & (F.col(c) < s) for c, s in zip(self.shape.columns, self.shape.sizes)), F.lit(True))
        keep = rows.columns
        now = rows.withColumn("state", F.when(F.coalesce(fits, F.lit(False)), F.lit(self.root)).otherwise(F.lit(REJECT))).withColumn("_rank", F.lit(0).cast("decimal(38,0)"))
        for i, slot in enumerate(self.shape.columns):
            c = F.col(slot).cast("int")
            whole = (c.cast("decimal(3,0)") * F.lit(str(self._rest(i + 1) if self.shape.universe < EXACT else 0)).cast("decimal(38,0)")).cast("decimal(38,0)")
            before = F.when(F.col("state") == REJECT, 0).when(F.col("state") == ACCEPT, whole).otherwise(F.try_element_at("before", c + 1)).cast("decimal(38,0)")
            now = self._met(now, i, self.ranked()[i].select("state", "next", "before"))
            now = now.withColumn("_rank", (F.col("_rank") + before).cast("decimal(38,0)")).withColumn("state", self._step(slot)).select(*keep, "state", "_rank")
        return now.select(*keep, F.when(F.col("state") == ACCEPT, F.col("_rank")).alias(name))

    def nth(self, ranks: DataFrame) -> DataFrame:
        """The accepted positions at the ranks of a frame's one column, with it; ranks that there aren't are left out. No layer sees more rows than ranks."""
        name = ranks.columns[0]
        dec = "decimal(38,0)"
        now = ranks.select(F.col(name), F.col(name).cast(dec).alias("_left"), F.lit(self.root).alias("state"))
        now = now.filter((F.col("_left") >= 0) & (F.col("_left") < F.lit(str(self.size())).cast(dec)))
        slots = self.shape.columns
        for i, slot in enumerate(slots):
            rest = F.lit(str(self._rest(i + 1))).cast(dec)
            # the last character with no more rests before it than are left
            at = F.when(F.col("next").isNull(), F.floor(F.col("_left") / rest)).otherwise(F.size(F.filter("before", lambda x: x <= F.col("_left"))) - 1).cast("int")
            now = self._met(now, i, self.ranked()[i].select("state", "next", "before")).withColumn("_c", at)
            left = F.when(F.col("next").isNull(), F.col("_left") % rest).otherwise(F.col("_left") - F.try_element_at("before", F.col("_c") + 1)).cast(dec)
            now = now.withColumn("_left", left).withColumn("state", F.when(F.col("next").isNull(), F.col("state")).otherwise(F.element_at("next", F.col("_c") + 1)))
            now = now.select(name, "_left", "state", *slots[:i], F.col("_c").cast("tinyint").alias(slot))
        return now.select(name, *slots)

    def first(self, k: int, offset: int = 0) -> DataFrame:
        """The k smallest accepted positions from ``offset`` on, with their ranks, none of the others enumerated."""
        return self.nth(self.spark.range(offset, offset + k).toDF("rank"))

    def bounds(self) -> DataFrame:
        """(layer, c): the characters in use, in one job."""
        rows = [self.spark.createDataFrame([], "layer int, c int")]
        for i, size in enumerate(self.shape.sizes):
            used = self.layers[i].select(F.posexplode("next").alias("c", "to")).filter(F.col("to") != REJECT).select(F.lit(i).alias("layer"), "c")
            # an arrow to ACCEPT leaves every later slot free
            free = self.layers[i].filter(F.array_contains("next", ACCEPT)).limit(1).select(F.explode(F.array(*(F.struct(F.lit(j).alias("layer"), F.lit(c).alias("c")) for j in range(i + 1, len(self.shape)) for c in range(self.shape.sizes[j])))).alias("x")).select("x.*") if i + 1 < len(self.shape) else None
            rows += [used] + ([free] if free is not None else [])
        if self.root == ACCEPT:
            rows.append(self.spark.createDataFrame([(i, c) for i, size in enumerate(self.shape.sizes) for c in range(size)], "layer int, c int"))
        return functools.reduce(DataFrame.union, rows).distinct()

    def bound(self) -> list[set[int]]:
        """Per slot the characters in use."""
        out: list[set[int]] = [set() for _ in self.shape.sizes]
        for layer, c in self.bounds().collect():  # a shape's slots and characters, however large the set
            out[layer].add(c)
        return out

    def check_bound(self, bound: list[set[int]]) -> bool:
        """Whether every slot keeps to its characters."""
        return all(own <= given for own, given in zip(self.bound(), bound, strict=True))

    def check_fixed(self, layer: int, char: int) -> bool:
        """Whether no accepted position has another character at a slot."""
        self.shape.layer(layer)
        return self.bound()[layer] <= {char}

    def is_linear(self) -> bool:
        """Whether the set is a product of per-slot character sets: it lies in the product of its bounds, so sizes tell."""
        return self.size() == math.prod(len(chars) for chars in self.bound())

    def complement(self) -> Automaton:
        return self.combine(self, lambda a, b: not a)

    def combine(self, other: Automaton, keep: Callable[[bool, bool], bool], folder: str | None = None) -> Automaton:
        """The product with another automaton: top down the pairs that occur, bottom up their states.

        With a ``folder``, layers are kept there under a name made of both roots and the operation, and a
        later call, also by another driver, takes up the layers that are whole. They stay until deleted.
        """
        if self.shape != other.shape:
            raise ValueError("automata of different shapes")
        constant = {(a, b): (ACCEPT if keep(a == ACCEPT, b == ACCEPT) else REJECT) for a in (REJECT, ACCEPT) for b in (REJECT, ACCEPT)}

        told = repr((self.shape.sizes, self.root, other.root, sorted(constant.items())))
        kept_at = None if folder is None else f"{folder.rstrip('/')}/{hashlib.sha256(told.encode()).hexdigest()}"

        def layer(df: DataFrame, name: str) -> DataFrame:
            return materialise(df, name) if kept_at is None else materialise_once(df, f"{kept_at}/{name}")

        def settled(a: str, b: str):
            """The result of pairs that need no look further down."""
            out = F.lit(None).cast("string")
            for x in (REJECT, ACCEPT):
                if constant[x, REJECT] == constant[x, ACCEPT]:
                    out = F.when(F.col(a) == x, constant[x, REJECT]).otherwise(out)
                if constant[REJECT, x] == constant[ACCEPT, x]:
                    out = F.when(F.col(b) == x, constant[REJECT, x]).otherwise(out)
                for y in (REJECT, ACCEPT):
                    out = F.when((F.col(a) == x) & (F.col(b) == y), constant[x, y]).otherwise(out)
            return out

        pairs = self.spark.createDataFrame([(self.root, other.root)], "l string, r string")
        steps: list[DataFrame] = []
        for i in range(len(self.shape)):
            open_ = pairs.filter(settled("l", "r").isNull())
            met = open_.join(self._full(i).toDF("l", "ln"), "l").join(other._full(i).toDF("r", "rn"), "r")
            steps.append(layer(met.select("l", "r", F.arrays_zip("ln", "rn").alias("to")), f"pairs{i:03d}"))
            pairs = steps[-1].select(F.explode("to").alias("t")).select(F.col("t.ln").alias("l"), F.col("t.rn").alias("r")).distinct()
        known = pairs.select("l", "r", settled("l", "r").alias("state"))
        layers: list[DataFrame] = []
        for i in range(len(self.shape) - 1, -1, -1):
            each = steps[i].select("l", "r", F.posexplode("to").alias("c", "t")).select("l", "r", "c", F.col("t.ln").alias("tl"), F.col("t.rn").alias("tr"))
            each = each.withColumn("s", settled("tl", "tr")).join(known.toDF("tl", "tr", "ks"), ["tl", "tr"], "left")
            rows = each.groupBy("l", "r").agg(F.sort_array(F.collect_list(F.struct("c", F.coalesce("s", "ks").alias("s")))).alias("o"))
            rows = rows.withColumn("next", F.transform("o", lambda x: x["s"]))
            known = layer(rows.select("l", "r", "next", _state_of().alias("state")), f"layer{i:03d}")
            layers.insert(0, known.filter(~F.col("state").isin(REJECT, ACCEPT)).select("state", "next").distinct())
            known = known.select("l", "r", "state")
        top = known.first()
        if top is None:
            a, b = self.root, other.root
            root = next((constant[x, y] for x in (REJECT, ACCEPT) for y in (REJECT, ACCEPT) if (a == x or constant[REJECT, y] == constant[ACCEPT, y] and b == y) and (b == y or constant[x, REJECT] == constant[x, ACCEPT] and a == x)), REJECT)
        else:
            root = top["state"]
        return Automaton(self.spark, self.shape, root, layers)

    def __and__(self, other: Automaton) -> Automaton:
        return self.combine(other, lambda a, b: a and b)

    def __or__(self, other: Automaton) -> Automaton:
        return self.combine(other, lambda a, b: a or b)

    def __sub__(self, other: Automaton) -> Automaton:
        return self.combine(other, lambda a, b: a and not b)

    def __eq__(self, other) -> bool:
        return isinstance(other, Automaton) and self.shape == other.shape and self.root == other.root

    def __hash__(self) -> int:
        return hash((self.shape, self.root))

    def contains(self, position) -> bool:
        p = self.shape.check(position)
        return self.accepts(self.spark.createDataFrame([p], self.shape.schema)).first()["accepted"] if p else self.root == ACCEPT

    def positions(self) -> PositionSet:
        """The accepted positions as rows."""
        paths = self.spark.createDataFrame([(self.root,)], "state string").filter(F.col("state") != REJECT)
        for i, name in enumerate(self.shape.columns):
            step = paths.join(self._full(i), "state").select(*self.shape.columns[:i], F.posexplode("next").alias(name, "state"))
            paths = step.filter(F.col("state") != REJECT).withColumn(name, F.col(name).cast("tinyint"))
        return PositionSet.from_frame(paths.select(*self.shape.columns), self.shape, distinct=False)

    def quick_stats(self) -> str:
        n = self.states()
        return f"{n} states" + (f", {self.size()} positions" if n <= 100_000 else "")


def fold(automata: list[Automaton], keep: Callable[[bool, bool], bool]) -> Automaton:
    """Combine several, small ones first."""
    return functools.reduce(lambda a, b: a.combine(b, keep), sorted(automata, key=Automaton.states))


def _together(automata: list[Automaton], absorbing: str) -> Automaton:
    """All of them in one pass down and one up, for "and" (REJECT absorbs) or "or" (ACCEPT does)."""
    first = automata[0]
    if any(a.shape != first.shape for a in automata):
        raise ValueError("automata of different shapes")
    different = {a.root: a for a in automata}
    tables = [functools.reduce(DataFrame.union, (_arrows(a.layers[i]) for a in different.values())).dropDuplicates(["state"]) for i in range(len(first.shape))]
    return _determined(first.spark, first.shape, first.spark.createDataFrame([([*different],)], "m array<string>"), tables, absorbing)


def _arrows(layer: DataFrame) -> DataFrame:
    """A layer with a list of one state for each character."""
    return layer.select("state", F.transform("next", lambda s: F.array(s)).alias("to"))


def _determined(spark: SparkSession, shape: Shape, roots: DataFrame, tables: list[DataFrame], absorbing: str) -> Automaton:
    """The automaton of a set of states (``m``, one row) whose characters lead to lists of states (``state``, ``to``), all to be met together.

    "And" and "or" are associative, commutative and idempotent, so what the states lead to is a set of
    states: the neutral constant and repetitions drop out, and the absorbing one settles the set. Top down
    the sets that occur, bottom up their states; each layer is met once, whatever the number of operands.
    """
    neutral = ACCEPT if absorbing == REJECT else REJECT

    def normal(states):
        kept = F.array_sort(F.array_distinct(F.filter(states, lambda s: s != neutral)))
        return F.when(F.exists(states, lambda s: s == absorbing), F.array(F.lit(absorbing))).when(F.size(kept) == 0, F.array(F.lit(neutral))).otherwise(kept)

    def name(members):
        return F.when(F.size(members) == 1, F.element_at(members, 1)).otherwise(F.sha2(F.concat_ws("&", members), 256))

    start = roots.select(normal(F.col("m")).alias("m")).select(name(F.col("m")).alias("k"), "m")
    now, steps = start, []
    for i, size in enumerate(shape.sizes):
        met = now.filter(~F.col("k").isin(REJECT, ACCEPT)).select("k", F.explode("m").alias("state")).join(tables[i], "state").groupBy("k").agg(F.collect_list("to").alias("all"))
        to = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: normal(F.flatten(F.transform("all", lambda n: F.element_at(n, c + 1)))))
        steps.append(materialise(met.select("k", to.alias("to")), f"sets{i:03d}"))
        now = steps[-1].select(F.explode("to").alias("m")).distinct().select(name(F.col("m")).alias("k"), "m")
    known = spark.createDataFrame([], "k string, state string")
    layers: list[DataFrame] = []
    for i in range(len(shape) - 1, -1, -1):
        each = steps[i].select(F.col("k").alias("own"), F.posexplode("to").alias("c", "m")).withColumn("t", name(F.col("m")))
        constant = F.col("t").isin(REJECT, ACCEPT)
        each = each.withColumn("k", F.when(constant, F.concat(F.lit("-"), "own")).otherwise(F.col("t"))).join(known, "k", "left")
        each = each.withColumn("s", F.when(constant, F.col("t")).otherwise(F.col("state")))
        grouped = each.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("o")).select(F.col("own").alias("k"), F.transform("o", lambda x: x["s"]).alias("next"))
        done = materialise(grouped.withColumn("state", _state_of()), f"layer{i:03d}")
        layers.insert(0, done.filter(~F.col("state").isin(REJECT, ACCEPT)).select("state", "next").distinct())
        known = done.select("k", "state")
    top = known.first()
    return Automaton(spark, shape, top["state"] if top is not None else start.first()["k"], layers)


def of_clauses(clauses: DataFrame, shape: Shape) -> Automaton:
    """The positions that meet some clause of a table: its columns are the slots, and a null leaves a slot free.

    Clauses are a trie: a node is what a clause asks of the slots so far, and shared beginnings are one
    node. Its arrows go to the node that asks for the character and to the one that leaves the slot free;
    where a clause asks nothing more, to ACCEPT. Sets of nodes are then the states. A clause with a
    character out of range is met by nothing, one without any by all, and no clauses by none.
    """
    spark, slots = clauses.sparkSession, shape.columns
    rows = clauses.select(*(F.col(c).cast("int").alias(n) for c, n in zip(clauses.columns, slots)))
    fits = functools.reduce(lambda a, b: a & b, (F.col(n).isNull() | F.col(n).between(0, size - 1) for n, size in zip(slots, shape.sizes)), F.lit(True))
    rows = materialise(rows.filter(fits).distinct(), "clauses")

    def node(depth: int):
        """The clause's node before a slot."""
        asked = F.concat_ws(",", *(F.coalesce(F.col(n).cast("string"), F.lit("*")) for n in slots[:depth])) if depth else F.lit("")
        more = functools.reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in slots[depth:]), F.lit(False))
        return F.when(more, F.concat(F.lit("#"), asked)).otherwise(ACCEPT)

    tables = []
    for i, size in enumerate(shape.sizes):
        edges = rows.select(node(i).alias("state"), F.struct(F.col(slots[i]).alias("c"), node(i + 1).alias("child")).alias("e")).filter(F.col("state") != ACCEPT)
        grouped = edges.groupBy("state").agg(F.collect_set("e").alias("es"))
        to = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.transform(F.filter("es", lambda e: e["c"].isNull() | (e["c"] == c)), lambda e: e["child"]))
        tables.append(grouped.select("state", to.alias("to")))
    roots = rows.select(node(0).alias("s")).agg(F.collect_set("s").alias("m"))  # the one root, or ACCEPT, or none
    return _determined(spark, shape, roots, tables, ACCEPT)


def image(a: Automaton, rules: DataFrame, backward: bool = False) -> Automaton:
    """Where the rules lead from the accepted positions, in one pass for all rules (``backward``: what leads there).

    ``rules`` has a row for each slot that a rule changes: ``rule``, ``slot``, ``before``, ``after``. A rule
    applies to positions that hold every ``before`` and writes each ``after``. A state is followed together
    with what is left of the rules, so that rules with equal rests go on as one, and a state whose rule is
    done goes on alone. Rules with a character or slot out of range apply to nothing.
    """
    spark, shape = a.spark, a.shape
    old, new = ("after", "before") if backward else ("before", "after")
    sizes = F.array(*(F.lit(s) for s in shape.sizes))
    ok = F.col("slot").between(0, len(shape) - 1)
    ok = ok & F.col(old).between(0, F.try_element_at(sizes, F.col("slot") + 1) - 1) & F.col(new).between(0, F.try_element_at(sizes, F.col("slot") + 1) - 1)
    rows = rules.select("rule", *(F.col(c).cast("int").alias(c) for c in ("slot", "before", "after"))).withColumn("ok", F.coalesce(ok, F.lit(False)))
    entry = F.struct("slot", F.col(old).alias("old"), F.col(new).alias("new"))
    rests = rows.groupBy("rule").agg(F.sort_array(F.collect_list(entry)).alias("rest"), F.every("ok").alias("ok")).filter("ok").select("rest").distinct()
    key = lambda rest: F.array_join(F.transform(rest, lambda x: F.concat_ws(":", x["slot"], x["old"], x["new"])), ";")

    def child(state, rest):
        return F.when((state == REJECT) | (F.size(rest) == 0), state).otherwise(F.concat(state, F.lit("@"), key(rest)))

    nodes = materialise(rests.select(F.lit(a.root).alias("s"), "rest"), "rules")
    roots = nodes.select(child(F.col("s"), F.col("rest")).alias("r")).agg(F.collect_set("r").alias("m"))
    tables = []
    for i, size in enumerate(shape.sizes):
        met = a._met(nodes.withColumnRenamed("s", "state"), i, a.layers[i])
        met = met.withColumn("next", F.coalesce("next", F.array_repeat(F.col("state"), size)))
        here = F.try_element_at("rest", F.lit(1))
        changed = F.coalesce(here["slot"] == i, F.lit(False))
        later = F.when(changed, F.slice("rest", 2, 1 << 20)).otherwise(F.col("rest"))
        met = met.withColumn("later", later).withColumn("changed", changed).withColumn("old", here["old"]).withColumn("new", here["new"])
        chars = F.sequence(F.lit(0), F.lit(size - 1))
        to = F.transform(chars, lambda c: F.when(~F.col("changed"), F.element_at("next", c + 1)).when(F.col("new") == c, F.element_at("next", F.col("old") + 1)).otherwise(F.lit(REJECT)))
        met = met.withColumn("to", to).select("state", "rest", "to", "later")
        own = met.select(child(F.col("state"), F.col("rest")).alias("state"), F.transform("to", lambda s: F.array(child(s, F.col("later")))).alias("to"))
        tables.append(_arrows(a.layers[i]).unionByName(own))
        nodes = materialise(met.select(F.explode("to").alias("s"), F.col("later").alias("rest")).filter((F.col("s") != REJECT) & (F.size("rest") > 0)).distinct(), f"rules{i:03d}")
    return _determined(spark, shape, roots, tables, ACCEPT)


def intersection(automata: list[Automaton]) -> Automaton:
    """What all accept, every layer of all operands met once."""
    return automata[0] if len(automata) == 1 else _together(automata, REJECT)


def union(automata: list[Automaton]) -> Automaton:
    """What any accepts, every layer of all operands met once."""
    return automata[0] if len(automata) == 1 else _together(automata, ACCEPT)


def product_cost(a: tuple[list[int], list[set[int]]], b: tuple[list[int], list[set[int]]], both: bool) -> int:
    """At most so many pairs of states meet, from layer sizes and bounds: no layer has more pairs than prefixes within the bounds."""
    pairs, prefixes = 0, 1
    for x, y, own, other in zip(a[0], b[0], a[1], b[1]):
        pairs += min(x * y, prefixes)
        prefixes *= len(own & other if both else own | other)
    return pairs


def fold_by_cost(automata: list[Automaton], both: bool, trace: list | None = None) -> Automaton:
    """Combine pair by pair, always the pair whose product can be least; estimates come anew with each result.

    ``both``: intersection, otherwise union. Equal sets count once; sets whose bounds share no character
    at some slot have no common position, which ends an intersection without a product. ``trace`` gets
    (left, right, estimate) of each step, operands numbered as given and results from there on.
    """
    shape = automata[0].shape
    if any(a.shape != shape for a in automata):
        raise ValueError("automata of different shapes")
    numbers = itertools.count()
    held, told, heap = {}, {}, []

    def enter(a: Automaton) -> None:
        k = next(numbers)
        if any(a == b for b in held.values()):
            return
        held[k], told[k] = a, (a.layer_sizes(), a.bound())
        for j in held:
            if j != k:
                heapq.heappush(heap, (product_cost(told[j], told[k], both), j, k))

    for a in automata:
        enter(a)
    while len(held) > 1:
        cost, j, k = heapq.heappop(heap)
        if j not in held or k not in held:
            continue
        a, b = held.pop(j), held.pop(k)
        if trace is not None:
            trace.append((j, k, cost))
        if both and any(not own & other for own, other in zip(told[j][1], told[k][1])):
            return Automaton(a.spark, shape, REJECT, [layer.limit(0) for layer in a.layers])
        enter(a & b if both else a | b)
    return next(iter(held.values()))
