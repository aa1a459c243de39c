"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates, exact links.

1. A pass over whole texts gives each document's set of word shingles as 64-bit hashes, its size, a
   128-bit fingerprint of the set and one signature: a single hash function deals shingles into
   ``BINS`` bins and keeps each bin's smallest. An empty bin borrows from a full one that a fixed
   random order of its own picks (optimal densification: for two sets the same bin is picked as
   long as they fill the same bins, and bins borrow independently). ``BANDS`` bands of consecutive
   bins are the bucket keys; at similarity 0.8 a pair shares none with a probability of 5e-6.
2. Equal fingerprints are one class (aggregated before any shuffle of members); only the class's
   smallest id goes on, so copies never multiply.
3. Each bucket proposes a star: its smallest id against every other. Stars bound candidates by the
   number of bucket entries. They are confirmed on full sets by ``100 * common >= 80 * union``.
4. What stars could miss are two members of one star that are linked with each other but not both
   with its centre. After the components of the confirmed links are known, stars are taken together
   by the smallest component that they reach, and those that reach into others are taken up again.
   Their reference is the set of shingles that most members
   hold; D(x) are those in which x differs from it, and s(x) = |x| / 9 - |D(x)|. A link allows two
   members to differ in (|x| + |y|) / 9 shingles and they differ in |D(x)| + |D(y)| -
   2|D(x) & D(y)|, so: members with s(x) + s(y) >= 0 are linked for certain; let t have the largest
   s, then all with s(y) >= -s(t) are linked with t; and each of the others shares at least
   -(s(x) + s(y)) / 2 > 0 elements of D with whatever it links with. Hence only pairs that share
   one of the rarest elements of both D, early enough to share as many as they need, are
   candidates (prefix and positional filter), and D alone decides them, exactly. Edits are mostly a copy's own, so a large family has few candidates, and no pair inside
   one component is ever compared.

So all pairs that share a bucket (or a centre) are decided exactly, and components are those of the full graph
of links but for the bands' miss rate. Nothing is capped or sampled.

Defined results: null and empty texts and texts of white space alone have an empty set and link
with nothing (n_shingles 0, component: their own id, kept); a text of fewer words than a shingle
has one shingle. A null id can't be a component: such rows get null and are not kept, and nothing
links through them. Repeated rows are each returned. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.bloom import KeyFilter, key_filter
from plyset.llm.common import Scratch, drop_staged
from plyset.llm.graph import components
from plyset.llm.text import batches, mix, owners, shingles, string_bytes, words

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"

_order: np.ndarray | None = None


def borrow_order() -> np.ndarray:
    """For each bin, the rank of every other bin as a lender."""
    global _order
    if _order is None:
        _order = np.random.default_rng(20240229).random((BINS, BINS)).astype(np.float32)
    return _order


def document_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = string_bytes(column)
    starts, _, hashes = words(data, offsets)
    first = np.searchsorted(starts, offsets)
    out = []
    for i in range(len(offsets) - 1):
        own = hashes[first[i] : first[i + 1]]
        if 0 < len(own) < n:
            out.append(mix(shingles(own, len(own)) ^ np.uint64(len(own))))
        else:
            out.append(np.unique(shingles(own, n)))
    return out


def band_keys(shingle_set: np.ndarray) -> np.ndarray:
    """The bucket keys of a set, by one permutation and densification."""
    h = mix(shingle_set ^ np.uint64(0x2545F4914F6CDD1D))
    of = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, of, mix(h))
    full = np.zeros(BINS, bool)
    full[of] = True
    if not full.all():
        lenders, empty = np.flatnonzero(full), np.flatnonzero(~full)
        low[empty] = low[lenders[np.argmin(borrow_order()[np.ix_(empty, lenders)], axis=1)]]
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + low[r::ROWS])
    return keys


def sign(docs: DataFrame, n: int) -> DataFrame:
    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            sets = document_sets(part.column("text"), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            f1 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else 0 for s in sets], np.uint64)
            f2 = np.array([np.add.reduce(mix(s ^ np.uint64(0xD6E8FEB86659FD93))) if len(s) else 0 for s in sets], np.uint64)
            # fewer than 4 shingles: similarity 0.8 means equality, which the fingerprint finds
            keys = [band_keys(s).view(np.int64) if len(s) >= 4 else np.empty(0, np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            columns = [part.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, n: int, needed: KeyFilter) -> DataFrame:
    """The sets of the documents whose ids the filter holds, and of few others: no text is shuffled for them."""

    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            part = part.filter(pa.array(needed.test(part.column("key").to_numpy())))
            if not part.num_rows:
                continue
            sets = document_sets(part.column("text"), n)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), lists], names=["rep", "shingles"])

    named = docs.filter("doc_id is not null and text is not null")
    return named.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "rep long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, common) of candidate pairs, on full sets. The pairs of a hub are dealt to ``HUB_SALTS`` tasks, each with the hub's set."""
    often = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= SPREAD)
    hub = key_filter(often.select(F.xxhash64("a").alias("key")), beyond=False).column(F.xxhash64("a"))  # asked on both sides, so a false hit does no harm
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    a = a.withColumn("z", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = pairs.select("a", "b").withColumn("z", F.when(hub, F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).cast("int")).otherwise(0))
    both = dealt.join(b, "b").join(a, ["a", "z"])
    return both.select("a", "b", F.size("sa").alias("size_a"), F.size("sb").alias("size_b"), F.size(F.array_intersect("sa", "sb")).alias("common"))


LINKED = "100 * common >= 80 * (size_a + size_b - common)"


#: Members of a family that meet its centre's set, or its majority's, in one group of a join.
SPREAD = 512
#: Tasks that the candidate pairs of a centre with at least ``SPREAD`` of them are dealt to.
HUB_SALTS = 64


def missed(checked: DataFrame, found: DataFrame, sets: DataFrame, kept: Scratch) -> DataFrame | None:
    """Links (a, b) between members of stars that lie in different components, or nothing to look for; see the module, step 4."""
    staged = kept.staged
    comp = found.select(F.col("node").alias("x"), F.col("component").alias("comp"))
    centre = found.select(F.col("node").alias("r"), F.col("component").alias("c"))
    stars = checked.select(F.col("a").alias("r"), F.col("b").alias("x")).join(comp, "x", "left").join(centre, "r", "left")
    stars = staged(stars.select("r", "x", F.coalesce("comp", "x").alias("comp"), F.coalesce("c", "r").alias("rcomp")), "stars")
    # a star goes by the smallest component that it reaches: an outsider's own star joins the family that it meets
    family_of = stars.groupBy("r", "rcomp").agg(F.min("comp").alias("c")).select("r", "rcomp", F.least("c", "rcomp").alias("c"))
    inner = stars.select("r", "x", "comp").join(family_of.select("r", "c"), "r").select("c", "x", "comp")
    stars = inner.unionByName(family_of.select("c", F.col("r").alias("x"), F.col("rcomp").alias("comp"))).distinct()
    stars = staged(stars, "stars")
    # three members at least (two were compared), one of them outside the centres' component
    open_ = stars.groupBy("c").agg(F.count("*").alias("m"), F.max((F.col("comp") != F.col("c")).cast("int")).alias("o")).filter("m > 2 and o = 1")
    open_ = staged(open_.select("c", "m", F.ceil(F.col("m") / SPREAD).cast("long").alias("salts")), "open")
    if open_.isEmpty():
        return None
    # what a family has once is dealt to each of its salts, so that no family's members meet in one task
    dealt = lambda df: df.join(open_.select("c", "salts"), "c").withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    stars = stars.join(open_, "c").withColumn("z", F.pmod(F.xxhash64("x"), "salts")).select("c", "z", "m", "x", "comp")
    stars = stars.join(sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx")), "x")
    stars = stars.join(dealt(sets.select(F.col("rep").alias("c"), F.col("shingles").alias("sc"))), ["c", "z"])
    off = F.concat(F.array_except("sc", "sx"), F.array_except("sx", "sc"))
    stars = staged(stars.select("c", "z", "m", "x", "comp", F.size("sx").alias("n"), off.alias("off")), "stars")
    each = stars.select("c", "m", F.explode("off").alias("e"))
    flips = each.groupBy("c", "m", "e").agg(F.count("*").alias("k")).filter("2 * k > m").groupBy("c").agg(F.collect_list("e").alias("flip"))
    none = F.array().cast("array<long>")
    family = stars.drop("m").join(dealt(flips), ["c", "z"], "left").withColumn("flip", F.coalesce("flip", none))
    family = family.withColumn("d", F.concat(F.array_except("off", "flip"), F.array_except("flip", "off"))).drop("off", "flip")
    family = staged(family.withColumn("s", F.col("n") - 9 * F.size("d")), "family")
    top = family.groupBy("c").agg(F.max(F.struct("s", F.col("x").alias("t"), F.col("comp").alias("tc"))).alias("b")).select("c", F.col("b.s").alias("ts"), "b.t", "b.tc")
    family = family.join(staged(dealt(top), "top"), ["c", "z"]).withColumn("inside", F.col("s") + F.col("ts") >= 0)
    sure = family.filter("inside and x <> t and comp <> tc").select(F.col("t").alias("a"), F.col("x").alias("b"))

    # everyone else shares elements with whomever it links with; the rarest first
    family = family.withColumn("comp", F.when(F.col("inside"), F.col("tc")).otherwise(F.col("comp")))
    each = family.select("c", "x", F.explode("d").alias("e"))
    df = staged(each.groupBy("c", "e").agg(F.count("*").alias("df")), "df")
    order = each.join(df.filter("df > 1"), ["c", "e"]).groupBy("c", "x").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("order"))
    family = staged(family.join(order, ["c", "x"]), "family")  # none left: every element is its own, so no link was missed
    need = F.when(F.col("inside"), F.floor((F.col("ts") - F.col("s")) / 18) + 1).otherwise(F.greatest(F.lit(1), F.ceil(-(F.col("s") + F.col("ts")) / 18)))
    rest = F.greatest(F.lit(0), F.size("order") - need + 1).cast("int")  # elements found once can't be shared
    family = family.withColumn("p", F.slice("order", F.lit(1), rest)).withColumn("m", F.size("order"))
    indexed = family.select("c", "x", F.col("comp").alias("xcomp"), F.col("inside").alias("xin"), F.col("s").alias("xs"), F.col("m").alias("xm"), F.posexplode("p.e").alias("xk", "e"))
    asking = family.filter("not inside").select("c", F.col("x").alias("f"), F.col("comp").alias("fcomp"), F.col("s").alias("fs"), F.col("m").alias("fm"), F.posexplode("p.e").alias("fk", "e"))
    # from the first element that two share on, neither has more to share than what follows it
    enough = "-(fs + xs) <= 18 * least(fm - fk, xm - xk)"
    pairs = asking.join(indexed, ["c", "e"]).filter(f"fcomp <> xcomp and (xin or f < x) and {enough}").select("c", "f", "x").distinct()
    one = family.select("c", F.col("x").alias("f"), F.col("n").alias("size_a"), F.col("d").alias("da"))
    two = family.select("c", "x", F.col("n").alias("size_b"), F.col("d").alias("db"))
    both = pairs.join(one, ["c", "f"]).join(two, ["c", "x"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    both = both.withColumn("common", ((F.col("size_a") + F.col("size_b") - apart) / 2).cast("int"))
    return sure.unionByName(both.filter(LINKED).select(F.col("f").alias("a"), F.col("x").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``; see the module."""
    kept = Scratch()
    staged = kept.staged
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = staged(sign(docs, n), "signed")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = staged(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")

    # buckets of more than one class, each entry with its bucket's centre
    reps = named.select("doc_id", "n_shingles", "f1", "f2", "bands").join(classes, ["f1", "f2", "n_shingles"]).filter("doc_id = rep")
    entries = reps.select("rep", F.explode("bands").alias("key"))
    entries = staged(entries, "entries")
    centres = entries.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("last")).filter("c <> last")
    centres = staged(centres.select("key", "c"), "centres")
    stars = staged(entries.join(centres, "key").select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    drop_staged(entries, centres)
    kept.frames = [signed, classes, stars]

    needed = key_filter(staged(stars.select(F.xxhash64("b").alias("key")).distinct(), "needed"))
    sets = staged(full_sets(docs, n, needed), "sets")
    checked = staged(confirm(stars.filter("a <> b"), sets), "checked")
    links = checked.filter(LINKED).select("a", "b")
    found = staged(components(links), "components")

    more = missed(checked, found, sets, kept)
    more = None if more is None else staged(more, "more")
    if more is not None and not more.isEmpty():
        label = found.select("node", "component")
        between = more.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left")
        between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(between.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        found = staged(joined, "components")

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = staged(of_class.select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component")), "of_class")
    kept.drop(signed, of_class)
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
