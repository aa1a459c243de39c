"""How many sets relate to each other: sizes, shares, inclusion and disjointness of every two, in one pass over their rows.

Sets are groups of one table of positions. A position's owners (the groups that hold it) are gathered
first and equal lists of owners counted, so that pairs are made of the few different lists and not of
positions; a pair without a common position comes from the groups' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: So many different groups are bits of one integer for each position; with more they are gathered as lists.
MOST_BITS = 63


def owned(held: DataFrame, within: list[str], slots: Sequence[str]) -> DataFrame:
    """How many positions (``_n``) each list of owners (``_o``, sorted) holds alone.

    A few groups are gathered as bits: that is a plain hash aggregate, while lists fall back to sorting all positions.
    """
    names = [r[0] for r in held.select("_g").distinct().limit(MOST_BITS + 1).collect()]
    if not 0 < len(names) <= MOST_BITS:
        owners = held.groupBy(*within, *slots).agg(F.sort_array(F.collect_set("_g")).alias("_o"))
        return owners.groupBy(*within, "_o").agg(F.count("*").alias("_n"))
    every = F.sort_array(F.array(*map(F.lit, names)))
    at = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    bits = held.select(*within, *slots, at(F.array_position(every, F.col("_g")).cast("int") - 1).alias("_m"))
    masks = bits.groupBy(*within, *slots).agg(F.bit_or("_m").alias("_m")).groupBy(*within, "_m").agg(F.count("*").alias("_n"))
    return masks.select(*within, F.filter(every, lambda g, i: F.col("_m").bitwiseAND(at(i)) != 0).alias("_o"), "_n")


def relations(rows: DataFrame, slots: Sequence[str], group: str, within: Sequence[str] = ()) -> DataFrame:
    """For every two groups (``a`` < ``b``) of equal ``within``: a_n, b_n, both_n, either_n, subset, superset, disjoint.

    Repeated rows count once; rows with a null group are in no set; nulls in slots are a value like others.
    """
    within = list(within)
    held = rows.filter(F.col(group).isNotNull()).select(*within, *slots, F.col(group).alias("_g"))
    lists = owned(held, within, slots)
    pairs = lists.select(*within, "_n", "_o", F.posexplode("_o").alias("_i", "a"))
    pairs = pairs.select(*within, "_n", "a", F.explode(F.slice("_o", F.col("_i") + 1, F.size("_o"))).alias("b"))
    common = pairs.groupBy(*within, "a", "b").agg(F.sum("_n").alias("both_n"))
    sizes = common.filter(F.col("a") == F.col("b")).select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(within)), F.col("a").alias("_g"), F.col("both_n").alias("_n"))
    # every two groups that occur: the groups of one ``within`` as a list, not a join of their rows
    names = sizes.groupBy(*(f"_w{i}" for i in range(len(within)))).agg(F.sort_array(F.collect_list(F.struct("_g", "_n"))).alias("_l"))
    each = names.select(*(F.col(f"_w{i}").alias(c) for i, c in enumerate(within)), "_l", F.posexplode("_l").alias("_i", "_a"))
    each = each.select(*within, "_a", F.explode(F.slice("_l", F.col("_i") + 2, F.size("_l"))).alias("_b"))
    every = each.select(*within, F.col("_a._g").alias("a"), F.col("_b._g").alias("b"), F.col("_a._n").alias("a_n"), F.col("_b._n").alias("b_n"))
    out = every.join(common, [*within, "a", "b"], "left").withColumn("both_n", F.coalesce("both_n", F.lit(0).cast("long")))
    return out.select(
        *within, "a", "b", "a_n", "b_n", "both_n", (F.col("a_n") + F.col("b_n") - F.col("both_n")).alias("either_n"),
        (F.col("both_n") == F.col("a_n")).alias("subset"), (F.col("both_n") == F.col("b_n")).alias("superset"), (F.col("both_n") == 0).alias("disjoint"),
    )
