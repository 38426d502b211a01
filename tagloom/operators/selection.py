"""The n-th row of each group by order keys, found by splitters and counts; nothing is sorted but a bounded rest.

Each round draws a few keys from the interval that still holds a group's cut, takes the two that enclose the wanted rank by a few
standard deviations, and counts the rows below, between and above them in one pass over the keys. Only the slot with the
cut goes on. When a slot is small enough, its distinct keys are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tagloom.operators.sizing import lookup_join, settle

SAMPLE = 4096  # keys drawn from a group's interval per round, on average
SPREADS = 4  # half width of the enclosing pair, in standard deviations of the sample
ENOUGH = 100_000  # rows of an interval whose distinct keys one task ranks

_KEY = "__key"


def order_key(order: list[str]) -> Column:
    """The order columns as one comparable value; nulls are the smallest, as in a sort."""
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])


def _inside(key: Column) -> Column:
    """Whether a key is in its group's interval: (bound, whether the bound itself belongs to it) on each side."""
    lo, hi = F.col("__lo"), F.col("__hi")
    above = lo.isNull() | (key > lo) | (F.col("__lo_in") & (key == lo))
    return above & (hi.isNull() | (key < hi) | (F.col("__hi_in") & (key == hi)))


def _split(keys: DataFrame, group: list[str], state: DataFrame, turn: int) -> DataFrame:
    """One round: the state of each group after its interval is cut in three slots."""
    key, wide = F.col(_KEY), settle(state.where(_open()))
    here = lookup_join(keys, wide, group, how="inner", null_safe=True).where(_inside(key))
    # rows are drawn, not keys, so that a pile of equal keys is drawn in proportion
    draw = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id(), F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    drawn = here.where(draw < F.lit(float(SAMPLE)) / F.col("__count")).groupBy(*group).agg(
        F.sort_array(F.collect_list(key)).alias("__drawn"))
    m, share = F.size("__drawn"), (F.col("__need") - 0.5) / F.col("__count")
    reach = SPREADS * F.sqrt(m * share * (1 - share)) + 1

    def pick(at: Column) -> Column:
        return F.get("__drawn", F.greatest(F.lit(0), F.least(m - 1, at)).cast("int"))

    splitters = lookup_join(wide, drawn, group, how="inner", null_safe=True).select(
        *group, *[c for c in wide.columns if c not in group],
        pick(F.floor(m * share - reach)).alias("__a"), pick(F.ceil(m * share + reach)).alias("__b"))
    splitters = settle(splitters)
    placed = lookup_join(keys, splitters, group, how="inner", null_safe=True).where(_inside(key))
    counts = settle(placed.groupBy(*group).agg(
        F.count_if(key < F.col("__a")).alias("__below"), F.count_if(key.between(F.col("__a"), F.col("__b"))).alias("__between")))
    found = lookup_join(splitters, counts, group, how="inner", null_safe=True)
    need, below, between = F.col("__need"), F.col("__below"), F.col("__between")
    low, middle = need <= below, need <= below + between
    slot = found.select(
        *group,
        F.when(low, F.col("__lo")).when(middle, F.col("__a")).otherwise(F.col("__b")).alias("__lo"),
        F.when(low, F.col("__lo_in")).otherwise(middle).alias("__lo_in"),
        F.when(low, F.col("__a")).when(middle, F.col("__b")).otherwise(F.col("__hi")).alias("__hi"),
        F.when(low, F.lit(False)).when(middle, F.lit(True)).otherwise(F.col("__hi_in")).alias("__hi_in"),
        F.when(low, need).when(middle, need - below).otherwise(need - below - between).alias("__need"),
        F.when(low, below).when(middle, between).otherwise(F.col("__count") - below - between).alias("__count"))
    # a group from which nothing was drawn keeps its interval for the next turn
    missed = lookup_join(wide, found.select(*group), group, how="left_anti", null_safe=True)
    return settle(state.where(~_open()).unionByName(slot).unionByName(missed))


def _open() -> Column:
    """Whether a group's interval is still too long to be ranked: many rows, and not all of one key."""
    one_key = F.coalesce(F.col("__lo") == F.col("__hi"), F.lit(False))
    return (F.col("__count") > ENOUGH) & ~one_key


def nth_keys(keys: DataFrame, group: list[str], n: int) -> DataFrame:
    """Per group with more than ``n`` rows: __cut, the key of its n-th row, __ties, how many rows with this key
    are among the first n, and __equal, how many there are. ``keys`` has the group's columns and __key (see :func:`order_key`)."""
    totals = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("__count")).where(F.col("__count") > n)
    kind, none = keys.schema[_KEY].dataType, F.lit(None)
    state = settle(totals.select(
        *group, none.cast(kind).alias("__lo"), F.lit(False).alias("__lo_in"), none.cast(kind).alias("__hi"),
        F.lit(False).alias("__hi_in"), F.lit(n).cast("bigint").alias("__need"), "__count"))
    turn = 0
    while not state.where(_open()).isEmpty():
        state = _split(keys, group, state, turn)
        turn += 1
    rest = lookup_join(keys, state, group, how="inner", null_safe=True).where(_inside(F.col(_KEY)))
    counted = rest.groupBy(*group, _KEY, "__need").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*group).orderBy(_KEY).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("__upto", upto)
    first = F.col("__upto") - F.col("__c")
    return settle(ranked.where((F.col("__need") > first) & (F.col("__need") <= F.col("__upto"))).select(
        *group, F.col(_KEY).alias("__cut"), (F.col("__need") - first).alias("__ties"), F.col("__c").alias("__equal")))


def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; of rows with equal keys at the cut any, as many as are due.

    The keys are written once and searched; the rows themselves are compared with their group's cut in one
    narrow pass and are neither sorted nor written. Only if rows tie at a cut are those rows numbered."""
    from tagloom.operators.ranking import rank_within

    keys = settle(df.select(*group, order_key(order).alias(_KEY)))
    cuts = nth_keys(keys, group, n)
    judged = lookup_join(df, cuts, group, how="left", null_safe=True)
    key, cut = order_key(order), F.col("__cut")
    extra = ["__cut", "__ties", "__equal"]
    if cuts.where("__ties < __equal").isEmpty():
        return judged.where(cut.isNull() | (key <= cut)).drop(*extra)
    tied = judged.where(key == cut).withColumn("__tie", F.monotonically_increasing_id())
    tied = rank_within(tied, group, ["__tie"], "__rn").where(F.col("__rn") <= F.col("__ties")).drop("__rn", "__tie", *extra)
    return judged.where(cut.isNull() | (key < cut)).drop(*extra).unionByName(tied)
