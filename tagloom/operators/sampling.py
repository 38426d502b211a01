"""Splits, resampling and draws. Every choice hangs on md5(seed, id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tagloom.functions import fixed
from tagloom.functions.hashing import choice, seeded_hash, uniform, uniform_between, uniform_int
from tagloom.operators.ranking import number_in_order, rank_within
from tagloom.operators.sizing import fits_broadcast, lookup_join, settle

_HASH = "__h"
HEX = 13  # hex digits used to place a hash in [0, 1)
SIGMAS = 6  # half width of the first search interval around a wanted rank
DIGITS = 3  # hex digits of a hash that one pass of the search by prefix looks at
TARGET_COPIES = 10_000  # draws of one row handled by one task


def class_totals(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))


def _hex_place(fraction: Column) -> Column:
    """Fraction in [0, 1] as a prefix that compares with md5 digits; 1 is above all."""
    digits = F.lpad(F.lower(F.hex(F.floor(fraction * F.lit(float(16**HEX))))), HEX, "0")
    return F.when(fraction >= 1, "g").otherwise(digits)


def _hash_cuts(hashed: DataFrame, group: list[str], id_col: str, targets: dict[str, Column]) -> DataFrame:
    """Per group, the (hash, id) of the row with the wanted rank in hash order.

    ``targets`` are ranks as expressions over the group size ``__n``; no cut where
    the rank is 0. Hashes are uniform, so a rank is almost surely close to its
    share of [0, 1): one aggregation counts the rows outside a narrow interval and
    keeps those inside, about ``SIGMAS * sqrt(n)`` per group. The count proves that
    the cut is inside; groups where it is not, as an id with many rows moves the ranks, go
    through the digits of the hash (:func:`_digit_cuts`). The table itself is neither shuffled nor
    sorted. Rows with equal ids (nulls are equal, and first) stand together at one place."""
    totals = class_totals(hashed, group).filter("__n > 0").select(
        *group, "__n", *[t.cast("bigint").alias(f"__t_{k}") for k, t in targets.items()])
    bounds = settle(_bounds(totals, list(targets), float(SIGMAS)))
    found = _cuts_within(hashed, group, id_col, list(targets), bounds)
    missed = [found.where(F.col(f"__miss_{k}")).select(*group, F.lit(k).alias("__name")) for k in targets]
    names, open_ = [f"__{k}" for k in targets], missed[0]
    for m in missed[1:]:
        open_ = open_.unionByName(m)
    open_ = settle(open_)
    if open_.isEmpty():
        return found.select(*group, *names)
    wanted = F.element_at(F.create_map(*[x for k in targets for x in (F.lit(k), F.col(f"__t_{k}"))]), F.col("__name"))
    open_ = lookup_join(open_, bounds, group, how="inner", null_safe=True).select(*group, "__name", wanted.alias("__need"))
    by_digits = _digit_cuts(hashed, group, id_col, open_)
    again = settle(by_digits.groupBy(*group).agg(*[F.max(F.when(F.col("__name") == k, F.col("__cut"))).alias(f"__d_{k}") for k in targets]))
    return settle(lookup_join(found, again, group, how="left", null_safe=True).select(
        *group, *[F.coalesce(f"__d_{k}", f"__{k}").alias(f"__{k}") for k in targets]))


def _digit_cuts(hashed: DataFrame, group: list[str], id_col: str, wanted: DataFrame) -> DataFrame:
    """(group, __name, __cut) for ranks ``wanted`` as (group, __name, __need): rows are counted per prefix of the hash, and only
    the prefix that holds the cut goes on, until it holds one (hash, id). An id with any number of rows
    is one count; a task merges at most 16^DIGITS counts of a rank."""
    here = F.struct(F.col(_HASH).alias("h"), F.col(id_col).alias("id"))
    state = settle(wanted.select(*group, "__name", "__need", F.lit("").alias("__prefix")))
    done = []
    for at in range(0, 32 + DIGITS, DIGITS):
        digit = F.substring(_HASH, at + 1, DIGITS)
        met = lookup_join(hashed.select(*group, _HASH, id_col), state, group, how="inner", null_safe=True)
        met = met.where(F.substring(_HASH, 1, at) == F.col("__prefix")) if at else met
        # beyond the last digit only ids with equal hashes are left to tell apart
        bars = met.groupBy(*group, "__name", "__need", "__prefix", (digit if at < 32 else here).alias("__digit")).agg(
            F.count(F.lit(1)).alias("__c"), F.min(here).alias("__least"), F.max(here).alias("__most"))
        upto = F.sum("__c").over(W.partitionBy(*group, "__name").orderBy("__digit").rowsBetween(W.unboundedPreceding, 0))
        hit = settle(bars.withColumn("__first", upto - F.col("__c")).where(
            (F.col("__need") > F.col("__first")) & (F.col("__need") <= F.col("__first") + F.col("__c"))))
        one = F.col("__least") == F.col("__most")
        done.append(hit.where(one).select(*group, "__name", F.col("__least").alias("__cut")))
        if at >= 32:
            break
        state = settle(hit.where(~one).select(
            *group, "__name", (F.col("__need") - F.col("__first")).alias("__need"), F.concat("__prefix", "__digit").alias("__prefix")))
        if state.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _bounds(totals: DataFrame, names: list[str], width: float) -> DataFrame:
    """Intervals of ``width`` standard deviations around the wanted ranks."""
    n = F.col("__n").cast("double")
    for k in names:
        t = F.col(f"__t_{k}").cast("double")
        reach = F.lit(width) * (F.sqrt(t * (n - t) / n) + 1)
        totals = totals.withColumn(f"__lo_{k}", _hex_place(F.greatest(F.lit(0.0), (t - reach) / n))).withColumn(
            f"__hi_{k}", _hex_place(F.least(F.lit(1.0), (t + reach) / n)))
    return totals


def _cuts_within(hashed, group, id_col, names, bounds) -> DataFrame:
    """Cuts of the named targets (ascending ranks), and whether each was outside its interval."""
    small = fits_broadcast(bounds)
    h = F.col(_HASH)
    inside, passed = F.lit(False), F.lit(0)
    for k in names:
        inside = inside | ((h >= F.col(f"__lo_{k}")) & (h < F.col(f"__hi_{k}")))
        passed = passed + (h >= F.col(f"__hi_{k}")).cast("int")
    placed = lookup_join(hashed.select(*group, _HASH, id_col), bounds, group, how="inner", null_safe=True, small=small)
    counted = placed.groupBy(
        *group, inside.alias("__in"), F.when(inside, h).alias("h"), F.when(inside, F.col(id_col)).alias("id"), passed.alias("__passed"),
    ).agg(F.count(F.lit(1)).alias("__c"))
    # a counted stretch stands right after the last interval below it
    edges = F.array(F.lit(""), *[F.col(f"__hi_{k}") for k in names])
    ranked = (
        lookup_join(counted, bounds, group, how="inner", null_safe=True, small=small)
        .withColumn("__key", F.coalesce("h", F.get(edges, F.col("__passed"))))
        .withColumn("__upto", F.sum("__c").over(
            W.partitionBy(*group).orderBy("__key", "id").rowsBetween(W.unboundedPreceding, 0)))
    )
    here = F.when(F.col("__in"), F.struct("h", "id"))
    hits = {k: (F.col(f"__t_{k}") > F.col("__upto") - F.col("__c")) & (F.col(f"__t_{k}") <= F.col("__upto")) for k in names}
    return settle(ranked.groupBy(*group).agg(
        *[F.max(F.when(hit, here)).alias(f"__{k}") for k, hit in hits.items()],
        *[(F.count_if(hit & ~F.col("__in")) > 0).alias(f"__miss_{k}") for k, hit in hits.items()]))


def _upto(cut: str, id_col: str) -> Column:
    here = F.struct(F.col(_HASH).alias("h"), F.col(id_col).alias("id"))
    return F.col(cut).isNotNull() & (here <= F.col(cut))


def stratified_split(
    df: DataFrame,
    label: str,
    id_col: str,
    val: float = fixed.VAL_FRACTION,
    test: float = fixed.TEST_FRACTION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split``: per class, in hash order, first test, then val, rest train.
    Rows with equal ids (NULL is one id) get one split; with unique ids the sizes are exact.

    Sizes: ``max(1, round(n*f))``, halves to even; no test rows for n <= 2, no
    val rows for n <= 3."""
    n = F.col("__n")

    def size(fraction: float, least: int) -> Column:
        share = F.bround(n.cast("double") * F.lit(float(fraction)), 0).cast("bigint")
        return F.when(n > least, F.greatest(F.lit(1).cast("bigint"), share)).otherwise(F.lit(0).cast("bigint"))

    hashed = df.withColumn(_HASH, seeded_hash(seed, F.col(id_col)))
    n_test = size(test, 2)
    cuts = _hash_cuts(hashed, [label], id_col, {"test": n_test, "val": n_test + size(val, 3)})
    split = F.when(_upto("__test", id_col), "test").when(_upto("__val", id_col), "val").otherwise("train")
    return (
        lookup_join(hashed, cuts, [label], how="left", null_safe=True)
        .withColumn("split", split)
        .drop(_HASH, "__test", "__val")
    )


def random_split_exact(
    df: DataFrame, id_col: str, frac: float = fixed.PLAIN_TRAIN_FRACTION, seed: int = fixed.SEED
) -> DataFrame:
    """Add ``split``: exactly ``int(frac * N)`` rows train, the rest val, no strata.
    Rows with equal ids (NULL is one id) stay together."""
    hashed = df.withColumn(_HASH, seeded_hash(seed, F.col(id_col)))
    n_train = F.floor(F.lit(float(frac)) * F.col("__n").cast("double"))
    cut = _hash_cuts(hashed.withColumn("__all", F.lit(0)), ["__all"], id_col, {"train": n_train})  # one row
    here = F.struct(F.col(_HASH).alias("h"), F.col(id_col).alias("id"))
    is_train = F.coalesce(here <= cut.select("__train").scalar(), F.lit(False))
    return hashed.withColumn("split", F.when(is_train, "train").otherwise("val")).drop(_HASH)


def select_split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name).drop("split")


def balanced_resample(
    df: DataFrame, label: str, id_col: str, n: int | None = None, seed: int = fixed.SEED
) -> DataFrame:
    """Draw with replacement: every class equally likely, uniform inside a class.

    One draw per row of ``df`` (``draw`` = that row's id) unless ``n`` is given.
    Returns (draw, label, id). Rows of small classes are drawn many times; such
    rows are repeated over salts so that no key gathers all its draws. Ids may repeat and be NULL."""
    keyed = df.filter(F.col(label).isNotNull()).select(label, id_col)
    classes = settle(number_in_order(class_totals(keyed, [label]), [label], "__class_no"))
    k, total = classes.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not k:
        return df.select(F.col(id_col).alias("draw"), label, id_col).limit(0)
    per_row = F.lit(float(n if n is not None else total)) / (F.lit(float(k)) * F.col("__n"))
    classes = settle(classes.withColumn("__copies", F.greatest(F.lit(1), F.ceil(per_row / TARGET_COPIES)).cast("int")))

    # number the rows of a class in hash order: place in a range partition + rows of the partitions before. Rows of
    # one id are alike; where they stand in the input tells them apart, so that they spread over partitions
    hashed = keyed.withColumn(_HASH, seeded_hash(f"{seed}:row", F.col(id_col))).withColumn(
        "__tie", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    numbered = rank_within(hashed, [label], [_HASH, id_col, "__tie"], "__row_no")
    rows = lookup_join(numbered, classes.select(label, "__class_no", "__copies"), [label], how="inner").select(
        label, id_col, "__class_no", (F.col("__row_no") - 1).alias("__row_no"),
        F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("__salt"))

    tickets = df.sparkSession.range(n).toDF("draw") if n is not None else keyed.select(F.col(id_col).alias("draw"))
    # draws with one id (nulls) hit one row: they travel as one row with their number
    counted = settle(tickets.groupBy("draw").agg(F.count(F.lit(1)).alias("__times")))
    often = F.col("__times") > TARGET_COPIES
    some_often = not counted.where(often).isEmpty()

    def drawn(some: DataFrame) -> DataFrame:
        placed = some.withColumn("__class_no", F.floor(uniform(f"{seed}:class", F.col("draw")) * F.lit(float(k))))
        placed = lookup_join(placed, classes.select("__class_no", "__n", "__copies"), ["__class_no"], how="inner").select(
            "draw", "__times", "__class_no",
            F.coalesce(F.floor(uniform(f"{seed}:pick", F.col("draw")) * F.col("__n").cast("double")), F.lit(0)).alias("__row_no"),
            F.pmod(F.xxhash64("draw"), F.col("__copies")).cast("int").alias("__salt"))
        return placed.join(rows, ["__class_no", "__row_no", "__salt"]).select("draw", label, id_col, "__times")

    out = drawn(counted.where(~often) if some_often else counted)
    if some_often:  # in parts, dealt to all tasks
        parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__times") - 1) / TARGET_COPIES))
        many = drawn(counted.where(often)).withColumn("__part", F.explode(parts)).repartition("__part")
        out = out.unionByName(many.withColumn(
            "__times", F.least(F.lit(TARGET_COPIES), F.col("__times") - F.col("__part") * TARGET_COPIES)).drop("__part"))
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))).drop("__again", "__times")


def recipe(
    id_col: Column,
    variant: Column,
    p: float = fixed.TRAIN_SKETCH_P,
    styles: Sequence[str] = fixed.SKETCH_STYLES,
    seed: int = fixed.SEED,
) -> Column:
    """Struct with the augmentation parameters of one (item, variant)."""

    def u(field: str) -> Column:
        return uniform(f"{seed}:{field}", id_col, variant)

    style = F.when(u("apply") <= F.lit(float(p)), choice(styles, u("style"))).otherwise("none")
    lo = uniform_int(*fixed.EDGE_LOW, u("lo"))
    pencil, edge, threshold = (style == s for s in fixed.SKETCH_STYLES)
    blurred = (style != "none") & (u("soften") < F.lit(fixed.POST_BLUR_P))
    return F.struct(
        style.alias("style"),
        F.when(pencil, uniform_between(*fixed.PENCIL_RADIUS, u("radius"))).alias("blur_radius"),
        F.when(pencil, uniform_between(*fixed.PENCIL_ALPHA, u("alpha"))).alias("alpha"),
        F.when(edge, lo).alias("lo"),
        F.when(edge, lo + uniform_int(*fixed.EDGE_GAP, u("gap"))).alias("hi"),
        F.when(threshold, choice(fixed.THRESHOLD_BLOCKS, u("block"))).alias("block"),
        F.when(threshold, uniform_int(*fixed.THRESHOLD_C, u("c"))).alias("c"),
        F.when(blurred, uniform_between(*fixed.POST_BLUR_RADIUS, u("post"))).alias("post_blur"),
    )


def draw_recipes(
    df: DataFrame,
    id_col: str,
    variants: int = 1,
    p: float = fixed.TRAIN_SKETCH_P,
    styles: Sequence[str] = fixed.SKETCH_STYLES,
    seed: int = fixed.SEED,
) -> DataFrame:
    """One row per (item, variant) with its recipe; a projection, no shuffle."""
    fanned = df.select(F.col(id_col), F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    return fanned.withColumn(
        "r", recipe(F.col(id_col), F.col("variant"), p, styles, seed)).select(id_col, "variant", "r.*")


def preview(
    df: DataFrame, id_col: str, n: int = 5, batch_size: int = fixed.BATCH_SIZE, seed: int = fixed.SEED
) -> DataFrame:
    """First row of each of the first ``n`` batches in hash order.

    A top-k report: only ``(n-1)*batch_size+1`` rows are brought together."""
    head = (
        df.withColumn(_HASH, seeded_hash(seed, F.col(id_col)))
        .orderBy(_HASH, id_col)
        .limit((n - 1) * batch_size + 1)
    )
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(_HASH, id_col)) - 1
    return (
        head.withColumn("__at", at)
        .filter(F.col("__at") % batch_size == 0)
        .withColumn("batch", (F.col("__at") / batch_size).cast("int"))
        .drop(_HASH, "__at")
    )
