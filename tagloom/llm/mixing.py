"""Mixing sources to target weights by hash thresholds found from histograms. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.llm.batches import WORD, written

#: Weights of the sources in code point order (null last), repeating; at most so many copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: A hash has BITS bits and is refined DIGIT bits at a time.
BITS, DIGIT = 60, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """The place of a document in its source's order: 60 bits from its id and text. Rows equal in both share it."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target.

    All sizes together are shared by weight; a target stops at MOST times its source's size and the
    excess goes to the others by weight. Sources are met in the order of the share at which they stop: one stops if the
    rest, shared among those not stopped before it, would reach its limit; the first that doesn't fixes the share of all after it.
    The windows run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("double")
    sums = sums.withColumn("weight", weight).withColumn("limit", (MOST * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    shared = (sums.withColumn("nr", F.row_number().over(by))
              .withColumn("share", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                          / F.sum("weight").over(after)))
    stops = F.col("share") >= F.col("limit") / F.col("weight")
    rest = F.min_by("share", F.when(~stops, F.col("nr"))).over(every)
    first = F.min(F.when(~stops, F.col("nr"))).over(every)
    stopped = first.isNull() | (F.col("nr") < first)
    return shared.select("source", "source_size", F.when(stopped, F.col("limit")).otherwise(F.col("weight") * rest).alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, copies, cut.

    Every document is taken ``copies`` times and once more if its place is below ``cut``. The budget of the extra copies
    picks a bucket of a histogram of the places (sizes summed by source and bucket, so a task passes
    on at most one row per source and bucket); only that bucket is refined, until it holds one place, which is in if that
    brings the source nearer to its target. A larger budget gives a larger cut, so selections are nested.
    """
    from tagloom.operators.sizing import fits_broadcast, lookup_join

    base = targets(sized)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = base.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = written(plan.withColumn("bucket", F.lit(0).cast("long")), "mix-plan")
    small = fits_broadcast(plan)
    for left in range(BITS - DIGIT, -1, -DIGIT):
        inside = lookup_join(sized, plan.select("source", "bucket"), ["source"], null_safe=True, how="inner", small=small)
        inside = inside.where(F.shiftright("place", left + DIGIT) == F.col("bucket"))
        bars = inside.groupBy("source", F.shiftright("place", left).alias("part")).agg(
            F.sum("size").alias("words"), F.count_distinct("place").alias("places") if left == 0 else F.count(F.lit(1)).alias("places"),
            F.min("place").alias("least"), F.max("place").alias("most"))
        bars = bars.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("part")))
        bars = bars.withColumnRenamed("source", "bar_source")
        cut = bars.join(plan.select("source", "budget"), F.col("bar_source").eqNullSafe(F.col("source"))).where(F.col("upto") > F.col("budget"))
        cut = cut.groupBy("source").agg(F.min_by(F.struct("part", "words", "upto", "least", "most"), "part").alias("bar"))
        plan = plan.withColumnRenamed("source", "plan_source").join(
            cut, F.col("plan_source").eqNullSafe(F.col("source")), "left").select(
            F.col("plan_source").alias("source"), "source_size", "target", "copies",
            # no bar: nothing of the bucket is needed in part; the bucket 2^BITS is never met again
            F.when(F.col("bar").isNull(), F.col("budget")).otherwise(F.col("budget") - (F.col("bar.upto") - F.col("bar.words"))).alias("budget"),
            F.coalesce(F.col("bar.part"), F.lit(1 << BITS)).alias("bucket"),
            F.col("bar.words").alias("words"), F.col("bar.least").alias("least"),
            (F.col("bar.least") == F.col("bar.most")).alias("single"))
        plan = written(plan, "mix-plan")
        # the same rows would go through all digits; stop once every boundary bucket holds one place
        if plan.where(~F.coalesce(F.col("single"), F.lit(True))).isEmpty():
            break
    nearer = F.col("words") - F.col("budget") < F.col("budget")
    return plan.select("source", "source_size", "target", "copies",
                       F.coalesce(F.col("least") + F.when(nearer, 1).otherwise(0), F.lit(0)).alias("cut"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
                       place(F.col("doc_id"), F.col("text")).alias("place"))


def _copies() -> Column:
    return F.col("copies") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)


def mix_plan(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    A null text has no words. Rows equal in id and text share one fate; a source whose documents are
    large comes as near to its target as whole documents allow. Texts are read once, narrow rows are written and
    read again per digit; no sort, no join on the documents' side.
    """
    from tagloom.operators.sizing import lookup_join

    sized = written(sized_documents(docs), "mix-sizes")
    plan = written(thresholds(sized), "mix-cuts")
    return lookup_join(sized, plan, ["source"], null_safe=True).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns. Documents without words (null texts too) are kept once
    if their place is below the cut of a thinned source, and never multiplied otherwise. An empty table gives an empty one; very long
    texts are counted whole."""
    from tagloom.operators.sizing import lookup_join

    sized = written(sized_documents(docs), "mix-sizes")
    plan = written(thresholds(sized), "mix-cuts").select("source", "copies", "cut")
    columns, used = docs.columns, {c.lower() for c in docs.columns}
    row = "__row"
    while row in used:
        row += "_"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row),
                         F.col("source").cast("string").alias("source"), place(F.col("doc_id"), F.col("text")).alias("place"))
    taken = lookup_join(packed, plan, ["source"], null_safe=True)
    some = F.coalesce(F.col(row)["text"], F.lit("")).rlike(WORD)
    times = F.when(some, _copies()).otherwise(F.least(_copies(), F.lit(1)))
    taken = taken.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    return taken.select(*[F.col(row)[c].alias(c) for c in columns])
