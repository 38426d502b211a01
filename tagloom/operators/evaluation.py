"""Counts, weights, confusion, accuracy, epoch logs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from tagloom.functions import fixed
from tagloom.operators.scoring import best_of
from tagloom.operators.sizing import fits_broadcast, lookup_join, settle

EPOCHS_PER_CHUNK = 65_536
WIDE_COLUMNS = 5_000  # classes that may be columns of a table


def class_counts(df: DataFrame, label: str, vocab: DataFrame) -> DataFrame:
    """(class_idx, class_name, n) for every class of the vocabulary, 0 if unseen."""
    counts = df.groupBy(F.col(label).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    return vocab.join(counts, "class_name", "left").select(
        "class_idx", "class_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Attach ``weight`` = 1 / rows of the class; not normalised."""
    counts = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    return lookup_join(df, counts, [label], how="left", null_safe=True).withColumn(
        "weight", F.lit(1.0) / F.greatest(F.col("__n"), F.lit(1))).drop("__n")


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(true, pred, n): partial counts are combined before the shuffle."""
    return df.groupBy(F.col(truth).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_names(vocab: DataFrame) -> list[str]:
    """Class names in class order: column names or a model's rows, so as many as those may be."""
    return [r["class_name"] for r in vocab.orderBy("class_idx").select("class_name").collect()]


def within(cm: DataFrame, vocab: DataFrame, other: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and vocabulary for the reports, so that no row is lost in them.

    Classes outside the vocabulary (NULL too) are counted as ``other``, a last class
    of its own that must not be in the vocabulary; without ``other`` they fail the job."""
    known = vocab.select("class_name")
    small = fits_broadcast(known)
    for side in ("true", "pred"):
        marked = known.select(F.col("class_name").alias(side), F.lit(True).alias("__known"))
        outside = F.lit(other) if other is not None else F.raise_error(F.concat(
            F.lit(f"not in the vocabulary, column {side}: "), F.coalesce(F.col(side), F.lit("NULL")))).cast("string")
        cm = lookup_join(cm, marked, [side], small=small).withColumn(
            side, F.when(F.col("__known"), F.col(side)).otherwise(outside)).drop("__known")
    if other is None:
        return cm, vocab
    last = vocab.agg((F.coalesce(F.max("class_idx"), F.lit(-1)) + 1).cast(vocab.schema["class_idx"].dataType).alias("class_idx"))
    return (cm.groupBy("true", "pred").agg(F.sum("n").alias("n")),
            vocab.unionByName(last.select("class_idx", F.lit(other).alias("class_name"))))


def sparse_rows(cm: DataFrame, vocab: DataFrame, other: str | None = None) -> DataFrame:
    """(class_idx, class_name, cells): per class its cells that are not zero, array<struct<idx, n>> in class order. ``other`` as in
    :func:`within`; classes are numbered from 0 without gaps. No class becomes a column, so there may be any number."""
    cm, vocab = within(cm, vocab, other)
    names = vocab.select("class_idx", "class_name")
    small = fits_broadcast(names)
    cells = lookup_join(cm, names.select(F.col("class_idx").alias("__t"), F.col("class_name").alias("true")), ["true"], how="inner", small=small)
    cells = lookup_join(cells, names.select(F.col("class_idx").cast("bigint").alias("__p"), F.col("class_name").alias("pred")), ["pred"], how="inner", small=small)
    rows = cells.groupBy("__t").agg(F.sort_array(F.collect_list(F.struct(F.col("__p").alias("idx"), "n"))).alias("cells"))
    none = F.expr("cast(array() as array<struct<idx:bigint,n:bigint>>)")
    return names.join(rows, F.col("class_idx") == F.col("__t"), "left").select("class_idx", "class_name", F.coalesce("cells", none).alias("cells"))


def _with_gaps(cells: Column, size: Column, cell, zeros) -> Column:
    """What ``cell`` makes of each cell, after what ``zeros`` makes of the number of zeros before it, and the zeros at the end."""
    def before(i: Column) -> Column:
        return F.coalesce(F.get(cells, i - 1)["idx"], F.lit(-1).cast("bigint"))

    filled = F.transform(cells, lambda c, i: F.concat(zeros(c["idx"] - before(i) - 1), cell(c["n"])))
    last = F.coalesce(F.get(cells, F.size(cells) - 1)["idx"], F.lit(-1).cast("bigint"))
    return F.concat(filled, F.array(zeros(size - last - 1)))


def confusion_rows(cm: DataFrame, vocab: DataFrame, other: str | None = None) -> DataFrame:
    """class_idx, class_name, counts: a class's cells of all classes as one array, zeros filled in. For any number of classes."""
    rows = sparse_rows(cm, vocab, other)
    zero = F.lit(0).cast("bigint")
    counts = F.flatten(_with_gaps(F.col("cells"), _class_count(vocab, other), lambda n: F.array(n), lambda k: F.array_repeat(zero, k.cast("int"))))
    return rows.select("class_idx", "class_name", counts.alias("counts"))


def confusion_lines(cm: DataFrame, vocab: DataFrame, other: str | None = None) -> DataFrame:
    """class_idx, class_name, line: the counts of a class as text, comma-joined, zeros filled in."""
    rows = sparse_rows(cm, vocab, other)
    line = F.array_join(_with_gaps(F.col("cells"), _class_count(vocab, other), lambda n: F.concat(F.lit(","), n.cast("string")),
                                   lambda k: F.repeat(F.lit(",0"), k.cast("int"))), "")
    return rows.select("class_idx", "class_name", F.substring(line, F.lit(2), F.length(line)).alias("line"))


def _class_count(vocab: DataFrame, other: str | None) -> Column:
    return (vocab.agg(F.count(F.lit(1))).scalar() + F.lit(0 if other is None else 1)).cast("bigint")


def confusion_wide(cm: DataFrame, vocab: DataFrame, other: str | None = None) -> DataFrame:
    """class_idx, class_name and one column per class; all cells, 0 if unseen. ``other`` as in :func:`within`.

    Names become columns, so there may be WIDE_COLUMNS classes; :func:`confusion_rows` and the written report have no such bound."""
    if vocab.limit(WIDE_COLUMNS + 1).count() > WIDE_COLUMNS:
        raise ValueError(f"more than {WIDE_COLUMNS} classes: use confusion_rows")
    names = vocabulary_names(vocab) + ([] if other is None else [other])
    return confusion_rows(cm, vocab, other).select(
        "class_idx", "class_name", *[F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(names)])


def per_class_accuracy(cm: DataFrame, vocab: DataFrame, other: str | None = None) -> DataFrame:
    """(class_idx, class_name, test_samples, correct, accuracy); 0.0 without rows. ``other``
    as in :func:`within`; a hit counts as correct only in a class of the vocabulary.

    Cells are summed by class first, so the vocabulary is joined once, to one row per class."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(zero)
    # predicted names come along with no rows, so that those outside the vocabulary show
    sides = F.array(F.struct(F.col("true").alias("c"), F.col("n").cast("bigint").alias("t"), hit.cast("bigint").alias("k")),
                    F.struct(F.col("pred").alias("c"), zero.alias("t"), zero.alias("k")))
    per = cm.select(F.inline(sides)).groupBy("c").agg(F.sum("t").alias("t"), F.sum("k").alias("k"))
    both = vocab.join(per, F.col("class_name").eqNullSafe(F.col("c")), "full")
    known = F.col("class_idx").isNotNull()
    if other is None:
        outside = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce("c", F.lit("NULL")))).cast("string")
        rows = both.select("class_idx", F.when(known, F.col("class_name")).otherwise(outside).alias("class_name"), "t", "k")
        # the name is read in every plan, or the test would be pruned away
        rows = rows.where(F.col("class_name").isNotNull())
    else:
        last = vocab.agg((F.coalesce(F.max("class_idx"), F.lit(-1)) + 1).cast(vocab.schema["class_idx"].dataType)).scalar()
        one = both.select(F.coalesce("class_idx", last).alias("class_idx"), F.coalesce("class_name", F.lit(other)).alias("class_name"),
                          "t", F.when(known, F.col("k")).otherwise(zero).alias("k"))
        empty = vocab.sparkSession.range(1).select(last.alias("class_idx"), F.lit(other).alias("class_name"), zero.alias("t"), zero.alias("k"))
        rows = one.unionByName(empty).groupBy("class_idx", "class_name").agg(F.sum("t").alias("t"), F.sum("k").alias("k"))
    return rows.select(
        "class_idx", "class_name", F.coalesce("t", zero).alias("test_samples"), F.coalesce("k", zero).alias("correct"),
        F.coalesce(F.try_divide("k", "t"), F.lit(0.0)).alias("accuracy"))


def worst_first(per_class: DataFrame) -> DataFrame:
    return per_class.orderBy("accuracy", "class_idx")


def weakest(per_class: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` classes with the lowest accuracy; class order breaks ties."""
    return worst_first(per_class).limit(n)


def top1_accuracy(cm: DataFrame) -> DataFrame:
    """One row: correct, total, accuracy = correct / max(1, total)."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    correct = F.coalesce(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n"))), F.lit(0))
    return cm.agg(correct.alias("correct"), total.alias("total"),
                  (correct / F.greatest(total, F.lit(1))).alias("accuracy"))


def epoch_metrics(batches: DataFrame, keys: list[str], loss: Column, correct: Column, n: Column) -> DataFrame:
    """Row-weighted mean loss and accuracy in percent; NULL when nothing was seen."""
    rows = F.sum(n)
    return batches.groupBy(*keys).agg(
        rows.alias("rows"),
        F.try_divide(F.sum(loss * n), rows).alias("loss"),
        F.try_divide(F.lit(100) * F.sum(correct), rows).alias("accuracy"))


def stage_report(df: DataFrame, group: str, kept: Column, flagged: Column) -> DataFrame:
    """Rows before, kept, removed and flagged, per class and in total."""
    return df.rollup(group).agg(
        F.grouping(group).cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("before"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("removed"),
        F.count_if(flagged).alias("flagged"))


@dataclass
class StageCounts:
    """Rows before, kept, removed and flagged, counted by the job that writes (or otherwise runs) ``rows``; reading the numbers
    waits for that job and starts none."""

    rows: DataFrame
    observation: Observation

    @property
    def numbers(self) -> dict[str, int]:
        return {k: int(v) for k, v in self.observation.get.items()}


def counted_stage(df: DataFrame, kept: Column, flagged: Column) -> StageCounts:
    """Account for a stage while its result is written: no second pass, no shuffle. ``kept`` and ``flagged`` are never NULL.
    :func:`stage_report` has the same numbers per class."""
    observation = Observation(f"stage-{uuid.uuid4().hex}")
    return StageCounts(df.observe(observation, F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("kept"),
                                  F.count_if(~kept).alias("removed"), F.count_if(flagged).alias("flagged")), observation)


def early_stop(
    log: DataFrame, run: str, epoch: str, metric: str,
    patience: int = fixed.PATIENCE, chunk: int = EPOCHS_PER_CHUNK,
) -> DataFrame:
    """(run, stop_epoch, best_epoch, best) for epochs numbered 0, 1, 2, ... per run.

    An epoch improves if it is strictly above the best so far (0.0 at first). The
    run stops at the first epoch with ``patience`` epochs in a row that do not
    improve (stop_epoch is NULL if there is none); best_epoch is -1 if no epoch
    up to there improved.

    A run of any length is cut in chunks: row windows see one chunk, and what the
    chunks before it mean for it comes from one row per chunk."""
    low = F.lit(float("-inf"))
    rows = log.select(
        run, F.col(epoch).cast("bigint").alias("__e"),
        F.coalesce(F.nanvl(F.col(metric).cast("double"), low), low).alias("__v"),
    ).withColumn("__chunk", F.floor(F.col("__e") / chunk))
    earlier = W.partitionBy(run).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy(run, "__chunk").agg(F.max("__v").alias("__peak")).select(
        run, "__chunk", F.greatest(F.lit(0.0), F.max("__peak").over(earlier)).alias("__base"))

    inside = W.partitionBy(run, "__chunk").orderBy("__e")
    seen = F.max("__v").over(inside.rowsBetween(W.unboundedPreceding, -1))
    marked = (
        rows.join(bases, [run, "__chunk"])
        .withColumn("__before", F.greatest("__base", seen))
        .withColumn("__up", F.when(F.col("__v") > F.col("__before"), F.col("__e")))
        .withColumn("__best", F.greatest("__before", "__v"))
        .withColumn("__last_up", F.max("__up").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    )
    waited = F.col("__e") - F.col("__last_up") >= patience
    chunks = marked.groupBy(run, "__chunk").agg(
        F.min("__e").alias("__start"), F.max("__e").alias("__end"),
        F.min("__up").alias("__first_up"), F.max("__up").alias("__up_end"),
        F.max("__base").alias("__base"), F.max("__best").alias("__best"),
        F.min(F.when(waited, F.struct(F.col("__e").alias("e"), F.col("__best").alias("b")))).alias("__inner"))
    carried = F.coalesce(F.max("__up_end").over(earlier), F.lit(-1)) + patience
    at = F.greatest(carried, F.col("__start"))
    outer = F.when(at <= F.coalesce(F.col("__first_up") - 1, F.col("__end")),
                   F.struct(at.alias("e"), F.col("__base").alias("b")))
    stops = chunks.withColumn("__stop", F.least(outer, F.col("__inner")))
    per_run = stops.groupBy(run).agg(
        F.min("__stop").alias("s"), F.max("__up_end").alias("u"), F.max("__best").alias("b"))
    return per_run.select(
        run, F.col("s.e").alias("stop_epoch"),
        F.when(F.col("s").isNotNull(), F.col("s.e") - patience)
        .otherwise(F.coalesce("u", F.lit(-1))).alias("best_epoch"),
        F.coalesce(F.col("s.b"), F.col("b")).alias("best"))


def evaluate(df: DataFrame, scorer, features: str, truth: str, vocab: DataFrame, other: str | None = None):
    """(confusion, per class, overall) of the scorer's best class against ``truth``; ``other`` as in :func:`within`.

    The confusion counts are written once and shared by the reports."""
    predicted = best_of(df, scorer, features, 1, "__best").select(
        F.col(truth).cast("string").alias("true"), F.get("__best", F.lit(0))["name"].alias("pred"))
    cm = settle(confusion(predicted, "true", "pred"))
    return cm, per_class_accuracy(cm, vocab, other), top1_accuracy(cm)
