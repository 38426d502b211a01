"""Relevance gate: drop rows that match a distractor better than their class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.functions.vectors import argmax, array_total, dot, gate_softmax, l2_normalise
from tagloom.operators.blocked import shared_sums
from tagloom.operators.sizing import fits_broadcast, lookup_join, settle


def prompt_rows(classes: DataFrame, name_col: str) -> DataFrame:
    """(class_name, slot, kind, prompt): the target text of each class, slot 0,
    then the generic and the explicit distractors in fixed order."""
    shared = [(i + 1, "generic", t) for i, t in enumerate(fixed.GENERIC_PROMPTS)]
    shared += [(len(shared) + i + 1, "explicit", t) for i, t in enumerate(fixed.EXPLICIT_PROMPTS)]
    slots = [F.struct(F.lit(0).alias("slot"), F.lit("target").alias("kind"),
                      F.format_string(fixed.TARGET_PROMPT, F.col(name_col)).alias("prompt"))]
    slots += [F.struct(F.lit(s).alias("slot"), F.lit(k).alias("kind"), F.lit(t).alias("prompt")) for s, k, t in shared]
    return classes.select(F.col(name_col).alias("class_name"), F.inline(F.array(*slots)))


def shared_rows(prompts: DataFrame) -> DataFrame:
    """(slot, kind, vec) of the distractors, each once."""
    return prompts.filter("kind <> 'target'").select("slot", "kind", "vec").distinct()


def shared_vectors(prompts: DataFrame) -> tuple[list[list[float]], int]:
    """(distractor vectors in slot order, how many of them are explicit) of a list that fits in a worker."""
    rows = shared_rows(prompts).orderBy("slot").collect()
    if len({r["slot"] for r in rows}) != len(rows):
        raise ValueError("the distractors must be one list shared by all classes")
    kinds = [r["kind"] for r in rows]
    if kinds != sorted(kinds, key=lambda k: k == "explicit"):
        raise ValueError("explicit distractors must come last")
    return [list(r["vec"]) for r in rows], kinds.count("explicit")


def decide(probs: Column, n_explicit: int, threshold: float, explicit: float) -> Column:
    """'explicit', 'off_topic' or 'keep' from the slot probabilities."""
    tail = array_total(F.slice(probs, F.size(probs) - (n_explicit - 1), n_explicit)) if n_explicit else F.lit(0.0)
    return (
        F.when(tail > explicit, "explicit")
        .when((F.get(probs, F.lit(0)) < threshold) | (argmax(probs) != 0), "off_topic")
        .otherwise("keep")
    )


def relevance_gate(
    items: DataFrame, prompts: DataFrame, class_col: str, vec_col: str, file_name: str,
    threshold: float = fixed.KEEP_THRESHOLD, explicit: float = fixed.EXPLICIT_THRESHOLD,
    trusted: Sequence[str] = ("seed_",), scale: float = fixed.SIMILARITY_SCALE, block_bytes: int | None = None,
) -> DataFrame:
    """Add ``p_target``, ``p_explicit`` and ``decision``; a class without a target prompt gives ``no_prompt``.

    ``prompts`` is (class_name, slot, kind, vec). The distractors are one
    list; one that fits in a worker (measured) travels with the function, a longer one (any, if ``block_bytes`` is given) is met block by block. The target
    vector of a class comes by a measured join. Trusted rows get no vector, so they are never scored."""
    listed = settle(shared_rows(prompts))
    if block_bytes is not None or not fits_broadcast(listed):
        return _blocked_gate(items, prompts, listed, class_col, vec_col, file_name, threshold, explicit, trusted, scale, block_bytes)
    shared, n_explicit = shared_vectors(listed)
    targets = prompts.filter("kind = 'target'").select(F.col("class_name").alias(class_col), F.col("vec").alias("__target"))
    is_trusted = F.lit(False)
    for prefix in trusted:
        is_trusted = is_trusted | F.col(file_name).startswith(prefix)
    scored = (
        lookup_join(items, targets, [class_col], how="left")
        .withColumn("__vec", F.when(~is_trusted, F.col(vec_col)))
        .withColumn("__p", gate_softmax(F.col("__vec"), F.col("__target"), shared, scale))
    )
    p = F.col("__p")
    return scored.select(
        *items.columns,
        F.get(p, F.lit(0)).alias("p_target"),
        (array_total(F.slice(p, F.size(p) - (n_explicit - 1), n_explicit)) if n_explicit else F.lit(0.0)).alias("p_explicit"),
        F.when(is_trusted, "trusted").when(F.col(vec_col).isNotNull() & F.col("__target").isNull(), "no_prompt")
        .when(p.isNull(), "unreadable")
        .otherwise(decide(p, n_explicit, threshold, explicit)).alias("decision"),
    )


def _blocked_gate(items, prompts, listed, class_col, vec_col, file_name, threshold, explicit, trusted, scale, block_bytes) -> DataFrame:
    """The gate for a list of distractors of any length: sums over their blocks."""
    repeated = listed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError("the distractors must be one list shared by all classes")
    last, first = listed.agg(F.max(F.when(F.col("kind") != "explicit", F.col("slot"))), F.min(F.when(F.col("kind") == "explicit", F.col("slot")))).first()
    if last is not None and first is not None and last > first:
        raise ValueError("explicit distractors must come last")
    targets = prompts.filter("kind = 'target'").select(F.col("class_name").alias(class_col), F.col("vec").alias("__target"))
    is_trusted = F.lit(False)
    for prefix in trusted:
        is_trusted = is_trusted | F.col(file_name).startswith(prefix)
    rows = lookup_join(items, targets, [class_col], how="left").withColumn(
        "__vec", F.when(~is_trusted & F.col("__target").isNotNull(), F.col(vec_col)))
    for kind in ("generic", "explicit"):
        rows = shared_sums(rows, "__vec", listed, kind, f"__{kind}", scale, block_bytes)
    own = F.lit(float(scale)) * dot(l2_normalise(F.col("__vec")), l2_normalise(F.col("__target")))
    rows = rows.withColumn("__own", own).withColumn("__other", F.greatest("__generic_m", "__explicit_m")).withColumn(
        "__top", F.greatest("__own", "__other"))

    def mass(kind: str) -> Column:
        return F.when(F.col(f"__{kind}_s") > 0, F.exp(F.col(f"__{kind}_m") - F.col("__top")) * F.col(f"__{kind}_s")).otherwise(F.lit(0.0))

    whole = F.exp(F.col("__own") - F.col("__top")) + mass("generic") + mass("explicit")
    scored = F.col("__own").isNotNull()
    p_target = F.when(scored, F.exp(F.col("__own") - F.col("__top")) / whole)
    p_explicit = F.when(scored, mass("explicit") / whole)
    # slot 0 wins a tie with a distractor
    judged = F.when(p_explicit > explicit, "explicit").when((p_target < threshold) | (F.col("__own") < F.col("__other")), "off_topic").otherwise("keep")
    return rows.select(
        *items.columns, p_target.alias("p_target"), p_explicit.alias("p_explicit"),
        F.when(is_trusted, "trusted").when(F.col(vec_col).isNotNull() & F.col("__target").isNull(), "no_prompt")
        .when(~scored, "unreadable").otherwise(judged).alias("decision"))


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("decision").isin("trusted", "keep"))
