"""Scorers, top-k, two-model routing and the answers built from them.

All of it is row by row in array form: no shuffle, and the same functions run
on a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.functions.text import canonical_label
from tagloom.functions.vectors import matrix_softmax, matrix_top, model_probs, ranked_pairs
from tagloom.operators.blocked import BlockedScorer, numbered_vectors
from tagloom.operators.sizing import fits_broadcast

# Names of the two answering models.
ROUTED, DIRECT = "legacy-gen1", "gen1-3"


class Scorer(Protocol):
    """Adds ``out``: array<double> of class probabilities in the order of
    ``names``. Rows with NULL features get NULL and must not be scored. A scorer may also have
    ``top(features, k)``: its ``k`` best (idx, p) without the whole array."""

    names: Sequence[str]

    def __call__(self, df: DataFrame, features: str, out: str) -> DataFrame: ...


@dataclass
class PrototypeScorer:
    """softmax(scale * cosine similarity to one vector per class)."""

    names: Sequence[str]
    vectors: Sequence[Sequence[float]]
    scale: float = fixed.SIMILARITY_SCALE

    def __call__(self, df: DataFrame, features: str, out: str) -> DataFrame:
        return df.withColumn(out, matrix_softmax(F.col(features), self.vectors, scale=self.scale, unit=True))

    def top(self, features: str, k: int) -> Column:
        return matrix_top(F.col(features), self.vectors, k, scale=self.scale, unit=True)


@dataclass
class LinearScorer:
    """softmax(W x + b): the classifier head on ready features."""

    names: Sequence[str]
    weights: Sequence[Sequence[float]]
    bias: Sequence[float]
    converged: bool = True

    def __call__(self, df: DataFrame, features: str, out: str) -> DataFrame:
        return df.withColumn(out, matrix_softmax(F.col(features), self.weights, self.bias))

    def top(self, features: str, k: int) -> Column:
        return matrix_top(F.col(features), self.weights, k, self.bias)


@dataclass
class BatchScorer:
    """Any model behind a loader: ``make_predict`` runs once per Python worker and
    returns a function from a numpy batch to a matrix of probabilities."""

    names: Sequence[str]
    make_predict: Callable
    width: int
    batch_size: int = 256

    def __call__(self, df: DataFrame, features: str, out: str) -> DataFrame:
        return df.withColumn(out, model_probs(F.col(features), self.make_predict, self.width, self.batch_size))


BACKBONES: dict[str, Callable[..., Scorer]] = {
    "prototype": PrototypeScorer,
    "linear": LinearScorer,
    "batch": BatchScorer,
}


def make_scorer(backbone: str, **params) -> Scorer:
    if backbone not in BACKBONES:
        raise ValueError(f"unknown backbone {backbone}")
    return BACKBONES[backbone](**params)


def prototype_scorer(
    prototypes: DataFrame, name: str, vec: str, scale: float = fixed.SIMILARITY_SCALE,
) -> PrototypeScorer | BlockedScorer:
    """Scorer from a table with one vector per class, classes in code-point order.

    A model that fits in a worker (measured) is loaded whole; a larger one stays a table and is scored block by block, with
    the same answers."""
    if not fits_broadcast(prototypes.select(name, vec)):
        return blocked_scorer(prototypes, name, vec, scale)
    rows = prototypes.select(F.col(name).cast("string").alias("n"), F.col(vec).alias("v")).orderBy("n").collect()
    return PrototypeScorer([r["n"] for r in rows], [list(r["v"]) for r in rows], scale)


def blocked_scorer(
    prototypes: DataFrame, name: str, vec: str, scale: float = fixed.SIMILARITY_SCALE, block_bytes: int | None = None,
) -> BlockedScorer:
    """Scorer over blocks of classes, for a model of any size."""
    named = prototypes.select(F.col(name).cast("string").alias("name"), F.col(vec).alias("vec"))
    return BlockedScorer(numbered_vectors(named, ["name"], "vec"), scale, block_bytes)


def name_list(names: Sequence[str]) -> Column:
    """The names as one constant, however many there are."""
    return F.from_json(F.lit(json.dumps(list(names))), "array<string>")


def top_k(probs: Column, names: Sequence[str], k: int = 3) -> Column:
    """array<struct<name, confidence>>, confidence in percent, best first; the
    lower class index wins a tie; never longer than the number of classes."""
    if k < 1:
        raise ValueError("k must be at least 1")
    labels = name_list(names)
    ranked = F.sort_array(F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("idx"))))
    return F.transform(
        F.slice(ranked, 1, k),
        lambda s: F.struct(F.get(labels, s["idx"]).alias("name"), (-s["neg"] * 100).alias("confidence")))


def best_k(probs: Column, names: Sequence[str], k: int = 3) -> Column:
    """Same as :func:`top_k`, ranked in Python right behind a scorer that runs
    there: for a wide vocabulary far less data comes back than the whole array."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return _named(ranked_pairs(probs, k), names)


def _named(pairs: Column, names: Sequence[str]) -> Column:
    labels = name_list(names)
    return F.transform(
        pairs, lambda s: F.struct(F.get(labels, s["idx"]).alias("name"), (s["p"] * 100).alias("confidence")))


def best_of(df: DataFrame, scorer: Scorer, features: str, k: int, out: str) -> DataFrame:
    """Add the scorer's ``k`` best classes, in blocks if the scorer can."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if hasattr(scorer, "best"):
        return scorer.best(df, features, k, out)
    if hasattr(scorer, "top"):
        return df.withColumn(out, _named(scorer.top(features, k), scorer.names))
    return scorer(df, features, "__p").withColumn(out, best_k(F.col("__p"), scorer.names, k)).drop("__p")


def score(df: DataFrame, scorer: Scorer, features: str, k: int = 3, out: str = "predictions") -> DataFrame:
    """Add the scorer's ``k`` best classes. Explode the result with the outer form:
    the plain one makes Spark test its size first and score every row twice."""
    return best_of(df, scorer, features, k, out)


def merge_aliases(predictions: Column, aliases: Mapping[str, str], merge: bool = False) -> Column:
    """Canonical names. Two entries may end up with one name and stay two, unless ``merge`` adds their confidences up; the merged
    entries are in falling order again, the earlier one first on a tie."""
    renamed = F.transform(
        predictions,
        lambda s: F.struct(canonical_label(s["name"], aliases).alias("name"), s["confidence"].alias("confidence")))
    if not merge:
        return renamed
    names = F.array_distinct(F.transform(renamed, lambda s: s["name"]))
    # the entries ride along, so that they are renamed once
    boxed = F.array(F.struct(renamed.alias("r"), names.alias("n")))
    summed = F.transform(boxed, lambda b: F.transform(b["n"], lambda n, i: F.struct(
        (-F.aggregate(F.filter(b["r"], lambda s: s["name"] == n), F.lit(0.0), lambda acc, s: acc + s["confidence"])).alias("minus"),
        i.alias("i"), n.alias("name"))))[0]
    return F.transform(F.array_sort(summed), lambda s: F.struct(s["name"].alias("name"), (-s["minus"]).alias("confidence")))


def route(
    df: DataFrame, predictions: str, features: str, second: Scorer, members: Sequence[str],
    aliases: Mapping[str, str] = fixed.LABEL_ALIASES, trust: float = fixed.TRUST, k: int = 3, merge: bool = False,
) -> DataFrame:
    """Add ``model`` and replace ``predictions`` by the second model's where the
    first model's best class is a member and the second model is confident. ``merge`` as in :func:`merge_aliases`; it comes
    before the test of confidence.

    Only member rows hand their features to the second model; the others pass
    NULL, so one narrow stage does it all, without a join."""
    best = F.get(F.col(predictions), F.lit(0))["name"]
    asked = df.withColumn("__f", F.when(best.isin(*members), F.col(features)))
    answered = best_of(asked, second, "__f", k, "__second").withColumn("__second", merge_aliases(F.col("__second"), aliases, merge))
    # the product, not the literal 55: it is a little above it in doubles
    sure = F.coalesce(F.get(F.col("__second"), F.lit(0))["confidence"] >= F.lit(trust * 100), F.lit(False))
    return (
        answered.withColumn("model", F.when(sure, ROUTED).otherwise(DIRECT))
        .withColumn(predictions, F.when(sure, F.col("__second")).otherwise(F.col(predictions)))
        .drop("__f", "__second")
    )


def verdict(df: DataFrame, predictions: str = "predictions", threshold: float = fixed.VERDICT_THRESHOLD) -> DataFrame:
    """Add ``top_name``, ``top_confidence`` (2 decimals), ``verdict``, ``message``.

    The rounded confidence is compared with the threshold."""
    top = F.get(F.col(predictions), F.lit(0))
    name, conf = top["name"], F.round(top["confidence"], 2)
    return df.select(
        "*", name.alias("top_name"), conf.alias("top_confidence"),
        F.when(conf < threshold, "low").otherwise("match").alias("verdict"),
        F.when(conf < threshold, F.format_string("best guess: %s, %.1f%%", name, conf))
        .otherwise(F.format_string("%s %.1f%%", name, conf)).alias("message"),
    )


def to_response(df: DataFrame, model: str = "model", predictions: str = "predictions", out: str = "response") -> DataFrame:
    """JSON document {model, predictions: [{name, confidence}]} in rank order."""
    rounded = F.transform(
        F.col(predictions),
        lambda s: F.struct(s["name"].alias("name"), F.round(s["confidence"], 2).alias("confidence")))
    return df.withColumn(out, F.to_json(F.struct(F.col(model).alias("model"), rounded.alias("predictions"))))
