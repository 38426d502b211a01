"""Composite jobs that prepare training tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.operators.evaluation import class_counts, class_weights
from tagloom.operators.head import fit_head
from tagloom.operators.ranking import class_index, class_vocabulary
from tagloom.operators.sampling import balanced_resample, draw_recipes, select_split, stratified_split
from tagloom.operators.scoring import LinearScorer
from tagloom.operators.sizing import lookup_join, settle


@dataclass
class Prepared:
    """Parts of a training table; the small jobs behind a part run when it is first asked for."""

    vocab: DataFrame      # (class_idx, class_name)
    items: DataFrame      # input + class_idx + split, a narrow pass over the input
    label: str
    id_col: str
    seed: int
    n: int | None

    @cached_property
    def keys(self) -> DataFrame:
        """Label and id of the train rows, written once; vectors and pixels stay where they are."""
        return settle(select_split(self.items, "train").select(self.label, self.id_col))

    @cached_property
    def train_counts(self) -> DataFrame:
        return class_counts(select_split(self.items, "train"), self.label, self.vocab)

    @cached_property
    def weights(self) -> DataFrame:
        """Train rows with weight."""
        return class_weights(select_split(self.items, "train"), self.label)

    @cached_property
    def draws(self) -> DataFrame:
        """One epoch of balanced draws from the train rows."""
        return balanced_resample(self.keys, self.label, self.id_col, self.n, self.seed)

    def weighted_draws(self) -> DataFrame:
        """``draws`` with ``weight``: a lookup by class, as one row may be drawn very often."""
        weights = self.train_counts.select(
            F.col("class_name").alias(self.label), (F.lit(1.0) / F.greatest(F.col("n"), F.lit(1))).alias("weight"))
        return lookup_join(self.draws, settle(weights), [self.label])


def prepare(df: DataFrame, label: str, id_col: str, seed: int = fixed.SEED, n: int | None = None) -> Prepared:
    """Class index, stratified split, counts, weights and a balanced resample."""
    vocab = settle(class_vocabulary(df, label))
    return Prepared(vocab, stratified_split(class_index(df, label, vocab), label, id_col, seed=seed), label, id_col, seed, n)


def two_phase_heads(
    clear: DataFrame, drawn: DataFrame, features: str, label: str, **options,
) -> tuple[LinearScorer, LinearScorer]:
    """Head on the features of the clear items, then, starting from it, the head on
    the features of their drawn copies."""
    first = fit_head(clear, features, label, **options)
    return first, fit_head(drawn, features, label, start=first, **options)


def second_phase(items: DataFrame, id_col: str, seed: int = fixed.SEED, variants: int = 1) -> DataFrame:
    """Recipes of the drawn-style phase on the split of the first phase.

    Train rows: probability 0.9 and all styles; val and test rows: always the
    pencil style, with fixed draws so that the score can be repeated."""
    train = draw_recipes(items.filter("split = 'train'"), id_col, variants, fixed.TRAIN_SKETCH_P, fixed.SKETCH_STYLES, seed)
    held = draw_recipes(items.filter("split <> 'train'"), id_col, 1, fixed.EVAL_SKETCH_P, ("pencil",), seed)
    tagged = train.withColumn("phase_split", F.lit("train")).unionByName(held.withColumn("phase_split", F.lit("held_out")))
    return tagged
