"""Quality rules whose cutoffs are fixed by labelled holdouts with a bounded false rejection rate.

The rules are tightened together along one path that is fixed beforehand. Per stratum the exact binomial bound of what a step rejects of the
good documents, all rules together, is tested step by step; the last step within the risk gives the cutoffs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts, words, written

#: Share of the good documents of a stratum that the rules may reject together, and the probability
#: that this promise fails in any stratum.
ALPHA, DELTA = 0.02, 0.05

#: Candidate cutoffs of each rule, fixed before any label is seen, mildest first; a rule rejects values above.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05, 0.02),
    "marked_words": (0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20, 0.10),
    "dup_line_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30),
    "repeat_share": (0.29, 0.26, 0.23, 0.20, 0.17, 0.14, 0.11, 0.08),
    "upper_share": (0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40),
}
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marked", "n_upper"]


def repeated_words(numbers: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, whether a window of its text that covers it occurs twice in that text.

    ``numbers`` names the words, ``owner`` the texts. Windows are named exactly, by renaming pairs
    of windows half as long.
    """
    n = len(numbers)
    inside = np.zeros(n, dtype=bool)
    if n < window:
        return inside
    name, length = np.unique(numbers, return_inverse=True)[1].astype(np.int64), 1
    while length < window:
        pair = name[:-length] * (int(name.max()) + 1) + name[length:]
        name, length = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * length
    whole = np.flatnonzero(owner[: n - window + 1] == owner[window - 1:])
    key = owner[whole] * (int(name.max(initial=0)) + 1) + name[whole]
    _, back, often = np.unique(key, return_inverse=True, return_counts=True)
    twice = whole[often[back] > 1]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.cumsum(edge[:n]) > 0


def _signals(texts: list[str | None]) -> dict:
    out = {k: np.zeros(len(texts), np.int64) for k in SIGNALS}
    index: dict[bytes, int] = {}
    flat, owner = [], []
    for k, t in enumerate(texts):
        if not t:
            continue
        ws = words(t)
        name = index.setdefault
        flat += [name(w, len(index)) for w in ws]
        owner.append((k, len(ws)))
        out["n_words"][k] = len(ws)
        out["word_chars"][k] = len(t) - sum(map(t.count, " \t\n\v\f\r"))
        out["n_symbols"][k] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        out["n_lines"][k] = len(lines)
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
    # per distinct word: ends in a mark that sentences do not end with; is in capitals
    marked = np.fromiter((w[-1:] in b"!|#*$%&<>" and (len(w) == 1 or w[-2:-1] in b"!|#*$%&<>") for w in index), bool, len(index))
    upper = np.fromiter((len(w) > 1 and (u := w.decode()).isupper() for w in index), bool, len(index))
    numbers = np.array(flat, dtype=np.int64)
    own = np.repeat([k for k, _ in owner], [n for _, n in owner]).astype(np.int64)
    size = len(texts)
    if len(numbers):
        out["n_repeat_words"] = np.bincount(own, weights=repeated_words(numbers, own), minlength=size).astype(np.int64)
        out["n_marked"] = np.bincount(own, weights=marked[numbers], minlength=size).astype(np.int64)
        out["n_upper"] = np.bincount(own, weights=upper[numbers], minlength=size).astype(np.int64)
    return out


def signals(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` with the counts of SIGNALS for each whole text (null: zeros), in one narrow pass."""
    return map_texts(docs, keep, F.col(text), [T.StructField(s, T.LongType()) for s in SIGNALS], lambda: _signals)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_value(rule: str) -> Column:
    top, below = {"symbol_share": ("n_symbols", "word_chars"), "marked_words": ("n_marked", "n_words"),
                  "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
                  "upper_share": ("n_upper", "n_words")}[rule]
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial. Terms are added from k downwards and get smaller, as k < n p."""
    if k >= n:
        return 1.0
    if k >= n * p:
        return max(0.0, 1.0 - binomial_cdf(n - k - 1, n, 1 - p)) if k < n else 1.0
    log = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, term, i = 0.0, 1.0, k
    while i >= 0 and term > 1e-17 * max(total, 1e-300):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, math.exp(log) * total)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact one-sided upper confidence bound of a binomial share (Clopper and Pearson)."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if binomial_cdf(k, n, mid) <= error else (mid, high)
    return high


def path_steps() -> list[tuple[str, float]]:
    """The one path along which the rules are tightened, fixed before any label is seen: in turn each rule goes on to its next cutoff.
    A step stands for the cutoffs of all steps up to it, so what it rejects contains what the steps before reject."""
    return [(r, grid[j]) for j in range(max(map(len, RULES.values()))) for r, grid in RULES.items() if j < len(grid)]


def first_step() -> Column:
    """The first step of the path that rejects a document; null if none does."""
    at: dict[str, list[int]] = {r: [] for r in RULES}
    for k, (r, _) in enumerate(path_steps()):
        at[r].append(k)
    # a value is over a rule's j-th cutoff and no milder one if j cutoffs are at or above it
    steps = [F.get(F.array(*map(F.lit, at[r])), sum(((rule_value(r) <= c).cast("int") for c in grid), F.lit(0))) for r, grid in RULES.items()]
    return F.least(*steps)


def chosen_step(rejected: list[int], n_good: int, strata: int, alpha: float, delta: float) -> tuple[int | None, float | None]:
    """The last step that can be promised, and its bound. ``rejected`` has the number of good documents that each step rejects first.

    Steps are tested in order, each with the error delta / strata for the joint share that it rejects, and testing stops at the first that fails, so
    neither steps nor rules ask for a further correction; the union over strata keeps the promise. A step is promised from
    log(delta / strata) / log(1 - alpha) documents on if it rejects none of them (217 for four strata, 0.02 and 0.05)."""
    chosen = bound = None
    total = 0
    for step, n in enumerate(rejected):
        total += n
        found = upper_bound(total, n_good, delta / strata)
        if found > alpha:
            break
        chosen, bound = step, found
    return chosen, bound


def choose_cutoffs(counts: pd.DataFrame, strata: int, alpha: float, delta: float) -> pd.DataFrame:
    """stratum, rule, cutoff, bound, n_good for strata given as stratum, n_good and rejected (of each step)."""
    path, out = path_steps(), []
    for row in counts.to_dict("records"):
        step, bound = chosen_step(list(row["rejected"]), int(row["n_good"]), strata, alpha, delta)
        cuts = dict(path[: step + 1]) if step is not None else {}
        out += [(row["stratum"], r, cuts.get(r), bound if r in cuts else None, int(row["n_good"])) for r in RULES]
    return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "bound", "n_good"])


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum one row: stratum, a cutoff per rule (null: none can be promised), the bound of the joint risk and the holdout's size.

    ``scored`` has doc_id, stratum, text_hash and SIGNALS, ``labels`` doc_id and quality. The holdout is every labelled
    good document (a document with several labels is good if all of them are; null labels and ids count for nothing) that
    passes the base rules; copies of a text in a stratum are one trial. No labels: no rows, and no rule rejects anything.
    """
    good = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("__quality")).where(F.col("__quality") == 1).drop("__quality"))
    held = scored.where(~base_failed()).select("doc_id", "stratum", "text_hash", first_step().alias("step"))
    trials = held.join(good, "doc_id", "left_semi").groupBy("stratum", "text_hash").agg(F.min("step").alias("step"))
    counts = trials.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), F.array(*[F.count_if(F.col("step") == k) for k in range(len(path_steps()))]).alias("rejected"))
    counts = written(counts, "quality-counts")
    strata = max(1, counts.count())
    schema = T.StructType([T.StructField("stratum", T.StringType()), T.StructField("rule", T.StringType()),
                           T.StructField("cutoff", T.DoubleType()), T.StructField("bound", T.DoubleType()),
                           T.StructField("n_good", T.LongType())])
    long = counts.mapInPandas(lambda it: (choose_cutoffs(pdf, strata, alpha, delta) for pdf in it), schema)
    wide = long.groupBy("stratum").agg(F.max("n_good").alias("n_good"), *[
        f for r in RULES for f in (F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}"),
                                   F.max(F.when(F.col("rule") == r, F.col("bound"))).alias(f"bound_{r}"))])
    return written(wide, "quality-cutoffs")


def verdicts(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """``scored`` with the cutoffs of its stratum and base_failed, rejected_by, kept: each row by its own counts."""
    from tagloom.operators.sizing import lookup_join

    judged = lookup_join(scored, cuts, ["stratum"], null_safe=True)
    hits = [F.when(rule_value(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]
    return (judged.withColumn("base_failed", base_failed())
            .withColumn("rejected_by", F.array_join(F.array_compact(F.array(*hits)), ","))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Verdict on every document: doc_id, the base counts, base_failed, kept, rejected_by.

    A null or empty text has no words and fails the base. A null stratum is a stratum of its own. Rows that repeat an
    id each get a row; copies of a text are one trial of the holdout. Documents of a stratum without a promised cutoff are kept
    unless the base fails: a stratum has cutoffs from about 220 distinct good documents on (four strata), more if a step rejects some.
    Very long texts are read whole, an empty table gives no rows, other columns are not read. Texts are read once; thereafter only counts are joined.
    """
    keep = {"doc_id": F.col("doc_id"), "stratum": F.col(stratum).cast("string"), "text_hash": F.xxhash64("text")}
    scored = written(signals(docs, keep), "quality-signals")
    cuts = cutoffs(scored, labels, alpha, delta)
    judged = verdicts(scored, cuts)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "rejected_by", "stratum", "n_good", *[f"cut_{r}" for r in RULES], *[f"bound_{r}" for r in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns: the rows to which ``quality_rules`` gives kept, whatever their
    ids. The signals of a row are computed once and written beside it; once the cutoffs are known each row is judged by its own. Texts
    are not joined."""
    keep = {"__row": F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "doc_id": F.col("doc_id"), "stratum": F.col(stratum).cast("string"),
            "text_hash": F.xxhash64("text")}
    rows = written(signals(docs, keep), "quality-rows")
    cuts = cutoffs(rows, labels)
    return verdicts(rows, cuts).where("kept").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
