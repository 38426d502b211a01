import math
import random

import plain
import pytest
from pyspark.sql import functions as F

from tagloom.llm import quality


def test_base_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        g, want = got[r["doc_id"]], plain.quality_base(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g["base_failed"] and g["kept"])


@pytest.mark.parametrize("k, n, p", [(0, 50, 0.1), (3, 40, 0.2), (12, 40, 0.2), (40, 40, 0.5), (5, 1000, 0.01)])
def test_binomial(k, n, p):
    exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_cdf(k, n, p) == pytest.approx(exact, rel=1e-9)
    if k < n:
        bound = quality.upper_bound(k, n, 0.05)
        assert quality.binomial_cdf(k, n, bound) == pytest.approx(0.05, rel=1e-6)


def test_cutoffs_reject_junk_and_keep_their_promise(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(3000):
        junk = i % 5 == 0
        rows.append((i, " ".join(word() + ("$$$" if junk else "") for _ in range(30)), "en" if i % 2 else "fr"))
        labels.append((i, 0 if junk else 1))
    rows.append((9001, " ".join(word() + "$$$" for _ in range(30)), None))  # no promise for its stratum
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.quality_rules(df, labels, alpha=0.05).collect()}
    assert all(got[i]["kept"] == (i % 5 != 0) for i in range(3000))
    assert got[9001]["kept"]
    assert all(got[i]["bound_symbol_share"] <= 0.05 / len(quality.RULES) for i in range(3000))


def test_noisy_labels_give_no_cutoff():
    import pandas as pd

    counts = [300] + [0] * (len(quality.path_steps()) - 1)
    found = quality.choose_cutoffs(pd.DataFrame([{"stratum": "en", "n_good": 1000, "rejected": counts}]), 1, 0.02, 0.05)
    assert found["cutoff"].isna().all()


def test_the_path_is_nested_and_ends_at_the_strictest_cutoffs():
    path = quality.path_steps()
    assert dict(path) == {r: grid[-1] for r, grid in quality.RULES.items()} and len(path) == sum(map(len, quality.RULES.values()))
    for r, grid in quality.RULES.items():
        assert [c for k, c in path if k == r] == list(grid)


@pytest.mark.parametrize("n, strata", [(400, 4), (1500, 4), (250, 1)])
def test_the_promise_holds_in_simulation(n, strata):
    """200 draws of holdouts from known risks: the chosen step's true risk is over alpha in at most a share delta / strata of them."""
    alpha, delta, steps = 0.02, 0.05, len(quality.path_steps())
    failed = chosen_at_all = 0
    for seed in range(200):
        r = random.Random(seed)
        # risks that creep over alpha somewhere on the path
        share = [r.random() * 2 * alpha * 3 / steps for _ in range(steps)]
        draws = [0] * steps
        for _ in range(n):
            u = r.random()
            for k, p in enumerate(share):
                u -= p
                if u < 0:
                    draws[k] += 1
                    break
        step, bound = quality.chosen_step(draws, n, strata, alpha, delta)
        chosen_at_all += step is not None
        failed += step is not None and sum(share[: step + 1]) > alpha
    assert failed <= 0.05 * 200 and chosen_at_all > (100 if n > 400 else 0)


def test_few_hundred_documents_suffice_and_copies_do_not_count(spark):
    """400 distinct good documents give a stratum cutoffs; 2,500 copies of one text are one trial and give none."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(30)), "few") for i in range(400)] + [(1000 + i, "one two three four five " * 5, "same") for i in range(2500)]
    rows += [(9000, " ".join(word() + "$$$" for _ in range(30)), "few"), (9001, " ".join(word() + "$$$" for _ in range(30)), "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows if i < 9000], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.quality_rules(df, labels).collect()}
    assert not got[9000]["kept"] and got[9001]["kept"]
    assert got[0]["n_good"] == 400 and got[0]["bound_symbol_share"] <= quality.ALPHA


def plain_kept(rows, labels, alpha=quality.ALPHA, delta=quality.DELTA):
    """The verdicts in plain Python, from the definitions: (doc_id, text, stratum) rows, (doc_id, quality) labels."""
    bad_end = set("!|#*$%&<>")

    def values(text):
        ws = plain.split(text)
        n, chars, symbols, dup, repeat = plain.quality_base(text)
        lines = [x for x in (text or "").split("\n") if plain.split(x)]
        marked = sum(w[-1] in bad_end and (len(w) == 1 or w[-2] in bad_end) for w in ws)
        upper = sum(len(w.encode()) > 1 and w.isupper() for w in ws)
        share = lambda a, b: a / b if b else 0.0
        return {"symbol_share": share(symbols, chars), "marked_words": share(marked, n), "dup_line_share": share(dup, len(lines)),
                "repeat_share": share(repeat, n), "upper_share": share(upper, n)}, n < 20 or 100 * repeat > 30 * n

    path = [(r, grid[j]) for j in range(max(map(len, quality.RULES.values()))) for r, grid in quality.RULES.items() if j < len(grid)]
    by_id = {}
    for i, q in labels:
        if i is not None and q is not None:
            by_id.setdefault(i, []).append(q)
    good = {i for i, qs in by_id.items() if min(qs) == 1}
    seen = {i: (text, stratum, *values(text)) for i, text, stratum in rows}
    trials = {}
    for i, (text, stratum, vals, failed) in seen.items():
        if i in good and not failed:
            trials.setdefault(stratum, {})[text] = vals
    cuts = {}
    for stratum, held in trials.items():
        error, n = delta / len(trials), len(held)
        active = {}
        for r, c in path:
            tried = {**active, r: c}
            k = sum(any(v[q] > x for q, x in tried.items()) for v in held.values())
            # the bound is within alpha if k or fewer rejections would be as rare as the error at alpha
            tail = sum(math.comb(n, i) * alpha ** i * (1 - alpha) ** (n - i) for i in range(k + 1))
            if tail > error:
                break
            active = tried
        cuts[stratum] = active
    return {i: not failed and not any(vals[r] > c for r, c in cuts.get(stratum, {}).items()) for i, (_, stratum, vals, failed) in seen.items()}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_verdicts_equal_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{folder}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want = plain_kept(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, labels).collect()}
    assert got == want


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "en", 3), (2, "", "en", 3), (3, text, None, 3), (3, text, None, 3), (None, text, "en", 3), (None, "x", "en", 3),
            (4, "a b " * 5000, "en", 3), (5, "\n\n \n" + text + "\n" + text + "\n", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.quality_rules(df, labels)
    assert sorted(((x["doc_id"], x["n_words"], x["n_dup_lines"], x["kept"]) for x in out.collect()), key=str) == sorted(
        [(1, 0, 0, False), (2, 0, 0, False), (3, 40, 0, True), (3, 40, 0, True), (None, 40, 0, True), (None, 1, 0, False),
         (4, 10000, 0, False), (5, 80, 1, False)], key=str)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert sorted((str(x["doc_id"]) for x in kept.collect())) == ["3", "3", "None"]
    assert quality.quality_rules(df.limit(0), labels.limit(0)).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == 3


def test_stage_keeps_the_rows_that_the_rules_keep(spark):
    """Cutoffs reject rows without an id and single rows of a repeated id."""
    r = random.Random(2)
    text = lambda junk: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) + ("$$$" if junk else "") for _ in range(30))
    rows = [(i, text(i % 5 == 0), "en") for i in range(4000)]
    labels = [(i, 0 if i % 5 == 0 else 1) for i in range(4000)]
    rows += [(None, text(True), "en"), (None, text(False), "en"), (9001, text(True), "en"), (9001, text(False), "en"), (9002, text(True), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__row", F.lit(1)).withColumn("kept", F.lit(0))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns
    got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str)
    assert got == sorted(((i, t) for i, t, lang in rows if "$" not in t or lang is None), key=str)
    verdict = quality.quality_rules(df, labels).where("kept").collect()
    assert sorted((x["doc_id"] for x in verdict), key=str) == sorted((i for i, _ in got), key=str)
