import zlib

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import language


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language.identify_languages(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= got[r["doc_id"]]["score"] <= 1
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and len(r["text"]) > 100]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def brute(word, table, languages):
    """Mean penalty of one word, straight from the table of shares."""
    absent = {0: -np.log10(language.WORD_FLOOR) + 1, 1: -np.log10(language.GRAM_FLOOR) + 1}
    if any((x, 0, word) in table for x in languages):
        return [-np.log10(table[x, 0, word]) if (x, 0, word) in table else absent[0] for x in languages]
    for n in range(language.LONGEST, 0, -1):
        hits = [g for g in language.grams(word, n) if any((x, n, g) in table for x in languages)]
        if hits:
            return [np.mean([-np.log10(table[x, n, g]) if (x, n, g) in table else absent[1] for g in hits]) for x in languages]
    return [absent[1]] * len(languages)


def test_backoff_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.entries(language.training_rows(docs)).toPandas()
    table = {(r.lang, r.size, r.entry): r.share for r in found.itertuples()}
    model = language.Model(found)
    scorer = language.Scorer(model)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["zzzqqq ЖЖ the", "é", "x" * 3000]
    lang, score = scorer(texts)
    for t, x, s in zip(texts, lang, score):
        mean = np.mean([brute(w, table, model.languages) for w in language.text_words(t)], axis=0)
        assert x == model.languages[int(np.argmin(mean))]
        assert abs(s - 1 / np.power(10.0, mean.min() - mean).sum()) < 1e-4


def test_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(9)] + [(20 + i, "der hund und die katze", "de") for i in range(9)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 !?", "de"), (None, "der hund", None), (53, "THE dog", None), (53, "THE dog", None), (54, "…", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify_languages(df).collect()]
    assert len(got) == len(rows)
    assert {(i, x) for i, x, _ in got if i in (50, 51, 52, 54)} == {(50, "und"), (51, "und"), (52, "und"), (54, "und")}
    assert [x for i, x, _ in got if i is None] == ["de"] and [x for i, x, _ in got if i == 53] == ["en", "en"]
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_languages(nothing).collect()} == {"und"}
    assert language.identify_languages(df.limit(0)).count() == 0


def test_lang_and_source_are_no_inputs_of_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a = {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(docs).collect()}
    assert a == {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(other).collect()}


def test_the_model_grows_with_its_entries_not_with_entries_times_languages(spark):
    """Sixty languages with words of their own: the shared arrays hold one value per language that has an entry."""
    import pickle
    import random

    rows = []
    for k in range(60):
        r = random.Random(k)
        vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(700)]
        rows += [(k * 12 + i, " ".join(r.choice(vocab) for _ in range(900)), f"l{k:02d}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    entries = sum(map(len, model.less))
    assert len(model.languages) == 60 and entries > 150_000
    assert sum(x.nbytes for part in (model.start, model.lang, model.less) for x in part) <= 12 * entries + 100
    assert len(pickle.dumps(model)) < 60 << 20
    got = language.predict(df, model, {"lang": F.col("lang")}).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_floors_rise_with_the_languages(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = language.entries(language.training_rows(docs)).count()
    monkeypatch.setattr(language, "LANGUAGES", 0.05)
    few = language.entries(language.training_rows(docs)).toPandas()
    assert 0 < len(few) < whole / 2
    assert few["share"].min() >= language.WORD_FLOOR * few["lang"].nunique() / 0.05
