import random
from collections import Counter

import plain
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm.quality import quality_rules


def test_stages_keep_the_columns_and_the_result_is_right(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality, simhash, pii, mixing, encoding = [f for _, f in corpus_pipeline.STAGES]
    kept = quality(spark, docs, folder)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
    kept = simhash(spark, kept, folder)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert left < good and len(left) == len({text[i] for i in left})
    masked = pii(spark, kept, folder)
    assert masked.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert set(after) == left
    for i, t in after.items():
        assert not plain.pii(t) and (plain.pii(text[i]) or t == text[i])
    mixed = mixing(spark, masked, folder)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= left and max(copies.values()) <= 3
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in final) == copies
    for r in final:
        assert r["piece_ids"] == lib.encode(after[r["doc_id"]], add_bos=True, add_eos=True)


def test_stages_on_an_empty_table_and_extra_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("fp", F.lit(1)).withColumn("size", F.lit("x"))
    for some in (docs.limit(0), docs.limit(20)):
        now = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, folder).count()


def test_null_and_repeated_ids_and_a_very_long_text_through_all_stages(spark):
    """Two rows without an id, two different rows of one id, a text of 300,000 characters, wordless rows: five are encoded, each whole."""
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    texts = [prose(60), prose(70), prose(80), prose(90) + " me@example.org", prose(46_000)]
    rows = list(zip([None, None, 7, 7, 8], texts)) + [(9, ""), (10, None), (7, " ")]
    now = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, tuple(lib.encode(t.replace("me@example.org", "[EMAIL]"), add_bos=True, add_eos=True))) for i, t in rows[:5]]
    assert sorted(((x["doc_id"], tuple(x["piece_ids"])) for x in now.collect()), key=str) == sorted(want, key=str)
