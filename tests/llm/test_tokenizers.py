import os
import random

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tagloom.llm import tokens
from tagloom.llm.pieces import Pieces, encode_pieces
from tagloom.llm.tokens import Tokens, count_tokens

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "th", "é", "🙂", "\n", "\t", " ", "  ", "▁", "\x00", "①", "ing", "�", "<s>", "</s>", "'s", "'re", "'ll", "'l", "'r", "'", "½",
         "<|endoftext|>", "1", "22", " ", "\u0085", "!", "'S", "ve", "l"]


def odd(n):
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["x" * 3000, "ab" * 4000, " " * 500, "", "'" * 99]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    return lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_piece_ids_equal_the_library():
    texts = odd(1500)
    p = Pieces(PIECES, check=False)
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts, add_bos=True, add_eos=True, num_threads=1)
    got = p.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    p.scores = -p.scores  # a wrong agenda is noticed
    p._pair_tables()
    p.check = True
    p.memo.clear()
    with pytest.raises(RuntimeError):
        p.encode(["the thing that was here, interesting considerations notwithstanding"])


def test_encoding_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " x"), (-3, " x"), (None, "y" * 100_000)], "doc_id long, text string")
    both = docs.unionByName(extra).withColumn("n_tokens", F.lit("clash"))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for r in both.collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(lib.decode(ids))))
    out = encode_pieces(both, PIECES, {"doc_id": F.col("doc_id")})
    assert sorted(map(tuple, out.drop("piece_ids", "decoded").collect()), key=str) == sorted(want, key=str)
    assert encode_pieces(both.limit(0), PIECES, {"doc_id": F.col("doc_id")}).count() == 0


@pytest.mark.parametrize("chunk", [3, 1024])
def test_token_counts_equal_the_library(library, chunk):
    texts = odd(1500)
    assert Tokens(BYTES, chunk).counts(texts) == library(texts)


def test_every_code_point_is_cut_like_the_library(library):
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}'{chr(c)}" for c in range(a, min(a + 64, 0x110000)) if not 0xD800 <= c < 0xE000)
             for a in range(0, 0x3000, 64)]
    assert Tokens(BYTES).counts(texts) == library(texts)


def test_tables_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    monkeypatch.setattr(tokens, "TRANSITIONS", 40)
    texts = odd(200)
    t = Tokens(BYTES)
    assert [t.counts([x])[0] for x in texts] == library(texts)


def test_counts_of_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é"), (-3, "é"), (None, "y " * 60_000)], "doc_id long, text string")
    both = docs.unionByName(extra).withColumn("n_bytes", F.lit("clash"))
    rows = both.collect()
    n = library([r["text"] or "" for r in rows])
    want = [(r["doc_id"], len((r["text"] or "").encode()), k, k > 1024) for r, k in zip(rows, n)]
    out = count_tokens(both, BYTES, {"doc_id": F.col("doc_id")})
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert count_tokens(both.limit(0), BYTES, {"doc_id": F.col("doc_id")}).count() == 0
