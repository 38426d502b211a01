import random

import plain
import pytest
from pyspark.sql import functions as F

from tagloom.llm.pii import find_pii, luhn, mask_pii, mod97, pii_digest

ODD = [
    None, "", "x", "a@b.c_x@y.org..z@q", "a.b@c.d@e.f", "x@y 1.2.3.4.5.6.7.8", "1.2.3.256 0001.02.3.4 999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "+1 (743) 555-3824 +49 30 1234567 +1 +12345678901234567",
    "9" * 20_000 + "@", "a" * 50_000, "+" * 999 + "1 2", "é🙂 mail: é🙂x@y.zz, 10.0.0.1", "1-2--3 4  5 6", "1" * 16, "0" * 16 + " " + "0" * 19,
]


def made(n):
    r = random.Random(5)
    parts = ["a@b.co", "@", ".", "-", "+1", "555", " ", "1.2.3.4", "4111111111111111", "é", "x", "(", ")", "\n", "256", "_", "%"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_plain_patterns(spark):
    texts = ODD + made(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_digest(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = plain.pii(t)
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == plain.sha(want), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in pii_digest(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r["doc_id"]] == plain.sha(",".join(f"{k}:{a}:{b}" for k, a, b in plain.pii(r["text"])))


@pytest.mark.parametrize("iban, fine", [("GB82WEST12345698765432", True), ("GB82 WEST 1234 5698 7654 32", True),
                                        ("DE89370400440532013000", True), ("DE89370400440532013001", False)])
def test_mod97(spark, iban, fine):
    assert spark.range(1).select(mod97(F.lit(iban))).first()[0] is fine


def test_luhn(spark):
    for d in ("4111111111111111", "4111111111111112", "79927398713"):
        assert spark.range(1).select(luhn(F.lit(d))).first()[0] == plain.luhn(d)


def test_added_spans_and_context(spark):
    texts = [(1, "Konto DE89 3704 0044 0532 0130 00 bitte"), (2, "DE89 3704 0044 0532 0130 01"),
             (3, "my visa 378282246310005 ok"), (4, "number 378282246310005 ok"), (5, "tel +1 555 555 5555, +1 555 555 5556")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["pii"]]
           for r in find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert ("iban", 6, 33, 1.0) in got[1] and not any(s[0] == "iban" for s in got[2])
    assert got[3] == [("shortcard", 8, 23, 0.6)] and got[4] == []
    assert [s[3] for s in got[5]] == [0.9, 0.9]


def test_masking_keeps_columns_and_nulls(spark):
    rows = [(1, "write a@b.co or 1.2.3.4!", "en", None, 24, 7), (2, None, None, None, None, 8), (2, "clean", "en", "s", 5, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __email int")
    out = mask_pii(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "write [EMAIL] or [IP]!", "en", None, 22, 7), rows[1], rows[2]], key=str)
    assert mask_pii(df.limit(0)).count() == 0


def test_long_text_with_many_spans(spark):
    """Thousands of spans in one text, at every place of a chunk, with characters of several bytes."""
    r = random.Random(8)
    bits = ["mail é🙂@b.co x", "a.b@c.de", "10.0.0.1", "1.2.3.999", "4111 1111 1111 1111", "+49 (30) 1234567", "ß" * 7, "🙂 word"]
    text = " ".join(r.choice(bits) + "é" * r.randint(0, 9) for _ in range(7000))
    df = spark.createDataFrame([(1, text), (2, "clean " * 4000), (3, "a@b.co" + "x" * 5000)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in find_pii(df).collect()}
    base = [(s["kind"], s["start"], s["end"]) for s in got[1]["pii"] if s["kind"] not in ("iban", "shortcard")]
    assert base == plain.pii(text) and len(base) > 3000
    want, at = [], 0
    for s in sorted(got[1]["pii"], key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            want += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    masks = {x["doc_id"]: x["text"] for x in mask_pii(df).collect()}
    assert masks[1] == "".join(want) + text[at:]
    assert masks[2] == "clean " * 4000
    assert masks[3] == "[EMAIL]"


def test_account_numbers_end_where_their_country_says(spark):
    """Capitals and digits that follow an account number are not taken in; other lengths are no account numbers."""
    good = ["DE89 3704 0044 0532 0130 00 BIC: COBADEFF", "DE89370400440532013000 12 EUR", "GB29 NWBK 6016 1331 9268 19 IBAN", "NO93 8601 1117 947 KONTO 5",
            "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606 X"]
    bad = ["DE89 3704 0044 0532 0130 0", "DE8937040044053201300012", "DE88370400440532013000", "QQ89370400440532013000", "xDE89370400440532013000"]
    df = spark.createDataFrame([(i, f"iban {t}") for i, t in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["end"] - s["start"]) for s in r["pii"] if s["kind"] == "iban"] for r in find_pii(df).collect()}
    assert [got[i] for i in range(len(good))] == [[("iban", n)] for n in (27, 22, 27, 18, 31, 33)]
    assert all(got[len(good) + i] == [] for i in range(len(bad)))
