import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagloom.functions import fixed, text
from tagloom.operators import labels as ops
from tagloom.operators.catalogue import bucket_catalogue, harvest_urls, ingest_pages, page_status, pending, publish_catalogue
from tagloom.plans.curation import class_table


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("slug, want", [
    ("mr-mime", "Mr. Mime"), ("farfetchd", "Farfetch'd"), ("ho-oh", "Ho-Oh"), ("deoxys-normal", "Deoxys"),
    ("nidoran-f", "Nidoran-F"), ("porygon-z", "Porygon-Z"), ("aBC-dEF", "Abc-Def"), ("pikachu", "Pikachu"),
    ("two words-x", "Two words-X"), ("a--b", "A--B"), ("", ""),
])
def test_display_name(spark, slug, want):
    assert one(spark, slug, text.display_name) == want


@pytest.mark.parametrize("name, want", [
    ("Farfetch'd", "farfetchd"), ("MrMime", "mr-mime"), ("Mr. Mime", "mr-mime"), ("Nidoran1", "nidoran-f"),
    ("Deoxys", "deoxys-normal"), ("Mime Jr.", "mime-jr"), ("St. O'Neil  X", "st-oneil-x"), ("A B", "a-b"),
])
def test_api_slug(spark, name, want):
    assert one(spark, name, text.api_slug) == want


@pytest.mark.parametrize("url, blocked", [
    (None, True), ("", True), ("https://www.PORNsite.com/a.png", True), ("https://ok.com/porn.png", False),
    ("http://user:xxx@ok.com:80/a", True), ("https://ok.com?x=hentai", False), ("https://rule34.blank host/a b", True),
    ("//e621.net/a.png", True), (" http://nsfw.com/a", True), ("not a url", False), ("porn", False),
])
def test_blocked_hosts(spark, url, blocked):
    assert one(spark, url, text.is_blocked) is blocked


@pytest.mark.parametrize("url, ext", [
    ("http://a.b/x.PNG", ".png"), ("http://a.b/x.jpeg?y=1.bmp", ".jpeg"), ("http://a.b/x", ".jpg"),
    ("http://a.b/x.png#top", ".jpg"), ("http://a.b/.png", ".jpg"), ("http://a.b/x.gif", ".jpg"),
    ("http://a.b/.a.webp", ".webp"), ("http://a.b/dir.png/x", ".jpg"), ("http://a.com", ".jpg"),
])
def test_extension(spark, url, ext):
    assert one(spark, url, text.url_extension) == ext


def test_first_nonempty_and_provenance(spark):
    df = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), (None, "", None)], "x string, y string, z string")
    got = [r[0] for r in df.select(text.first_nonempty(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got == ["c", "a", ""]
    names = spark.createDataFrame([("seed_00.png",), ("card_a.png",), ("ddg_1.jpg",), ("000001.jpg",), ("bing_1.jpg",)], "f string")
    kinds = [r[0] for r in names.select(text.provenance(F.col("f"))).collect()]
    assert kinds == ["seed", "card", "ddg", "crawler", "crawler"]
    assert rows(ops.purge(names, "f")) == [("card_a.png",), ("seed_00.png",)]


def test_scope(spark):
    classes = spark.createDataFrame([(1, "A"), (2, "b"), (3, "C"), (4, "D")], "id int, name string")
    assert rows(ops.scope_classes(classes, "id", "name")) == [(1, "A"), (2, "b"), (3, "C"), (4, "D")]
    assert rows(ops.scope_classes(classes, "id", "name", 2, 3, [])) == [(2, "b"), (3, "C")]
    assert rows(ops.scope_classes(classes, "id", "name", only=["B", "d"])) == [(2, "b"), (4, "D")]


def test_aliases_keep_rows_apart(spark):
    df = spark.createDataFrame([("Mime",), ("MrMime",), ("Abra",)], "n string")
    want = [("Abra",), ("Mr. Mime",), ("Mr. Mime",)]
    assert rows(ops.canonicalise(df, "n")) == want
    table = spark.createDataFrame(list(fixed.LABEL_ALIASES.items()), "alias string, canonical string")
    assert rows(ops.canonicalise(df, "n", table)) == want


def test_vocab_diff(spark):
    a = spark.createDataFrame([("Mr. Mime",), ("Abra",), ("Mew",)], "class_name string")
    b = spark.createDataFrame([("Mime",), ("MrMime",), ("Abra",), ("Odd",)], "class_name string")
    assert rows(ops.vocab_diff(a, b)) == [("Mew", "a"), ("Odd", "b")]


def test_quota(spark):
    data = [("a", "seed_1")] * 9 + [("a", "card_1")] * 5 + [("b", "x")] * 120 + [("c", "ddg_1")] * 119 + [("d", "seed_0")]
    df = spark.createDataFrame(data, "c string, f string")
    assert rows(ops.plan_quota(df, "c", "f")) == [("a", 5, 115 // 8 + 1), ("c", 119, 1), ("d", 0, 120 // 8 + 1)]


def test_harvest(spark):
    import json

    deep = {"z": "http://h/1.png", "a": {"x": None, "versions": {"q": "http://h/v.png"}, "m": "http://h/2.png"},
            "versions": {"k": "http://h/v2.png"}, "list": ["http://h/l.png"], "again": "http://h/1.png",
            "n": 5, "up": "http://h/3.PNG", "svg": "http://h/3.svg", "ftp": "ftp://h/4.png",
            "b": {"c": {"versions": {"d": "http://h/v3.png"}, "e": "http://h/0.png"}}}
    docs = [(1, json.dumps(deep)), (2, "{broken"), (3, None), (4, "{}"), (5, '"http://h/top.png"')]
    got = rows(harvest_urls(spark.createDataFrame(docs, "id int, j string"), "id", "j"))
    assert got == [(1, 0, "http://h/1.png"), (1, 1, "http://h/2.png"), (1, 2, "http://h/0.png"), (5, 0, "http://h/top.png")]


PAGE = "page int, last_page int, data array<struct<id string, setCode string, nationalPokedexNumber int, supertype string>>"


def test_pages_complete_and_gap(spark, tmp_path):
    def page(n, last=3):
        return (n, last, [(f"c{n}", "s", n, "Pokémon"), ("", "s", n, "Pokémon"), (f"t{n}", "s", n, "Trainer")])

    full = spark.createDataFrame([page(1), page(2, 9), page(3)], PAGE)
    rows_full, status = ingest_pages(full)
    assert tuple(status.first()) == (3, 3, True)
    assert rows_full.count() == 9
    assert publish_catalogue(rows_full, status, str(tmp_path / "full"))
    assert spark.read.parquet(str(tmp_path / "full")).count() == 9

    gap = spark.createDataFrame([page(1, 4), page(2), page(4)], PAGE)
    rows_gap, status = ingest_pages(gap)
    assert tuple(status.first()) == (4, 2, False)
    assert sorted({r["page"] for r in rows_gap.collect()}) == [1, 2]
    assert not publish_catalogue(rows_gap, status, str(tmp_path / "gap"))
    assert not (tmp_path / "gap").exists()

    assert tuple(page_status(spark.createDataFrame([page(2)], PAGE)).first()) == (1, 0, False)
    assert tuple(page_status(spark.createDataFrame([page(1, None), page(2)], PAGE)).first()) == (1, 1, True)

    wanted = spark.createDataFrame([(1,), (3,)], "nationalPokedexNumber int")
    kept = bucket_catalogue(rows_full, wanted, "nationalPokedexNumber", fixed.CARD_SUPERTYPE)
    assert rows(kept.select("page", "id")) == [(1, "c1"), (3, "c3")]


def test_pending(spark):
    targets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "c string, f int")
    assert rows(pending(targets, targets.filter("f = 1"), ["c", "f"])) == [("a", 2)]


def test_class_table(spark):
    api = spark.createDataFrame([(1, "mr-mime"), (2, "abra"), (3, "ho-oh")], "id int, name string")
    assert rows(class_table(api, 2)) == [(1, "Mr. Mime", "mr-mime"), (2, "Abra", "abra")]
