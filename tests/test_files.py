"""Image folders, lists, mappings, reports, manifests and the stream."""

import csv
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, png, rows
from tagloom.operators import images, scoring
from tagloom.operators.evaluation import confusion, per_class_accuracy
from tagloom.operators.ranking import dedup_first
from tagloom.plans.curation import catalogue_items, class_table, curate
from tagloom.sources import readers, writers
from tagloom.streaming.scoring import answer, stream_score


def shade(y, x):
    return (7 * y % 256, (5 * x + y) % 256, (x * y) % 256)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    files = {
        "Mr. Mime/seed_00.png": png(40, 30, shade),
        "Mr. Mime/card_a+b.png": png(40, 30, shade),
        "Farfetch'd/card_1.png": png(50, 20, lambda y, x: (*shade(y, x), 128), 4),
        "Farfetch'd/gray.png": png(20, 20, lambda y, x: (10 * y % 256,), 1),
        "Farfetch'd/broken.png": b"not an image",
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_folder_scan_and_quarantine(spark, folder):
    df = readers.read_labelled_images(spark, folder)
    names = [("Farfetch'd", "broken.png"), ("Farfetch'd", "card_1.png"), ("Farfetch'd", "gray.png"),
             ("Mr. Mime", "card_a+b.png"), ("Mr. Mime", "seed_00.png")]
    assert rows(df.select("class_name", "file_name")) == names
    raw = readers.read_labelled_images(spark, folder, decode=False)
    assert rows(raw.select("class_name", "file_name")) == names
    assert rows(raw.select("path")) == rows(df.select("path"))
    good, bad = readers.split_unreadable(df)
    assert rows(bad.select("file_name")) == [("broken.png",)]
    assert good.count() == 4


def test_crop(spark, folder):
    good, _ = readers.split_unreadable(readers.read_labelled_images(spark, folder))
    cut = images.crop_top(good, 0.52, F.col("file_name").startswith("card_"))
    before = {r["file_name"]: r["image"] for r in good.collect()}
    after = {r["file_name"]: r["image"] for r in cut.collect()}
    assert (after["card_a+b.png"]["height"], after["card_1.png"]["height"]) == (20, 26)
    assert after["seed_00.png"] == before["seed_00.png"]
    old = before["card_1.png"]
    assert bytes(after["card_1.png"]["data"]) == bytes(old["data"])[: 26 * old["width"] * old["nChannels"]]


def test_phash(spark, folder):
    df = readers.read_labelled_images(spark, folder)
    got = {r["file_name"]: r["fingerprint"] for r in images.phash(df).collect()}
    assert got["broken.png"] is None
    assert all(len(h) == 16 and int(h, 16) >= 0 for f, h in got.items() if f != "broken.png")
    assert got["seed_00.png"] == got["card_a+b.png"] != got["card_1.png"]
    assert {len(r["fingerprint"]) for r in images.phash(df, 16).collect() if r["fingerprint"]} == {64}
    kept = dedup_first(images.phash(df), ["class_name"], "fingerprint", "file_name")
    assert rows(kept.select("file_name")) == [("card_1.png",), ("card_a+b.png",), ("gray.png",)]


def test_phash_kernel_properties():
    rng = np.random.default_rng(0)
    smooth = (np.outer(np.sin(np.arange(64) / 9), np.cos(np.arange(48) / 7)) * 100 + 120).astype(np.uint8)
    base = images._fingerprint(smooth, 8)
    bits = lambda h: bin(int(h, 16)).count("1")
    assert 24 <= bits(base) <= 33
    noisy = np.clip(smooth + rng.integers(-2, 3, smooth.shape), 0, 255).astype(np.uint8)
    assert bin(int(base, 16) ^ int(images._fingerprint(noisy, 8), 16)).count("1") < 16
    bigger = np.kron(smooth, np.ones((2, 2), dtype=np.uint8))
    assert bin(int(base, 16) ^ int(images._fingerprint(bigger, 8), 16)).count("1") < 16
    assert images._resize(np.full((50, 70), 9, np.uint8), 32).tolist() == np.full((32, 32), 9.0).tolist()
    assert images._gray(np.array([[[0, 0, 255], [255, 255, 255]]], dtype=np.uint8)).tolist() == [[76, 255]]


def test_augment(spark, folder):
    good, _ = readers.split_unreadable(readers.read_labelled_images(spark, folder))
    out = images.augment(good, "file_name", variants=3, p=0.5)
    got = out.collect()
    assert len(got) == 12 and {r["variant"] for r in got} == {0, 1, 2}
    assert {r["style"] for r in got} == {"none", "pencil"}
    source = {r["file_name"]: r["image"] for r in good.collect()}
    for r in got:
        img, src = r["image"], source[r["file_name"]]
        px = np.frombuffer(bytes(img["data"]), np.uint8).reshape(img["height"], img["width"], 3)
        assert (img["height"], img["width"], img["nChannels"]) == (src["height"], src["width"], 3)
        if r["style"] == "pencil":
            assert (px[:, :, 0] == px[:, :, 1]).all() and (px[:, :, 1] == px[:, :, 2]).all()
        elif src["nChannels"] >= 3:
            full = np.frombuffer(bytes(src["data"]), np.uint8).reshape(src["height"], src["width"], src["nChannels"])
            assert (px == full[:, :, :3]).all()
    again = images.augment(good.repartition(4), "file_name", variants=3, p=0.5)
    key = lambda rs: sorted((r["file_name"], r["variant"], bytes(r["image"]["data"])) for r in rs)
    assert key(again.collect()) == key(got)
    one = images.augment(good, "file_name", fixed_pencil=True).collect()
    assert len(one) == 4 and {r["style"] for r in one} == {"pencil"}


def test_pencil_kernel():
    flat = np.full((30, 20), 90, np.uint8)
    assert (images._pencil(flat, 21.0, 0.5) == 90).all()
    assert abs(images._blur_rows(np.eye(25), 3.0).sum(axis=0) - 1).max() < 1e-12


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_bytes("Zed\r\n\r\n  Mr. Mime \nFarfetch'd\n 　\nNidoran♀".encode())
    want = [(0, "Zed"), (1, "Mr. Mime"), (2, "Farfetch'd"), (3, "Nidoran♀")]
    assert sorted(tuple(r) for r in readers.read_vocab(spark, str(path)).collect()) == want
    assert sorted(r["class_idx"] for r in readers.read_vocab(spark, str(path), start=1).collect()) == [1, 2, 3, 4]


def test_vocabulary_round_trip_in_many_files(spark, tmp_path):
    out = str(tmp_path / "v")
    vocab = spark.range(5000).select(F.col("id").alias("class_idx"), F.concat(F.lit("name "), F.col("id") * 7 % 5003).alias("class_name"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_vocab(vocab.repartition(9), out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(glob.glob(f"{out}/part-*")) > 1
    assert sorted(tuple(r) for r in readers.read_vocab(spark, out).collect()) == sorted(tuple(r) for r in vocab.collect())


def test_mapping(spark, tmp_path):
    data = {"Mr. Mime": "mr-mime", 'Quo"te': "a,b}", "Flabébé": "flabebe", "Farfetch'd": "farfetchd"}
    for indent in (None, 2):
        path = tmp_path / f"m{indent}.json"
        path.write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")
        assert dict(tuple(r) for r in readers.read_mapping(spark, str(path)).collect()) == data
    out = str(tmp_path / "out")
    writers.write_mapping(spark.createDataFrame(list(data.items()), "name string, value string"), out)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*")))
    assert json.loads(text) == data and "Flabébé" in text
    assert dict(tuple(r) for r in readers.read_mapping(spark, out).collect()) == data


def test_reports(spark, tmp_path):
    vocab = spark.createDataFrame([(0, "a b"), (1, "b"), (2, "c")], "class_idx long, class_name string")
    pred = spark.createDataFrame([("a b", "a b"), ("a b", "b"), ("a b", "b"), ("b", "b")], "t string, p string")
    cm = confusion(pred, "t", "p")
    writers.write_reports(cm, per_class_accuracy(cm, vocab), vocab, str(tmp_path))
    def read(name):
        return [r for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*")) for r in csv.reader(open(f, encoding="utf-8"))]
    assert read("confusion_matrix") == [["", "a b", "b", "c"], ["a b", "1", "2", "0"], ["b", "0", "1", "0"], ["c", "0", "0", "0"]]
    assert read("per_class_accuracy") == [
        ["class", "test_samples", "accuracy"], ["c", "0", "0.0000"], ["a b", "3", "0.3333"], ["b", "1", "1.0000"]]


def test_manifest(spark, tmp_path):
    df = spark.range(100).withColumn("split", F.when(F.col("id") < 80, "train").otherwise("val"))
    writers.write_manifest(df, str(tmp_path / "m"), "split")
    assert sorted(os.listdir(tmp_path / "m"))[-2:] == ["split=train", "split=val"]
    assert spark.read.parquet(str(tmp_path / "m")).filter("split = 'val'").count() == 20


def test_class_table_files(spark, tmp_path):
    """API documents -> class list and slug map."""
    for i, slug in enumerate(["abra", "mr-mime", "ho-oh"], start=1):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "name": slug, "sprites": {}}))
    api = spark.read.schema("id int, name string").json(str(tmp_path / "*.json"))
    table = class_table(api, 3)
    writers.write_vocab(table.select((F.col("dex") - 1).alias("class_idx"), F.col("name").alias("class_name")), str(tmp_path / "names"))
    writers.write_mapping(table, str(tmp_path / "slugs"), "name", "slug")
    assert sorted(tuple(r) for r in readers.read_vocab(spark, str(tmp_path / "names"), 1).collect()) == [
        (1, "Abra"), (2, "Mr. Mime"), (3, "Ho-Oh")]
    assert dict(tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "slugs")).collect())["Mr. Mime"] == "mr-mime"


def test_catalogue_from_files(spark, tmp_path):
    for n in (1, 2):
        cards = [{"id": f"c{n}{k}", "setCode": "s", "nationalPokedexNumber": 1 + k % 2, "supertype": "Pokémon"} for k in range(6)]
        cards.append({"id": f"t{n}", "setCode": "s", "nationalPokedexNumber": None, "supertype": "Trainer"})
        (tmp_path / f"p{n}.json").write_text(json.dumps({"page": n, "last_page": 2, "data": cards}, indent=1))
    pages = readers.read_pages(spark, str(tmp_path / "*.json"))
    wanted = spark.createDataFrame([(1,)], "nationalPokedexNumber int")
    stored = spark.createDataFrame([(1, "card_c12.png")], "nationalPokedexNumber int, file_name string")
    items, status = catalogue_items(pages, wanted, stored, "nationalPokedexNumber", cap=4)
    assert status.first()["is_complete"]
    assert rows(items.select("page", "pos", "id")) == [(1, 0, "c10"), (1, 4, "c14"), (2, 0, "c20")]


def test_curate(spark):
    """A seed loses to a card with the same picture; the gate may then drop the card."""
    data = [("a", "seed_0", "h1", [1.0, 0.0]), ("a", "card_0", "h1", [0.0, 1.0]), ("a", "seed_1", "h2", [0.0, 1.0]),
            ("a", "card_2", "h3", [1.0, 0.1]), ("a", "card_3", None, None)]
    df = spark.createDataFrame(data, "cls string, f string, fp string, vec array<double>")
    prompts = spark.createDataFrame(
        [("a", 0, "target", [1.0, 0.0]), (None, 1, "generic", [0.0, 1.0]), (None, 2, "explicit", [-1.0, 0.0])],
        "class_name string, slot int, kind string, vec array<double>")
    out = curate([df.filter("f LIKE 'seed%'"), df.filter("f LIKE 'card%'")], prompts, "cls", "f", "fp", "vec")
    assert rows(out.manifest.select("f", "decision")) == [("card_0", "off_topic"), ("card_2", "keep"), ("seed_1", "trusted")]
    assert rows(out.items.select("f")) == [("card_2",), ("seed_1",)]
    assert rows(out.report) == [("a", 0, 5, 2, 2, 1, 0), (None, 1, 5, 2, 2, 1, 0)]


def test_stream_matches_batch(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/embeddings.parquet")
    first = scoring.PrototypeScorer(["c0", "c1"], np.eye(2, 64).tolist(), 10.0)
    second = scoring.LinearScorer(["c0", "c1_old"], (np.eye(2, 64) * 5).tolist(), [0.0, 0.0])
    items.limit(200).repartition(3).write.parquet(str(tmp_path / "in"))
    options = dict(keys=["vec_id"], features="embedding", first=first, second=second, members=["c1"], aliases={"c1_old": "c1"})

    def run():
        q = stream_score(spark, str(tmp_path / "in"), items.schema, str(tmp_path / "out"), str(tmp_path / "cp"),
                         files_per_batch=1, **options)
        assert q.awaitTermination(180)
        return spark.read.parquet(str(tmp_path / "out"))

    def batch():
        df = answer(spark.read.parquet(str(tmp_path / "in")), "embedding", first, second, ["c1"], {"c1_old": "c1"})
        return df.select("vec_id", "model", "top_name", "top_confidence", "verdict", "response")

    got = run()
    assert rows(got) == rows(batch())
    assert {r["model"] for r in got.collect()} == {"legacy-gen1", "gen1-3"}
    # a second run sees new files only; every item is answered once
    items.filter("vec_id > 250").write.mode("append").parquet(str(tmp_path / "in"))
    got = run()
    assert rows(got) == rows(batch())


def naive_hash(gray, n=8):
    """Direct double sums; the image is 32 x 32, so no resampling is involved."""
    side = len(gray)
    c = lambda k, i: np.cos(np.pi * k * (2 * i + 1) / (2 * side))
    low = [[sum(gray[y][x] * c(u, y) * c(v, x) for y in range(side) for x in range(side)) for v in range(n)] for u in range(n)]
    flat = [x for row in low for x in row]
    middle = sorted(flat)
    middle = (middle[31] + middle[32]) / 2
    return f"{int(''.join('1' if x > middle else '0' for x in flat), 2):016x}"


def naive_pencil(gray, radius, alpha):
    h, w = gray.shape
    reach = int(3 * radius + 0.5)
    taps = {d: np.exp(-0.5 * (d / radius) ** 2) for d in range(-reach, reach + 1)}
    total = sum(taps.values())
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            blurred = sum(
                t * s * (255 - int(gray[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)]))
                for dy, t in taps.items() for dx, s in taps.items()) / total**2
            dodged = 255 - int(np.rint(blurred))
            out[y, x] = int(gray[y, x] + alpha * (dodged - int(gray[y, x])))
    return out


def test_hash_and_pencil_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 256, (32, 32), dtype=np.uint8) for _ in range(3)]
    df = spark.createDataFrame(
        [(i, (f"f{i}", 32, 32, 1, 0, p.tobytes())) for i, p in enumerate(pictures)], f"id int, image {images.IMAGE_TYPE}")
    got = {r["id"]: r["fingerprint"] for r in images.phash(df).collect()}
    assert got == {i: naive_hash(p.tolist()) for i, p in enumerate(pictures)}

    small = rng.integers(0, 256, (7, 9), dtype=np.uint8)
    diff = images._pencil(small, 2.0, 0.6).astype(int) - naive_pencil(small, 2.0, 0.6)
    assert abs(diff).max() <= 1 and (diff != 0).mean() < 0.05


def test_registered_image_queries_use_the_same_kernels(spark):
    """The whole smallest table, row by row in plain Python."""
    from tagloom.queries import QUERIES

    vecs = {r["vec_id"]: np.array(r["embedding"], dtype=np.float32).astype(float)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    gray = {i: np.floor((v * 0.5 + 0.5) * 255).astype(np.uint8).reshape(8, 8) for i, v in vecs.items()}
    got = {r["vec_id"]: r["fingerprint"] for r in QUERIES["i2_phash"](spark, SF).collect()}
    assert got == {i: images._fingerprint(g, 8) for i, g in gray.items()}
    assert QUERIES["i3_augment"](spark, SF).count() == 2 * len(gray)
