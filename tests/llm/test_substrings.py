import random

import plain
import pytest
from pyspark.sql import functions as F

from tagloom.llm.substrings import Block, Parser, WordHashes, drop_substrings


def compare(spark, rows, columns="doc_id long, text string"):
    df = spark.createDataFrame(rows, columns)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in drop_substrings(df).collect()), key=str)
    want = []
    for row, (n, kept) in zip(rows, plain.repeated([r[1] for r in rows])):
        text = " ".join(kept)
        want.append((row[0], n, n - len(kept), plain.sha(text), text))
    assert got == sorted(want, key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    compare(spark, [tuple(r) for r in docs.collect()])


def test_small_vocabulary_edits_and_cycles(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    base = [r.choice(vocab) for _ in range(400)]
    rows = []
    for d in range(60):
        ws = list(base[r.randint(0, 200):r.randint(220, 400)])
        for _ in range(r.randint(0, 6)):
            ws[r.randrange(len(ws))] = r.choice(vocab)
        pre = [r.choice(vocab) for _ in range(r.randint(0, 30))]
        rows.append((d, " ".join(pre + ws + pre)))
    rows += [(100, "a " * 90), (101, "a b " * 40), (102, " ".join(vocab[:34])), (103, " ".join(vocab[:34])), (104, " ".join(vocab[:35])),
             (105, " ".join(vocab[:35]) + " x"), (106, " ".join(vocab)), (107, "\n\t".join(vocab[:36]))]
    compare(spark, rows)


def test_nulls_repeats_ties_and_clashes(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(1, None, "k"), (2, "", "k"), (3, text, "k"), (3, text, "k"), (None, text[:-1] + "q", "z"), (None, None, None), (7, " \n ", "s"),
            (7, " ".join(f"u{i}" for i in range(60)), "s")]
    compare(spark, rows, "doc_id long, text string, key string")
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("packed", F.lit(1))
    assert drop_substrings(df).count() == len(rows) and drop_substrings(df.limit(0)).count() == 0


def test_one_row_alone_keeps_its_words(spark):
    compare(spark, [(1, " ".join(f"t{i}" for i in range(500)))])


def naive_factors(ws, blocks, own, window):
    """Longest match at each place by trying every place of every block, from left to right."""
    def common(i, b, o):
        n = 0
        while i + n < len(ws) and o + n < len(blocks[b]) and ws[i + n] == blocks[b][o + n]:
            n += 1
        return n

    def longest(i):
        tried = [(common(i, b, o), -b, -o) for b in range(len(blocks)) for o in range(len(blocks[b])) if own[b] < 0 or own[b] + o != i]
        n, b, o = max(tried, default=(0, 0, 0))
        return (n, -b, -o) if n >= window else (0, -1, -1)

    out, i = [], 0
    while i < len(ws):
        n, b, o = longest(i)
        if n:
            out.append((i, n, b, o))
        i += n or 1
    return out


@pytest.mark.parametrize("window", [7, 9])
def test_the_parse_is_greedy(window):
    """Against the definition: every factor is the longest match in any block at its place, and the next one starts behind it."""
    number = WordHashes()
    for seed in range(150):
        r = random.Random(seed)
        vocab = [b"w%d" % i for i in range(r.choice([1, 2, 3, 30]))]
        base = [r.choice(vocab) for _ in range(120)]
        blocks = [base[a:a + r.randint(5, 50)] for a in (r.randint(0, 80) for _ in range(r.randint(0, 5)))]
        cuts = [(r.randint(0, 100), r.randint(1, 30)) for _ in range(r.randint(0, 4))]
        ws = [w for a, n in cuts for w in [*base[a:a + n], r.choice(vocab)]]
        own = [-1] * len(blocks)
        if ws and r.random() < 0.5:  # a block of the text itself
            a = r.randrange(len(ws))
            blocks.append(ws[a:a + 40])
            own.append(a)
        parser = Parser(ws, [(p, Block(b, number, window)) for p, b in zip(own, blocks)], number, window)
        found = parser.factors()
        assert found == naive_factors(ws, blocks, own, window)
        places = {}
        for b, block in enumerate(blocks):
            for o in range(len(block) - window + 1):
                places.setdefault(tuple(block[o:o + window]), []).append(own[b] + o if own[b] >= 0 else None)
        want = set()
        for i in range(len(ws) - window + 1):
            if any(p != i for p in places.get(tuple(ws[i:i + window]), [])):
                want.update(range(i, i + window))
        assert set(parser.covered().nonzero()[0].tolist()) == want


def test_windows_over_the_border_of_a_factor_are_checked():
    """The longest match ends inside the text; a second block holds what lies over its end."""
    ws = [b"w%d" % i for i in range(100)]
    number = WordHashes()
    parser = Parser(ws, [(-1, Block(ws[:60], number)), (-1, Block(ws[40:85], number))], number)
    assert [(i, n) for i, n, _, _ in parser.factors()] == [(0, 60)]
    assert parser.covered().nonzero()[0].tolist() == list(range(85))


def test_factors_come_from_words_not_from_hashes(monkeypatch):
    """With hashes of windows and of words that are all equal the parse is the same: they propose, words decide."""
    from tagloom.llm import substrings

    np, ws = substrings.np, [b"w%d" % (i % 50) for i in range(90)]

    def parsed(number):
        parser = Parser(ws, [(-1, Block(ws[10:60], number)), (-1, Block([b"x"] * 60, number))], number)
        return parser.factors(), parser.covered().tolist()

    want = parsed(WordHashes())
    assert want[0]
    monkeypatch.setattr(substrings, "_ranges", lambda hashes, first, length: np.zeros(len(first), np.uint64))
    assert parsed(WordHashes()) == want
    assert parsed(lambda words: np.zeros(len(words), np.uint64)) == want


def test_long_texts_and_passages_over_many_blocks(spark):
    """Passages longer than a reference block, from long texts, at any offset; a text that repeats one word."""
    r = random.Random(2)
    long = [f"v{r.randrange(5000)}" for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[7_777:9_900])), (3, "pre " + " ".join(long[383:383 + 512 + 40]) + " post"), (4, "a " * 20_000),
            (5, " ".join(long[29_000:] + [f"n{i}" for i in range(100)] + long[:700]))]
    compare(spark, rows)


def test_kernels_get_slices_of_bounded_size(spark):
    """By bytes, not only by rows; results do not depend on them."""
    import pyarrow as pa
    import zstandard

    from tagloom.llm import substrings

    pack = zstandard.ZstdCompressor(level=3).compress
    texts = [b"a " * 50_000, b"", b"b c", b"d" * 400_000, b"e " * 300_000, b"f"]
    sizes = [len(t) for t in texts]
    assert substrings._sizes(pa.array(map(pack, texts), pa.binary())) == sizes
    assert substrings._sizes(pa.array([*(t.decode() for t in texts), None, "é"], pa.string())) == [*sizes, 0, 2]
    assert list(substrings.slices(sizes)) == [(0, 4), (4, 2)]
    assert list(substrings.slices([3_000_000] * 3)) == [(0, 1), (1, 1), (2, 1)]
    assert list(substrings.slices([1] * 600)) == [(0, 256), (256, 256), (512, 88)] and list(substrings.slices([])) == []
    r = random.Random(4)
    base = [f"v{r.randrange(90)}" for _ in range(3000)]
    rows = [(i, " ".join(base[a:a + 400])) for i, a in enumerate(r.randrange(2500) for _ in range(25))]
    compare(spark, rows)
