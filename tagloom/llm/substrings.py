"""Duplicate passages by relative Lempel-Ziv parsing.

The corpus is its own reference: its texts are cut in reference blocks of BLOCK words that overlap. A document is parsed from left to right
against the indexed reference blocks that it can match at all: at each place the longest match in any of them is extended word by word, the
parse goes on behind it, and a word without a match of WINDOW words is a literal. Factors are duplicate passages; the windows
over the border behind a factor are looked up too, as another block may hold them.

Which blocks a document can match is found by routing: windows that share their smallest hash of GRAM words (their anchor) lie in pieces
that the words themselves determine. Equal pieces point to one of their places, and where only anchors are shared single windows do. Routes
only say where to look: what counts is the extension, which compares words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.llm.batches import written

WINDOW, GRAM = 35, 6
#: Word hashes kept per task; emptied when full, which changes no result.
MEMO = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A span is first window * SPAN + number of windows.
SPAN = 128
#: Reference blocks kept per task, as many texts point to the same ones; emptied when full, which changes no result.
BLOCKS_KEPT = 2000
#: Bytes of texts and rows that a kernel gets at once.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 256
#: Words of a reference block, and words after which the next one starts; a window lies whole in the block in whose stride it starts.
BLOCK, STRIDE = 512, 384


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 .. BASE^n and their inverses; as BASE is odd it has an inverse mod 2^64. Kept, and made anew when longer ones are asked for."""
    if len(_POWERS[0]) <= n:
        size = max(n, 2 * len(_POWERS[0]), 4096)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
                _POWERS[k] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, base, np.uint64)), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n + 1]


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s[i] such that the hash of words a..b-1 is (s[b] - s[a]) * BASE^-a, and these inverse powers."""
    n = len(hashes)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * up, dtype=np.uint64, out=sums[1:])
    return sums, down


def _ranges(hashes: np.ndarray, first: np.ndarray, length) -> np.ndarray:
    """Hashes of the word ranges first .. first + length - 1, the length mixed in."""
    sums, down = _sums(hashes)
    with np.errstate(over="ignore"):
        raw = (sums[first + length] - sums[first]) * down[first]
        return _mixed(raw + np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class WordHashes:
    """64-bit hashes of words, each distinct word hashed once."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        for w in set(ws).difference(self.memo):
            self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.memo.__getitem__, ws), np.uint64, len(ws))


def blocks(hashes: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Blocks of several texts whose words stand one after another; ``ends`` closes each text.

    Returns text number, anchor hash, block hash, first window (within its text) and number of windows.
    """
    n, wide = len(hashes), window - gram + 1
    if n < window:
        return [np.zeros(0, np.int64)] * 5
    owner = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    grams = _ranges(hashes, np.arange(n - gram + 1), gram)
    best, length = np.arange(len(grams)), 1
    while length < wide:  # leftmost smallest of ``length`` grams from each position on
        step = min(length, wide - length)
        a, b = best[:-step], best[step:]
        best = np.where(grams[a] <= grams[b], a, b)
        length += step
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1:])
    if not len(at):
        return [np.zeros(0, np.int64)] * 5
    anchor = best[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[at[1:]] != owner[at[:-1]]))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    first = at[head]
    text = owner[first]
    return (text, grams[anchor[head]].astype(np.int64), _ranges(hashes, first, count + window - 1).astype(np.int64),
            first - np.append(0, ends)[text], count)


def _sizes(column: pa.Array) -> list[int]:
    """Bytes of the texts of a column, plain or packed; a packed one states its size in its first bytes."""
    if not pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_pylist()
    return [zstandard.frame_content_size(p.as_py()[:18]) for p in column]


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First row and number of rows that hold SLICE_BYTES and SLICE_ROWS at most; a longer text comes alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > SLICE_BYTES or i - start == SLICE_ROWS):
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start


def _batches(kernel_of, schema: T.StructType, texts: str):
    """Run a kernel over slices of bounded size; ``texts`` is the column whose texts count."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        kernel = kernel_of()
        for batch in batches:
            for start, n in slices(_sizes(batch.column(texts))):
                for made in kernel(batch.slice(start, n)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow)], schema=arrow)

    return run


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """num (a number for each row), doc_id and the packed text, written: all that later steps read of the table."""
    plain = docs.select(F.monotonically_increasing_id().alias("num"), "doc_id", F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*plain.schema.fields[:2], T.StructField("packed", T.BinaryType())])

    def kernel_of():
        pack = zstandard.ZstdCompressor(level=3).compress

        def kernel(batch):
            yield batch.column(0), batch.column(1), [pack((t or "").encode()) for t in batch.column(2).to_pylist()]

        return kernel

    return written(plain.mapInArrow(_batches(kernel_of, schema, "text"), schema), "texts")


def indexed_blocks(texts: DataFrame) -> DataFrame:
    """One row per piece of each text: num, anchor, block (hash of the piece), span."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("num", "anchor", "block", "span")])

    def kernel_of():
        number, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress

        def kernel(batch):
            nums = batch.column(0).to_numpy(zero_copy_only=False)
            parts = [unpack(p).split() for p in batch.column(1).to_pylist()]
            ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
            which, anchor, block, first, count = blocks(number([w for p in parts for w in p]), ends)
            yield nums[which], anchor, block, first * SPAN + count

        return kernel

    return texts.select("num", "packed").mapInArrow(_batches(kernel_of, schema, "packed"), schema)


def _windows(with_text: DataFrame) -> DataFrame:
    """The windows of chosen pieces: anchor, hash, num, span (one window), shared."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "hash", "num", "span")] + [T.StructField("shared", T.BooleanType())])

    def kernel_of():
        number, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress

        def kernel(batch):
            parts = [unpack(p).split() for p in batch.column(1).to_pylist()]
            hashes = number([w for p in parts for w in p])
            start = np.cumsum([0, *map(len, parts)]).astype(np.int64)
            pieces = batch.column(2).flatten()
            anchor, span, shared = (pieces.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "span", "shared"))
            row = np.repeat(np.arange(len(parts)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            count = span % SPAN
            which = np.repeat(np.arange(len(span)), count)
            first = (span // SPAN)[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            nums = batch.column(0).to_numpy(zero_copy_only=False)
            yield (anchor[which], _ranges(hashes, start[row][which] + first, WINDOW).astype(np.int64), nums[row][which], first * SPAN + 1, shared[which])

        return kernel

    return with_text.mapInArrow(_batches(kernel_of, schema, "packed"), schema)


def _places() -> list[Column]:
    """The first and the last place of a group of equal pieces or windows."""
    place = F.struct("num", "span")
    return [F.min(place).alias("one"), F.max(place).alias("two"), F.count(F.lit(1)).alias("n")]


def _route() -> Column:
    """From a row's place to another of its group: num, ref (a row number) and at (a reference block of it). A piece that starts in one
    reference block may end in the next, so both ends of its windows are routed."""
    own = F.struct("num", "span")
    other = F.when(F.col("one") == own, F.col("two")).otherwise(F.col("one"))
    first = F.floor(other["span"] / SPAN)
    last = first + F.pmod(other["span"], F.lit(SPAN)) - 1
    ends = F.array_distinct(F.array(F.floor(first / STRIDE), F.floor(last / STRIDE)))
    return F.transform(ends, lambda at: F.struct(F.col("num").alias("num"), other["num"].alias("ref"), at.alias("at")))


def routes(texts: DataFrame) -> DataFrame:
    """num, ref, at: reference blocks (the at-th of row ref) that each text can match. Every window that also starts elsewhere has a route to
    a block with another of its places; rows move as pieces of about 16 words, windows only where anchors alone are shared."""
    index = written(indexed_blocks(texts), "blocks")
    again = written(index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("a")), "anchors")
    met = written(index.join(again, F.col("anchor") == F.col("a")).drop("a"), "met")
    different = written(met.groupBy("anchor", "block").agg(*_places()), "different")
    # equal pieces
    copied = different.where("n > 1").select(F.col("anchor").alias("a"), F.col("block").alias("b"), "one", "two")
    whole = met.join(copied, (F.col("anchor") == F.col("a")) & (F.col("block") == F.col("b"))).select(F.inline(_route()))
    # anchors with several different pieces: single windows
    mixed = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("a"))
    edges = different.join(written(mixed, "mixed"), F.col("anchor") == F.col("a"))
    edges = edges.groupBy("one.num").agg(F.collect_list(F.struct("anchor", "one.span", (F.col("n") > 1).alias("shared"))).alias("chosen"))
    chosen = edges.join(texts.select(F.col("num").alias("t"), "packed"), F.col("num") == F.col("t")).select("num", "packed", "chosen")
    windows = written(_windows(chosen), "windows")
    twice = windows.groupBy("anchor", "hash").agg(*_places()).where("n > 1").select(
        F.col("anchor").alias("a"), F.col("hash").alias("h"), "one", "two")
    partly = windows.where(~F.col("shared")).join(written(twice, "twice"), (F.col("anchor") == F.col("a")) & (F.col("hash") == F.col("h")))
    return written(whole.unionByName(partly.select(F.inline(_route()))).distinct(), "routes")


def reference_blocks(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """ref, at, packed: the words of the wanted reference blocks (the at-th STRIDE words of row ref on, BLOCK of them)."""
    chosen = wanted.groupBy("ref").agg(F.collect_set("at").alias("ats")).join(
        texts.select(F.col("num").alias("t"), "packed"), F.col("ref") == F.col("t")).select("ref", "packed", "ats")
    schema = T.StructType([T.StructField("ref", T.LongType()), T.StructField("at", T.LongType()), T.StructField("packed", T.BinaryType())])

    def kernel_of():
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

        def kernel(batch):
            for ref, packed, ats in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ws = unpack(packed).split()
                for k in range(0, len(ats), 256):  # a long text in parts
                    some = ats[k:k + 256]
                    yield [ref] * len(some), some, [pack(b" ".join(ws[at * STRIDE:at * STRIDE + BLOCK])) for at in some]

        return kernel

    return written(chosen.mapInArrow(_batches(kernel_of, schema, "packed"), schema), "reference")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal hashes at the start of two runs of words."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Block:
    """A reference block: its words, their hashes, the hashes of its windows."""

    def __init__(self, ws: list[bytes], number: WordHashes, window: int = WINDOW):
        self.words, self.hashes = ws, number(ws)
        n = max(0, len(ws) - window + 1)
        self.windows = _ranges(self.hashes, np.arange(n), window) if n else np.zeros(0, np.uint64)


class Parser:
    """Greedy parse of a text against reference blocks. Hashes propose places and lengths, words confirm them."""

    def __init__(self, ws: list[bytes], references: list[tuple[int, Block]], number: WordHashes, window: int = WINDOW):
        """``references``: (place of its first word in this very text, or -1 if it is of another, block) of each block."""
        own = Block(ws, number, window)
        self.window, self.words, self.hashes = window, ws, own.hashes
        self.blocks = [b for _, b in references]
        self.own = [p for p, _ in references]
        none = np.zeros(0, np.int64)
        key = np.concatenate([np.zeros(0, np.uint64), *[b.windows for b in self.blocks]])
        block = np.concatenate([none, *[np.full(len(b.windows), i) for i, b in enumerate(self.blocks)]])
        at = np.concatenate([none, *[np.arange(len(b.windows)) for b in self.blocks]])
        order = np.argsort(key, kind="stable")
        self.key, self.block, self.at = key[order], block[order], at[order]
        self.low, self.high = np.searchsorted(self.key, own.windows, "left"), np.searchsorted(self.key, own.windows, "right")
        # windows that stand anywhere but at their own place
        here = np.zeros(len(own.windows), np.int64)
        for place, b in references:
            if place >= 0:
                here[place:place + len(b.windows)] += 1
        self.proposed = np.flatnonzero(self.high - self.low > here)

    def _match(self, i: int, block: Block, at: int) -> int:
        """Number of equal words from word i of the text and word ``at`` of a block on."""
        n = _common(self.hashes[i:], block.hashes[at:])
        if self.words[i:i + n] == block.words[at:at + n]:
            return n
        return next(k for k in range(n) if self.words[i + k] != block.words[at + k])

    def longest(self, i: int) -> tuple[int, int, int]:
        """(length, block, place in it) of the longest match at word i in any block, the first of equally long ones; length 0 if none
        reaches a window. A place of the text does not match itself."""
        best = (0, -1, -1)
        for k in range(self.low[i], self.high[i]):
            block, at = int(self.block[k]), int(self.at[k])
            if self.own[block] >= 0 and self.own[block] + at == i:
                continue
            n = self._match(i, self.blocks[block], at)
            if n >= self.window and (n > best[0] or n == best[0] and (block, at) < best[1:]):
                best = (n, block, at)
        return best

    def factors(self) -> list[tuple[int, int, int, int]]:
        """(first word, length, block, place in it) of the factors of a window or more, from left to right."""
        out, i = [], 0
        while (k := int(np.searchsorted(self.proposed, i))) < len(self.proposed):
            i = int(self.proposed[k])
            n, block, at = self.longest(i)
            if n:
                out.append((i, n, block, at))
            i += n or 1
        return out

    def covered(self) -> np.ndarray:
        """Which words a duplicate window covers: the factors, and what matches from a place before the end of a factor over its border."""
        out = np.zeros(len(self.words), bool)
        for i, n, _, _ in self.factors():
            out[i:i + n] = True
            end = i + n
            a, b = np.searchsorted(self.proposed, [max(i, end - self.window + 1), end])
            for s in self.proposed[a:b][::-1].tolist():
                if self._elsewhere(s):  # the last one covers what those before it cover
                    out[s:s + self.window] = True
                    break
        return out

    def _elsewhere(self, i: int) -> bool:
        """Whether the window at word i stands in a block at another place."""
        own = self.words[i:i + self.window]
        for k in range(self.low[i], self.high[i]):
            block, at = int(self.block[k]), int(self.at[k])
            if (self.own[block] < 0 or self.own[block] + at != i) and own == self.blocks[block].words[at:at + self.window]:
                return True
        return False


def drop_substrings(docs: DataFrame, text: str = "text", kept_text: bool = True) -> DataFrame:
    """Remove repeated passages: doc_id, n_words, n_removed, kept_sha256 and, with ``kept_text``, the kept words.

    A word goes if a window of WINDOW words over it also starts anywhere else, in the same text or another. Null and empty texts have no
    words; texts shorter than a window lose none, very long ones are parsed whole. Repeated rows are copies of each other and
    lose all their windows. An empty table gives no rows; other columns are not read. Texts move compressed: once to their routes' pieces where
    anchors are mixed, the wanted blocks to the texts that point there, and once to be parsed; all else that moves is one row per piece of about 16 words.
    What is removed matches word for word; a match could be missed only where 64-bit hashes of different windows are equal.
    """
    texts = _numbered(docs, text)
    wanted = routes(texts)
    blocks_ = reference_blocks(texts, wanted.select("ref", "at").distinct())
    held = wanted.join(blocks_.withColumnsRenamed({"ref": "r", "at": "a"}), (F.col("ref") == F.col("r")) & (F.col("at") == F.col("a")))
    held = held.groupBy("num").agg(F.collect_list(F.struct("ref", "at", "packed")).alias("blocks")).withColumnRenamed("num", "n")
    rows = texts.join(held, F.col("num") == F.col("n"), "left").select("doc_id", "packed", "num", "blocks")
    fields = [rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept", T.StringType())] * kept_text)

    def kernel_of():
        number, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        known: dict[tuple[int, int], Block] = {}

        def block_of(ref: int, at: int, packed: bytes) -> Block:
            if (ref, at) not in known:
                if len(known) >= BLOCKS_KEPT:
                    known.clear()
                known[ref, at] = Block(unpack(packed).split(), number)
            return known[ref, at]

        def kernel(batch):
            out = []
            for packed, num, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                ws = unpack(packed).split()
                n = len(ws)
                if found:
                    places = sorted((b["ref"], b["at"], b["packed"]) for b in found)
                    parser = Parser(ws, [(at * STRIDE if ref == num else -1, block_of(ref, at, p)) for ref, at, p in places], number)
                    ws = [ws[i] for i in np.flatnonzero(~parser.covered()).tolist()]
                kept = b" ".join(ws)
                out.append((n, n - len(ws), hashlib.sha256(kept).hexdigest(), *([kept.decode()] * kept_text)))
            yield batch.column(0), *([list(x) for x in zip(*out)] or [[]] * (len(fields) - 1 + kept_text))

        return kernel

    return rows.mapInArrow(_batches(kernel_of, schema, "packed"), schema)
