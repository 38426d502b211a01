"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts

SPACE = "▁"
#: Chunks kept with their ids per task; the table is emptied when full, which changes no result.
MEMO = 600_000
#: Longer chunks use one heap each, shorter ones share the batched agenda.
SHORT = 48


class Pieces:
    """Encoder of one model.

    A text becomes ``▁`` + text with ``▁`` for blanks. No piece of the vocabulary has a
    ``▁`` after another character (checked on loading), so no merge crosses the
    place before a run of ``▁``: the chunks between are encoded one by one, each
    distinct chunk once. Within a chunk an agenda of adjacent symbol pairs is worked off by score,
    leftmost first among equals, until no pair forms a piece; symbols that are no piece
    become their bytes. New chunks of a batch are compared with the library's ids; a difference raises.
    """

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.library, self.library.get_piece_size()
        kinds = [(m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)) for i in range(n)]
        self.ids = {m.id_to_piece(i): i for i in range(n) if not kinds[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a blank inside need whole-text agendas")
        if m.is_unused(n - 1) or not all(m.is_byte(m.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the vocabulary has no byte fallback")
        if m.encode(" a  b ") != m.encode(" a  b ".replace(" ", SPACE)) or len(m.encode("  ")) == 0:
            raise ValueError("the model normalises white space")
        self.scores = np.array([m.get_score(i) for i in range(n)])
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end, self.check = m.bos_id(), m.eos_id(), check
        self.memo: dict[str, bytes] = {}
        self._pair_tables()

    def _pair_tables(self) -> None:
        """All splits of every piece in two pieces (or characters): the pairs that can merge,
        as sorted keys left * size + right."""
        extra = {c: None for p in self.ids for c in p if c not in self.ids}
        self.symbols = dict(self.ids) | {c: len(self.scores) + k for k, c in enumerate(extra)}
        self.size = len(self.scores) + len(extra) + 1
        self.other = self.size - 1  # any character that no piece holds
        keys, merged = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        keys, merged = np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order]
        # open addressing: a few probes per lookup instead of a binary search
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.mask = (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_id = np.full(1 << bits, -1, dtype=np.int64)
        at, left = self._hash(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] < 0
            first = left[free]
            _, u = np.unique(at[first], return_index=True)
            put = first[u]
            self.slot_key[at[put]], self.slot_id[at[put]] = keys[put], merged[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            left = left[rest[left]]
            at[left] = (at[left] + 1) & self.mask
        # equal scores share a rank, so that the leftmost of them goes first
        ordered = np.unique(-self.scores[np.unique(merged)]) if len(merged) else np.zeros(0)
        self.rank = np.full(len(self.scores) + 1, 1 << 40, dtype=np.int64)
        self.rank[np.unique(merged)] = np.searchsorted(ordered, -self.scores[np.unique(merged)])
        self.pair_id = {int(k): int(v) for k, v in zip(keys, merged)}
        self.lengths = [len(self.library.id_to_piece(i)) for i in range(len(self.scores))]
        self.by_code = np.full(0x110000, self.other, dtype=np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.by_code[ord(c)] = i

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair forms, -1 for none."""
        keys = left * self.size + right
        at = self._hash(keys)
        found = np.where(self.slot_key[at] == keys, self.slot_id[at], -1)
        open_ = np.flatnonzero((found < 0) & (self.slot_key[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            k = self.slot_key[at[open_]]
            hit = k == keys[open_]
            found[open_[hit]] = self.slot_id[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
        return found

    def _out(self, chunk: str, ids: list[int]) -> bytes:
        """Ids of the symbols as bytes; what is no piece goes as UTF-8 bytes."""
        out, at = [], 0
        for i in ids:
            if i < len(self.scores):
                out.append(i)
                at += self.lengths[i]
            else:
                out += [self.bytes[b] for b in chunk[at].encode()]
                at += 1
        return np.array(out, dtype="<u4").tobytes()

    def _heap(self, chunk: str) -> list[int]:
        """The agenda of one long chunk as a heap over a linked list of symbols."""
        ids = [self.symbols.get(c, self.other) for c in chunk]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and (j := after[i]) < n and (new := self.pair_id.get(ids[i] * self.size + ids[j])) is not None:
                agenda.append((int(self.rank[new]), i, ids[i], ids[j], new))

        for i in range(n):
            offer(i)
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            held = len(agenda)
            offer(before[i])
            offer(i)
            fresh = agenda[held:]
            del agenda[held:]
            for x in fresh:
                heapq.heappush(agenda, x)
        return [i for i in ids if i >= 0]

    def _batched(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many short chunks side by side: in each round every chunk's best
        pair merges. All symbols in order, and where each chunk's end."""
        flat = self.by_code[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))
        done_ids, done_owner = [], []
        pair = self._merged(flat[:-1], flat[1:])
        pair[owner[:-1] != owner[1:]] = -1
        pair = np.append(pair, -1)
        while len(flat):
            key = self.rank[pair] * (len(flat) + 1) + np.arange(len(flat))
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(key, starts)
            live = best < (1 << 40)
            at = best[live] % (len(flat) + 1)
            alive = np.repeat(live, np.diff(np.append(starts, len(flat))))
            done_ids.append(flat[~alive])
            done_owner.append(owner[~alive])
            if not len(at):
                break
            flat[at] = pair[at]
            alive[at + 1] = False
            shift = np.cumsum(alive) - 1
            flat, owner, pair, at = flat[alive], owner[alive], pair[alive], shift[at]
            for i in (at, at[at > 0] - 1):
                i_next = np.minimum(i + 1, len(flat) - 1)
                new = self._merged(flat[i], flat[i_next])
                new[(owner[i] != owner[i_next]) | (i == i_next)] = -1
                pair[i] = new
        ids, own = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(own, kind="stable")
        return ids[order], np.cumsum(np.bincount(own, minlength=len(chunks)))

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encode new chunks and compare them with the library."""
        short = [c for c in chunks if len(c) <= SHORT]
        out = {}
        if short:
            ids, ends = self._batched(short)
            starts = np.append(0, ends[:-1])
            flat = ids.astype("<u4").tobytes()
            out = {c: flat[a:b] for c, a, b in zip(short, (starts * 4).tolist(), (ends * 4).tolist())}
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(ids >= len(self.scores)), side="right"))
            for k in odd.tolist():
                out[short[k]] = self._out(short[k], ids[starts[k]:ends[k]].tolist())
        for c in chunks:
            if len(c) > SHORT:
                out[c] = self._out(c, self._heap(c))
        if self.check:
            # a chunk of one blank is what the library puts before any text, and none before an empty one
            own = [c for c in out if len(c) > 1]
            want = self.library.encode([c[1:].replace(SPACE, " ") for c in own], num_threads=1)
            flat = np.fromiter(chain.from_iterable(want), dtype="<u4").tobytes()
            mine = list(map(out.__getitem__, own))
            if b"".join(mine) != flat or list(map(len, mine)) != [4 * n for n in map(len, want)]:
                raise RuntimeError("the ids of a batch differ from the library's")
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, with begin and end ids."""
        cut = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        parts = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = [c for c in set().union(*parts) if c not in memo]
        if new:
            memo.update(self._learn(new))
        head, tail = (np.array([x], dtype="<u4").tobytes() for x in (self.begin, self.end))
        return [b"".join([head, *map(memo.__getitem__, p), tail]) for p in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, dtype="<u4").tolist() for x in ids], num_threads=1)


def encode_pieces(docs: DataFrame, model: str, keep: dict[str, Column], text: str = "text", ids: bool = True) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns ``keep`` with n_tokens, ids_sha256, decoded_sha256 and, with ``ids``,
    piece_ids and decoded. A null text counts as empty: begin and end id only. Repeated rows give repeated rows,
    an empty table an empty one. One narrow pass; each task holds the model and at most
    ``MEMO`` chunks beside one batch.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make():
        pieces = Pieces(model)

        def kernel(texts):
            found = pieces.encode(texts)
            back = pieces.decode(found)
            out = {"n_tokens": [len(x) // 4 for x in found],
                   "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found],
                   "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back]}
            if ids:
                out |= {"piece_ids": [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found], "decoded": back}
            return out

        return kernel

    return map_texts(docs, keep, F.col(text), fields, make)
