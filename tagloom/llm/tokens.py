"""Token counts of byte-level BPE by finite-state transducers.

Two deterministic transducers run over a text. The *cutter* reads classes of
characters and marks where pre-tokens start; its input is dealt in equal chunks, every chunk's map from state
to state is computed on its own, and the maps compose in a parallel prefix scan, which
gives each chunk the state it starts in. The *counter* reads the bytes of a
pre-token; each of its transitions carries the number of tokens it adds, so the
sum along the path is the number of tokens.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts

#: Counts kept for pre-tokens, and compiled transitions, per task; emptied when full, which changes no result.
MEMO, TRANSITIONS = 600_000, 1_500_000
CHUNK = 1_024

# ---------------------------------------------------------------- cutter

#: Classes of characters: blank, other white space, number, other, apostrophe, letter; the letters of the
#: contractions 's 't 'm 'd, 're 've, 'll; the end of a segment.
BLANK, SPACE, NUMBER, OTHER, QUOTE, LETTER, STMD, RV, EL, EE, END = range(11)
#: States: nothing open, one blank, one other white space, more white space ending in a blank / in another,
#: inside letters / numbers / others, apostrophe at a start, the same with r or v, with l.
START, B1, S1, BM, SM, L, N, O, Q, QR, QL = range(11)
LETTERS = (LETTER, STMD, RV, EL, EE)


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and emit[state, class]: bit 0, a pre-token starts at the character
    read; bit 1, one starts at the character before it."""
    nxt, emit = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    opened = {BLANK: B1, SPACE: S1, NUMBER: N, OTHER: O, QUOTE: Q, **dict.fromkeys(LETTERS, L)}
    joined = opened | {QUOTE: O}  # after a blank that belongs to it, an apostrophe opens no contraction
    for c, to in opened.items():
        for s in range(11):
            nxt[s, c], emit[s, c] = to, 1
        for s in (B1, BM):
            if c not in (BLANK, SPACE):
                nxt[s, c], emit[s, c] = joined[c], 0 if s == B1 else 2
        if c not in (BLANK, SPACE):
            emit[SM, c] = 3
        else:
            for s in (B1, S1, BM, SM):
                nxt[s, c], emit[s, c] = (BM if c == BLANK else SM), 0
        for s in (QR, QL):  # the letter read before turns out to open a pre-token of its own
            nxt[s, c], emit[s, c] = (L, 2) if c in LETTERS else (to, 3)
    for c in LETTERS:
        emit[L, c] = 0
    emit[N, NUMBER] = 0
    for c in (OTHER, QUOTE):
        nxt[O, c], emit[O, c] = O, 0
        nxt[Q, c], emit[Q, c] = O, 0
    nxt[Q, STMD], emit[Q, STMD] = START, 0
    nxt[Q, RV], emit[Q, RV] = QR, 0
    nxt[Q, EL], emit[Q, EL] = QL, 0
    nxt[QR, EE], emit[QR, EE] = START, 0
    nxt[QL, EL], emit[QL, EL] = START, 0
    nxt[:, END], emit[:, END] = START, 1
    emit[[QR, QL], END] = 3
    return nxt, emit


def classes() -> np.ndarray:
    """Class of each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]):ord(m[0][-1]) + 1] = c
    out[0xD800:0xE000] = OTHER
    for text, c in ((" ", BLANK), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", EL), ("e", EE)):
        out[[ord(x) for x in text]] = c
    return out


def starts(cls: np.ndarray, nxt: np.ndarray, emit: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a pre-token starts. ``cls`` ends with END.

    Step 1 runs every chunk from every state, until all its states have met in one. Step 2 composes
    the maps: after round k each holds the map of up to 2^k chunks. Step 3 runs every chunk once from its own state.
    """
    n = len(cls)
    m = -(-n // chunk)
    grid = np.full(m * chunk, END, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(m, chunk).T)
    table, states = nxt.ravel(), nxt.shape[0]
    width = nxt.shape[1]
    maps = np.tile(np.arange(states, dtype=np.uint8), (m, 1))
    apart, one = np.arange(m), np.zeros(m, np.uint8)
    met = np.zeros(m, bool)
    for row in grid:
        if met.any():
            one[met] = table[one[met].astype(np.intp) * width + row[met]]
        if len(apart):
            at = table[maps[apart].astype(np.intp) * width + row[apart, None]]
            maps[apart] = at
            same = (at == at[:, :1]).all(axis=1)
            one[apart[same]] = at[same, 0]
            met[apart[same]] = True
            apart = apart[~same]
    maps[met] = one[met, None]
    step = 1
    while step < m:  # inclusive prefix scan
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.full(m, START, np.uint8)
    state[1:] = maps[:-1, START]
    marks = np.empty_like(grid)
    flat = emit.ravel()
    for k, row in enumerate(grid):
        at = state.astype(np.intp) * width + row
        marks[k] = flat[at]
        state = table[at]
    marks = marks.T.ravel()[:n]
    out = (marks & 1).astype(bool)
    out[:-1] |= marks[1:] > 1
    return out


# ---------------------------------------------------------------- counter


class Counter:
    """Counts the tokens of pre-tokens.

    The last token of the encoding of a prefix is fixed by that prefix: it is the suffix that is a
    token and may follow the last token of what stands before it. A state is therefore a set of items: for each
    open position, the place in the trie of the token bytes read since, the token that ends there, and
    how many tokens fewer were counted there. Determinising item sets gives a transducer
    whose transitions carry the change of the count. States are compiled when first reached.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"]]
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        plain = byte_letters()
        raw = lambda s: bytes(plain[c] for c in s)
        self.rank = {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((raw(a), raw(b)), k)
        tokens = {bytes([b]) for b in range(256)} | {raw(a) + raw(b) for a, b in pairs}
        if not all(c in vocab for c in plain):
            raise ValueError("the vocabulary lacks some bytes")
        # the trie: node 0 is the root; child[node << 8 | byte]; token[node]
        self.child, self.token, self.inner = {}, [b""], [True]
        for t in sorted(tokens):
            node = 0
            for b in t:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(b"")
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = t
        self.follows: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, 0, 0),)
        self.items, self.number, self.step = [start], {start: 0}, {}

    def merge(self, text: bytes) -> list[bytes]:
        """The defining procedure on a short byte string: merge the first best pair until none is left."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 40) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 40:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, before: int, node: int) -> bool:
        key = (before, node)
        if (known := self.follows.get(key)) is None:
            a, t = self.token[before], self.token[node]
            self.follows[key] = known = self.merge(a + t) == ([a, t] if a else [t])
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        moved, last, change = [], 0, 0
        for node, before, less in self.items[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            moved.append((to, before, less))
            if self.token[to] and not last and self._may_follow(before, to):
                last, change = to, less + 1
        items = (*((node, before, less - change) for node, before, less in moved if self.inner[node]), (0, last, 0))
        if items not in self.number:
            self.number[items] = len(self.items)
            self.items.append(items)
        return self.number[items], change

    def count(self, piece: str) -> int:
        """Number of tokens of one pre-token."""
        state, n, step = 0, 0, self.step
        for b in piece.encode():
            key = state << 8 | b
            found = step.get(key)
            if found is None:
                step[key] = found = self._compile(state, b)
            state, change = found
            n += change
        if len(step) > TRANSITIONS:
            self._reset()
            self.follows.clear()
        return n


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes, by rule: printable
    bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Counts tokens of whole texts, batch by batch."""

    def __init__(self, path: str, chunk: int = CHUNK):
        self.counter, self.chunk = Counter(path), chunk
        self.nxt, self.emit = cutter()
        self.cls = classes()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.counter.specials, key=len, reverse=True)))) \
            if self.counter.specials else None

    def counts(self, texts: list[str | None]) -> list[int]:
        # special strings are one token each and end the segment before them
        segments, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            parts = [t or ""] if self.special is None else self.special.split(t or "")
            extra[k] = len(parts) - 1
            segments += parts
            owner += [k] * len(parts)
        if not segments:
            return []
        stream = "\0".join(segments) + "\0"
        codes = np.frombuffer(stream.encode("utf-32-le"), dtype="<u4")
        cls = self.cls[codes]
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        cls[ends] = END
        mark = starts(cls, self.nxt, self.emit, self.chunk)
        at = np.flatnonzero(mark)
        # an END also starts a piece of its own, which counts nothing
        is_end = cls[at] == END
        cuts = at.tolist()
        pieces = [stream[a:b] for a, b in zip(cuts, [*cuts[1:], len(stream)])]
        memo, count = self.counter.memo, self.counter.count
        if len(memo) > MEMO:
            memo.clear()
        for p in set(pieces).difference(memo):
            memo[p] = count(p)
        n = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
        n[is_end] = 0
        per = np.bincount(np.searchsorted(ends, at), weights=n, minlength=len(segments))
        return (np.bincount(np.array(owner), weights=per, minlength=len(texts)).astype(np.int64) + extra).tolist()


def count_tokens(docs: DataFrame, vocabulary: str, keep: dict[str, Column], text: str = "text", limit: int = 1024) -> DataFrame:
    """``keep`` with n_bytes, n_tokens and over_limit of each whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows, an empty table an empty one;
    a very long text is one slice of its own and its chunks are scanned side by side. One narrow pass.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("over_limit", T.BooleanType())]

    def make():
        tokens = Tokens(vocabulary)

        def kernel(texts):
            n = tokens.counts(texts)
            return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return kernel

    return map_texts(docs, keep, F.col(text), fields, make)
