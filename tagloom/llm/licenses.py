"""License scan by conditional compression.

In a block of text around license words, windows about as long as a license text are compressed, in lower case and with single blanks,
alone and with that text as a raw zstandard dictionary. The bytes saved rank the candidates. They are looked at in that order, and the
first that the words confirm wins: it must stand in the window with few exact differences. Nothing is found that
does not save enough.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import OrderedDict
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts

# License, wording. Several wordings may name one license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                         "option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                         "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
                         "later version."),
    ("LGPL-2.1-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                          "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                          "option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                          "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                          "option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                          "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                          "option) any later version."),
    # up to the disclaimer, so that it does not fit the longer licenses of the family
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                     "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                     "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License v2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
)
# Words that open a candidate block.
CUES = re.compile(r"licen[sc]|copyright|permission|redistribut|rights|\bcc[ -]?by|\bcc0|free software|spdx|unencumbered|creative\s+commons|eclipse\s+public", re.I)
#: An SPDX tag names its licenses itself; operators and exceptions are not licenses.
SPDX = re.compile(r"spdx-license-identifier:[ \t]*([\w.+()-]+(?:[ \t]+(?:or|and|with)[ \t]+[\w.+()-]+)*)", re.I)
SPDX_ID = re.compile(r"(?<![\w.+-])(with[ \t]+[(]?)?(?!(?:or|and)(?![\w.+-]))(\w(?:[\w.+-]*[\w+])?)", re.I)


#: Characters around a cue that belong to its block; blocks that touch are one. The longest template fits.
REACH = 700
#: A long block is scanned in pieces of so many characters that overlap by REACH, so that time is linear in the text.
PIECE = 4096
#: Share of a template's own compressed size that it must save, and the share of its words that may differ.
SAVING, DIFFERENCE = 0.25, 0.1
#: Compression level of windows.
LEVEL = 6
#: Blocks whose result is kept per task.
MEMO = 20_000
_WORD = re.compile(r"[^\s\"'(),;:]+")
_VERSION = re.compile(r"v?\.?(\d{1,2}(?:\.\d+)*?)(?:\.0)*")
# Per word that names a family, the words that tell its licenses apart. They and versions must match exactly.
FAMILIES = {
    "gnu": {"gnu", "general", "lesser", "library", "affero", "later", "only"},
    "apache": {"apache"},
    "mozilla": {"mozilla"},
    "eclipse": {"eclipse"},
    "cc": {"cc", "by", "nc", "nd", "sa"},
    "cc0": {"cc0", "by", "nc", "nd", "sa"},
}


def block_ranges(text: str) -> list[tuple[int, int]]:
    """Places of candidate blocks: around every cue of the whole text, cut at white space, touching ones joined."""
    out: list[list[int]] = []
    for m in CUES.finditer(text):
        a = max(0, m.start() - REACH)
        if a and (cut := re.compile(r"\s").search(text, a, m.start())):
            a = cut.end()
        b = min(len(text), m.end() + REACH)
        if b < len(text) and (cut := text[m.end():b].rfind(" ")) > 0:
            b = m.end() + cut
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; punctuation at a word's end does not count."""
    return [(w, m.start(), m.start() + len(m[0].rstrip("."))) for m in _WORD.finditer(text) if (w := m[0].lower().rstrip("."))]


def canonical(word: str) -> str:
    """A version number without mark and zeros at the end (v3, 3.0: 3); other words as they are."""
    m = _VERSION.fullmatch(word)
    return m[1] if m else word


def telling(template: list[str]) -> tuple[list[int], set[str]]:
    """Places of the template's words that must match exactly, and the words that may not be put beside them."""
    family = {w for x in template for w in FAMILIES.get(x, ())}
    return [i for i, w in enumerate(template) if _VERSION.fullmatch(w) or family & set(w.split("-"))], family


def differences(template: list[str], block: list[str], allowed: int) -> tuple[int, int, int] | None:
    """Least number of word differences between the template and a run of the block's words, with the run's place:
    words missing, replaced or put in between. None if over ``allowed`` or if a telling word differs."""
    best = None
    fixed, family = telling(template)
    want, have = [canonical(w) for w in template], [canonical(w) for w in block]
    if not {want[i] for i in fixed} <= set(have):
        return None
    places = {}
    for i, w in enumerate(have):
        places.setdefault(w, []).append(i)
    # a run within the limit holds one of the first allowed + 1 words of the template at its place, give or take the limit
    starts = sorted({max(0, i - k - d) for k in range(min(allowed + 1, len(template))) for i in places.get(want[k], ())
                     for d in range(-allowed, allowed + 1) if i - k - d > -allowed - 1})
    for s in starts:
        run = have[s:s + len(template) + allowed]
        match = [m for m in SequenceMatcher(None, want, run, autojunk=False).get_matching_blocks() if m.size]
        if not match or match[0].b > 0 and best:
            continue
        first, last = match[0].b, match[-1].b + match[-1].size
        pairs = {m.a + k: m.b + k for m in match for k in range(m.size)}
        same = sum(template[i] == block[s + j] for i, j in pairs.items())
        n = max(len(template), last - first) - same
        if n > allowed or best is not None and (n, s + first) >= best[:2]:
            continue
        if not all(i in pairs for i in fixed):
            continue
        # beside a telling word, a word of the family makes another license of it (GNU Lesser General)
        told = {pairs[i] for i in fixed}
        between = set(range(first, last)) - set(pairs.values())
        if any(family & set(run[j].split("-")) and told & {j - 1, j + 1} for j in between):
            continue
        best = (n, s + first, s + last)
        if n == 0:
            break
    return best


def plain_bytes(text: str) -> bytes:
    """What is compressed: lower case, single blanks. Case and line breaks do not count for the words either."""
    return " ".join(text.lower().split()).encode()


def tagged(text: str) -> list[tuple[int, int, str, float, int]]:
    """The licenses that SPDX tags name, as they are written there."""
    return [(m.start(1) + i.start(2), m.start(1) + i.end(2), i[2], 1.0, 0) for m in SPDX.finditer(text) for i in SPDX_ID.finditer(m[1]) if not i[1]]


def cue_words(text: str, ws: list[tuple[str, int, int]]) -> list[int]:
    """Numbers of the words in which cues start."""
    starts = [a for _, a, _ in ws]
    return sorted({max(0, bisect.bisect_right(starts, m.start()) - 1) for m in CUES.finditer(text)}) if ws else []


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [[w for w, _, _ in tokens(t)] for _, t in templates]
        self.cues = [cue_words(t, tokens(t)) for _, t in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL).compress
        self.with_template = []
        for _, t in templates:
            data = zstandard.ZstdCompressionDict(plain_bytes(t), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.with_template.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data).compress)
        frame = len(self.plain(b""))
        self.own = [len(self.plain(plain_bytes(t))) - frame for _, t in templates]
        self.memo: OrderedDict[str, list] = OrderedDict()

    def windows(self, text: str, ws: list[tuple[str, int, int]]) -> set[tuple[int, int, int]]:
        """(template, first word, end): around each cue, the words that a template can cover which holds the cue at one of its own
        places. A window is about as long as its template, so what surrounds it does not hide the saving; where cues are dense,
        neighbours are joined up to three times that length."""
        at, out = cue_words(text, ws), set()
        for i, own in enumerate(self.cues):
            n, allowed = len(self.words[i]), self._allowed(i)
            start = end = None
            for c in at:
                a, b = max(0, c - max(own) - allowed), min(len(ws), c - min(own) + n + allowed)
                if start is not None and b - start <= max(3 * n, n + 12):
                    end = b
                    continue
                if start is not None:
                    out.add((i, start, end))
                start, end = a, b
            if start is not None:
                out.add((i, start, end))
        return out

    def saved(self, i: int, window: str) -> int:
        """Bytes by which template i as a dictionary shortens the compressed window."""
        data = plain_bytes(window)
        return len(self.plain(data)) - len(self.with_template[i](data))

    def rank(self, i: int, saved: int) -> tuple[int, int]:
        """What a candidate is sorted by: most bytes saved first, then the order of the templates."""
        return -saved, i

    def _allowed(self, i: int) -> int:
        return int(DIFFERENCE * len(self.words[i]))

    def scan_block(self, block: str) -> list[tuple[int, int, str, float, int]]:
        """Licenses in a block: start, end, name, saving, differences.

        Every window is compressed with its template; candidates that save enough are confirmed in the order of their rank, and the
        first that the words confirm wins. Its words are taken out; windows that held some of them are compressed again without them."""
        if block in self.memo:
            return self.memo[block]
        ws, rest = tokens(block), block
        gone, found, queue = [False] * len(ws), [], []

        def propose(i: int, a: int, b: int) -> None:
            saved = self.saved(i, rest[ws[a][1]:ws[b - 1][2]])
            if saved >= SAVING * self.own[i]:
                heapq.heappush(queue, (*self.rank(i, saved), a, b, i, saved, sum(gone[a:b])))

        for i, a, b in self.windows(block, ws):
            propose(i, a, b)
        while queue:
            *_, a, b, i, saved, was_gone = heapq.heappop(queue)
            if sum(gone[a:b]) != was_gone:
                propose(i, a, b)
                continue
            there = [k for k in range(a, b) if not gone[k]]
            hit = differences(self.words[i], [ws[k][0] for k in there], self._allowed(i))
            # words that a taken license stands between are no run
            if hit is None or there[hit[2] - 1] - there[hit[1]] != hit[2] - 1 - hit[1]:
                continue
            first, last = there[hit[1]], there[hit[2] - 1]
            start, end = ws[first][1], ws[last][2]
            found.append((start, end, self.names[i], round(saved / self.own[i], 3), hit[0]))
            rest = rest[:start] + " " * (end - start) + rest[end:]
            gone[first:last + 1] = [True] * (last + 1 - first)
            propose(i, a, b)
        found.sort()
        self.memo[block] = found
        if len(self.memo) > MEMO:
            self.memo.popitem(last=False)
        return found

    def _scan_range(self, text: str, a: int, b: int):
        """Licenses in text[a:b], piece by piece. A license belongs to the piece in whose part before the overlap it starts; the next piece
        starts after what is found."""
        while b - a > PIECE:
            border = a + PIECE - REACH
            border = max(text.rfind(" ", a, border), text.rfind("\n", a, border)) + 1 or border
            hits = [(a + s, a + e, *rest) for s, e, *rest in self.scan_block(text[a:a + PIECE]) if a + s < border]
            yield from hits
            a = max([border, *(e for _, e, *_ in hits)])
        yield from ((a + s, a + e, *rest) for s, e, *rest in self.scan_block(text[a:b]))

    def __call__(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        return sorted([x for a, b in block_ranges(text or "") for x in self._scan_range(text, a, b)] + tagged(text or ""))


def scan_licenses(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` with found: array<struct<start, end, license, saving, differences>> of each whole text, in order of place.

    A null or empty text has none. Offsets in code points, end exclusive. Repeated blocks are compressed once per task. Of templates that
    save equally many bytes the earlier one is tried first. Repeated rows each get their row, an empty table gives none; columns that
    are not in ``keep`` are not read, so their names cannot clash.
    """
    item = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()),
                         T.StructField("saving", T.DoubleType()), T.StructField("differences", T.LongType())])
    names = item.names

    def make():
        scanner = Scanner()
        return lambda texts: {"found": [[dict(zip(names, x)) for x in scanner(t)] for t in texts]}

    return map_texts(docs, keep, F.col(text), [T.StructField("found", T.ArrayType(item))], make)


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_found, licenses (names in code point order, comma-joined), spans (license:start:end:differences, by place)."""
    found = scan_licenses(docs, {"doc_id": F.col("doc_id")})
    name = F.transform("found", lambda x: x["license"])
    span = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["differences"].cast("string")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"),
                        F.array_join(F.array_sort(F.array_distinct(name)), ",").alias("licenses"), F.array_join(span, ",").alias("spans"))
