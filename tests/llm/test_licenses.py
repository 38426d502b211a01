import random

from pyspark.sql import functions as F

from tagloom.llm.licenses import TEMPLATES, Scanner, license_digest, scan_licenses, tokens


def exact(text):
    """Brute force: every template whose words stand in the text word for word, longest first, without overlap."""
    ws = tokens(text or "")
    plain = [w for w, _, _ in ws]
    hits = []
    for name, t in TEMPLATES:
        want = [w for w, _, _ in tokens(t)]
        hits += [(-len(want), i, i + len(want), name) for i in range(len(plain) - len(want) + 1) if plain[i:i + len(want)] == want]
    taken, out = set(), set()
    for _, a, b, name in sorted(hits):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out.add((ws[a][1], ws[b - 1][2], name))
    return out


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    n = 0
    for r in scan_licenses(docs, {"doc_id": F.col("doc_id")}).collect():
        want = exact(texts[r["doc_id"]])
        n += len(want)
        assert {(x["start"], x["end"], x["license"]) for x in r["found"] if x["differences"] == 0} == want
        assert len(r["found"]) == len(want)
    assert n > 30


def test_every_template_in_noise_and_with_small_changes():
    r, scan = random.Random(6), Scanner()
    noise = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    for name, t in TEMPLATES:
        text = f"{noise(300)}\n{t}\n{noise(200)}"
        assert [(x[2], x[4]) for x in scan(text)] == [(name, 0)]
        ws = t.split()
        if len(ws) > 30:
            ws[12] = "changed"
            del ws[20]
            assert [(x[2], x[4]) for x in scan(f"{noise(50)} {' '.join(ws)} {noise(50)}")] == [(name, 2)]
    both = f"{TEMPLATES[2][1]}\n{noise(9)}\n{TEMPLATES[13][1]}"
    assert {x[2] for x in scan(both)} == {TEMPLATES[2][0], TEMPLATES[13][0]}
    assert scan("No permission to license the copyright of rights here. " * 400) == []


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "x" * 200_000 + " Released under the MIT License. " + "y " * 50_000, 1), (4, "Released under the MIT License.", 2),
            (4, "Released under the MIT License.", 2), (None, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int")
    got = sorted(((r["doc_id"], r["n_found"], r["licenses"]) for r in license_digest(df).collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 1, "MIT"), (4, 1, "MIT"), (4, 1, "MIT"), (None, 2, "CC-BY-4.0,CC-BY-NC-4.0")], key=str)
    assert license_digest(df.limit(0)).count() == 0


def test_long_block_is_scanned_in_pieces():
    """Licenses on every border of the pieces; thousands of mentions in one block take linear time."""
    for shift in range(3000, 4400, 37):
        text = "rights " + "x" * shift + f" {TEMPLATES[3][1]} " + "copyright and permission " * 200 + TEMPLATES[2][1]
        assert [(x[0], x[2], x[4]) for x in Scanner()(text)] == [(text.index("Permission is"), "MIT", 0), (text.index("Released under"), "MIT", 0)]
    dense = "lorem ipsum dolor. All rights reserved. " * 3000
    got = Scanner()(dense)
    assert [x[0] for x in got] == [k * 40 + 19 for k in range(3000)]
    assert {x[2] for x in got} == {"All-Rights-Reserved"}


def test_words_that_tell_licenses_apart_must_match():
    """Notices of other versions and relatives are not taken for a template; filler words may still differ."""
    scan = Scanner(TEMPLATES[:18])
    by = lambda name: max((t for n, t in TEMPLATES[:18] if n == name), key=len)
    gpl, later, lesser, apache, cc0 = by("GPL-2.0"), by("GPL-3.0-or-later"), by("LGPL-3.0"), by("Apache-2.0"), by("CC0-1.0")
    for text in (later.replace("version 3", "version 2"), later.replace("GNU General", "GNU Lesser General"), later.replace("any later", "no other"),
                 later.replace("GNU General", "GNU Affero General"), later.replace("version 3", "version two"), lesser.replace("version 3", "version 2.1"),
                 gpl.replace("version 2", "version 1"), gpl.replace("GNU General", "GNU Library General"), apache.replace("2.0", "1.1"),
                 cc0.replace("CC0 1.0", "CC0 2.0"), by("MPL-2.0").replace("2.0", "1.1"), by("CC-BY-NC-4.0").replace("4.0", "3.0")):
        assert scan(f"one two three. {text} four five six.") == [], text
    for text, name, n in ((gpl.replace("version 2", "version 2.0"), "GPL-2.0", 1), (lesser.replace("work", "library"), "LGPL-3.0", 1),
                          (later.replace("program", "package"), "GPL-3.0-or-later", 1), (apache.replace("http:", "https:"), "Apache-2.0", 1),
                          (by("MIT").replace("conditions: The", "conditions: 1. The").replace("this software", "this library"), "MIT", 2)):
        assert [(x[2], x[4]) for x in scan(f"one two three. {text} four five six.")] == [(name, n)], text


def test_every_template_in_capitals_title_case_and_broken_lines():
    r, scan = random.Random(7), Scanner()
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))
    for name, t in TEMPLATES:
        for form in (t.upper(), t.title(), t.lower(), t.replace(" ", "\n   ")):
            before = noise(100)
            got = scan(f"{before}\n{form}\n{noise(100)}")
            assert [(x[0], x[2], x[4]) for x in got] == [(len(before) + 1, name, 0)], form


def test_short_templates_in_prose():
    """Whatever the text around saves or costs, a template that stands in it is found, in any case."""
    import pyarrow.parquet as pq

    r, scan = random.Random(3), Scanner()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t for t in texts if t and len(t) > 1500 and not scan(t)]
    for k in range(120):
        t, (name, form) = r.choice(texts), TEMPLATES[(2, 11, 17)[k % 3]]
        at = r.randrange(1, len(t))
        form = (form, form.upper(), form.title())[k // 3 % 3]
        assert [(x[0], x[2], x[4]) for x in scan(f"{t[:at]}\n{form}\n{t[at:]}")] == [(at + 1, name, 0)]


def test_tags_and_common_notices():
    scan = Scanner()
    for text, want in (("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("# spdx-license-identifier:  (GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0) AND ISC.",
                       ["GPL-2.0-or-later", "Apache-2.0", "ISC"]), ("SPDX-License-Identifier: GPL-2.0+ */", ["GPL-2.0+"]), ("SPDX-License-Identifier: ", []),
                       ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
                       ("This is free and unencumbered software released into the public domain.", ["Unlicense"])):
        got = scan(text)
        assert [x[2] for x in got] == want, text
        if "identifier" in text.lower():
            assert [text[x[0]:x[1]] for x in got] == want
    two, three = (next(t for n, t in TEMPLATES[18:] if n == f"BSD-{k}-Clause") for k in (2, 3))
    numbered = [t.replace("met: R", "met: 1. R").replace("disclaimer. R", "disclaimer. 2. R").replace("Neither", "3. Neither") for t in (two, three)]
    assert [[x[2] for x in scan(t)] for t in numbered] == [["BSD-2-Clause"], ["BSD-3-Clause"]]
    lesser = next(t for n, t in TEMPLATES if n == "LGPL-2.1-or-later")
    assert [x[2] for x in scan(lesser.replace("program", "library"))] == ["LGPL-2.1-or-later"]


def _bsd(k):
    return max((t for n, t in TEMPLATES if n == f"BSD-{k}-Clause"), key=len)


class Shuffled(Scanner):
    """The savings are known but do not rank."""

    def rank(self, i, saved):
        return random.Random(i * 31 + saved).random(), i


class InOrder(Scanner):
    """No ranking: the order of the templates alone."""

    def rank(self, i, saved):
        return 0, i


class Blind(Scanner):
    """Compression switched off: nothing is ever saved."""

    def saved(self, i, window):
        return 0


class Equal(Scanner):
    """Compression switched off the other way: every template saves as much as every other."""

    def saved(self, i, window):
        return 10_000


def test_the_ranking_decides():
    """Several templates fit these notices word for word; which one is reported is up to the bytes they save."""
    r = random.Random(4)
    noise = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    apache = max((t for n, t in TEMPLATES if n == "Apache-2.0"), key=len)
    notices = [f"{noise(40)} {t} {noise(40)}" for t in (_bsd(2), _bsd(3), apache) for _ in range(4)]
    want = [[(n, len(tokens(t)))] for n, t in (("BSD-2-Clause", _bsd(2)), ("BSD-3-Clause", _bsd(3)), ("Apache-2.0", apache)) for _ in range(4)]
    found = lambda scan: [[(x[2], len(tokens(text[x[0]:x[1]]))) for x in scan(text)] for text in notices]
    assert found(Scanner()) == want
    for other in (Shuffled, InOrder, Equal):
        assert found(other()) != want
    assert found(Blind()) == [[]] * len(notices)


def test_nothing_is_confirmed_that_saves_too_little():
    """The words of a template in another order stand in the text, but no run of bytes does: it saves little and is never confirmed."""
    asked = []

    class Spy(Scanner):
        def saved(self, i, window):
            asked.append((i, super().saved(i, window)))
            return asked[-1][1]

    scan, text = Spy(), "one " + " ".join(reversed(TEMPLATES[3][1].split())) + " two"
    assert scan(text) == []
    mit = [s for i, s in asked if i == 3]
    assert mit and max(mit) < 0.8 * scan.own[3]


def test_dense_cues_take_linear_time():
    import time

    times = []
    for n in (2000, 8000):
        text = " ".join(f"w{i} rights" for i in range(n))
        start = time.time()
        assert Scanner()(text) == []
        times.append(time.time() - start)
    assert times[1] < 10 * times[0] + 1
