"""Brute-force versions of the operators, in plain Python."""

import hashlib
import re

SPACE = " \t\n\v\f\r"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    """Base spans of a text, kind by kind."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def quality_base(text):
    ws = split(text)
    covered = set()
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if split(x)]
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def repeated(texts, window=35):
    """Per text: number of words and the words left after repeated windows went."""
    places = {}
    parts = [split(t) for t in texts]
    for d, ws in enumerate(parts):
        for i in range(len(ws) - window + 1):
            places.setdefault(tuple(ws[i:i + window]), []).append((d, i))
    gone = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return [(len(ws), [w for i, w in enumerate(ws) if i not in g]) for ws, g in zip(parts, gone)]
