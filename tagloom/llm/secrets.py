"""Secrets in text: patterns propose candidates, and what a candidate decodes to decides.

Base kinds go by their pattern and length. All others are confirmed by structure: base64 or hex is decoded, key encodings are parsed
(every nested length must fit, and the fields must be those of a private key), token headers must be signed-token headers.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
import zlib

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts, sha256_hex

# The base patterns. Letters of the words before an assigned value count in either case, ASCII only.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: A run of hex digits, met where it starts; shorter ones fail anyway.
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}+")
#: What a text holds in lower case if ASSIGN matches in it.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")
#: All kinds in the order in which they are listed.
KINDS = (*BASE, "pem", "der", "openssh", "token", "checked", "wrapped")

#: A candidate run is met where it starts, and matched possessively, so that time is linear in the text.
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
PEM_END = re.compile(r"-----END ([A-Z0-9 ]{1,40})-----")
BASE64_LEAST = 40
BASE64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{BASE64_LEAST},}}+={{0,2}}+")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}+|[0-9A-F]{64,}+)(?![0-9A-Za-z])")
SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)(?![A-Za-z0-9_.-]*[A-Za-z0-9_-])")
# Prefixes of tokens that end in six base-62 digits of the CRC-32 of the thirty characters before.
CHECKED = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Bytes of the signature per signature algorithm; null: any from the least on.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": None,
              "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}
SIGNATURE_LEAST = 64
OPENSSH = b"openssh-key-v1\0"
#: Decodings within decodings that are followed, nested fields of a key, and bytes of its numbers (131,072 bits).
WRAPS, NESTED, NUMBER = 3, 16, 1 << 14


class Malformed(ValueError):
    pass


def element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the contents of the element at ``at``; its length must fit before ``end`` and be written in the
    shortest way."""
    if end - at < 2:
        raise Malformed("no room for a length")
    tag, length, start = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        raise Malformed("long tag")
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 8 or end - start < n:
            raise Malformed("bad length")
        length, start = int.from_bytes(data[start:start + n], "big"), start + n
        if length < 0x80 or n > 1 and length < 1 << 8 * (n - 1):
            raise Malformed("length not in its shortest form")
    if length > end - start:
        raise Malformed("length beyond the end")
    return tag, start, start + length


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """All elements that fill at..end exactly."""
    out = []
    while at < end:
        out.append(found := element(data, at, end))
        at = found[2]
    return out


def well_formed(data: bytes, at: int, end: int) -> None:
    """Walk all nested elements; every length must fit, down to NESTED levels."""
    todo = [(at, end, 0)]
    while todo:
        at, end, depth = todo.pop()
        for tag, a, b in elements(data, at, end):
            if tag & 0x20:
                if depth >= NESTED:
                    raise Malformed("nested too deep")
                todo.append((a, b, depth + 1))
            elif tag in (2, 6) and a == b:
                raise Malformed("empty number or name")


def object_name(data: bytes, a: int, b: int) -> str:
    """An object identifier in dots."""
    numbers, value = [], 0
    for i in range(a, b):
        value = value << 7 | data[i] & 0x7F
        if not data[i] & 0x80:
            numbers.append(value)
            value = 0
    if not numbers or data[b - 1] & 0x80:
        raise Malformed("cut name")
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def private_key(data: bytes) -> str | None:
    """What kind of private key the bytes encode, null if none: PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA."""
    try:
        tag, a, b = element(data, 0, len(data))
        if tag != 0x30 or b != len(data):
            return None
        well_formed(data, a, b)
        fields = elements(data, a, b)
        tags = [t for t, _, _ in fields]
        if any(t == 2 and e - s > NUMBER for t, s, e in fields):
            return None
        number = int.from_bytes(data[fields[0][1]:fields[0][2]], "big") if tags[:1] == [2] else None
        if number in (0, 1) and tags[1:9] == [2] * 8 and tags[9:] in ([], [0x30]):
            n, e, d, p, q = (int.from_bytes(data[s:t], "big") for _, s, t in fields[1:6])
            return "pkcs1" if n == p * q and 1 < e < n and d > 1 else None
        if number == 0 and tags[1:] == [2] * 5:
            p, q, g = (int.from_bytes(data[s:t], "big") for _, s, t in fields[1:4])
            return "dsa" if q > 1 and (p - 1) % q == 0 and 1 < g < p else None
        if number == 1 and tags[1:2] == [4] and set(tags[2:]) <= {0xA0, 0xA1} and 16 <= fields[1][2] - fields[1][1] <= 66:
            return "sec1" if tags[2:] == sorted(set(tags[2:])) else None
        if number in (0, 1) and tags[1:3] == [0x30, 4] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            return f"pkcs8:{_algorithm(data, fields[1])}"
        if tags == [0x30, 4]:
            return f"encrypted:{_algorithm(data, fields[0])}"
    except (Malformed, IndexError):
        pass
    return None


def _algorithm(data: bytes, field: tuple[int, int, int]) -> str:
    names = elements(data, field[1], field[2])
    if not 1 <= len(names) <= 2 or names[0][0] != 6:
        raise Malformed("no algorithm")
    return object_name(data, *names[0][1:])


def openssh_key(data: bytes) -> str | None:
    """The cipher of an OpenSSH private key whose nested lengths fit exactly, null if it is none."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)

    def number() -> int:
        nonlocal at
        if len(data) - at < 4:
            raise Malformed("cut number")
        at += 4
        return int.from_bytes(data[at - 4:at], "big")

    def string() -> bytes:
        nonlocal at
        n = number()
        if n > len(data) - at:
            raise Malformed("length beyond the end")
        at += n
        return data[at - n:at]

    try:
        cipher, _, _, keys = string(), string(), string(), number()
        if not 1 <= keys <= len(data) or not re.fullmatch(rb"[a-z0-9@.-]{1,64}", cipher):
            return None
        for _ in range(keys):
            string()
        private = string()
        if at != len(data) or len(private) < 8 or cipher == b"none" and private[:4] != private[4:8]:
            return None
        return cipher.decode()
    except Malformed:
        return None


def unbase64(run: str) -> bytes | None:
    """Bytes of a base64 run, with either alphabet, with or without its padding."""
    body = run.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = unbase64(part)
    try:
        value = json.loads(data.decode()) if data else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token: its header names one, its payload is an object, its signature has the right size."""
    head = _object(header)
    algorithm = head.get("alg") if head else None
    if not isinstance(algorithm, str) or algorithm not in SIGNATURES or _object(payload) is None:
        return None
    mark = unbase64(signature)
    if mark is None:
        return None
    size = SIGNATURES[algorithm]
    return algorithm if (len(mark) == size if size else len(mark) >= SIGNATURE_LEAST) else None


def checked_token(body: str, check: str) -> bool:
    value = 0
    for c in check:
        value = value * 62 + DIGITS62.index(c)
    return zlib.crc32(body.encode()) == value


def _pem_blocks(text: str):
    """(label, start, body start, body end, end) of each begin line with the next end line of its label, if no other begins before."""
    begins = list(PEM_BEGIN.finditer(text))
    ends = list(PEM_END.finditer(text)) if begins else []
    at = [m.start() for m in ends]
    for k, m in enumerate(begins):
        i = bisect.bisect_left(at, m.end())
        if i < len(ends) and ends[i][1] == m[1] and (k + 1 == len(begins) or begins[k + 1].start() > at[i]):
            yield m[1], m.start(), m.end(), ends[i].start(), ends[i].end()


def _pem_key(label: str, body: str) -> str | None:
    if not label.endswith("PRIVATE KEY"):
        return None
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    # an old form has headers (encryption) before the body
    headers = [x for x in lines if ":" in x]
    packed = "".join(x for x in lines if ":" not in x)
    data = unbase64(packed) if re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", packed) else None
    if data is None:
        return None
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers):
        return "encrypted" if len(data) >= 16 and len(data) % 8 == 0 else None
    return private_key(data) or openssh_key(data)


def _decoded(data: bytes, wraps: int) -> tuple[str, str] | None:
    """Kind and detail of what a candidate's bytes hold."""
    if (key := private_key(data)) is not None:
        return "der", key
    if (cipher := openssh_key(data)) is not None:
        return "openssh", cipher
    if wraps > 0 and data.isascii():
        inner = confirmed(data.decode("ascii"), wraps - 1)
        if inner:
            return "wrapped", inner[0][0]
    return None


def longest_word(text: str) -> int:
    """Characters of the longest run without white space; no candidate of hex or base64 is longer."""
    return max(map(len, text.split()), default=0)


def confirmed(text: str, wraps: int = WRAPS) -> list[tuple[str, int, int, str]]:
    """Structurally confirmed secrets of a text: kind, start, end, detail. A part of a larger one is not reported again."""
    out = []
    for label, start, a, b, end in _pem_blocks(text):
        if (detail := _pem_key(label, text[a:b])) is not None:
            out.append(("pem", start, end, detail))
    for m in SIGNED.finditer(text) if "eyJ" in text else ():
        if (detail := signed_token(*m.groups())) is not None:
            out.append(("token", *m.span(), detail))
    for m in CHECKED.finditer(text) if "gh" in text and "_" in text else ():
        if checked_token(m[1], m[2]):
            out.append(("checked", *m.span(), m[0][:3]))
    taken = sorted((s, e) for _, s, e, _ in out)
    starts = [s for s, _ in taken]
    if longest_word(text) < BASE64_LEAST:  # a run of hex is longer still
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b) - 1
        return i < 0 or taken[i][1] <= a

    for pattern, decode in ((HEX_RUN, lambda r: bytes.fromhex(r) if len(r) % 2 == 0 else None), (BASE64_RUN, unbase64)):
        for m in pattern.finditer(text):
            if free(*m.span()) and (data := decode(m[0])) and (hit := _decoded(data, wraps)):
                out.append((hit[0], *m.span(), hit[1]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    lower, out = text.lower(), []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", *m.span(), "") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    out += [("access", *m.span(), "") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if longest_word(text) >= HEX_LEAST:
        out += [("hex", *m.span(), "") for m in HEX.finditer(text)]
    return out


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """All secrets of a text by start, then kind."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed(text), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` with secrets: array<struct<kind, start, end, detail>> of each whole text, by start, then kind.

    Kinds assign, access and hex go by pattern and length. Added ones: pem, der and openssh (private keys), token (signed
    token), checked (token with a checksum) and wrapped (base64 or hex that decodes to a text with one of these, WRAPS decodings
    deep); detail tells the format, algorithm or cipher. Offsets in code points, end exclusive. A null or empty text has none; rows
    that repeat each get theirs; columns that are not named in ``keep`` are not read, an empty table gives no rows. One
    narrow pass; time is linear in the text whatever its length.
    """
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("detail", T.StringType())])
    names = item.names

    def make():
        return lambda texts: {"secrets": [[dict(zip(names, x)) for x in scan(t)] for t in texts]}

    return map_texts(docs, keep, F.col(f"`{text}`"), [T.StructField("secrets", T.ArrayType(item))], make)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed (structurally confirmed ones)."""
    found = find_secrets(docs, {"doc_id": F.col("doc_id")})

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, sha256_hex(joined(base)).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
                        F.size(F.filter("secrets", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_confirmed"))
