"""Personal data in text: patterns propose spans, checksums confirm them, nearby words adjust scores.

Everything is a DataFrame expression; no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.batches import sha256_hex

# Characters of an account number (IBAN) by country, as registered.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban_pattern() -> str:
    """Two letters, two check digits and as many characters as the country has, so that words that follow are not taken in."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    forms = "|".join(rf"(?:{'|'.join(cs)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{forms})(?![A-Za-z0-9])"


# The patterns. Possessive quantifiers and the test that an attempt starts where a run starts (or
# where the last match ended) keep long runs linear and match the same spans as the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
}
BASE = ("email", "ip", "card", "phone")
# Words that make a kind likelier when they stand shortly before a span.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|debit|master|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|appel|tel[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
# Score of a confirmed span, what a context word adds, and what an added span needs.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "shortcard": 0.3}  # in the order of the kinds
CONTEXT_BONUS, LEAST, CONTEXT_CHARS = 0.3, 0.5, 40
#: Elements that are gathered before they are set aside, and characters of a chunk of text: with them long texts cost linear time.
PART, CHUNK = 256, 2048


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the mod-97 check (remainder 1)."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    """The name under which a match counts, null if it fails its check."""
    if kind == "email":
        return F.lit("email")
    if kind == "ip":
        def small(part):
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)
        return F.when(F.forall(F.split(m, r"\."), small), "ip")
    if kind == "card":
        d = _digits(m)
        n = F.length(d)
        return F.when(n.between(13, 19), F.when(luhn(d), F.when(n >= 16, "card").otherwise("shortcard")))
    if kind == "phone":
        return F.when(F.length(_digits(m)).between(8, 15), "phone")
    return F.when(mod97(m), "iban")


def _run(items: Column, state: dict[str, Column], empty: str, step, finish) -> Column:
    """Walk ``items`` with a state and gather what ``step`` makes: (new state, array of new elements) of each item. Elements are
    gathered in parts of PART, so a step copies at most PART elements however many there are."""
    def one(acc, x):
        full = F.size(acc["last"]) >= PART
        values, new = step(acc, x)
        return F.struct(*[v.alias(k) for k, v in values.items()],
                        F.when(full, F.concat(acc["parts"], F.array(acc["last"]))).otherwise(acc["parts"]).alias("parts"),
                        F.concat(F.when(full, F.expr(empty)).otherwise(acc["last"]), new).alias("last"))

    none = F.expr(empty)
    start = F.struct(*[v.alias(k) for k, v in state.items()], F.slice(F.array(none), 1, 0).alias("parts"), none.alias("last"))
    return F.aggregate(items, start, one, lambda acc: finish(acc, F.flatten(F.concat(acc["parts"], F.array(acc["last"])))))


def _score(kind: Column, near: Column) -> Column:
    start = F.lit(0.0)
    for name, value in SCORE.items():
        start = F.when(kind == name, value).otherwise(start)
    return F.round(F.least(F.lit(1.0), start + F.when(near, CONTEXT_BONUS).otherwise(0.0)), 2)


def _placed(text: Column, matches: Column, kind: str) -> Column:
    """Confirmed spans of one kind: name, start and end in code points, score, in order. The pieces
    between the matches (split) and the matches alternate, so their lengths add up to the places; the
    last CONTEXT_CHARS characters before a match are carried along. No step goes back to the text."""
    between = F.split(text, PATTERNS[kind], -1)
    pieces = F.zip_with(matches, between, lambda m, gap: F.struct(
        m.alias("match"), gap.alias("gap"), _valid(kind, m).alias("kind"), F.length(m).alias("length")))
    empty = "cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)"

    def tail(*parts):
        return F.substring(F.concat(*parts), -CONTEXT_CHARS, CONTEXT_CHARS)

    def step(acc, x):
        end = acc["at"] + F.length(x["gap"]) + x["length"]
        near = F.lower(tail(acc["tail"], x["gap"])).rlike(rf"(?:^|[^\p{{L}}])(?:{CONTEXT[kind]})(?:$|[^\p{{L}}])")
        span = F.struct(x["kind"].alias("kind"), (end - x["length"]).alias("start"), end.alias("end"), _score(x["kind"], near).alias("score"))
        return ({"at": end, "tail": tail(acc["tail"], x["gap"], x["match"])},
                F.when(x["kind"].isNull(), F.expr(empty)).otherwise(F.array(span)))

    # the piece after the last match has no partner
    walk = _run(F.filter(pieces, lambda x: x["match"].isNotNull()), {"at": F.lit(0), "tail": F.lit("")}, empty, step, lambda acc, found: found)
    return F.when(F.size(matches) > 0, walk).otherwise(F.expr(empty))


def _of_kind(spans: Column, kind: str, least: float = 0.0) -> Column:
    return F.filter(spans, lambda s: (s["kind"] == kind) & (s["score"] >= least))


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: array<struct<kind, start, end, score>>.

    Kinds email, ip, card and phone are those that pass their check; iban (mod-97) and
    shortcard (13 to 15 digits, Luhn) are added when their score with context words reaches LEAST. Ordered by kind as
    listed, then start; offsets in code points, end exclusive. A null or empty text has an empty array; other columns
    are passed through, rows that repeat each get their spans, an empty table gives no rows. One narrow pass: each pattern runs once over a text, twice if it matches, and the work is
    linear in the text whatever the number of spans.
    """
    names, found = {k: _free(docs, f"__{k}") for k in PATTERNS}, _free(docs, "__found")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    proposed = docs.withColumns({n: F.regexp_extract_all(whole, F.lit(PATTERNS[k]), 0) for k, n in names.items()})
    # columns of their own, used more than once: Spark does not copy them into the functions that walk the arrays
    placed = proposed.withColumn(found, F.concat(*[_placed(whole, F.col(n), k) for k, n in names.items()]))
    ordered = F.concat(*[_of_kind(F.col(found), k, 0.0 if k in BASE else LEAST) for k in SCORE])
    return placed.withColumn(out, ordered).drop(found, *names.values())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, all spans."""
    found = find_pii(docs.select("doc_id", "text"), out="pii").drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(_of_kind(F.col("pii"), k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, sha256_hex(_joined(base)).alias("base_sha256"), _joined(F.col("pii")).alias("spans"),
                        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


def masked(chunks: Column, spans: Column) -> Column:
    """A text, given in chunks of CHUNK characters, with each span (overlapping ones together) replaced by its kind in brackets."""
    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def piece(start, end):
        first = F.floor(start / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)

    def step(acc, s):
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        new = F.when(s["start"] >= acc["at"], F.array(piece(acc["at"], s["start"]), label)).otherwise(F.expr(empty))
        return {"at": F.greatest(acc["at"], s["end"])}, new

    empty = "cast(array() as array<string>)"
    return _run(by_place, {"at": F.lit(0)}, empty, step,
                lambda acc, parts: F.concat(F.array_join(parts, ""), piece(acc["at"], F.size(chunks) * CHUNK)))


def mask_pii(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked; n_chars, if there, follows the new text. Null texts stay null."""
    spans, chunks = _free(docs, "__pii"), _free(docs, "__chunks")
    hit = F.size(spans) > 0
    out = find_pii(docs, out=spans)
    out = out.withColumn(chunks, F.when(hit, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    out = out.withColumn("text", F.when(hit, masked(F.col(chunks), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
