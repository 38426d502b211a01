"""Column functions on names, labels and URLs. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tagloom.functions import fixed

# The blanks that name cleaning and line reading treat as white space.
UNICODE_BLANKS = r"\t\n\x0B\f\r\x1c-\x1f \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def literal_lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small literal table, NULL when the key is missing."""
    if not table:
        return F.lit(None).cast("string")
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*entries), key)


def capitalise(part: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(part, 1, 1)), F.lower(part.substr(F.lit(2), F.length(part))))


def display_name(slug: Column, special: Mapping[str, str] = fixed.DISPLAY_SPECIAL) -> Column:
    """Exact special cases first, otherwise every ``-`` part capitalised."""
    general = F.array_join(F.transform(F.split(slug, "-"), capitalise), "-")
    return F.coalesce(literal_lookup(slug, special), general)


def api_slug(name: Column, overrides: Mapping[str, str] = fixed.SLUG_OVERRIDES) -> Column:
    """Lower case; overrides; else drop ``.`` and ``'``, blanks become ``-``."""
    key = F.lower(name)
    general = F.regexp_replace(F.regexp_replace(key, "[.']", ""), r"[ \t\r\n\f\x0B ]+", "-")
    return F.coalesce(literal_lookup(key, overrides), general)


def canonical_label(label: Column, aliases: Mapping[str, str] = fixed.LABEL_ALIASES) -> Column:
    return F.coalesce(literal_lookup(label, aliases), label)


def first_nonempty(*cols: Column, default: str = "") -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(default))


def url_authority(url: Column) -> Column:
    """Lower-cased host part with user info and port; the scheme may be missing."""
    clean = F.translate(url, "\t\r\n", "")
    return F.lower(F.regexp_extract(clean, r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def is_blocked(url: Column, terms: Sequence[str] = fixed.BLOCKED_HOST_TERMS) -> Column:
    """True for NULL or empty URLs and for those with a blocked authority. An authority with
    only one of the two brackets cannot be parsed and blocks nothing."""
    pattern = "|".join(re.escape(t) for t in terms)
    host = url_authority(url)
    return url.isNull() | (url == "") | (host.rlike(pattern) & (host.contains("[") == host.contains("]")))


def url_extension(
    url: Column,
    allowed: Sequence[str] = fixed.IMAGE_EXTENSIONS,
    default: str = fixed.DEFAULT_EXTENSION,
) -> Column:
    """Lower-case extension of the part before ``?``; ``default`` if not allowed."""
    path = F.split(url, r"\?", 2)[0]
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*([.][^/.]*)$", 1))
    return F.when(ext.isin(*allowed), ext).otherwise(F.lit(default))


def provenance(file_name: Column) -> Column:
    out = None
    for prefix, kind in fixed.PROVENANCE_PREFIXES.items():
        test = file_name.startswith(prefix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("crawler")


def item_file_name(kind: str, key: Column, extension: Column | None = None) -> Column:
    """``seed_07.png`` / ``ddg_00007.jpg`` / ``card_<id>.png``."""
    if kind == "seed":
        return F.format_string("seed_%02d.png", key)
    if kind == "ddg":
        return F.concat(F.format_string("ddg_%05d", key), extension if extension is not None else F.lit(fixed.DEFAULT_EXTENSION))
    if kind == "card":
        return F.concat(F.lit("card_"), key.cast("string"), F.lit(".png"))
    raise ValueError(f"unknown kind of item: {kind}")


def url_key(url: Column) -> Column:
    """Stable item key: survives a change of the order in which URLs are listed."""
    return F.md5(url)


def text_fingerprint(text: Column) -> Column:
    """md5 of the lower-cased text with runs of blanks made one blank. Drop NULL
    texts first: the result is never NULL, so that a later test for NULL does not
    make Spark compute it a second time."""
    return F.md5(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+", " "))))
