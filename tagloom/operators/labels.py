"""Class tables, label clean-up, lookups, quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.functions.text import canonical_label, is_blocked, provenance
from tagloom.operators.sizing import lookup_join


def scope_classes(
    classes: DataFrame, id_col: str, name_col: str,
    min_id: int = 1, max_id: int | None = None, only: Sequence[str] | None = None,
) -> DataFrame:
    """Ids in [min_id, max_id] and, if given, names from ``only`` (any case).

    Without ``max_id`` the size of the class table is the upper bound. An empty
    ``only`` means no name filter."""
    upper = F.lit(max_id) if max_id is not None else classes.agg(F.count(F.lit(1))).scalar()
    out = classes.filter((F.col(id_col) >= min_id) & (F.col(id_col) <= upper))
    if only:
        out = out.filter(F.lower(F.col(name_col)).isin(*sorted({o.lower() for o in only})))
    return out


def canonicalise(df: DataFrame, col: str, aliases: Mapping[str, str] | DataFrame = fixed.LABEL_ALIASES) -> DataFrame:
    """Replace aliased labels; rows are not merged. ``aliases`` is a literal table
    or a DataFrame (alias, canonical); of a repeated alias the largest name counts."""
    if isinstance(aliases, DataFrame):
        table = aliases.groupBy(F.col("alias").alias(col)).agg(F.max("canonical").alias("__canonical"))
        return lookup_join(df, table, [col], how="left").withColumn(
            col, F.coalesce("__canonical", col)).drop("__canonical")
    return df.withColumn(col, canonical_label(F.col(col), aliases))


def lookup_default(df: DataFrame, table: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    """Left lookup of ``value``; ``default`` where the key is missing. Of a repeated key the
    largest value counts, so that no row of ``df`` is multiplied."""
    return lookup_join(df, table.groupBy(*on).agg(F.max(value).alias(value)), on, how="left").withColumn(
        value, F.coalesce(F.col(value), default))


def purge(df: DataFrame, file_name: str, keep: Sequence[str] = ("seed", "card")) -> DataFrame:
    """Keep rows of the named provenances only."""
    return df.filter(provenance(F.col(file_name)).isin(*keep))


def drop_blocked(df: DataFrame, url_col: str, terms: Sequence[str] = fixed.BLOCKED_HOST_TERMS) -> DataFrame:
    return df.filter(~is_blocked(F.col(url_col), terms))


def expand_templates(
    classes: DataFrame, name_col: str,
    templates: Sequence[str] = fixed.SEARCH_TEMPLATES, engines: Sequence[str] = fixed.SEARCH_ENGINES,
) -> DataFrame:
    """One row per class, engine and template; a projection over literal lists."""
    combos = F.array(*[
        F.struct(F.lit(e).alias("engine"), F.lit(i).alias("slot"), F.format_string(t, F.col(name_col)).alias("query"))
        for e in engines for i, t in enumerate(templates)
    ])
    return classes.select("*", F.inline(combos))


def plan_quota(
    df: DataFrame, group: str, file_name: str,
    per_class: int = fixed.PER_CLASS_TARGET,
    n_engines: int = len(fixed.SEARCH_ENGINES), n_templates: int = len(fixed.SEARCH_TEMPLATES),
    classes: DataFrame | None = None,
) -> DataFrame:
    """Rows to ask for per query, for classes below ``per_class``.

    Everything but seeds counts as existing, cards too. ``classes`` (with the column ``group``) lists all
    classes; those without any item have 0 and get the largest quota."""
    have = df.groupBy(group).agg(F.count_if(~F.col(file_name).startswith("seed_")).alias("existing"))
    if classes is not None:
        have = classes.select(group).distinct().join(have, group, "left").fillna(0, ["existing"])
    remaining = F.lit(per_class) - F.col("existing")
    per_query = F.greatest(F.lit(1), F.floor(remaining / F.lit(n_engines * n_templates)) + 1)
    return have.filter(F.col("existing") < per_class).withColumn("per_query", per_query.cast("bigint"))


def union_sources(*tables: DataFrame) -> DataFrame:
    """One table from several sources; columns missing in one come out as NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def vocab_diff(a: DataFrame, b: DataFrame, name: str = "class_name", aliases=fixed.LABEL_ALIASES) -> DataFrame:
    """Names only in ``a`` / only in ``b`` after mapping the aliases of ``b``."""
    left, right = a.select(name).distinct(), canonicalise(b.select(name), name, aliases).distinct()
    return (
        left.exceptAll(right).withColumn("side", F.lit("a"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))
    )
