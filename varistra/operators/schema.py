"""Projections over column families, schema alignment, set operations and data-quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family(column: str, prefixes: tuple[str, ...]) -> tuple[str, str] | None:
    """(prefix, head) by the longest prefix that fits."""
    for p in sorted(prefixes, key=len, reverse=True):
        if column.startswith(p):
            return p, column[len(p):]
    return None


def filter_heads(df: DataFrame, prefixes: tuple[str, ...], allowed: set[str]) -> DataFrame:
    """Without family columns whose head isn't allowed; one select."""
    return df.select(*[c for c in df.columns if (f := family(c, prefixes)) is None or f[1] in allowed])


def rewrite_prefixes(df: DataFrame, new: dict[str, str], clash: str) -> DataFrame:
    """New prefixes for old ones, longest old first; a column that has a new name already gets ``clash`` before it."""
    renames = {c: new[f[0]] + f[1] for c in df.columns if (f := family(c, tuple(new)))}
    targets = set(renames.values())
    renames |= {c: clash + c for c in df.columns if c in targets and c not in renames}
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in df.columns])


def align(df: DataFrame, schema: dict[str, str], fills: dict[str, object] | None = None) -> DataFrame:
    """Exactly the columns of schema, in order; missing ones typed null or their fill."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit((fills or {}).get(c))).cast(t).alias(c) for c, t in schema.items()])


def order_columns(df: DataFrame, catalog: list[str]) -> DataFrame:
    """The catalog's columns in its order, then others by name."""
    first = [c for c in catalog if c in df.columns]
    return df.select(*first, *sorted(set(df.columns) - set(first)))


def feature_groups(columns: list[str], prefixes: tuple[str, ...]) -> dict[str, list[str]]:
    """Column names by family."""
    out: dict[str, list[str]] = {}
    for c in columns:
        f = family(c, prefixes)
        out.setdefault(f[0] if f else "", []).append(c)
    return out


# Heads that are positions or counts, no properties to predict.
METADATA_HEADS = ("residue_number", "exon_number", "n_transcripts_with_exon", "ppi_partner_count", "fstack_state")


def without_metadata(df: DataFrame, head: str = "head") -> DataFrame:
    """P20: rows of long form, or of a catalog of heads, whose head is no metadata; a null head stays."""
    return df.filter(~F.coalesce(F.col(head).isin(*METADATA_HEADS), F.lit(False)))


def column_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, nans, std): one pass over all columns."""
    value = lambda c: F.col(c).cast("double")
    valid = lambda c: F.when(F.isnan(value(c)), F.lit(None)).otherwise(value(c))
    aggs = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.isnan(value(c))).alias("nans"), F.stddev_pop(valid(c)).alias("std")) for c in columns]
    return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def require_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Df, or an error if one of the columns has nulls or NaNs."""
    bad = [r for r in column_health(df, columns).collect() if r.nulls or r.nans]  # a row for each column
    if bad:
        raise ValueError("nulls or NaNs in " + ", ".join(f"{r.column} ({r.nulls}, {r.nans})" for r in bad))
    return df


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Df, or an error if key has repeats."""
    n, distinct = df.agg(F.count(key), F.countDistinct(key)).first()
    if n != distinct:
        raise ValueError(f"{key}: {n} values, {distinct} distinct")
    return df


def drop_degenerate(df: DataFrame, columns: list[str], coverage: float = 0.01, std: float = 1e-6) -> DataFrame:
    """Without columns that have no values, or few values that hardly differ."""
    out = []
    for r in column_health(df, columns).collect():
        share = (r.n - r.nulls - r.nans) / r.n if r.n else 0.0
        if share == 0 or share < coverage or (r.std or 0.0) < std:
            out.append(r.column)
    return df.drop(*out)


def union_relaxed(frames: list[DataFrame], types: dict[str, str]) -> DataFrame:
    """By name, missing columns null, the named columns cast first."""
    cast = [f.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def non_blank(c: Column, also: tuple[str, ...] = ()) -> Column:
    """Neither null nor blank nor one of ``also``."""
    return c.isNotNull() & (F.trim(c) != "") & (~F.trim(c).isin(*also) if also else F.lit(True))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "head", value: str = "value") -> DataFrame:
    """Long form; every value as double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)
