"""Schema-level helpers on whole DataFrames; none of them runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def flatten_struct(df: DataFrame, name: str) -> DataFrame:
    """Replace a struct column by its fields."""
    rest = [c for c in df.columns if c != name]
    return df.select(f"{name}.*", *rest)


def pack(df: DataFrame, name: str = "value") -> DataFrame:
    """All columns as one struct."""
    return df.select(F.struct(*df.columns).alias(name))


def key_first(df: DataFrame, key: str) -> DataFrame:
    return df.select(f"`{key}`", *[f"`{c}`" for c in df.columns if c != key])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def cast_columns(df: DataFrame, spec: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast the named columns; text that is no number raises when strict, else is NULL."""
    return df.withColumns(
        {c: F.col(f"`{c}`").cast(t) if strict else F.col(f"`{c}`").try_cast(t) for c, t in spec.items()}
    )


def cast_by_type(df: DataFrame, spec: dict[str, str], keep=()) -> DataFrame:
    """Cast every column of the given types, except those in ``keep`` (ids)."""
    casts = {
        f.name: spec[f.dataType.simpleString()]
        for f in df.schema
        if f.dataType.simpleString() in spec and f.name not in keep
    }
    return cast_columns(df, casts)


def split_by_type(df: DataFrame, categorical=(), exclude=()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) column names by type; ``categorical`` declares more of the first."""
    cat, num = [], []
    for f in df.schema:
        if f.name in exclude:
            continue
        if f.name in categorical or not isinstance(f.dataType, T.NumericType):
            cat.append(f.name)
        else:
            num.append(f.name)
    return cat, num


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{f.name}`" for f in df.schema if isinstance(f.dataType, T.NumericType)])


def preview(df: DataFrame, n: int = 5, order=()) -> DataFrame:
    """First ``n`` rows; give an order to make them the same on every run."""
    return (df.orderBy(*order) if order else df).limit(n)
