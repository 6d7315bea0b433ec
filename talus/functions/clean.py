"""Typing and cleaning: amounts scaled once, tolerant parsing, sentinels to null, optional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXTS = ("", "null", "none", "nan", "nat")
TRUE_TEXTS = ("true", "1", "yes")
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")


def text_or_null(c: Column) -> Column:
    """The trimmed text, null for the texts that stand for null."""
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin(*NULL_TEXTS), None).otherwise(t)


def scaled(c: Column) -> Column:
    """An amount in 1e-8 units as a double; what isn't a number is null. Exact up to the last cast."""
    return (text_or_null(c).try_cast("decimal(28,8)") * F.lit("0.00000001").cast("decimal(9,8)")).cast("double")


def is_amount(name: str, explicit: tuple[str, ...] = ()) -> bool:
    return name in explicit or "amount" in name.lower() or "srate" in name.lower()


def scale_amounts(df: DataFrame, explicit: tuple[str, ...] = ()) -> DataFrame:
    """Scale the named columns and those whose name tells of an amount or a rate, once."""
    return df.select(*[scaled(F.col(f"`{c}`")).alias(c) if is_amount(c, explicit) else F.col(f"`{c}`") for c in df.columns])


def datetime_of(c: Column) -> Column:
    """A timestamp from any of the known forms, else null."""
    t = text_or_null(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATETIME_FORMATS], t.try_cast("timestamp"))


def date_of(c: Column) -> Column:
    return text_or_null(c).try_cast("date")


def truth(c: Column) -> Column:
    """true, 1 and yes are true, other texts false, null stays."""
    return F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXTS))


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: tolerant casts, typed nulls for what is missing."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.BooleanType):
            c = truth(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, T.TimestampType) and dict(df.dtypes)[f.name] == "string":
            c = datetime_of(F.col(f"`{f.name}`"))
        else:
            c = F.col(f"`{f.name}`").try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def ensure(df: DataFrame, columns: list[str], default: float = 0) -> DataFrame:
    """Add the columns that are missing, with the default."""
    missing = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit(default).alias(c) for c in missing])


def aliased(df: DataFrame, name: str, *candidates: str) -> Column:
    """The first of the candidate columns that df has, under one name; a null text if none."""
    found = next((c for c in candidates if c in df.columns), None)
    return (F.col(found) if found else F.lit(None).cast("string")).alias(name)


def kyc_level(level1: Column, level2: Column) -> Column:
    """2 if the second level is there, else 1 if the first is, else 0."""
    return F.when(level2.isNotNull(), 2).when(level1.isNotNull(), 1).otherwise(0)


def kyc_level_text(level1: Column, level2: Column) -> Column:
    """As kyc_level, on texts with null stand-ins, and level 2 needs level 1."""
    one, two = text_or_null(level1).isNotNull(), text_or_null(level2).isNotNull()
    return F.when(one & two, 2).when(one, 1).otherwise(0)


def account_age_days(created: Column, as_of: str = "2026-03-26") -> Column:
    """Whole days of 24 hours up to as_of (UTC), -1 for null."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))
    return F.coalesce(F.floor(seconds / 86400), F.lit(-1)).cast("long")


def over(x: Column, denominator: Column) -> Column:
    """x over the denominator, where 0 counts as 1."""
    return x / F.when(denominator == 0, 1).otherwise(denominator)


def ratio(x: Column, denominator: Column) -> Column:
    """x over the denominator, null for 0."""
    return F.try_divide(x, F.nullif(denominator, F.lit(0)))


def encode_values(df: DataFrame) -> DataFrame:
    """Every column as the text that a key-value store keeps: 0/1, eight decimals, ISO times, "0" for null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            c = F.when(c, "1").otherwise("0")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.format_string("%.8f", c.cast("double"))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        else:
            c = c.cast("string")
        out.append(F.when(F.col(f"`{name}`").isNull(), "0").otherwise(c).alias(name))
    return df.select(*out)
