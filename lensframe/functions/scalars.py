"""Scalar functions shared by operators, as Column expressions (no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An epoch-millisecond number is a time strictly between these.
WHEN_AFTER, WHEN_BEFORE = 946_684_800_000, 4_102_444_800_000
#: The texts that are booleans, and the forms of an integer and of a finite number.
TRUE_TEXTS, FALSE_TEXTS = ("true", "True", "TRUE"), ("false", "False", "FALSE")
INTEGER_FORM = r"^[+-]?\d+$"
NUMBER_FORM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_when(c: Column, kind: T.DataType) -> Column:
    """The time a cell stands for: an epoch-millisecond number, or a text that begins with an ISO date; else null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.when((c > WHEN_AFTER) & (c < WHEN_BEFORE), F.timestamp_millis(c.cast("bigint")))
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))))
    return F.lit(None).cast("timestamp")


def canon(c: Column) -> Column:
    """Lower case, letters and digits only: names that differ in spelling alone meet."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canon_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def slug_name(name: str) -> str:
    """A name as a slug; a leading "the lens:" is dropped."""
    bare = re.sub(r"^\s*(the\s+)?lens:\s*", "", name, flags=re.I)
    return re.sub(r"^-+|-+$", "", re.sub("[^a-z0-9]+", "-", bare.lower()))


def normalize_well(c: Column) -> Column:
    """A well's name for matching: upper case, no leading country code, no blanks around slashes, single blanks."""
    up = F.regexp_replace(F.upper(c), r"^NO\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(up, r"\s*/\s*", "/"), r"\s+", " "))


def in_interval(v: Column, lo: Column, hi: Column) -> Column:
    """Whether a finite number lies in a closed interval; anything that is no number is outside."""
    n = v.try_cast("double")
    finite = ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    return F.coalesce(finite & (n >= lo.try_cast("double")) & (n <= hi.try_cast("double")), F.lit(False))


def half_up(c: Column) -> Column:
    """Rounding with halves going up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def fmt_int(c: Column) -> Column:
    """A number without decimals, with separators of thousands."""
    return F.format_number(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), 0)


def fmt_num(c: Column) -> Column:
    """Whole numbers and those of 1000 or more without decimals, others with four significant digits."""
    d = c.cast("double")
    whole = (F.abs(d) >= 1000) | (d == F.floor(d))
    scale = F.pow(F.lit(10.0), F.lit(3) - F.floor(F.log10(F.abs(d))))
    return F.when(whole, F.format_number(half_up(d), 0)).otherwise(F.regexp_replace((F.round(d * scale) / scale).cast("string"), r"\.0$", ""))


def fmt_date(c: Column) -> Column:
    """Epoch milliseconds as a UTC date; nothing for null and 0."""
    return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(F.date_format(F.timestamp_millis(c.cast("bigint")), "yyyy-MM-dd"))


def snippet(c: Column, n: int) -> Column:
    """The first ``n`` characters with white space collapsed, and an ellipsis where more follows."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def digit_mask(c: Column, longest: int = 6) -> Column:
    """Runs of digits as as many ``#``, ``longest`` at most."""
    out = F.regexp_replace(c, rf"\d{{{longest},}}", "#" * longest)
    for n in range(longest - 1, 0, -1):
        out = F.regexp_replace(out, rf"(?<![\d#])\d{{{n}}}(?!\d)", "#" * n)
    return out


def code_mask(c: Column, longest: int = 6) -> Column:
    """``digit_mask``, and runs of two or more capitals as as many ``A``."""
    upper = c
    upper = F.regexp_replace(upper, rf"[A-Z]{{{longest},}}", "\u0001" * longest)
    for n in range(longest - 1, 1, -1):
        upper = F.regexp_replace(upper, rf"(?<![A-Z\u0001])[A-Z]{{{n}}}(?![A-Z])", "\u0001" * n)
    return F.regexp_replace(digit_mask(upper, longest), "\u0001", "A")


def content_hash(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts, each preceded by its length."""
    framed = F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))
    return F.left(F.sha2(framed, 256), F.lit(16))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A hash of a row's content over its columns in the order of their names."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"}), 256)


def string_hash(c: Column) -> Column:
    """A small stable number of a text: the polynomial of 31 over its characters in 32 bits, modulo 100000, from 900000 on."""
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    folded = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), lambda a, ch: wrap(a * 31 + F.ascii(ch)))
    return F.lit(900_000) + F.abs(folded) % 100_000


#: The entities of markup that have names; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    """Text with its named entities decoded."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def is_empty(c: Column, kind: T.DataType) -> Column:
    """Null, or an empty text."""
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def text_of(c: Column) -> Column:
    return c.cast("string")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns cast to what all their cells are: bigint, double or boolean; empty cells are null, all else stays text.

    One aggregation over the table decides for all columns. Only finite numbers and the six boolean spellings count.
    """
    names = [c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not names:
        return df
    checks = []
    for n in names:
        v = F.trim(F.col(f"`{n}`"))
        filled = v.isNotNull() & (v != "")
        integer = v.rlike(INTEGER_FORM) & v.try_cast("bigint").isNotNull()
        number = v.rlike(NUMBER_FORM) & v.try_cast("double").isNotNull() & (F.abs(v.try_cast("double")) < F.lit(float("inf")))
        checks += [F.count_if(filled).alias(f"{n}\u0001n"), F.count_if(filled & integer).alias(f"{n}\u0001i"), F.count_if(filled & number).alias(f"{n}\u0001d"), F.count_if(filled & v.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias(f"{n}\u0001b")]
    seen = df.agg(*checks).first().asDict()
    out = {}
    for n in names:
        c = F.col(f"`{n}`")
        v = F.trim(c)
        total, i, d, b = (seen[f"{n}\u0001{k}"] for k in "nidb")
        if total and i == total:
            out[n] = F.when(v != "", v.try_cast("bigint"))
        elif total and d == total:
            out[n] = F.when(v != "", v.try_cast("double"))
        elif total and b == total:
            out[n] = F.when(v != "", v.isin(*TRUE_TEXTS))
        else:
            out[n] = F.when(v != "", c)
    return df.withColumns(out)
