"""Null-safe coercions used by the cleaning step (all JVM-side expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text layouts tried in order after the ISO forms; parts in brackets may be absent.
_TIME = "[ H:mm[:ss[.SSSSSS][.SSS]]]"
DATE_FORMATS = [
    "yyyy-M-d" + _TIME, "yyyy/M/d" + _TIME,
    "M/d/yyyy" + _TIME, "M/d/yyyy h:mm[:ss] a", "M-d-yyyy" + _TIME, "M/d/yy" + _TIME, "M/d/yy h:mm[:ss] a",
    "d.M.yyyy" + _TIME, "d-MMM-yyyy" + _TIME, "d MMM yyyy" + _TIME, "d MMMM yyyy" + _TIME,
    "MMM d, yyyy" + _TIME, "MMM d, yyyy h:mm[:ss] a", "MMMM d, yyyy" + _TIME, "MMM d yyyy" + _TIME,
    "MMM d yyyy h:mm[:ss] a", "d-MMM-yy" + _TIME, "yyyyMMdd[ HHmmss][ HH:mm[:ss]]", "yyyyMMdd'T'HHmmss",
    "yyyyMMddHHmmss",
]
# Separators between two numbers of which either may be the month: a column is read one way, never both.
AMBIGUOUS = ("/", "-")

# Fixed value: a plain decimal number. Casting alone would also take "1d", "2f", "NaN" and "Infinity".
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def nan_to_null(df: DataFrame, name: str) -> Column:
    """The column, with a floating-point NaN read as missing."""
    c = F.col(name)
    if isinstance(_dtype(df, name), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def customer_id_text(df: DataFrame, name: str = "CustomerID") -> Column:
    """Customer id as text with every literal ``.0`` removed.

    Integral doubles go through bigint first so 12345678.0 does not become
    ``1.2345678E7``.
    """
    dt = _dtype(df, name)
    c = nan_to_null(df, name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    elif not isinstance(dt, T.StringType):
        c = c.cast("string")
    return F.replace(c, F.lit(".0"), F.lit(""))


def invoice_text(df: DataFrame, name: str = "InvoiceNo") -> Column:
    """Invoice number as text; a missing one becomes the literal ``nan``."""
    return F.coalesce(nan_to_null(df, name).cast("string"), F.lit("nan"))


def date_layouts(df: DataFrame, name: str = "InvoiceDate") -> list[str]:
    """``DATE_FORMATS`` in the day and month order that the column's values agree with.

    One aggregate over the column counts, for each separator, the values that
    can't be month first (first number above 12) and those that can't be day
    first (second number above 12). The order that fits more values holds for
    the whole column; month first where both fit alike. Two counters a
    separator come back, whatever the column's size.
    """
    text = F.trim(F.col(name).cast("string"))
    tests, over = [], "(1[3-9]|[2-9][0-9])"  # two digits above 12
    for i, sep in enumerate(AMBIGUOUS):
        tests += [F.count_if(text.rlike(f"^{over}{sep}[0-9]{{1,2}}{sep}")).alias(f"m{i}"),
                  F.count_if(text.rlike(f"^[0-9]{{1,2}}{sep}{over}{sep}")).alias(f"d{i}")]
    votes = df.agg(*tests).first()
    layouts = list(DATE_FORMATS)
    for i, sep in enumerate(AMBIGUOUS):
        if votes[f"d{i}"] < votes[f"m{i}"]:
            layouts = [f.replace(f"M{sep}d{sep}y", f"d{sep}M{sep}y") for f in layouts]
    return layouts


def layout_shape(layout: str) -> str:
    """A pattern that every text of a date layout matches; a failed parse costs far more than a failed match."""
    out = []
    for quoted, field, other in re.findall(r"'([^']*)'|([A-Za-z]+)|(.)", layout):
        if field:
            kinds = re.findall(r"(?:MMM+|a)|yyyy|yy|([A-Za-z])\1*", field)
            if len(kinds) > 1:  # fields without a separator: digits throughout
                out.append("[0-9+-]+")
            elif field == "a" or field.startswith("MMM"):
                out.append("[^0-9]+")
            else:
                out.append({"yyyy": "[+-]?[0-9]{4,}", "yy": "[0-9]{2}"}.get(field, "[+-]?[0-9]+"))
        else:
            out.append({"[": "(?:", "]": ")?"}.get(other) or re.escape(quoted or other))
    return f"(?i)^{''.join(out)}$"


def timestamp_ntz(df: DataFrame, name: str = "InvoiceDate", formats: list[str] | None = None) -> Column:
    """Timestamp without zone; unparseable text becomes null (row kept).

    ISO forms (fraction, ``T``, zone suffix) are cast; other texts run through
    ``formats``, by default ``date_layouts`` of the column (``DATE_FORMATS``
    for a stream, which can't be counted beforehand). A value that doesn't fit
    its column's order of day and month is null, not read the other way. Only
    layouts of the text's shape are tried.
    """
    dt = _dtype(df, name)
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike("^[0-9]{4}-"), text.try_cast("timestamp_ntz"))
    layouts = formats or (DATE_FORMATS if df.isStreaming else date_layouts(df, name))
    return F.coalesce(iso, *[F.when(text.rlike(layout_shape(f)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz"))
                             for f in layouts])


def number(df: DataFrame, name: str) -> Column:
    """Double value; text that isn't a plain number, and NaN, become null."""
    dt = _dtype(df, name)
    c = nan_to_null(df, name)
    if isinstance(dt, T.NumericType):
        return c.cast("double")
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))
