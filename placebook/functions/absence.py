"""What counts as a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space in text, ASCII
# separators 1C-1F included.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _says_something(c: Column) -> Column:
    """Null for null. A first byte from ``!`` to ``~`` settles nearly every value
    with two byte comparisons; the rest (accents, scripts, blanks) is trimmed."""
    printable = (c >= "!") & (c < "\x7f")
    return printable | (F.ltrim(c, F.lit(WHITESPACE)) != "")


def has_text(c: Column | str) -> Column:
    """True unless the text is null, empty or white space. Never null."""
    return F.coalesce(_says_something(column(c)), F.lit(False))


def strip(c: Column | str) -> Column:
    return F.trim(column(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    """The value itself, untrimmed, or null when it is blank."""
    c = column(c)
    return F.when(_says_something(c), c)


def nan_to_null(c: Column | str) -> Column:
    c = column(c)
    return F.when(~F.isnan(c), c)


def opinion(field: T.StructField) -> Column:
    """A column's value where it says something, else null."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return blank_to_null(c)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return nan_to_null(c)
    return c


def present(df: DataFrame, name: str) -> Column:
    """True where a column of any type holds a value."""
    return F.coalesce(opinion(df.schema[name]).isNotNull(), F.lit(False))
