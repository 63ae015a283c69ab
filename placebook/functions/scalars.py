"""Small scalar rules: percentages, labels, bins, number text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placebook.functions.absence import column, strip

# Lower bounds of the map scale and the label of each bin.
BIN_STARTS = [1_000, 10_000, 100_000, 500_000]
BIN_LABELS = ["<1K", "1K–10K", "10K–100K", "100K–500K", "500K+"]

# Fixed value: label of level 1 where subdivision codes exist.
SUBDIVISION_LABEL = "Subdivision (ISO 3166-2)"


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal, ties to even; 0.0 of nothing."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 1)).otherwise(F.lit(0.0))


def level_label(level: int, has_codes: Column) -> Column:
    plain = F.lit(f"Level {level}")
    return F.when(has_codes, F.lit(SUBDIVISION_LABEL)).otherwise(plain) if level == 1 else plain


def bin_of(rows: Column | str) -> Column:
    """Index 0..4 on the map scale; lower bounds belong to the upper bin."""
    rows = column(rows)
    return reduce(lambda a, b: a + b, [(rows >= t).cast("int") for t in BIN_STARTS])


def bin_label(rows: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, BIN_LABELS)), bin_of(rows) + 1)


def whole_number(c: Column | str) -> Column:
    """Text to a whole number; blank or unreadable text is 0."""
    return F.coalesce(strip(c).try_cast("bigint"), F.lit(0))


def day(ts: Column | str) -> Column:
    return F.date_format(column(ts), "yyyy-MM-dd")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(column(path), "/"), -1)


def number_text(c: Column | str) -> Column:
    """A double as the shortest text that reads back the same.

    Plain digits between 1e-4 and 1e16, exponent form outside, as in CSV files
    written by the usual data-frame tools.
    """
    c = column(c)
    raw = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    digits = F.format_string("%02d", F.abs(power))
    return (
        F.when((size < 1e7) & (size >= 1e-3) | (size == 0) | F.isnan(c), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )
