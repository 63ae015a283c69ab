"""Writing the catalog as records or as one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.operators.catalog import total_aggregates


def write_records(entries: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON record per group and line; the form for any number of groups."""
    entries.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_document(entries: DataFrame, path: str, generated_at: str, mode: str = "error") -> None:
    """The catalog as one JSON document, as browsers load it: time stamp, totals, and
    entries by English name.

    The entries are sorted and written line by line between a head and a tail, so the
    writing task holds one entry at a time, whatever their number.
    """
    low = entries.agg(F.min(F.struct("name_en", "iso2"))).first()[0] or (None, None)
    totals = entries.agg(*total_aggregates())
    head = totals.select(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.struct(*totals.columns).alias("totals"))).alias("json"))
    head = head.select(F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"countries":[')).alias("value"))
    record = F.to_json(F.struct(*entries.columns))
    is_first = F.col("name_en").eqNullSafe(F.lit(low[0])) & F.col("iso2").eqNullSafe(F.lit(low[1]))
    body = entries.select("name_en", "iso2", F.concat(F.when(is_first, F.lit("")).otherwise(F.lit(",")), record).alias("value"))
    tail = entries.sparkSession.createDataFrame([("]}",)], "value string")
    nothing = F.lit(None).cast("string")
    parts = [
        head.select(F.lit(0).alias("part"), nothing.alias("name_en"), nothing.alias("iso2"), "value"),
        body.select(F.lit(1).alias("part"), "name_en", "iso2", "value"),
        tail.select(F.lit(2).alias("part"), nothing.alias("name_en"), nothing.alias("iso2"), "value"),
    ]
    ordered = parts[0].union(parts[1]).union(parts[2]).coalesce(1).sortWithinPartitions("part", "name_en", "iso2")
    ordered.select("value").write.mode(mode).option("maxRecordsPerFile", 0).text(path)
