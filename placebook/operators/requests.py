"""Deciding what a request for files gets, and describing the bundle it becomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.functions.scalars import base_name
from placebook.operators.ranking import first_occurrences
from placebook.schema import ALL_ROWS, BUNDLE_MAX, FORMATS, SHEET_ROW_LIMIT, VIEWS

OK, GONE, CONFLICT, INVALID = 200, 404, 409, 422


def selected_codes(requested: DataFrame, code: str = "iso2", position: str = "position") -> DataFrame:
    """Requested codes in upper case, each once, where it first came up."""
    return first_occurrences(requested, F.upper(code), position, code)


def selection(entries: DataFrame, requested: DataFrame, with_sample: bool = False) -> DataFrame:
    """Catalog entries picked from the listing, with their position; optionally sendable
    ones only. A code the listing does not have cannot be picked; :func:`bundles` decides
    what asking for one does."""
    chosen = entries.join(selected_codes(requested), "iso2")
    return chosen.where(F.col("sample_csv").isNotNull()) if with_sample else chosen


def effective_rows(view: Column) -> Column:
    """Rows actually served: the source file's, the view's, or the table's."""
    of_view = F.coalesce(F.element_at("view_stats", view)["rows"], F.col("rows"))
    return (
        F.when(F.coalesce("files_are_source", F.lit(False)), F.col("source_rows"))
        .when(view != ALL_ROWS, of_view)
        .otherwise(F.col("rows"))
    )


def raw_files(entries: DataFrame) -> DataFrame:
    """(iso2, fmt, name, bytes) of groups that serve their source files as they are."""
    raw = entries.where("files_are_source")
    return raw.select("iso2", F.explode("files").alias("fmt", "file")).select(
        "iso2", "fmt", "file.name", "file.bytes"
    )


def served_name(view: Column) -> Column:
    middle = F.when(view != ALL_ROWS, F.concat(view, F.lit("."))).otherwise(F.lit(""))
    return F.concat("iso2", F.lit("."), middle, "fmt")


def served_views(files: DataFrame, fmt: str = "parquet") -> DataFrame:
    """(iso2, view, fmt, bytes) of materialized views, from their listing."""
    return files.select(F.col("group").alias("iso2"), "view", F.lit(fmt).alias("fmt"), "bytes")


def served_sources(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(iso2, view, fmt, bytes) of source files that are really there, by the names that
    the catalog gives them."""
    wanted = raw_files(entries).select("iso2", "fmt", "name")
    there = sources.select("name", "bytes")
    return wanted.join(there, "name").select("iso2", F.lit(ALL_ROWS).alias("view"), "fmt", "bytes")


def decisions(
    requests: DataFrame,
    entries: DataFrame,
    served: DataFrame | None = None,
    sheet_limit: int = SHEET_ROW_LIMIT,
) -> DataFrame:
    """Each request with a status code, a reason, and the file it is answered with.

    ``served (iso2, view, fmt, bytes)``, if given, lists the files that are there, those of
    source files under the view of all rows; sizes come from it and a file that it lacks
    cannot be had. The checks are tried in order and the first that fails names the reason.
    """
    known = entries.select(
        "iso2", "files_are_source", "files", "rows", "view_stats", "source_rows", "last_updated", "source_file",
        F.lit(True).alias("_known"),
    )
    r = requests.withColumn("iso2", F.upper("iso2")).join(known, "iso2", "left")
    raw = F.coalesce("files_are_source", F.lit(False))
    view, fmt = F.col("view"), F.col("fmt")
    raw_name = F.element_at("files", fmt)["name"]
    missing, size = F.lit(False), F.element_at("files", fmt)["bytes"]
    if served is not None:
        there = served.select(*(F.col(c).alias(f"_{c}") for c in ("iso2", "view", "fmt", "bytes")))
        of_view = F.when(raw, F.lit(ALL_ROWS)).otherwise(view)
        r = r.join(there, (F.col("iso2") == F.col("_iso2")) & (of_view == F.col("_view")) & (fmt == F.col("_fmt")), "left")
        missing, size = F.col("_iso2").isNull(), F.col("_bytes")
    offered = F.coalesce(F.element_at("view_stats", view).isNotNull(), F.lit(False))
    others = F.array_join(F.array_sort(F.map_keys("files")), " or ")
    hint = F.when(F.size("files") > 0, F.concat(F.lit(", try "), others)).otherwise(F.lit(""))
    too_long = (fmt == "xlsx") & (effective_rows(view) > sheet_limit)
    absent = F.element_at("files", fmt).isNull()
    rules = [
        (~fmt.isin(FORMATS) | ~view.isin(VIEWS), INVALID, F.lit("unknown format or view")),
        (F.col("_known").isNull(), GONE, F.lit("unknown group")),
        (raw & absent, CONFLICT, F.concat(F.lit("not available as "), fmt, hint)),
        (raw & missing, GONE, F.lit("file is not in place")),
        (~raw & (F.col("rows") == 0), CONFLICT, F.lit("no rows to export")),
        (~raw & (view != ALL_ROWS) & ~offered, CONFLICT, F.lit("view not offered")),
        (~raw & too_long, CONFLICT, F.lit("too many rows for a sheet")),
        (~raw & missing, CONFLICT, F.lit("not generated")),
    ]
    code = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(OK))
    reason = reduce(
        lambda rest, rule: F.when(rule[0], rule[2]).otherwise(rest), reversed(rules), F.lit("ok")
    )
    granted = lambda value: F.when(code == OK, value)
    return r.select(
        *requests.columns,
        code.alias("code"),
        reason.alias("reason"),
        granted(F.when(raw, raw_name).otherwise(served_name(view))).alias("file"),
        granted(effective_rows(view)).alias("rows"),
        granted(size).alias("bytes"),
        granted(F.col("last_updated")).alias("last_updated"),
        granted(base_name("source_file")).alias("source_file"),
        granted(raw).alias("raw"),
    )


def bundles(
    requests: DataFrame,
    entries: DataFrame,
    served: DataFrame | None = None,
    sheet_limit: int = SHEET_ROW_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, members) of bundles, from ``requests (bundle, iso2, fmt, view, position)``.

    A bundle is had whole or not at all: its code and reason are those of the first member,
    in the order asked for, that cannot be had. A code asked for twice counts once, where
    it first came up; an unknown one fails the bundle like any other. More than
    ``BUNDLE_MAX`` codes, repeats included, are refused. Members are one row per code with
    its own decision; ``granted`` tells whether the whole bundle is.
    """
    each = requests.groupBy("bundle", F.upper("iso2").alias("iso2")).agg(
        F.min("position").alias("position"), F.min_by(F.struct("fmt", "view"), "position").alias("as"), F.count("*").alias("asked")
    )
    asked = each.select("bundle", "iso2", "position", "as.*", "asked")
    members = decisions(asked, entries, served, sheet_limit)
    fault = F.when(F.col("code") != OK, F.struct("position", "iso2", "code", "reason"))
    raw_codes = F.array_sort(F.collect_list(F.when(F.col("raw"), F.struct("position", "iso2"))))
    judged = members.groupBy("bundle").agg(
        F.sum("asked").alias("asked"), F.min(fault).alias("fault"), F.count("*").alias("groups"),
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), raw_codes.alias("raw"),
        F.min_by("fmt", "position").alias("fmt"), F.min_by("view", "position").alias("view"),
    )
    too_many = F.col("asked") > BUNDLE_MAX
    whole = ~too_many & F.col("fault").isNull()
    limit = F.lit(f"a bundle holds 1 to {BUNDLE_MAX} groups")
    verdicts = judged.select(
        "bundle", "fmt", "view",
        F.when(too_many, INVALID).otherwise(F.coalesce("fault.code", F.lit(OK))).alias("code"),
        F.when(too_many, limit).otherwise(F.coalesce("fault.reason", F.lit("ok"))).alias("reason"),
        F.when(~too_many, F.col("fault.iso2")).alias("refused"),
        *(F.when(whole, F.col(c)).alias(c) for c in ("groups", "rows", "bytes")),
        F.when(whole, F.array_join(F.transform("raw", lambda x: x.iso2), ", ")).alias("raw_groups"),
    )
    of_bundle = verdicts.select("bundle", (F.col("code") == OK).alias("granted"))
    return verdicts, members.drop("asked").join(of_bundle, "bundle")


def manifest(members: DataFrame) -> DataFrame:
    """The lines of granted bundles: one per group, with its position."""
    lines = members.where("granted")
    return lines.select("bundle", "position", "iso2", "file", "rows", "bytes", "last_updated", "source_file", "raw")


# Titles and widths of the manifest's columns; longer text pushes the rest to the right.
MANIFEST_COLUMNS = [("group", 8), ("rows", 14), ("updated", 14), ("served as", 36), ("made from", 0)]


def _cell(text: Column, width: int) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) >= width, F.concat(text, F.lit(" " * (width > 0)))).otherwise(F.rpad(text, width, " "))


def manifest_text(verdicts: DataFrame, lines: DataFrame, dated: str) -> DataFrame:
    """(bundle, text): a table of the files, and below it what they add up to.

    A text holds ``BUNDLE_MAX`` lines at most, so it is put together as one value.
    """
    origin = F.concat("source_file", F.when(F.col("raw"), F.lit(" (as delivered)")).otherwise(F.lit("")))
    cells = [F.col("iso2"), F.format_number("rows", 0), F.col("last_updated"), F.col("file"), origin]
    line = F.concat(*(_cell(c, width) for c, (_, width) in zip(cells, MANIFEST_COLUMNS, strict=True)))
    in_order = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    bodies = lines.groupBy("bundle").agg(F.transform(in_order, lambda x: x.line).alias("body"))
    title = F.lit("".join(title.ljust(width) for title, width in MANIFEST_COLUMNS))
    total = F.format_string(
        "%,d groups with %,d rows in %,d bytes, %s of %s, out of the catalog of %s",
        "groups", "rows", "bytes", "fmt", F.replace("view", F.lit("_"), F.lit(" ")), F.lit(dated),
    )
    raw_note = F.when(F.col("raw_groups") != "", F.concat(F.lit("Served as delivered, without codes: "), "raw_groups"))
    csv_note = F.when(F.col("fmt") == "csv", F.lit("Read code columns as text; as numbers they lose leading zeros."))
    text = F.concat_ws("\n", title, F.array_join("body", "\n"), F.lit(""), total, raw_note, csv_note, F.lit(""))
    return verdicts.join(bodies, "bundle").select("bundle", text.alias("text"))
