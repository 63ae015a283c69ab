"""Stages that prepare the canonical table from delivered files.

These follow a prose description of each stage, not code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.functions.absence import has_text, strip
from placebook.functions.scalars import base_name
from placebook.operators.ranking import one_per_key
from placebook.schema import COLUMNS, GROUP, MASTER
from placebook.session import settle
from placebook.sources.delimited import SourceFiles

VERSION_PATTERN = r"_v(\d+)"


def resolve_versions(
    files: DataFrame, revision_folder: str, group: str = GROUP, path: str = "rel_path"
) -> DataFrame:
    """One file per group: a revision beats any batch file, then the highest ``_v``.

    The folder is the first part of the path. A name without ``_v`` is version 0.
    """
    folder = F.substring_index(path, "/", 1)
    version = F.coalesce(
        F.regexp_extract(base_name(path), VERSION_PATTERN, 1).try_cast("bigint"), F.lit(0)
    )
    rank = F.struct((folder == revision_folder).alias("revision"), version.alias("version"), path)
    best = files.groupBy(group).agg(F.max_by(F.struct(path), rank).alias("_best"), F.max(rank).alias("_rank"))
    return best.select(
        group,
        F.col(f"_best.{path}").alias("selected_rel_path"),
        F.when(F.col("_rank.revision"), F.lit(revision_folder))
        .otherwise(F.substring_index(f"_best.{path}", "/", 1))
        .alias("selected_batch"),
        F.col("_rank.version").alias("selected_version"),
    )


def header_name(c: Column | str) -> Column:
    """A header as mappings spell it: stripped, lower case."""
    return F.lower(strip(c))


def mapped_headers(
    headers: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None, group: str = GROUP
) -> DataFrame:
    """(group, header, canonical): overrides of the group first, then the mapping.

    ``canonical`` is null for a header nothing maps.
    """
    named = headers.select(group, "header", header_name("header").alias("_name"))
    general = mapping.select(header_name("header").alias("_name"), F.col("canonical").alias("_general"))
    out = named.join(one_per_key(general, ["_name"]), "_name", "left")
    if overrides is None:
        return out.select(group, "header", F.col("_general").alias("canonical"))
    own = overrides.select(
        group, header_name("header").alias("_name"), F.col("canonical").alias("_own")
    )
    return out.join(one_per_key(own, [group, "_name"]), [group, "_name"], "left").select(
        group, "header", F.coalesce("_own", "_general").alias("canonical")
    )


def unmapped_headers(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("canonical").isNull()).drop("canonical")


def map_sources(
    source: SourceFiles, mapping: DataFrame, overrides: DataFrame | None = None, schema: T.StructType = MASTER
) -> DataFrame:
    """Records of files with any number of headers under the canonical names and types.

    (file, canonical columns). ``mapping (header, canonical)`` says what headers mean,
    ``overrides (file, header, canonical)`` what they mean in one file. The headers of a
    file become one row: which fields hold which column. That small table meets the
    records where they lie, so rows are neither taken apart nor grouped, and no step is
    done once per template. Of several fields of one column the first that says something
    is taken, the last one as it is if none does; columns nobody maps are null.
    """
    named = mapped_headers(source.headers, mapping, overrides, "file").where("canonical is not null")
    placed = named.join(source.headers, ["file", "header"]).groupBy("file", "canonical").agg(
        F.array_sort(F.collect_set("ordinal")).alias("ordinals")
    )
    plans = placed.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "ordinals"))).alias("_plan"))
    rows = source.records.join(settle(plans, "plans"), "file", "left")
    out = []
    for field in schema:
        ordinals = F.element_at("_plan", F.lit(field.name))
        values = F.transform(ordinals, lambda o: F.get("fields", o))
        value = F.coalesce(F.get(F.filter(values, has_text), 0), F.element_at(values, -1))
        typed = value if isinstance(field.dataType, T.StringType) else strip(value).try_cast(field.dataType)
        out.append(typed.alias(field.name))
    return rows.select("file", *out)


def map_columns(df: DataFrame, mapping: dict[str, str], schema: T.StructType = MASTER) -> DataFrame:
    """One template's rows under the canonical column names and types.

    Only names change, so nothing moves. Of two headers mapped to one column the
    first that says something is used; columns nobody maps are null.
    """
    by_canonical: dict[str, list[Column]] = {}
    for header in df.columns:
        canonical = mapping.get(header.strip().lower())
        if canonical:
            by_canonical.setdefault(canonical, []).append(F.col(f"`{header}`"))
    out = []
    for field in schema:
        sources = by_canonical.get(field.name, [])
        value = F.coalesce(*(F.when(has_text(c), c) for c in sources[:-1]), sources[-1]) if sources else F.lit(None)
        text = value.cast("string")
        typed = text if isinstance(field.dataType, T.StringType) else strip(text).try_cast(field.dataType)
        out.append(typed.alias(field.name))
    return df.select(*out)


def backfill(
    df: DataFrame,
    countries: DataFrame,
    languages: DataFrame,
    translations: DataFrame,
    group: str = GROUP,
) -> DataFrame:
    """Fill blank country fields from the dimension tables.

    ``country_lc`` also counts as blank when it merely repeats ``country_en`` and
    the group's language is not English. Without a translation it stays as it is.
    """
    ref = countries.select(
        F.col(group).alias("_group"),
        *(F.col(c).alias(f"_{c}") for c in ("country_iso3", "country_en", "continent_code", "continent_name")),
    )
    told = one_per_key(translations.select(group, "language", "name_lc"), [group, "language"])
    names = one_per_key(languages.select(group, "language"), [group]).join(told, [group, "language"], "left").select(
        F.col(group).alias("_lang_group"), F.col("language").alias("_language"), F.col("name_lc").alias("_name_lc")
    )
    joined = df.join(one_per_key(ref, ["_group"]), F.col(group) == F.col("_group"), "left").join(
        names, F.col(group) == F.col("_lang_group"), "left"
    )
    untranslated = F.col("country_lc").eqNullSafe(F.col("country_en")) & (F.col("_language") != "en")
    keep_local = has_text("country_lc") & ~F.coalesce(untranslated, F.lit(False))
    filled = {
        c: F.when(has_text(c), F.col(c)).otherwise(F.coalesce(f"_{c}", c))
        for c in ("country_iso3", "country_en", "continent_code", "continent_name")
        if c in df.columns
    }
    filled["country_lc"] = F.when(keep_local, F.col("country_lc")).otherwise(
        F.coalesce("_name_lc", "country_lc")
    )
    return joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def with_region_code(df: DataFrame, regions: DataFrame, group: str = GROUP) -> DataFrame:
    """Fill a blank level-1 code from a (group, level-1 name) → code table."""
    ref = regions.select(
        F.col(group).alias("_group"), F.col("region_1_en").alias("_region"), F.col("region_1_iso_code").alias("_code")
    )
    code = F.when(has_text("region_1_iso_code"), F.col("region_1_iso_code")).otherwise(
        F.coalesce("_code", "region_1_iso_code")
    )
    joined = df.join(
        one_per_key(ref, ["_group", "_region"]), (F.col(group) == F.col("_group")) & (F.col("region_1_en") == F.col("_region")), "left"
    )
    return joined.withColumn("region_1_iso_code", code).select(*df.columns)


def with_code(df: DataFrame, code: str = "postal_code") -> DataFrame:
    """Rows that carry a code."""
    return df.where(has_text(code))


def code_counts(df: DataFrame, group: str = GROUP, code: str = "postal_code") -> DataFrame:
    """(group, rows_in, rows_out, emptied): what dropping blank codes does."""
    marked = df.select(group, has_text(code).cast("int").alias("_kept"))
    return marked.groupBy(group).agg(
        F.count("*").alias("rows_in"),
        F.sum("_kept").alias("rows_out"),
        (F.sum("_kept") == 0).alias("emptied"),
    )


def emptied_groups(df: DataFrame, group: str = GROUP, code: str = "postal_code") -> DataFrame:
    """Groups that had rows but are left with none."""
    return code_counts(df, group, code).where("emptied").select(group)


def differences(
    source: DataFrame, delivered: DataFrame, columns: Sequence[str] = tuple(COLUMNS)
) -> DataFrame:
    """Rows found more often on one side, with how often: both directions at once.

    ``surplus`` > 0: only delivered; < 0: only in the source. Repeated rows cancel
    in the map tasks before the one shuffle, and rows meet on all their columns,
    so no group is a hot spot.
    """
    sides = source.select(*columns, F.lit(-1).alias("_side")).unionByName(
        delivered.select(*columns, F.lit(1).alias("_side"))
    )
    return sides.groupBy(*columns).agg(F.sum("_side").alias("surplus")).where("surplus <> 0")


def row_digest(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row, null being a value of its own, as two numbers."""
    told = [*(F.col(c).isNull() for c in columns), *(F.col(c) for c in columns)]
    return [F.xxhash64(F.lit(seed), *told).alias(f"_digest{seed}") for seed in (0, 1)]


def audit(
    source: DataFrame,
    delivered: DataFrame,
    group: str = GROUP,
    columns: Sequence[str] = tuple(COLUMNS),
) -> DataFrame:
    """(group, source_rows, delivered_rows, lost, added). Reads only.

    Only numbers of rows are asked for, so rows meet as their digests, which are narrow: no
    text is sorted, held or moved.
    """
    one, none = F.lit(1), F.lit(0)
    digest = row_digest(columns)
    both = source.select(group, *digest, one.alias("_s"), none.alias("_d")).unionByName(
        delivered.select(group, *digest, none.alias("_s"), one.alias("_d"))
    )
    rows = both.groupBy(group, "_digest0", "_digest1").agg(F.sum("_s").alias("_s"), F.sum("_d").alias("_d"))
    surplus = F.col("_d") - F.col("_s")
    return rows.groupBy(group).agg(
        F.sum("_s").alias("source_rows"),
        F.sum("_d").alias("delivered_rows"),
        F.sum(F.greatest(-surplus, F.lit(0))).alias("lost"),
        F.sum(F.greatest(surplus, F.lit(0))).alias("added"),
    )


def code_lengths(df: DataFrame, group: str = GROUP, code: str = "postal_code") -> DataFrame:
    """(group, usual_length): the most frequent length of a code, the longer on a tie."""
    lengths = (
        df.where(has_text(code))
        .groupBy(group, F.length(strip(code)).alias("_length"))
        .agg(F.count("*").alias("_n"))
    )
    return lengths.groupBy(group).agg(
        F.max_by("_length", F.struct("_n", "_length")).alias("usual_length"),
        F.sum("_n").alias("coded_rows"),
    )


def lost_zeros(df: DataFrame, group: str = GROUP, code: str = "postal_code") -> DataFrame:
    """Rows whose all-digit code is shorter than usual in its group, with the code
    as it must have been."""
    usual = settle(code_lengths(df, group, code), "lengths").select(
        F.col(group).alias("_group"), "usual_length"
    )
    bare = strip(code)
    short = bare.rlike(r"^[0-9]+$") & (F.length(bare) < F.col("usual_length"))
    return (
        df.join(usual, F.col(group).eqNullSafe(F.col("_group")))
        .where(short)
        .select(*df.columns, "usual_length", F.lpad(bare, F.col("usual_length"), F.lit("0")).alias("restored"))
    )
