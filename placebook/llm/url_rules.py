"""URL rules found by their rarest literal token.

A rule is a host with a path prefix, or a regular expression with the literal words it
cannot match without. Each rule is filed under the one of its words that is rarest among
the URLs at hand. A URL's words fetch the rules filed under them, and only those are
tried. The longest fitting host-and-path rule decides; without one, a fitting pattern
blocks; otherwise the URL is allowed.

Words are runs of ASCII letters and digits, lower-cased. A host rule needs all words of
its host, and those of its path that end before the prefix does. A pattern lists its
words, alternatives being patterns of their own; a URL's word also counts without the digits
at its end, for patterns that allow any there. A pattern without words is filed under the
empty word, which every URL has.

* Null url, or no ``://``: empty host and path, no rule, allowed. Empty url likewise.
* Repeated urls: judged once, every row comes back. Null ids stay. Empty table: no rows.
* Equal rules: one of them. Rules of equal length: first by text. Other columns are
  ignored. Very long urls: words follow their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm.common import if_small, stored

# Rules of the contract (verdict, host, path).
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Patterns over host and path, with the words each needs.
PATTERNS = [
    (r"(^|\.)cheap-(pills|meds)\.", ["cheap"]),
    (r"(^|\.)(online-)?casino[0-9]*\.", ["casino"]),
    (r"/wp-login\.php\z", ["wp", "login", "php"]),
    (r"/signin(/|\z)", ["signin"]),
    (r"/signup(/|\z)", ["signup"]),
    (r"/logout(/|\z)", ["logout"]),
    (r"/cart/checkout(/|\z)", ["cart", "checkout"]),
    (r"\.exe\z", ["exe"]),
    (r"\.apk\z", ["apk"]),
    (r"\.dmg\z", ["dmg"]),
]
RULES_BROADCAST = 100_000


@dataclass(frozen=True)
class Rules:
    hosts: list[tuple[str, str, str]]
    patterns: list[tuple[str, list[str]]]


PRODUCTION = Rules(HOST_RULES, PATTERNS)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def words_of(text: Column) -> Column:
    """Distinct words, with and without the digits at their ends, the empty word among them."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.concat(F.array(F.lit("")), words, F.transform(words, lambda w: F.rtrim(w, F.lit("0123456789")))))


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``rule, verdict, host, prefix, pattern, words``: rules with the words they need."""
    rows = []
    for verdict, host, path in rules.hosts:
        # The last word of a prefix may go on in the URL, unless something ends it.
        words = set(_words(host)) | set(_words(path)[: None if path[-1:] in ("", "/") else -1])
        rows.append((host + path, verdict, host, path, None, sorted(words)))
    rows += [(pattern, "block", None, None, pattern, sorted(words) or [""]) for pattern, words in rules.patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, host string, prefix string, pattern string, words array<string>").dropDuplicates(["rule"])


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule with ``token``: the rarest of its words among all ``urls (host, path)``."""
    needed = rules.select("rule", F.explode("words").alias("token"))
    tokens = urls.select(F.explode(words_of(F.concat_ws(" ", "host", "path"))).alias("token"))
    counts = tokens.join(if_small(needed.select("token").distinct(), RULES_BROADCAST), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = needed.join(counts, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rules.join(ranked, "rule")


def judge(pages: DataFrame, rules: Rules = PRODUCTION) -> DataFrame:
    """``page_id, host, path, rule, pattern, verdict`` for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.where("host <> '' or path <> ''").select("host", "path").distinct()
    filed = if_small(index(rule_table(pages.sparkSession, rules), urls).drop("words"), RULES_BROADCAST).withColumnRenamed("host", "rule_host")
    asked = urls.select("host", "path", F.explode(words_of(F.concat_ws(" ", "host", "path"))).alias("token"))
    tried = asked.join(filed, "token")
    on_host = (F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host"))
    fits = F.when(F.col("pattern").isNull(), on_host & F.startswith("path", "prefix")).otherwise(F.expr("concat(host, path) rlike pattern"))
    # Host rules before patterns; the longest, then the first by text.
    rank = F.struct(F.col("pattern").isNotNull(), -F.length("rule"), "rule")
    found = tried.where(fits).groupBy("host", "path").agg(F.min_by(F.struct("rule", "pattern", "verdict"), rank).alias("own"))
    found = stored(found, "url-verdicts")  # so that Spark can split a hot URL's rows in the join
    return rows.join(found, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("own.pattern").isNull(), F.col("own.rule")).alias("rule"),
        F.col("own.pattern").alias("pattern"),
        F.coalesce("own.verdict", F.lit("allow")).alias("verdict"),
    )


def judge_sql(rules: Rules = PRODUCTION) -> str:
    """The same over all rules at once, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    hosts = ", ".join(f"({quote(v)}, {quote(h)}, {quote(p)})" for v, h, p in rules.hosts)
    patterns = ", ".join(f"({quote(p)})" for p, _ in rules.patterns)
    return f"""
WITH parts AS (
    SELECT page_id::BIGINT AS page_id,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
urls AS (SELECT DISTINCT host, path FROM parts),
rules(verdict, rule_host, prefix) AS (VALUES {hosts}),
patterns(pattern) AS (VALUES {patterns}),
by_rule AS (
    SELECT host, path, arg_max(rule_host || prefix, length(rule_host || prefix)) AS rule, arg_max(verdict, length(rule_host || prefix)) AS verdict
    FROM urls, rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)
    GROUP BY ALL),
by_pattern AS (
    SELECT host, path, arg_min(pattern, (-length(pattern), pattern)) AS pattern
    FROM urls, patterns WHERE regexp_matches(host || path, pattern) GROUP BY ALL)
SELECT page_id, p.host, p.path, r.rule, CASE WHEN r.rule IS NULL THEN b.pattern END AS pattern,
    CASE WHEN r.rule IS NOT NULL THEN r.verdict WHEN b.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN by_rule r USING (host, path) LEFT JOIN by_pattern b USING (host, path)
"""
