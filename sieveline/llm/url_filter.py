"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Built-in DataFrame functions only. A URL is expanded into every (host suffix, path prefix) pair that a rule could be
written as; pairs meet rules by the first four bytes of a SHA-256 digest, then whole digests are compared, and of the
rules that fit, the longest wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Rules are broadcast up to this number (some 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Rules may differ in at most this many lengths of path; expressions are made for these lengths only.
MAX_PATH_LENGTHS = 256


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict in place of columns of those names.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest rule text wins, ties go to
    the longer host, then to block. Where none fits, rule is null and verdict is `default`. Null or unparsable URLs
    have an empty host and path, which no rule with a host fits. Repeated rows and rules change nothing; each row keeps
    its own verdict; an empty table of pages or rules is fine. The join can spread: no row waits for others of its host.
    """
    rules = rules.where("rule_host is not null and rule_path is not null and verdict in ('allow', 'block')").select(
        "verdict", F.lower("rule_host").alias("rule_host"), "rule_path"
    )
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().limit(MAX_PATH_LENGTHS + 1).collect())
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"rules have more than {MAX_PATH_LENGTHS} lengths of path")
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    rules = rules.select(
        digest.alias("rule_digest"), F.substring(digest, 1, 8).alias("short"),
        # Largest first: length of the text, length of the host, block before allow.
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"), "verdict",
        ).alias("found"),
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = fresh(pages, "row")
    based = pages.select(F.struct(*(F.col(c) for c in kept)).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn(row, F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    wanted = F.filter(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(wanted, lambda n: F.substring("path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    # explode_outer keeps pages without any expression; rows of a page are next to each other, so they merge before the shuffle.
    tried = based.withColumn("digest", F.explode_outer(pairs)).withColumn("short", F.substring("digest", 1, 8))
    found = tried.join(F.broadcast(rules) if few else rules, "short", "left").select(
        row, "page", "host", "path", F.when(F.col("digest") == F.col("rule_digest"), F.col("found")).alias("found")
    )
    best = found.groupBy(row).agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("found").alias("found"))
    return best.select(*(F.col("page")[c].alias(c) for c in kept), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
