"""URL filtering: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "rule string, pattern string, tokens array<string>, verdict string, rank int"
# Words that as a whole token of a host mark sites no training set wants.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx")
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def literal_tokens(text: str, open_end: bool = False) -> list[str]:
    """Whole tokens that any text with ``text`` in it must have; with an open end the last may go on."""
    tokens = re.findall(r"[a-z0-9]+", text.lower())
    if open_end and text and re.match(r"[a-z0-9]", text[-1].lower()):
        tokens = tokens[:-1]
    return tokens


def site_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host, all its subdomains, and the paths that start with ``path``.

    Among such rules the longest that fits wins.
    """
    pattern = rf"(?s)^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    return host + path, pattern, literal_tokens(host + path, open_end=True), verdict, len(host + path)


def word_rule(word: str, verdict: str = "block") -> tuple:
    """A rule for hosts with a whole token ``word``; weaker than any site rule."""
    pattern = rf"^(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?![a-z0-9])"
    return f"*{word}*", pattern, [word], verdict, 0


def rules_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Every row with ``host``, ``path``, the winning ``rule`` and its ``verdict`` (null if none fits).

    A rule is a regular expression on host and path, the whole tokens (runs of
    a-z and 0-9) that every match holds, and a rank.  It is indexed by the
    token that fewest distinct addresses hold; an address meets only the rules
    indexed by one of its tokens, and only those are run.  Rules without a
    token meet every address.  The highest rank wins, then the first rule by
    name.  Null urls and urls without ``://`` have an empty host and path.
    Columns of ``pages`` named like a result give way to it.

    Addresses are judged once and joined back; a frequent token meets the few
    rules it indexes, and a frequent address is one row until the last join.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "rank")
    marked = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    places = marked.select("host", "path").distinct()
    words = F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("[a-z0-9]+"), F.lit(0))
    tokens = places.select(
        "host", "path", F.explode(F.array_distinct(F.concat(words, F.array(F.lit(""))))).alias("token")
    )
    listed = rules.select(
        "*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token")
    )
    seen = tokens.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    index = (
        listed.join(seen, "token", "left")
        .groupBy("rule", "pattern", "verdict", "rank")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("_rarest"))
        .select("rule", "pattern", "verdict", "rank", F.col("_rarest.token").alias("token"))
    )
    hits = (
        tokens.join(index, "token")
        .where(F.expr("regexp_like(concat(host, path), pattern)"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.col("rank")).alias("order"), "rule", "verdict")).alias("_won"))
        .select(
            F.col("host").alias("_host"), F.col("path").alias("_path"),
            F.col("_won.rule").alias("rule"), F.col("_won.verdict").alias("verdict"),
            (-F.col("_won.order")).alias("rank"),
        )
    )
    return marked.join(
        hits, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left"
    ).drop("_host", "_path")
