"""URL filters: rules of host and path, found by their rarest literal token.

Each rule names a host and the start of a path. It is filed under one token that every URL it fits must hold:
a label of its host or a whole segment of its path, namely the one that the fewest URLs hold. A URL's tokens
fetch the rules filed under them, and only those rules' regular expressions run. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, start of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """From after the first :// up to a slash, question mark, hash or the end; ASCII letters in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that any URL which the rule fits must hold. A last segment without a slash behind it may go on."""
    return [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in path.split("/")[1:-1]]


def _pattern(host: str, path: str) -> str:
    return r"(?s)^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)


def url_tokens(host: Column, path: Column) -> Column:
    of = lambda kind, text, at: F.transform(F.split(text, at), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(of("h:", host, r"\."), of("p:", path, "/")))


def judge_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row for each distinct url of df (null too): url, host, path, rule, verdict.

    The longest fitting rule wins; of equally long ones the first in code-point order. Null urls and urls
    without :// have an empty host and path, fit no rule and get the default verdict, as do all urls if there
    are no rules. An empty df gives no rows. Other columns of df are not read.
    """
    spark = df.sparkSession
    given = RULES if rules is None else rules
    for _, host, path in given:
        if not host or not path.startswith("/"):
            raise ValueError(f"a rule needs a host and a path that starts with a slash: {host!r}, {path!r}")
    book = spark.createDataFrame(
        [(k, h + p, v, _pattern(h, p), _rule_tokens(h, p)) for k, (v, h, p) in enumerate(given)],
        "rule_no int, rule string, verdict string, pattern string, tokens array<string>",
    )
    urls = df.select(F.col(url).alias("url")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    held = urls.where("host != ''").select("url", "host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    # How many URLs hold each token that some rule could be filed under; the result is no longer than the rules.
    filed_under = book.select("rule_no", F.explode("tokens").alias("token"))
    seen = held.join(filed_under.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    rarest = (
        filed_under.join(seen, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n_urls"), "token")).alias("least"))
        .select("rule_no", F.col("least.token").alias("token"))
    )
    index = book.drop("tokens").join(rarest, "rule_no")
    best = (
        held.join(index, "token")
        .where(F.expr("concat(host, path) rlike pattern"))
        .groupBy("url")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct((-F.length("rule")).alias("n"), "rule", "rule_no")).alias("won"))
    )
    return urls.join(best, "url", "left").select(
        "url", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages with host, path, rule and verdict, each row kept, repeated ones too.

    Columns of pages that have one of these four names are replaced.
    """
    new = {"host", "path", "rule", "verdict"}
    own = pages.select(*[c for c in pages.columns if c.lower() not in new])
    key = fresh_key = "judged_url"
    while key.lower() in {c.lower() for c in own.columns}:
        key = fresh_key = f"{fresh_key}_"
    judged = judge_urls(pages, url, rules, default).withColumnRenamed("url", key)
    # A null url never meets a join key; its verdict is the default.
    return own.join(judged, own[url] == judged[key], "left").select(
        *own.columns,
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
