"""URL filtering against a list of hosts and paths, in DataFrame functions only.

A list entry is a canonical URL ``host/path`` with a verdict; it fits its host and all subdomains if the URL's path starts
with its path, and the longest entry that fits wins. A URL's possible entries are its host's suffixes, of no more labels
than a listed host has, joined with those prefixes of its path whose lengths occur in the list. A blocked Bloom filter of
the listed entries lets few others pass, and an exact hash join removes these false positives.

The filter takes ``BITS_PER_ENTRY`` bits an entry and is broadcast in segments of ``BROADCAST_BYTES`` at most, by hash range;
keys are never shuffled to be probed, only those that pass are for the exact join. The list itself is broadcast up to
``BROADCAST_BYTES``, by its counted size. URLs are judged once for each distinct host and path, so a hot URL costs no more
than others.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no entry; such URLs, and all that fit
none, get the default verdict; of entries that fit and are equally long the one that comes last by its characters wins;
an entry listed twice with different verdicts blocks; an empty list leaves the default to all; URLs of any length and
number of labels are read whole; repeated rows are a row each; an empty table gives an empty result. Extra columns pass
through ``filter_urls``, but those that have a result column's name give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bloom
from marlstone.llm.common import cut

BITS_PER_ENTRY = 32
BROADCAST_BYTES = 32 << 20

#: (host, path, verdict) of the production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hosts that are listed for what they serve, each under every domain that pages come from; the method blocks them and their
#: subdomains where no rule decides.
JUNK = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
LISTED = [(f"{host}.{domain}", "/", "block") for host in JUNK for domain in DOMAINS]


def rules(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in entries], "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matches(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """For each distinct (host, path) that fits an entry: host, path, rule, rule_verdict of the longest."""
    entries = listed.select(F.concat("host", "path").alias("__ms_key"), F.length("path").alias("__ms_n"), F.size(F.split("host", r"\.")).alias("__ms_labels"), "verdict")
    entries = cut(entries.groupBy("__ms_key", "__ms_n", "__ms_labels").agg(F.max("verdict").alias("__ms_verdict")), "url-list")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("__ms_key") + 24), F.lit(0)).alias("b"), F.collect_set("__ms_n").alias("lengths"), F.coalesce(F.max("__ms_labels"), F.lit(1)).alias("labels")).first()
    of_block = bloom.block_bits(size["n"] * BITS_PER_ENTRY)
    filter_ = cut(bloom.bitmaps(bloom.exploded(entries.select(F.xxhash64("__ms_key").alias(bloom.HASH)), of_block).distinct()), "url-bloom")
    distinct = urls.where("host != ''").select("host", "path").distinct()
    # The host's suffixes, then each with the prefixes of the path that have a listed length.
    tail = F.slice(F.split("host", r"\."), F.lit(-1) * F.least(F.lit(size["labels"]), F.size(F.split("host", r"\."))), F.lit(size["labels"]))
    suffix = F.transform(F.sequence(F.lit(1), F.size("__ms_tail")), lambda i: F.array_join(F.slice(F.col("__ms_tail"), i, size["labels"]), "."))
    prefix = F.filter(F.lit(sorted(size["lengths"])) if size["lengths"] else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffix, lambda s: F.transform(prefix, lambda n: F.concat(s, F.col("path").substr(F.lit(1), n)))))
    possible = distinct.withColumn("__ms_tail", tail).select("host", "path", F.explode(keys).alias("__ms_key")).withColumn(bloom.HASH, F.xxhash64("__ms_key"))
    passed = bloom.probe(possible, filter_, of_block, BROADCAST_BYTES).where("__ms_maybe")
    exact = entries.select("__ms_key", "__ms_verdict")
    hits = passed.join(F.broadcast(exact) if size["b"] * 4 <= BROADCAST_BYTES else exact.hint("merge"), "__ms_key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("__ms_key").alias("n"), F.col("__ms_key").alias("rule"), F.col("__ms_verdict").alias("verdict"))).alias("b"))
    return best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict"))


def filter_urls(pages: DataFrame, by_rule: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict: the longest rule's verdict, else the longest listed entry's, else the default."""
    pages = pages.drop("host", "path", "rule", "verdict")
    split = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    parts = split.select("host", "path")
    found = cut(matches(parts, by_rule).join(matches(parts, listed).select("host", "path", F.col("rule_verdict").alias("list_verdict")), ["host", "path"], "full"), "url-hits")
    found = found.select(F.concat("host", F.lit("")).alias("host"), F.concat("path", F.lit("")).alias("path"), "rule", F.coalesce("rule_verdict", "list_verdict").alias("verdict"))
    # Merged whatever their size: what is hit grows with the URLs.
    return split.join(found.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op5_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules(spark, RULES), rules(spark, LISTED)).select("page_id", "host", "path", "rule", "verdict")


def _fits(entries: list[tuple[str, str, str]], what: str) -> str:
    """SQL for the longest entry that fits: its key or its verdict."""
    order = sorted(sorted(entries, key=lambda e: e[0] + e[1], reverse=True), key=lambda e: -len(e[0] + e[1]))
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for h, p, v in order]
    return f"CASE {' '.join(cases)} END"


SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {_fits(RULES, "rule")} AS rule,
       coalesce({_fits(RULES, "verdict")}, {_fits(LISTED, "verdict")}, 'allow') AS verdict FROM s
"""
