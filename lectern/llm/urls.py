"""URL filters: a URL is judged by the longest rule for its host, or a parent domain, and the start of its path.

A rule `host/path` becomes the SHA-256 digest of that string, of which the first PREFIX hex digits are its join key. A URL is expanded
into every host suffix and path prefix of a shape that some rule has; the keys are joined first, then full digests are compared, and of
the rules that fit the longest one decides. Each distinct URL is judged once.

Edge cases (tests/llm/test_urls.py): a null URL, or one without `://`, has an empty host and path and fits no rule; ports and user
names are part of the host; an empty path fits no rule, as a rule's path starts with `/`; repeated rules count once and of
contradictory ones block wins; repeated rows and null ids keep one result each; empty tables of either kind work; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import settle

#: Hex digits of a digest that are joined on.
PREFIX = 8
#: Rules are broadcast up to so many; their strings are URLs, so a row has at most a few kilobytes.
BROADCAST_ROWS = 50_000
#: What is said of a URL that no rule fits.
DEFAULT = "allow"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a short list of rules."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, url, host, path, rule, verdict) for every row of pages; rules: (host, path, verdict)."""
    own = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of allow and block, block
    own = own.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("reach"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict")
    own = settle(own.withColumn("digest", F.sha2("rule", 256)).withColumn("key", F.substring("digest", 1, PREFIX)), "rules")
    shape = own.agg(F.collect_set("labels"), F.collect_set("reach"), F.count("*")).first()  # numbers of at most the longest rule
    keyed = own.select("key", "digest", "rule", "host_length", F.col("verdict").alias("said"))
    keyed = F.broadcast(keyed) if shape[2] <= BROADCAST_ROWS else keyed

    host, path = host_and_path(F.col("url"))
    urls = settle(pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().withColumns({"host": host, "path": path}), "urls")
    many = lambda xs: F.array(*map(F.lit, sorted(xs))).cast("array<int>")
    shapes = urls.withColumn("labels", F.explode(F.filter(many(shape[0]), lambda n: n <= _labels(F.col("host")))))
    shapes = shapes.withColumn("reach", F.explode(F.filter(many(shape[1]), lambda n: n <= F.length("path"))))
    digest = F.sha2(F.concat(F.expr("substring_index(host, '.', -labels)"), F.expr("substring(path, 1, reach)")), 256)
    expanded = shapes.select("url", digest.alias("found")).withColumn("key", F.substring("found", 1, PREFIX))
    fits = expanded.join(keyed, "key").where("found = digest")
    best = F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule", "said"))
    judged = settle(fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.said"), "judged")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    return rows.join(judged, "url", "left").select("id", "url", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
