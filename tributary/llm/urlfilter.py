"""URL filters with DataFrame functions only (operator 8).

Every distinct URL is expanded into host-suffix and path-prefix expressions, of just the lengths that some rule has (so the
number of expressions is bounded by the rules, not by the URL); expressions meet rules in an equi-join on a short prefix of
their SHA-256 digests, full digests confirm, and the rule with the longest text wins.  Rules are broadcast if their number is
below ``broadcast_rules`` (it is counted), else joined by shuffle.

Edge cases: a null URL or one without "://" has empty host and path; a rule path must literally start the path, so no rule
fits an empty path; rules of equal length: the longer host, then block before allow, then text order; repeated pages give a
row each; null page ids stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://", up to "?" or "#"; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^?#]*", 0)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/]*(?s)(.*)$", 1)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8, broadcast_rules: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict.  rules: (verdict, host, path), as a list or a DataFrame of these columns."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.where("rule_host is not null and rule_path is not null")
    # Sets of lengths: at most a few thousand numbers, since hosts and paths are at most that long.
    shape = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("rule_host"))).alias("h"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("p")).first()
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict")
    )
    known = rules.select(F.substring(digest, 1, prefix_hex).alias("short"), digest.alias("digest"), rank.alias("rank"))
    if shape["n"] <= broadcast_rules:
        known = F.broadcast(known)

    parts = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    source = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    lens = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
    host, path = F.col("host"), F.col("path")
    hosts = F.transform(
        F.filter(lens(shape["h"]), lambda n: (n == F.length(host)) | ((n < F.length(host)) & (F.substring(host, F.length(host) - n, F.lit(1)) == "."))), lambda n: F.substring(host, F.length(host) - n + 1, n)
    )
    paths = F.transform(F.filter(lens(shape["p"]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat_ws("\n", h, p))))
    # A URL's path and host decide; equal ones are judged once, by partial aggregation before the shuffle.
    distinct = source.select("host", "path").distinct()
    tried = distinct.select("host", "path", F.explode(pairs).alias("expression")).select("host", "path", F.sha2("expression", 256).alias("digest"))
    tried = tried.withColumn("short", F.substring("digest", 1, prefix_hex))
    t, k = tried.alias("t"), known.alias("k")
    met = t.join(k, F.col("t.short") == F.col("k.short")).where(F.col("t.digest") == F.col("k.digest"))
    fit = met.groupBy("host", "path").agg(F.max("rank").alias("rank"))
    out = source.join(fit, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict"))
