"""URL filtering by explicit rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's bad rate is
shrunk towards the level above by a beta-binomial prior whose strength is estimated from the spread
between its children (method of moments). A host is blocked when the lower bound of its posterior bad
rate lies above a limit. Hosts are counted before anything is joined, so a host with a third of all
pages is one row of the reputation table, and the join that brings verdicts to the pages can be split.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged as the
host "". A host without labelled pages has its domain's prior. Several labels of one page count as
one, bad if any is. Repeated pages each get a row. Without any label nothing is blocked but by rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (rule as host and path prefix, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Limits:
    """Block above this bad rate, at this many standard deviations below the posterior mean."""

    bad_rate: float = 0.5
    deviations: float = 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and suffix (last label), without user and port."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)


def _strength(children: DataFrame) -> float:
    """Prior strength of one level from the spread of its children (n, x) around the mean m above them."""
    m = F.col("m")
    row = children.agg(
        F.sum(F.pow(F.col("x") - F.col("n") * m, 2)).alias("seen"),
        F.sum(F.col("n") * m * (1 - m)).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("pairs"),
    ).first()
    if not row["pairs"]:
        return 1.0
    spread = (row["seen"] - row["binomial"]) / row["pairs"]
    return 1.0 / min(max(spread, 0.001), 0.999) - 1.0


def _shrunk(x: Column, n: Column, strength: float, above: Column) -> Column:
    return (x + F.lit(strength) * above) / (n + F.lit(strength))


def host_reputation(pages: DataFrame, outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, n, x, bad_rate, lower_bound, blocked) for every host of ``pages`` (page_id, host).

    ``outcomes`` has (page_id, bad). Only the three prior strengths and the overall rate, four numbers,
    pass through the driver.
    """
    once = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = (
        pages.join(once, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("x"))
    )
    domain, suffix = _levels(F.col("host"))
    counts = counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "x")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = suffixes.agg(F.sum("n"), F.sum("x")).first()
    overall = F.lit(((total[1] or 0.0) + 1.0) / ((total[0] or 0.0) + 2.0))

    by_suffix = suffixes.withColumn("m", overall)
    s = _strength(by_suffix)
    up = by_suffix.select("suffix", _shrunk(F.col("x"), F.col("n"), s, F.col("m")).alias("m"))
    by_domain = domains.join(up, "suffix")
    d = _strength(by_domain)
    up = by_domain.select("domain", _shrunk(F.col("x"), F.col("n"), d, F.col("m")).alias("m"))
    by_host = counts.join(up, "domain")
    h = _strength(by_host)

    weight = F.col("n") + F.lit(h)
    mean = _shrunk(F.col("x"), F.col("n"), h, F.col("m"))
    bound = F.col("bad_rate") - F.lit(limits.deviations) * F.sqrt(
        F.col("bad_rate") * (1 - F.col("bad_rate")) / (weight + 1)
    )
    return (
        by_host.withColumn("bad_rate", mean)
        .withColumn("lower_bound", bound)
        .select("host", "n", "x", "bad_rate", "lower_bound", (F.col("lower_bound") > limits.bad_rate).alias("blocked"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limits: Limits = Limits()) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, lower_bound for every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(split.select("page_id", "host"), outcomes, limits)
    name, decision = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("blocked"), "block").otherwise("allow")
    return split.join(reputation, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(decision, by_method).alias("verdict"), "bad_rate", "lower_bound"
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from a label table: a page is bad when it is toxic or of low quality."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
