"""URL rules as intervals of canonical keys, matched by one sorted sweep.

A key is the host with its labels reversed, then ``?``, then the path (neither part can hold a
``?``). The urls that a rule covers on its own host have keys that start with the rule's key, which
is the interval from the key to the key followed by the byte FF. Intervals nest or are disjoint, so a
sweep over all keys in order needs a stack only: its depth is a running sum of +1 at starts and -1 at
ends, and its top is the last start seen at the present depth. Sub-domains are covered by probing
a url once for every suffix of its host that has rules. The sweep runs in range-partitioned slices;
depth and tops are carried from slice to slice by totals of one row per slice and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txnrisk.llm.ordering import SLICE, before_each_slice, in_slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, START, PROBE = 0, 1, 2  # order of events at one key


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without it or for null."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rules_from(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with their keys; of equal rules a ``block`` stays, nulls go."""
    whole = rules.select(
        ascii_lower(F.col("host").cast("string")).alias("rule_host"),
        F.col("path").cast("string").alias("rule_path"),
        F.col("action").cast("string").alias("action"),
    ).dropna()
    single = whole.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    suffix = F.array_join(reversed_labels(F.col("rule_host")), ".")
    return single.select(
        suffix.alias("suffix"),
        F.encode(F.concat(suffix, F.lit("?"), "rule_path"), "UTF-8").alias("key"),
        F.struct(
            F.length(F.concat("rule_host", "rule_path")).alias("size"),
            F.length("rule_host").alias("host_size"),
            F.col("action"),
            F.concat("rule_host", "rule_path").alias("rule"),
        ).alias("found"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    A rule fits its host and all sub-domains if the url's path starts with the rule's path. The
    longest host and path wins, then the longer host. No fitting rule: null, and ``default``. A null
    url, or one without ``://``, has an empty host and path. Same-named columns are replaced; other
    columns come back as they were, whatever their names (they travel in one struct). Repeated rows
    stay repeated. Equal (host, path) pairs are looked up once, and equal probe keys (a rule's
    suffix and a path, such as every home page under one suffix) go through the sweep once and are
    joined back, so neither a url nor a key held by a third of all rows fills one task of the sweep.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in added]
    address = F.col(url).cast("string")
    payload = F.struct(*[F.col(c) for c in kept]).alias("payload")
    parsed = pages.select(payload, url_host(address).alias("host"), url_path(address).alias("path"))
    ruled = rules_from(rules)
    labels = reversed_labels(F.col("host"))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.lit(1), k), ".")
    )
    distinct = parsed.groupBy("host", "path").agg(F.count("*").alias("n"))
    asked = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(ruled.select("suffix").distinct(), "suffix", "left_semi")
        .select("host", "path", F.encode(F.concat("suffix", F.lit("?"), "path"), "UTF-8").alias("key"))
    )
    probes = asked.select("key").distinct().select(
        "key", F.lit(PROBE).alias("kind"), F.lit(0).alias("step"), ruled_null(ruled).alias("found")
    )
    starts = ruled.select("key", F.lit(START), F.lit(1), "found")
    ends = ruled.select(F.concat("key", F.unhex(F.lit("FF"))), F.lit(END), F.lit(-1), ruled_null(ruled))
    tops = _swept(probes.union(starts).union(ends))
    best = asked.join(tops, "key").groupBy("host", "path").agg(F.max("found").alias("found"))
    return parsed.join(best, ["host", "path"], "left").select(
        *[F.col("payload").getField(c).alias(c) for c in kept],
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.action", F.lit(default)).alias("verdict"),
    )


def ruled_null(ruled: DataFrame) -> Column:
    return F.lit(None).cast(ruled.schema["found"].dataType)


def _swept(events: DataFrame) -> DataFrame:
    """For every probe key the innermost rule whose interval holds it (keys outside all are left out)."""
    slices = in_slices(events, F.col("key"), F.col("kind"))
    order = [F.col("key"), F.col("kind")]
    totals = slices.groupBy(SLICE).agg(F.sum("step").alias("step"))
    before = F.coalesce(before_each_slice(totals, F.sum("step")), F.lit(0))
    base = totals.select(SLICE, before.alias("base"))
    inside = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    deep = slices.join(base, SLICE).select(
        *slices.columns, (F.sum("step").over(inside) + F.col("base")).alias("depth")
    )
    last = deep.groupBy(SLICE, "depth").agg(F.max_by("found", F.when(F.col("kind") == START, F.col("key"))).alias("found"))
    carried = before_each_slice(last, F.last("found", ignorenulls=True), ["depth"])
    tops = last.select(SLICE, "depth", carried.alias("carried"))
    here = Window.partitionBy(SLICE, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.coalesce(F.last("found", ignorenulls=True).over(here), F.col("carried"))
    return (
        deep.join(tops, [SLICE, "depth"], "left")
        .withColumn("found", top)
        .filter((F.col("kind") == PROBE) & (F.col("depth") > 0))
        .select("key", "found")
    )
