"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) covers the keys that begin with its own key: the host's labels in reverse
order, a separator, and the path. Such intervals are nested or disjoint. A url has one key per
host suffix, because rules cover subdomains; each key and each rule becomes an event, events are
sorted once over all tasks, and the sweep keeps the stack of rules that are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .frames import pack, unpack

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Sorts before any character of a host or path, so that a host sorts before its subdomains.
_HOST_END = "\x01"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _ASCII_UPPER, _ASCII_UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(_HOST_END), path)


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with the stack of rules that are open there: itself, then those around it.

    Rules around a rule have the same host and a shorter path, so a window per host suffices to
    find them; of rules with the same host and path the smallest verdict counts.
    """
    flat = rules.select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = flat.withColumn("key", _key(F.col("host"), F.col("path")))
    # A path's prefixes are its possible outer rules: an equi-join on (host, prefix) per rule.
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    inner = keyed.select(F.col("key").alias("at"), "host", F.explode(prefixes).alias("path"))
    entry = F.struct(F.length("path").alias("long"), "key", "host", "path", "verdict")
    return (
        inner.join(keyed, ["host", "path"])
        .groupBy("at").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))
    )


def _sweep(points: DataFrame, stacks: DataFrame) -> DataFrame:
    """For each point the innermost open rule. Sorted ranges pass their last stack on to the next."""
    events = points.select("key", F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.select(F.col("at").alias("key"), F.lit(0).alias("kind"), "stack")
    order = ["key", "kind"]
    ranged = settle(
        events.unionByName(starts).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    last = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(last))
    # One row per range: the stack it ends with, and before that the one it begins with.
    ends = ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("ends"))
    parts = ranged.select("part").distinct().join(ends, "part", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.last("ends", ignorenulls=True).over(before).alias("carry"))
    open_here = F.coalesce("open", "carry")
    # The stack belongs to the last rule that began; rules that ended meanwhile are popped.
    still = F.filter(open_here, lambda r: F.col("key").startswith(r["key"]))
    return (
        swept.where("kind = 1").join(F.broadcast(carried), "part")
        .withColumn("rule", F.get(still, F.lit(0)))
        .select("key", "rule").where("rule IS NOT NULL")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of `pages` with `host`, `path`, `rule` and `verdict`.

    `rules` has host, path and verdict. A rule fits its host and all subdomains if the url's
    path starts with the rule's path; the longest rule (host and path together, then the longer
    host) wins and appears as host + path. Without a rule `rule` is null and `verdict` is `default`.

    Equal urls are judged once, so a url that many pages share moves once per task. A null url or
    one without `://` has an empty host and path. Rules with a null part count it as empty.
    Columns of `pages` named like the four new ones are replaced. Empty tables are fine.
    """
    packed = pack(pages, _url=url).withColumns({"_host": url_host(F.col("_url")), "_path": url_path(F.col("_url"))})
    distinct = packed.select("_host", "_path").distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)),
    )
    hosts = rules.select(F.coalesce("host", F.lit("")).alias("suffix")).distinct()
    # Only suffixes that some rule names can match.
    keyed = (
        distinct.withColumn("suffix", F.explode(suffixes)).join(hosts, "suffix", "left_semi")
        .withColumn("key", _key(F.col("suffix"), F.col("_path")))
    )
    keyed = settle(keyed.select("_host", "_path", "key"))
    matched = _sweep(keyed.select("key").distinct(), _rule_stacks(rules))
    text = F.concat("rule.host", "rule.path")
    best = (
        keyed.join(matched, "key")
        .groupBy("_host", "_path")
        .agg(F.max(F.struct(F.length(text).alias("a"), F.length("rule.host").alias("b"), text.alias("rule"),
                            F.col("rule.verdict").alias("verdict"))).alias("best"))
    )
    judged = packed.join(settle(best), ["_host", "_path"], "left")
    return unpack(
        judged, pages.columns, host=F.col("_host"), path=F.col("_path"),
        rule=F.col("best.rule"), verdict=F.coalesce("best.verdict", F.lit(default)),
    )
