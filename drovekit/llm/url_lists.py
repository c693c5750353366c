"""URL filters over time: dated list entries become validity intervals, captures meet those of their time.

An entry adds or removes a pattern on a day: a domain (which holds for its subdomains) or a path
prefix of a host, to block or to allow. A pattern's entries in order give the intervals in which it
stands. A capture has a key for each suffix of its host and each prefix of its path; the as-of
join is an equality on key and calendar bucket, so that a pattern which changed often meets each
capture in one bucket only, with the interval test on top. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a calendar bucket.
BUCKET = 64
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dots; empty if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("."))


def path(url: Column) -> Column:
    """Path of a URL without query and fragment, as it is written; at least a slash."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def keys(url: Column) -> Column:
    """What entries could hold for a URL: d:<suffix> for each suffix of its host, p:<host>/<prefix> for each whole segment of its path."""
    labels, parts = F.split(host(url), r"\."), F.filter(F.split(path(url), "/"), lambda s: s != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    # sequence counts down where there are no segments; the filter takes that away
    counts = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda k: k > 0)
    prefixes = F.transform(counts, lambda k: F.concat(F.lit("p:"), host(url), F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, kind, since, until) from entries (key, kind, action, day): [since, until) of each added pattern.

    kind is block or allow, action is add or remove. Of entries of one day a removal counts last. A
    pattern that is added while it stands goes on. Entries with a null in any column don't count.
    """
    known = entries.select("key", "kind", "action", "day").dropna().filter(F.col("action").isin("add", "remove") & F.col("kind").isin("block", "allow")).groupBy("key", "kind", "day").agg(F.max("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("key", "kind").orderBy("day"))
    return known.withColumn("until", F.coalesce(after, F.to_date(F.lit(FOREVER)))).filter("action = 'add'").select("key", "kind", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, day): page_id, host, day, n_active, blocked, pattern.

    n_active counts the entries that stand on the capture's day. The longest pattern decides, an
    allowing one on a tie; pattern is the one that decides, null without any. A null url or day
    meets no entry and isn't blocked. Repeated captures are judged each; rows without a page_id as
    others. Other columns aren't read; without entries nothing is blocked.
    """
    rows = captures.select("page_id", "url", F.col("day").cast("date"))
    last = F.lit(captures.agg(F.max(F.col("day").cast("date"))).first()[0]).cast("date")
    bucket = lambda d: F.floor(F.unix_date(d) / BUCKET)
    spans = intervals(entries).filter(F.col("since") <= last)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.least(F.date_sub("until", 1), last)))))
    # captures of one URL and day meet the list once
    distinct = rows.filter("url is not null and day is not null").select("url", "day").distinct()
    each = distinct.withColumn("key", F.explode(keys(F.col("url")))).withColumn("bucket", bucket(F.col("day")))
    hit = each.join(spans, ["key", "bucket"]).filter("since <= day and day < until")
    first = F.max(F.struct(F.length("key").alias("n"), (F.col("kind") == "allow").alias("allow"), "key"))
    found = hit.groupBy("url", "day").agg(F.count("*").alias("n_active"), first.alias("top"))
    out = rows.alias("a").join(found.alias("b"), (F.col("a.url") == F.col("b.url")) & (F.col("a.day") == F.col("b.day")), "left")
    return out.select("a.page_id", host(F.col("a.url")).alias("host"), "a.day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce(~F.col("top.allow"), F.lit(False)).alias("blocked"), F.col("top.key").alias("pattern"))
