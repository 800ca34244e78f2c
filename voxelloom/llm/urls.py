"""URL filters: dated list entries against captures, as of the fetch time.

A list is a log of entries ``(list_name, kind, rule, action, listed)``: from the day *listed* on, a rule
is put on the list or taken off it.  Entries become validity intervals, and a capture is judged by
the entries that were active on the day it was fetched.  Rules are exact URLs, URL prefixes that
end at a path segment, and hosts with their subdomains, so a capture meets them by equality on
each of its keys and never by a range over a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The captures that meet one rule on one day are dealt over so many keys.
SALTS = 8


def bare(url: Column) -> Column:
    """URL without scheme, user, port, query and fragment; the host in lower case."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(rest, "/", 1), r"^.*@", ""), r":\d+$", ""))
    host = F.regexp_replace(host, r"\.$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    return F.concat(host, path)


def keys(target: Column) -> Column:
    """``(kind, rule)`` of all rules that can match a bare URL."""
    host = F.substring_index(target, "/", 1)
    labels = F.split(host, r"\.")
    parts = F.split(target, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("rule")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("rule")))
    exact = F.array(F.struct(F.lit("url").alias("kind"), target.alias("rule")))
    return F.concat(hosts, prefixes, exact)


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, kind, rule, from_day, to_day``: when each rule is active, to_day exclusive or null.

    On a day with several entries of one rule, taking it off wins.  Entries with a null field or an
    unknown action do not count.  A rule has at most one state a day after the first grouping, so the
    window over a rule is bounded by the days of the log, however many rows repeat.
    """
    log = entries.select(F.col("list_name").cast("string"), F.col("kind").cast("string"), F.col("rule").cast("string"),
                         F.col("action").cast("string"), F.to_date("listed").alias("day"))
    log = log.where("action IN ('add', 'remove') AND list_name IS NOT NULL AND kind IS NOT NULL AND rule IS NOT NULL "
                    "AND day IS NOT NULL")
    days = log.groupBy("list_name", "kind", "rule", "day").agg((F.max("action") == "add").alias("active"))
    by_rule = Window.partitionBy("list_name", "kind", "rule").orderBy("day")
    changes = days.withColumn("before", F.coalesce(F.lag("active").over(by_rule), F.lit(False))).where("active <> before")
    spans = changes.select("*", F.col("day").alias("from_day"), F.lead("day").over(by_rule).alias("to_day"))
    return spans.where("active").select("list_name", "kind", "rule", "from_day", "to_day")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``url, fetched, n_lists, lists, rule`` for each different pair of url and fetch time.

    ``rule`` is the most specific active rule: the longest, then the first by kind and text.  A null or empty
    URL and a null time match no rule.
    """
    once = captures.select(F.col(url_col).cast("string").alias("url"),
                           F.col(time_col).cast("timestamp").alias("fetched")).distinct()
    spans = intervals(entries)
    # per rule one row: all its intervals over all lists, met by equality
    rules = spans.groupBy("kind", "rule").agg(F.collect_list(F.struct("list_name", "from_day", "to_day")).alias("spans"))
    probes = (once.where("url IS NOT NULL AND fetched IS NOT NULL")
              .select("url", "fetched", F.explode(F.array_distinct(keys(bare(F.col("url"))))).alias("k"))
              .select("url", "fetched", "k.kind", "k.rule", F.to_date("fetched").alias("day")).where("rule <> ''"))
    # probes of one rule on one day have one answer: counted first, a hot host is one row a day and task
    asked = probes.select("kind", "rule", "day").distinct()
    active = F.filter("spans", lambda s: (s["from_day"] <= F.col("day"))
                      & (s["to_day"].isNull() | (F.col("day") < s["to_day"])))
    answers = (asked.join(rules, ["kind", "rule"])
               .withColumn("lists", F.array_distinct(F.transform(active, lambda s: s["list_name"])))
               .where(F.size("lists") > 0)
               .select("kind", "rule", "day", "lists", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    hits = (probes.withColumn("salt", F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS)).cast("int"))
            .join(answers, ["kind", "rule", "day", "salt"]))
    best = F.max_by(F.col("rule"), F.struct(F.length("rule"), F.col("kind"), F.col("rule")))
    found = hits.groupBy("url", "fetched").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"), best.alias("rule"))
    return (once.join(found.withColumnsRenamed({"url": "u", "fetched": "f"}),
                      (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
            .select("url", "fetched", F.coalesce(F.size("lists"), F.lit(0)).cast("bigint").alias("n_lists"),
                    F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), "rule"))
