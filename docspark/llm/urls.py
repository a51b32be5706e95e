"""Dated URL lists as validity intervals, and every capture judged by what was listed when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, small, written

#: Day after all days that a list can name.
FOREVER = 2_000_000_000


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port, a leading ``www.`` and closing dots; '' if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path of an absolute URL without query, fragment and closing slashes; '' for the root."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def url_keys(url: Column) -> Column:
    """All patterns that can match a URL: its host and the domains above it, and its host with each leading part of the path.

    Domain patterns look like ``example.org``, path patterns like ``example.org/a/b``.
    """
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    paths = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 2, i - 1), "/")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(
    entries: DataFrame, pattern_col: str = "pattern", day_col: str = "day", action_col: str = "action",
) -> DataFrame:
    """``(pattern, spans)``: for each pattern the intervals ``(lo, hi, action)`` in which it was listed, ``hi`` excluded.

    An entry says that from its day on the pattern is listed with its action (``block`` or
    ``allow``) or no longer listed (NULL action). Of entries of one pattern and day ``allow``
    comes before ``block`` before removal. Entries are first reduced to one for each pattern and
    day with map-side combine, so a pattern's history is at most as long as the calendar. Rows
    with NULL pattern or day are ignored; patterns are compared in lower-case hosts as given by
    :func:`url_keys`.
    """
    check_columns(entries, pattern_col, day_col, action_col)
    rank = F.when(F.col(action_col) == "allow", 2).when(F.col(action_col) == "block", 1).otherwise(0)
    per_day = (
        entries.where(F.col(pattern_col).isNotNull() & F.col(day_col).isNotNull())
        .groupBy(F.col(pattern_col).alias("pattern"), F.col(day_col).cast("int").alias("lo")).agg(F.max(rank).alias("r"))
    )
    by_day = Window.partitionBy("pattern").orderBy("lo")
    changed = per_day.withColumn("_before", F.lag("r").over(by_day)).where("_before IS NULL OR _before <> r")
    spans = changed.withColumn("hi", F.coalesce(F.lead("lo").over(by_day), F.lit(FOREVER))).where("r > 0")
    action = F.when(F.col("r") == 2, "allow").otherwise("block").alias("action")
    return spans.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", action))).alias("spans"))


def url_verdicts(
    captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day",
    pattern_col: str = "pattern", entry_day_col: str = "day", action_col: str = "action",
) -> DataFrame:
    """``captures`` with ``verdict`` (block, allow or none), ``matched`` (the deciding pattern) and ``n_active``.

    Active are the patterns of a URL that were listed on its fetch day; of them the longest
    decides. One join by pattern brings the history of a pattern; it has one row a pattern, so
    no capture is multiplied, and it is broadcast only when its files prove it small; else
    AQE splits a hot host. Verdicts are made once for each URL and day.

    NULL or relative URLs and NULL days match nothing; repeated captures get equal verdicts; an
    empty list gives ``none`` everywhere; the columns verdict, matched and n_active replace
    columns of those names.
    """
    check_columns(captures, url_col, day_col)
    history = written(intervals(entries, pattern_col, entry_day_col, action_col))
    fetched = captures.select(F.col(url_col).alias("_u"), F.col(day_col).cast("int").alias("_d")).where("_u IS NOT NULL AND _d IS NOT NULL").distinct()
    active = fetched.select("_u", "_d", F.explode(url_keys(F.col("_u"))).alias("pattern")).join(small(history), "pattern").select(
        "_u", "_d", "pattern",
        F.get(F.filter("spans", lambda s: (s["lo"] <= F.col("_d")) & (F.col("_d") < s["hi"])), F.lit(0))["action"].alias("action")
    ).where("action IS NOT NULL")
    best = active.groupBy("_u", "_d").agg(
        F.max(F.struct(F.length("pattern"), F.col("pattern"), F.col("action"))).alias("m"), F.count(F.lit(1)).alias("_n")
    ).select("_u", "_d", F.col("m.action").alias("_verdict"), F.col("m.pattern").alias("_matched"), "_n")
    c = captures.alias("c")
    joined = c.join(best, (F.col(f"c.`{url_col}`") == F.col("_u")) & (F.col(f"c.`{day_col}`").cast("int") == F.col("_d")), "left")
    kept = [F.col(f"c.`{x}`") for x in captures.columns if x not in ("verdict", "matched", "n_active")]
    return joined.select(
        *kept, F.coalesce("_verdict", F.lit("none")).alias("verdict"), F.col("_matched").alias("matched"),
        F.coalesce("_n", F.lit(0)).alias("n_active"),
    )


def site_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A dated list made from the pages themselves, so that it grows with them: ``pattern, day, action``.

    A host is blocked from day ``first % 200`` when its smallest page id ``first`` is even, taken
    off 60 days later when that id divides by 4 and listed again 120 days after the first day when
    it divides by 8. Every third host has its first path segment allowed from day 30 on.
    """
    seen = pages.select(host_of(F.col(url_col)).alias("host"), F.split(path_of(F.col(url_col)), "/")[1].alias("part"), F.col(id_col).alias("id")).where("host <> ''")
    hosts = seen.groupBy("host").agg(F.min("id").alias("first"), F.min("part").alias("part"))
    day = (F.col("first") % 200).cast("int")
    event = lambda pattern, when, action: F.struct(pattern.alias("pattern"), when.cast("int").alias("day"), F.lit(action).cast("string").alias("action"))
    events = F.array(
        F.when(F.col("first") % 2 == 0, event(F.col("host"), day, "block")),
        F.when(F.col("first") % 4 == 0, event(F.col("host"), day + 60, None)),
        F.when(F.col("first") % 8 == 0, event(F.col("host"), day + 120, "block")),
        F.when((F.col("first") % 3 == 0) & (F.col("part") != ""), event(F.concat("host", F.lit("/"), "part"), F.lit(30), "allow")),
    )
    return hosts.select(F.explode(events).alias("e")).where("e IS NOT NULL").select("e.*")
