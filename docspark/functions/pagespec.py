"""Page selections such as ``1-5,10`` as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip_blank

RANGE = r"^(\d+)\s*-\s*(\d+)$"


def _parts(spec: Column) -> Column:
    return F.transform(F.split(spec, ","), strip_blank)


def _end(part: Column, which: int) -> Column:
    """First or last page of a part; NULL when it is no positive integer."""
    text = F.when(part.rlike(r"^\d+$"), part).when(part.rlike(RANGE), F.regexp_extract(part, RANGE, which))
    n = text.try_cast("long")
    return F.when((n >= 1) & (n <= 9007199254740991), n)


def parse_ranges(spec: Column, limit: int | None = None) -> Column:
    """struct(ranges, error): disjoint (lo, hi, before) in input order, repeats dropped; NULL ranges mean all.

    ``before`` pages come earlier in the selection. Ranges are never unrolled; with ``limit``
    a selection of more pages is an error.
    """
    span = "array<struct<lo:bigint,hi:bigint,before:bigint>>"

    def without(acc, lo, hi):
        """The parts of lo..hi that no earlier range has."""
        def cut(parts, r):
            return F.filter(F.flatten(F.transform(parts, lambda p: F.array(
                F.struct(p["lo"].alias("lo"), F.least(p["hi"], r["lo"] - 1).alias("hi")),
                F.struct(F.greatest(p["lo"], r["hi"] + 1).alias("lo"), p["hi"].alias("hi"))))), lambda q: q["lo"] <= q["hi"])

        return F.aggregate(acc["ranges"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), cut)

    def placed(acc, parts):
        return F.aggregate(parts, F.struct(acc["ranges"].alias("ranges"), acc["total"].alias("total")), lambda a, p: F.struct(
            F.concat(a["ranges"], F.array(F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), a["total"].alias("before")))).cast(span).alias("ranges"),
            (a["total"] + p["hi"] - p["lo"] + 1).alias("total")))

    def step(acc, part):
        lo, hi = _end(part, 1), _end(part, 2)
        wrong = F.concat(F.lit('Invalid page range: "'), spec, F.lit('"'))
        down = F.concat(F.lit('Invalid page range (start > end): "'), spec, F.lit('"'))
        error = F.when(acc["error"].isNotNull(), acc["error"]).when(lo.isNull() | hi.isNull(), wrong).when(lo > hi, down)
        if limit is not None:
            many = F.concat(wrong, F.lit(f" selects more than {limit} pages"))
            error = error.when(part.contains("-") & (acc["total"] + hi - lo + 1 > limit), many)
        none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
        new = placed(acc, F.when(error.isNull(), without(acc, lo, hi)).otherwise(none))
        return F.struct(new["ranges"].alias("ranges"), new["total"].alias("total"), error.alias("error"))

    start = F.struct(
        F.array().cast(span).alias("ranges"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("error"))
    got = F.aggregate(_parts(spec), start, step)
    none = F.coalesce(spec, F.lit("")) == ""
    return F.struct(
        F.when(~none & got["error"].isNull(), got["ranges"]).alias("ranges"), F.when(~none, got["error"]).alias("error"))


def unrolled(ranges: Column) -> Column:
    """Every page of the ranges, for a selection that is to be shown."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))


def parse_strict(spec: Column, limit: int | None = None) -> Column:
    """struct(pages, error): :func:`parse_ranges` unrolled."""
    return let(parse_ranges(spec, limit), lambda r: F.struct(unrolled(r["ranges"]).alias("pages"), r["error"].alias("error")))


def parse_clamped(spec: Column, total: Column) -> Column:
    """struct(pages, error): 0-based, sorted; pages past the end become the last."""
    parts = _parts(spec)
    total = total.cast("long")

    def problem(p):
        lo, hi = p.substr(F.lit(1), F.length(p)), p
        single = p.rlike(r"^\d+$")
        lo = F.when(single, p).otherwise(F.regexp_extract(p, RANGE, 1)).try_cast("decimal(38,0)")
        hi = F.when(single, p).otherwise(F.regexp_extract(p, RANGE, 2)).try_cast("decimal(38,0)")
        return (
            F.when(p == "", F.concat(F.lit('Invalid pageRanges syntax: empty segment in "'), spec, F.lit('"')))
            .when(~single & ~p.rlike(RANGE),
                  F.concat(F.lit('Invalid pageRanges syntax: cannot parse "'), p, F.lit('" in "'), spec, F.lit('"')))
            .when(((lo < 1) | (hi < 1)) & single,
                  F.concat(F.lit('Invalid pageRanges syntax: page number must be >= 1, got "'), p, F.lit('"')))
            .when((lo < 1) | (hi < 1),
                  F.concat(F.lit('Invalid pageRanges syntax: page numbers must be >= 1, got "'), p, F.lit('"')))
            .when(lo > hi, F.concat(F.lit('Invalid pageRanges syntax: descending range "'), p, F.lit('" ('),
                                    lo, F.lit(">"), hi, F.lit(")")))
        )

    error = F.when(total <= 0, F.concat(
        F.lit("Invalid pageRanges: PDF has no pages (totalPages="), total, F.lit(")"))).otherwise(
        F.get(F.filter(F.transform(parts, problem), lambda e: e.isNotNull()), F.lit(0)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(
        parts, lambda p: F.sequence(F.least(_end(p, 1), total) - 1, F.least(_end(p, 2), total) - 1)))))
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def parse_targets(spec: Column) -> Column:
    """struct(ranges, error): wanted pages as ranges; blank parts are skipped."""
    parts = F.filter(_parts(spec), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.struct(
        F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(1))).otherwise(p).try_cast("long").alias("lo"),
        F.when(p.contains("-"), F.regexp_replace(p, r"^[^-]*-", "")).otherwise(p).try_cast("long").alias("hi"),
        p.alias("p")))
    bad = F.get(F.filter(ends, lambda e: e["lo"].isNull() | e["hi"].isNull() | (e["lo"] > e["hi"])), F.lit(0))
    error = F.when(bad.isNotNull(), F.concat(
        F.when(bad["lo"] > bad["hi"], F.lit("Descending range not allowed: '")).otherwise(F.lit("Invalid slide range: '")),
        bad["p"], F.lit("' in '"), spec, F.lit("'")))
    return F.struct(F.when(error.isNull(), ends).alias("ranges"), error.alias("error"))
