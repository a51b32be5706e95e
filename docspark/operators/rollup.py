"""Duplicates, keyed merges, usage, validation and drift rollups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..ordering import broadcast_if_small, map_of, stored

# ---- duplicates ----------------------------------------------------------


def first_per_content(df: DataFrame, content: str, pos: str) -> DataFrame:
    """First row number of every distinct content, with the number of copies.

    Only hash and position are shuffled, after a partial count per task.
    """
    return df.groupBy(F.md5(content).alias("content_md5")).agg(F.min(pos).alias(pos), F.count(F.lit(1)).alias("copies"))


# Limits of the asset filter.
MIN_SIDE, MIN_AREA, MIN_BYTES, MIN_PAGE_SHARE, MAX_ASPECT, MIN_BPP, BPP_AREA = 100, 30_000, 2048, 0.05, 12, 0.08, 500_000


def filter_assets(assets: DataFrame) -> DataFrame:
    """Assets worth keeping: (doc_id, pos, width, height, n_bytes, content, render_w, ..).

    A duplicate is remembered once the size tests pass, before the later tests.
    """
    w, h = F.col("width"), F.col("height")
    sized = assets.where((w >= MIN_SIDE) & (h >= MIN_SIDE) & (w * h >= MIN_AREA) & (F.col("n_bytes") >= MIN_BYTES))
    rest = [c for c in assets.columns if c not in ("doc_id", "content")]
    first = sized.groupBy("doc_id", F.md5("content").alias("content_md5")).agg(F.min_by(F.struct(*rest), "pos").alias("a"))
    one = first.select("doc_id", "content_md5", "a.*")
    area = w * h
    on_page = (F.col("page_w") > 0) & (F.col("page_h") > 0)
    tiny = on_page & (F.try_divide("render_w", "page_w") < MIN_PAGE_SHARE) & (F.try_divide("render_h", "page_h") < MIN_PAGE_SHARE)
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))
    dull = (F.col("n_bytes") / area < MIN_BPP) & (area < BPP_AREA)
    return one.where(~F.coalesce(tiny, F.lit(False)) & (aspect <= MAX_ASPECT) & ~dull)


def canonical_markdown(c: Column) -> Column:
    """Text with run-dependent stamps and asset folder names masked."""
    t = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?md)^(\s*Crawled:\s+).*$", "$1__IGNORED__")
    t = F.regexp_replace(t, r"(?md)^(\s*Imported:\s+).*$", "$1__IGNORED__")
    t = F.regexp_replace(t, r"[^\s\]()/]+_files/", "__ASSET_DIR__/")
    return X.strip_blank(t)


def equivalent_documents(docs: DataFrame, text: str, path: str) -> DataFrame:
    """Each path with the first path of equal canonical content."""
    # the patterns run once over the texts
    keyed = stored(docs.select(path, F.sha2(canonical_markdown(F.col(text)), 256).alias("_key")))
    first = keyed.groupBy("_key").agg(F.min(path).alias("first_path"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(broadcast_if_small(first), "_key").select(path, "first_path", "copies")


# ---- keyed merges --------------------------------------------------------


def keyed_merge(existing: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """New rows replace old ones of the same key in place; others append in order.

    Of repeated new keys the last wins, at the first one's position. The result
    is ordered by (part, pos): part 0 is the old table, part 1 the additions.
    """
    cols = [c for c in existing.columns if c not in (key, pos)]
    last = new.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*cols), pos).alias("_new"), F.min(pos).alias("_new_pos"))
    old = existing.where(F.col(key).isNotNull()).select(key, F.col(pos).alias("_pos"), F.struct(*cols).alias("_old"))
    both = old.join(last, key, "full")
    value = F.coalesce("_new", "_old")
    return both.select(
        key, F.when(F.col("_pos").isNull(), 1).otherwise(0).cast("long").alias("part"),
        F.coalesce("_pos", "_new_pos").alias(pos), *[value[c].alias(c) for c in cols],
        F.col("_new").isNotNull().alias("replaced"))


def last_per_path(files: DataFrame, path: str, pos: str, size: str) -> DataFrame:
    """Repeated paths keep the last file."""
    return files.groupBy(path).agg(F.max_by(size, pos).alias(size), F.max(pos).alias(pos), F.count(F.lit(1)).alias("versions"))


def file_totals(files: DataFrame, path: str, pos: str, size: str) -> DataFrame:
    return last_per_path(files, path, pos, size).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum(size).alias("total_bytes"))


def safe_entry(name: Column) -> Column:
    """Relative archive path without root and dot parts; NULL when it climbs up."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


# ---- usage ---------------------------------------------------------------


def reference_occurrences(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """(doc_id, filename, occurrence_index) of every reference in reading order."""
    refs = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return docs.select("doc_id", F.posexplode(refs).alias("_p", "ref")).select(
        "doc_id", F.regexp_extract("ref", r"([^/]*)$", 1).alias("filename"), (F.col("_p") + 1).cast("long").alias("occurrence_index"))


def usage_counts(assets: DataFrame, occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """usage_count per asset; an asset nobody refers to counts once."""
    used = occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return assets.join(used, keys, "left").withColumn("usage_count", F.coalesce("_n", F.lit(1))).drop("_n")


def ratio_variants(occurrences: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    """Distinct display ratios per asset, one row each."""
    return occurrences.where(F.col(ratio).isNotNull()).select(*keys, ratio).distinct()


def shared_assets(usage: DataFrame, asset: str) -> DataFrame:
    """Assets used more than once, sorted."""
    return usage.groupBy(asset).agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > 1).orderBy(asset)


def slide_ledger(slides: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Slides with the number of children of each kind, zero when none.

    Every child table is counted on its own before the join, so nothing fans out.
    """
    out = slides
    for kind, df in children.items():
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{kind}")), key, "left")
    return out.na.fill(0, [f"n_{k}" for k in children])


def slide_ledger_items(slides: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """The ledger's lists in long form: (key, kind, seq, item) of children(key, seq, item)."""
    rows = None
    for kind, df in children.items():
        part = df.select(key, F.lit(kind).alias("kind"), "seq", "item")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(slides.select(key), key, "left_semi")


def frequency_rank(df: DataFrame, value: Column, limit: int, buckets: int = 1 << 12) -> DataFrame:
    """Most frequent values (value, count), ties by value, without a shuffle of every distinct value.

    Three steps. Rows are counted by hash bucket, at most ``buckets`` rows a task. The values of the
    fullest buckets are counted exactly; the ``limit``-th of these counts is a bound that the result
    cannot fall below. A value reaches the bound only in a bucket that does, so at last the values of
    the other such buckets are counted. Where no other bucket reaches it, nothing is read for it.

    NULL is no value; fewer values than ``limit`` give them all; a limit below 1 is an error.
    """
    if limit < 1 or buckets < 1:
        raise ValueError("limit and buckets must be 1 or greater")
    rows = df.select(value.alias("value")).where(F.col("value").isNotNull())
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets))
    filled = rows.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))

    def counted(chosen: DataFrame) -> DataFrame:
        # at most ``buckets`` numbers
        inside = rows.join(F.broadcast(chosen), bucket == F.col("_b"), "left_semi")
        return inside.groupBy("value").agg(F.count(F.lit(1)).alias("count"))

    def best(counts: DataFrame) -> DataFrame:
        return counts.orderBy(F.col("count").desc(), "value").limit(limit)

    fullest = filled.orderBy(F.col("_n").desc(), "_b").limit(min(2 * limit, buckets)).select("_b")
    leading = best(counted(fullest))
    bound = leading.agg(F.when(F.count(F.lit(1)) == limit, F.min("count")).otherwise(F.lit(0)).alias("_least"))
    others = filled.join(F.broadcast(bound), F.col("_n") >= F.col("_least")).select("_b").join(F.broadcast(fullest), "_b", "left_anti")
    return best(leading.unionByName(counted(others)))


def chart_totals(charts: DataFrame) -> DataFrame:
    """charts(.., plot_types, series_count): counts over all charts."""
    return charts.agg(
        F.count(F.lit(1)).alias("chart_count"), F.coalesce(F.sum("series_count"), F.lit(0)).alias("series_count"),
        F.count_if(F.size("plot_types") > 1).alias("multi_plot_chart_count"))


def table_totals(tables: DataFrame) -> DataFrame:
    """tables(.., row_count, column_count): counts over all tables."""
    return tables.agg(F.count(F.lit(1)).alias("table_count"))


def chart_value(c: Column) -> Column:
    """Data point as text; whole numbers without a fraction."""
    whole = c == F.floor(c)
    return F.when(c.isNull(), F.lit("")).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def chart_grid(points: DataFrame, series: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Markdown lines (chart_id, line_no, line) of charts.

    series(chart_id, name, chart_type, series_pos, series) lists the columns,
    points(chart_id, series_pos, idx, value) the values, categories(chart_id,
    idx, label) the rows; without categories rows are numbered from 1.
    """
    heads = series.groupBy("chart_id").agg(
        F.first("name").alias("name"), F.first("chart_type").alias("chart_type"),
        F.sort_array(F.collect_list(F.struct("series_pos", "series"))).alias("_s"))
    names = F.transform("_s", lambda s: s["series"])
    corner = F.lit("#" if categories is None else "Category")
    title = F.concat(F.lit("> [Chart] "), "name", F.when(F.col("chart_type") != "", F.concat(F.lit(" — "), "chart_type")).otherwise(F.lit("")))

    def row(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    top = heads.select("chart_id", F.posexplode(F.array(
        title, F.lit(""), row(F.concat(F.array(corner), names)),
        row(F.transform(F.concat(F.array(corner), names), lambda _: F.lit("---"))))).alias("_p", "line"))
    top = top.select("chart_id", (F.col("_p") + 1).cast("long").alias("line_no"), "line")
    values = points.groupBy("chart_id", "idx").agg(
        map_of("series_pos", chart_value(F.col("value"))).alias("_v"))
    if categories is None:
        rows = values.withColumn("label", (F.col("idx") + 1).cast("string"))
    else:
        rows = categories.join(values, ["chart_id", "idx"], "left")
    rows = rows.join(broadcast_if_small(heads.select("chart_id", "_s")), "chart_id")
    cells = F.concat(F.array(F.coalesce("label", F.lit(""))), F.transform(
        "_s", lambda s: F.coalesce(F.try_element_at(F.col("_v"), s["series_pos"]), F.lit(""))))
    body = rows.select("chart_id", (F.col("idx") + 5).alias("line_no"), row(cells).alias("line"))
    return top.unionByName(body)


# ---- validation ----------------------------------------------------------


def _percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(n / total * 100)).cast("long")


def validation_summary(checked: DataFrame) -> DataFrame:
    """checked(errors, warnings, missing_readme, missing_spec): one row of totals.

    Errors rank before warnings; percentages are cut, not rounded.
    """
    e, w = F.size("errors") > 0, F.size("warnings") > 0
    n = F.count(F.lit(1))
    valid, failed, warned = F.count_if(~e & ~w), F.count_if(e), F.count_if(~e & w)
    return checked.agg(
        n.alias("total"), valid.alias("valid"), _percent(valid, n).alias("valid_pct"),
        failed.alias("has_errors"), _percent(failed, n).alias("errors_pct"),
        warned.alias("has_warnings"), _percent(warned, n).alias("warnings_pct"),
        F.count_if("missing_readme").alias("missing_readme"), F.count_if("missing_spec").alias("missing_spec"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Row count per value, largest first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def issue_category(message: Column) -> Column:
    return (
        F.when(message.contains("Invalid XML"), F.lit("XML well-formedness"))
        .when(message.contains("viewBox"), F.lit("viewBox issues"))
        .when(message.contains("foreignObject"), F.lit("foreignObject"))
        .when(F.lower(message).contains("font"), F.lit("Font issues"))
        .otherwise(F.lit("Other")))


# Envelope of sizes relative to the body size.
RAMP_MIN, RAMP_MAX = 0.5, 5.0


def normalize_size(c: Column) -> Column:
    v = F.lower(X.strip_blank(c))
    return X.strip_blank(F.regexp_replace(v, r"px\z", ""))


def normalize_font_stack(c: Column) -> Column:
    parts = F.transform(F.split(c, ","), lambda p: F.lower(F.regexp_replace(X.strip_blank(p), "^[\"']+|[\"']+$", "")))
    return F.array_join(F.filter(parts, lambda p: p != ""), ",")


def _plain_stack(stack: str) -> str:
    parts = [p.strip().strip("\"'").lower() for p in stack.split(",")]
    return ",".join(p for p in parts if p)


def allow_list_drift(
    files: DataFrame, file: str, markup: str, colors: list[str], fonts: list[str], sizes: list[str],
    body: float | None = None, poster: bool = False,
) -> DataFrame:
    """(file, category, value): distinct values of a file outside the allowed lists.

    The allowed lists are the options of one run; sizes also pass when their
    ratio to the body size lies in the ramp, without an upper end for posters.
    """
    m = F.col(markup)
    used_colors = F.transform(
        F.regexp_extract_all(m, F.lit(r"""\b(?:fill|stroke|stop-color)\s*=\s*["'](#[0-9A-Fa-f]{3,8})["']"""), F.lit(1)), F.upper)
    ok_colors = [c.upper() for c in colors]
    stacks = F.transform(
        F.regexp_extract_all(m, F.lit(r"""font-family\s*=\s*("[^"\n]*"|'[^'\n]*')"""), F.lit(1)),
        lambda s: X.strip_blank(s.substr(F.lit(2), F.length(s) - 2)))
    ok_fonts = [_plain_stack(f) for f in fonts]
    used_sizes = F.transform(F.regexp_extract_all(m, F.lit(r"""font-size\s*=\s*["']([^"']+)["']"""), F.lit(1)), normalize_size)
    ok_sizes = [re.sub(r"px$", "", s.strip().lower()).strip() for s in sizes]

    def size_drifts(s):
        ratio = s.try_cast("double") / F.lit(body)
        in_ramp = ratio >= RAMP_MIN if poster else ratio.between(RAMP_MIN, RAMP_MAX)
        out = ~s.isin(ok_sizes)
        return out & ~F.coalesce(in_ramp, F.lit(False)) if body else out

    found = F.concat(
        F.transform(F.filter(used_colors, lambda c: ~c.isin(ok_colors)), lambda v: F.struct(F.lit("colors").alias("category"), v.alias("value"))),
        F.transform(F.filter(stacks, lambda f: ~normalize_font_stack(f).isin(ok_fonts) if ok_fonts else F.lit(False)),
                    lambda v: F.struct(F.lit("fonts").alias("category"), v.alias("value"))),
        F.transform(F.filter(used_sizes, lambda s: size_drifts(s) if ok_sizes else F.lit(False)),
                    lambda v: F.struct(F.lit("sizes").alias("category"), v.alias("value"))),
    )
    return files.select(file, F.inline(F.array_distinct(found)))


def drift_summary(drift: DataFrame, file: str) -> DataFrame:
    """Distinct files per drifting value, most frequent first.

    Each file names a value once already, so a plain count is exact.
    """
    return drift.groupBy("category", "value").agg(F.count(file).alias("files")).orderBy("category", F.col("files").desc(), "value")


def small_size_drift(
    used: DataFrame, file: str, size: str, allowed: list[str], body: float, shown: int | None = None,
) -> DataFrame:
    """(file, message): undeclared sizes that read as left over from a template.

    Two counting steps keep a file with very many uses spread; only the distinct
    sizes of a file, or the ``shown`` smallest, are brought together for its message.
    """
    if not allowed or not body or body <= 0:
        raise ValueError("allowed sizes and a positive body size are needed")
    try:
        floor = min(float(v) for v in allowed)
    except ValueError:
        floor = None
    n = F.col(size).try_cast("double")
    below = n < floor if floor is not None else F.lit(False)
    odd = used.where(~F.col(size).isin(allowed) & n.isNotNull() & ((n <= body * 0.75) | below))
    counted = odd.groupBy(file, size).agg(F.count(F.lit(1)).alias("n")).withColumn("_v", F.col(size).cast("double"))
    under = F.max((F.col("_v") < floor).cast("int")) if floor is not None else F.max(F.lit(0))
    per_file = counted.groupBy(file).agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"), under.alias("under"))
    flagged = per_file.where((F.col("distinct") >= 2) | (F.col("total") >= 4) | (F.col("under") == 1))
    w = Window.partitionBy(file).orderBy("_v", size)
    top = counted.withColumn("_r", F.row_number().over(w))
    if shown is not None:
        top = top.where(F.col("_r") <= shown)
    text = F.concat(F.col(size), F.when(F.col("n") > 1, F.concat(F.lit("x"), "n")).otherwise(F.lit("")))
    samples = top.groupBy(file).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), ", ").alias("_sample"))
    more = F.lit("") if shown is None else F.when(
        F.col("distinct") > shown, F.concat(F.lit(" (+"), F.col("distinct") - shown, F.lit(" more)"))).otherwise(F.lit(""))
    return flagged.join(samples, file).select(file, F.concat(
        F.lit("possible template font-size drift: undeclared sub-body size(s) "), "_sample", more,
        F.lit(". Map each text item to a spec_lock typography role first, then reflow card height / y / dy / line-height "
              "from the locked px values.")).alias("message"))


# ---- names, folders, indexes ---------------------------------------------

# Canvas formats with display names, and their aliases.
CANVAS_FORMATS = {
    "ppt169": "PPT 16:9", "ppt43": "PPT 4:3", "wechat": "WeChat Article Header", "xiaohongshu": "小红书",
    "moments": "Moments/Instagram", "story": "Story/Vertical", "banner": "Horizontal Banner", "a4": "A4 Print",
}
CANVAS_ALIASES = {
    "xhs": "xiaohongshu", "wechat_moment": "moments", "wechat-moment": "moments", "朋友圈": "moments", "小红书": "xiaohongshu",
}


def _lookup(d: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def parse_project_name(name: Column) -> Column:
    """struct(name, format, format_name, date, date_formatted) of ``name_format_YYYYMMDD``."""
    low = F.lower(name)
    date = X.empty_to_null(F.regexp_extract(name, r"_(\d{8})$", 1))
    day = F.try_to_date(date, "yyyyMMdd")
    full = r"^(.+)_([a-z0-9_-]+)_(\d{8})$"
    raw = F.regexp_extract(low, full, 2)
    key = F.coalesce(_lookup(CANVAS_ALIASES, raw), raw)
    standard = _lookup(CANVAS_FORMATS, key).isNotNull()
    tail = F.lit(None).cast("string")
    for fmt in sorted(CANVAS_FORMATS, key=len, reverse=True):
        tail = F.coalesce(tail, F.when(low.rlike(rf"_{fmt}(?:_\d{{8}})?$"), F.lit(fmt)))
    fmt = F.when(standard, key).otherwise(tail)
    undated = F.regexp_replace(name, r"_\d{8}$", "")
    stripped = F.when(tail.isNotNull(), F.substring(undated, F.lit(1), F.length(undated) - F.length(tail) - 1))
    ends = F.lower(undated).endswith(F.concat(F.lit("_"), tail))
    short = F.when(ends, stripped).otherwise(undated)
    return F.struct(
        F.when(standard, F.substring(name, F.lit(1), F.length(F.regexp_extract(low, full, 1)))).otherwise(short).alias("name"),
        F.coalesce(fmt, F.lit("unknown")).alias("format"),
        F.coalesce(_lookup(CANVAS_FORMATS, fmt), F.lit("Unknown format")).alias("format_name"),
        F.coalesce(date, F.lit("unknown")).alias("date"),
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("Unknown date")).alias("date_formatted"))


def folder_statistics(files: DataFrame, path: str, size: str) -> DataFrame:
    """File count and bytes per extension; the row without one holds the totals of all files."""
    ext = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]*)$", 1)
    by_ext = files.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    total = by_ext.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).select(F.lit("*").alias("extension"), "files", "bytes")
    return by_ext.unionByName(total)


def index_formats(projects: DataFrame, fmt: str, amount: str) -> DataFrame:
    """Projects and summed amount per format, most projects first."""
    return projects.groupBy(fmt).agg(F.count(F.lit(1)).alias("projects"), F.sum(amount).alias("amount")).orderBy(
        F.col("projects").desc(), fmt)


def index_recent(projects: DataFrame, date: str, tie: str, n: int = 5) -> DataFrame:
    """The newest projects; a top-n, not a full sort."""
    return projects.orderBy(F.col(date).desc(), tie).limit(n)


def landscape_suggestion(images: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Warning per document of images(doc_id, width, height) that is mostly landscape.

    Documents listed in ``explicit`` chose an orientation and get none.
    """
    counts = images.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("width") > F.col("height") * 1.2).alias("wide"))
    counts = counts.where((F.col("n") >= 3) & (F.col("wide") / F.col("n") >= 0.6))
    if explicit is not None:
        counts = counts.join(broadcast_if_small(explicit.select("doc_id")), "doc_id", "left_anti")
    return counts.select("doc_id", F.concat(
        "wide", F.lit(" of "), "n",
        F.lit(" embedded images are landscape-oriented; consider landscape: true for better page usage")).alias("warning"))


# ---- read-back, replacement, selectors -----------------------------------


def read_back_misses(tokens: DataFrame, outputs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens(doc_id, slide, token) that the output text does not contain.

    All blanks are ignored; an empty token always passes. A document's tokens come
    together as one row, so its text is moved and flattened once.
    """
    flat = X.remove_whitespace
    want = tokens.select("doc_id", "slide", "token").distinct().groupBy("doc_id").agg(
        F.collect_list(F.struct("slide", "token", flat(F.col("token")).alias("flat"))).alias("_want"))
    got = outputs.select("doc_id", flat(F.col(text)).alias("_flat"))
    missed = F.filter("_want", lambda t: ~F.coalesce(F.contains(F.col("_flat"), t["flat"]), F.lit(False)) & (t["flat"] != ""))
    return want.join(got, "doc_id", "left").select("doc_id", F.inline(missed)).select("doc_id", "slide", "token")


_HEX = re.compile(r"#(?:[0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})")


def replace_color(files: DataFrame, text: str, old: str, new: str, dry_run: bool = False) -> DataFrame:
    """Files that hold the colour in any case, with hit count and the new text."""
    if not _HEX.fullmatch(old) or not _HEX.fullmatch(new):
        raise ValueError(f"not a HEX color: old={old!r} new={new!r}")
    pattern = f"(?i){re.escape(old)}"
    out = files.withColumn("hits", F.regexp_count(F.col(text), F.lit(pattern)).cast("long")).where(F.col("hits") > 0)
    return out if dry_run else out.withColumn(text, F.regexp_replace(F.col(text), pattern, new))


SELECTORS = ["slot_id", "shape_id", "shape_name"]


def resolve_edits(edits: DataFrame, slots: DataFrame) -> DataFrame:
    """edits(edit_id, slide, slot_id, shape_id, shape_name, text) to slots(slide, seq, ..).

    The first selector that finds a slot wins; of slots sharing a selector the
    last one counts. ``target`` is its seq, NULL for an unresolved edit.
    """
    out = edits
    for s in SELECTORS:
        keys = slots.where(F.coalesce(F.col(s).cast("string"), F.lit("")) != "").groupBy("slide", s).agg(F.max("seq").alias(f"_{s}"))
        out = out.join(broadcast_if_small(keys), ["slide", s], "left")
    named = [F.when(F.coalesce(F.col(s).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{s}:"), s)) for s in SELECTORS]
    return out.select(
        "edit_id", "slide", "text", F.coalesce(*[F.col(f"_{s}") for s in SELECTORS]).alias("target"),
        F.coalesce(*named, F.lit("")).alias("selector")
    ).withColumn("error", F.when(F.col("target").isNull(), F.lit("replacement target not found in slide library")))


# ---- text fit ------------------------------------------------------------


def _capacity() -> Column:
    """Estimated width units of a text box; NULL without a usable box."""
    w, h, role = F.col("width"), F.col("height"), F.col("role")
    old_p, new_p = F.col("old_paragraphs"), F.col("new_paragraphs")
    inferred = h / F.greatest(old_p, F.lit(1)) / 1.25
    guess = (
        F.when((old_p > 0) & inferred.between(8, 56), inferred).when(role == "title_candidate", 28.0)
        .when(role == "body_candidate", 16.0).otherwise(14.0))
    size = F.when(F.col("font_size_px") > 0, F.col("font_size_px")).otherwise(guess)
    lines = F.greatest(F.floor(h / F.greatest(size * 1.25, F.lit(1.0))), old_p, new_p, F.lit(1))
    usable = F.greatest(w - F.when(w >= 180, 24).otherwise(12), w * 0.72, F.lit(1.0))
    units = usable / F.greatest(size * 0.52, F.lit(1.0)) * lines
    scaled = F.when(role == "label_candidate", units * 0.7).when(role == "title_candidate", units * 0.85).otherwise(units)
    return F.when((w > 0) & (h > 0), scaled)


def text_fit(pairs: DataFrame) -> DataFrame:
    """OK / WARN with its reason for pairs(role, old_text, new_text, old_paragraphs, width, height, font_size_px, ..)."""
    lines = F.filter(F.split(F.regexp_replace("new_text", r"\r\n?", "\n"), "\n"), lambda t: t.rlike(r"\S"))
    df = pairs.withColumns({
        "old_width": F.greatest(X.visual_width(F.col("old_text")), F.lit(1.0)),
        "new_width": X.visual_width(F.col("new_text")).cast("double"),
        "new_paragraphs": F.greatest(F.size(lines), F.lit(1)).cast("long"),
    })
    df = df.withColumn("_cap", _capacity())
    old, new, cap, role = F.col("old_width"), F.col("new_width"), F.col("_cap"), F.col("role")
    old_p, new_p, ratio = F.col("old_paragraphs"), F.col("new_paragraphs"), F.col("new_width") / F.col("old_width")
    fits = F.coalesce(new <= cap, F.lit(False))
    label = (role == "label_candidate") | ((old <= 8) & (old_p <= 1))
    label_limit = F.when(F.col("width") >= 220, F.greatest(old, old * 1.25)).otherwise(old)
    title = (role == "title_candidate") & (old_p <= 1)

    def case(status, message):
        return F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))

    verdict = (
        F.when(label & fits & (old > 8), case("OK", "short label fits estimated text-box capacity"))
        .when(label & (new > label_limit), case("WARN", "short label exceeds original visual width; rewrite shorter"))
        .when(label, case("OK", "short label fits original visual width"))
        .when(title & fits, case("OK", "title fits estimated text-box capacity"))
        .when(title & (ratio > F.when(old <= 12, 1.15).otherwise(1.35)),
              case("WARN", "title is too long for the original slot; rewrite first"))
        .when(title, case("OK", "title stays near original capacity"))
        .when(new_p > F.greatest(old_p + 2, old_p * 2, F.lit(2)),
              case("WARN", "body paragraph count changed too much; compress or split pages"))
        .when((F.col("width") * F.col("height") < 30000) & (ratio > 2.0),
              case("WARN", "small text box with much longer text; rewrite shorter"))
        .when(F.coalesce(new > cap, F.lit(False)), case("WARN", "text exceeds estimated text-box capacity; rewrite or split"))
        .when(ratio > F.when(role == "body_candidate", 3.0).otherwise(2.2),
              case("WARN", "text is much longer than source slot; rewrite or choose another page"))
        .otherwise(case("OK", "within estimated slot capacity")))
    return df.withColumn("_v", verdict).select(
        *pairs.columns, "old_width", "new_width", "new_paragraphs", "_v.status", "_v.message").drop("old_text", "new_text")


def fit_summary(rated: DataFrame) -> DataFrame:
    return rated.agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "WARN").alias("warn"))


# ---- page roles ----------------------------------------------------------

# Keywords of closing, contents and chapter pages.
CLOSING = ["thank", "thanks", "q&a", "qa", "contact", "致谢", "谢谢", "感谢", "答疑", "联系方式"]
CONTENTS = ["agenda", "contents", "content", "outline", "目录", "议程"]
CHAPTER = ["chapter", "part", "section", "章节", "部分"]


def page_type(index: Column, total: Column, text: Column, slots: Column) -> Column:
    """Role of a deck page, position first."""
    low = F.lower(text)
    return (
        F.when(index == 1, F.lit("cover_candidate"))
        .when((index == total) | X.mentions(low, CLOSING), F.lit("ending_candidate"))
        .when(X.mentions(low, CONTENTS), F.lit("toc_candidate"))
        .when(X.mentions(low, CHAPTER), F.lit("chapter_candidate"))
        .when((slots <= 2) & (F.length(text) <= 80), F.lit("chapter_candidate"))
        .otherwise(F.lit("content_candidate")))


def slide_type(index: Column, total: Column, text: Column, n_texts: Column, images: Column, shapes: Column) -> Column:
    """Role of an imported slide, keywords first."""
    low = F.lower(text)
    return (
        F.when(X.mentions(low, CLOSING), F.lit("ending_candidate"))
        .when(X.mentions(low, CONTENTS), F.lit("toc_candidate"))
        .when(X.mentions(low, CHAPTER), F.lit("chapter_candidate"))
        .when((index == 1) & (images <= 3), F.lit("cover_candidate"))
        .when((index == total) & (n_texts <= 6), F.lit("ending_candidate"))
        .when((n_texts <= 3) & (shapes <= 12), F.lit("chapter_candidate"))
        .otherwise(F.lit("content_candidate")))


def slot_role(order: Column, name: Column, y: Column, text: Column, text_nodes: Column) -> Column:
    """Role of a text slot by order, name, place and length."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when((order == 1) | low.contains("title") | low.contains("标题"), F.lit("title_candidate"))
        .when((y < 160) & (F.length(text) <= 80), F.lit("title_candidate"))
        .when((text_nodes >= 4) | (F.length(text) >= 120), F.lit("body_candidate"))
        .otherwise(F.lit("label_candidate")))
