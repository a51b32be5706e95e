"""Layout tables: spans, lines, blocks, figures, reading order.

spans(doc_id, page_no, block_no, line_no, span_no, size, flags, font, text, y0)
and rectangles (doc_id, page_no, pos, x0, y0, x1, y1). A page is the unit that
is brought together; documents of any length stay spread over pages.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..ordering import broadcast_if_small, stored

PAGE = ["doc_id", "page_no"]
LINE = ["doc_id", "page_no", "block_no", "line_no"]

# Sizes assumed for a document without text.
DEFAULT_SIZES = {"body": 12.0, "h1": 24.0, "h2": 18.0, "h3": 14.0}


def font_sizes(spans: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Body and heading sizes (doc_id, body, h1, h2, h3) of every document.

    The size with most characters is the body, earliest first on a tie; the
    three largest sizes above body + 1 are the headings.
    """
    text = X.strip_blank(F.col("text"))
    place = F.struct("page_no", "block_no", "line_no", "span_no")
    counted = spans.where(text != "").groupBy("doc_id", F.round("size", 1).alias("size")).agg(
        F.sum(F.length(text)).alias("chars"), F.min(place).alias("first"))
    body = counted.groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("chars")).alias("c"), "first")).alias("body"))
    larger = counted.select("doc_id", "size").join(body, "doc_id").where(F.col("size") > F.col("body") + 1)
    w = Window.partitionBy("doc_id").orderBy(F.col("size").desc())
    ranked = larger.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)
    heads = ranked.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("_r") == i, F.col("size"))).alias(f"h{i}") for i in (1, 2, 3)])
    out = body.join(heads, "doc_id", "left")
    if documents is not None:
        out = documents.select("doc_id").join(out, "doc_id", "left")
        bare = F.col("body").isNull()
        out = out.select("doc_id", *[F.when(bare, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in DEFAULT_SIZES.items()])
    return out


def heading_level(size: Column, text: Column, flags: Column, strict: bool = True) -> Column:
    """0 for body text, 1 to 3 for headings; needs body, h1, h2 and h3 in the row."""
    by_size = (
        F.when(size >= F.col("h1") - 0.5, 1).when(size >= F.col("h2") - 0.5, 2)
        .when(size >= F.col("h3") - 0.5, 3).otherwise(0))
    if not strict:
        return by_size
    t = X.strip_blank(text)
    sentence = t.rlike(r"[.。!！?？]\z") & ~t.rlike(r"^[\d第]+[.、章节]")
    thin = (flags.bitwiseAND(F.lit(16)) == 0) & (by_size >= 2) & (size < F.col("body") + 2)
    return F.when(text == "", by_size).when((F.length(t) > 80) | sentence | thin, 0).otherwise(by_size)


# Name parts of monospace fonts.
MONOSPACE = [
    "courier", "consolas", "monaco", "menlo", "monospace", "source code", "fira code", "jetbrains", "inconsolata",
    "dejavu sans mono", "liberation mono", "ubuntu mono", "roboto mono", "robotomono", "sf mono", "cascadia", "hack",
]


def is_monospace(font: Column) -> Column:
    return X.mentions(F.lower(F.coalesce(font, F.lit(""))), MONOSPACE)


def format_span(text: Column, flags: Column) -> Column:
    """Bold and italic markers by flag bits 16 and 2."""
    t = X.strip_blank(X.strip_control(text))
    bold, italic = flags.bitwiseAND(F.lit(16)) != 0, flags.bitwiseAND(F.lit(2)) != 0
    mark = F.when(bold & italic, F.lit("***")).when(bold, F.lit("**")).when(italic, F.lit("*")).otherwise(F.lit(""))
    return F.when(t == "", F.lit("")).otherwise(F.concat(mark, t, mark))


def assemble_lines(spans: DataFrame, sizes: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Spans to line elements with heading, list and code flags."""
    clean = X.strip_control(F.col("text"))
    df = spans.withColumn("text", clean).join(broadcast_if_small(sizes), "doc_id")
    blank = ~F.col("text").rlike(r"\S")
    mono = is_monospace(F.col("font"))
    level = heading_level(F.col("size"), F.col("text"), F.col("flags"))
    shown = (
        F.when(blank | mono, F.col("text")).when(level > 0, X.strip_blank(F.col("text")))
        .otherwise(format_span(F.col("text"), F.col("flags"))))
    lines = df.groupBy(*LINE).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", shown.alias("t")))), lambda s: s["t"]), "").alias("t"),
        F.max(F.when(~blank, F.col("size"))).alias("size"),
        F.coalesce(F.bit_or(F.when(~blank, F.col("flags"))), F.lit(0)).alias("flags"),
        F.coalesce(F.bool_or(~blank & mono), F.lit(False)).alias("is_code"),
        F.min("y0").alias("y0"), *[F.first(c).alias(c) for c in ("body", "h1", "h2", "h3")],
    )
    lines = lines.withColumn("t", X.strip_blank(F.col("t"))).where(F.col("t") != "")
    if noise is not None:
        keys = noise.select("doc_id", F.col("text").alias("t")).distinct()
        lines = lines.join(broadcast_if_small(keys), ["doc_id", "t"], "left_anti")
    lines = lines.withColumn("t", X.merge_markers(F.col("t")))
    lines = lines.withColumns({"level": heading_level(F.coalesce("size", F.lit(0.0)), F.col("t"), F.col("flags")),
                               "_i": X.list_item(F.col("t"))})
    bare = F.regexp_replace("t", r"\*+([^*]+)\*+", "$1")
    content = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), bare)).when(
        F.col("_i.is_list"), F.col("_i.text")).otherwise(F.col("t"))
    return lines.select(*LINE, "y0", content.alias("content"), (F.col("level") > 0).alias("is_heading"),
                        F.col("_i.is_list").alias("is_list"), "is_code")


BOX = ["x0", "y0", "x1", "y1"]


def _level(b) -> Column:
    """Tiles of side 2 ** level that are about as long as the rectangle."""
    side = F.greatest(b[2] - b[0], b[3] - b[1])
    return F.when(side > 1, F.ceil(F.log2(side))).otherwise(0).cast("int")


def _tiles(rects: DataFrame, levels: Column) -> DataFrame:
    """``rects`` once for each tile that they touch on each of the levels."""
    on = lambda v, n: F.floor(v / F.pow(F.lit(2.0), n))
    cells = lambda n: F.flatten(F.transform(
        F.sequence(on(F.col("x0"), n), on(F.col("x1"), n)),
        lambda x: F.transform(F.sequence(on(F.col("y0"), n), on(F.col("y1"), n)), lambda y: F.struct(n.alias("tn"), x.alias("tx"), y.alias("ty")))))
    return rects.select("*", F.inline(F.flatten(F.transform(levels, cells))))


def _met(mine: DataFrame, others: DataFrame, when: Column, narrower: int | None, columns: list[str]) -> DataFrame:
    """Distinct ``columns`` of ``mine`` for which some rectangle of the page in ``others`` (columns ``_x0`` ..) satisfies ``when``.

    ``when`` holds only for rectangles that overlap. Each of ``others`` stands in the tiles of its own
    size; ``mine`` looks in the tiles of that size that it touches, on its own level less ``narrower``
    and on all wider ones in use. Without ``narrower`` the others look for ``mine`` as well. A pair is thus
    compared only where the two are close, however many rectangles a page has; it is only asked
    whether there is a match, so several common tiles do no harm.
    """
    some = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    mine, others, level = mine.where(some), others.where(some), _level(G.box())

    def looks(asking: DataFrame, asked: DataFrame) -> DataFrame:
        used = asked.agg(F.collect_set(level).alias("_used"))  # one row, at most as many numbers as doubles have exponents
        return _tiles(asking.join(F.broadcast(used)), F.filter("_used", lambda n: n >= level - (narrower or 0))).drop("_used")

    stands = lambda r: _tiles(r, F.array(level))
    found = None
    for here, there in [(looks(mine, others), stands(others))] + [(stands(mine), looks(others, mine))] * (narrower is None):
        there = there.select(*[F.col(c).alias(f"_{c}") for c in there.columns])
        same = [F.col(c) == F.col(f"_{c}") for c in (*PAGE, "tn", "tx", "ty")]
        got = here.join(there, reduce(Column.__and__, same, when), "left_semi").select(*columns)
        found = got if found is None else found.unionByName(got)
    return found.distinct()


#: Rectangles of a page up to which they are compared one by one, or folded in one row.
FEW = 128


def _crowded(rects: DataFrame) -> DataFrame:
    """Pages of more rectangles than FEW."""
    return rects.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > FEW).select(*PAGE)


def _without_met(rects: DataFrame, others: DataFrame, when: Column, narrower: int | None) -> DataFrame:
    """``rects`` without those that ``when`` matches to one of ``others`` on the page: page by page where those are few, else by tiles."""
    whole = lambda p: (F.col(f"{p}x1") > F.col(f"{p}x0")) & (F.col(f"{p}y1") > F.col(f"{p}y0"))
    spots, crowded = [*PAGE, *BOX], _crowded(others)
    few = others.join(crowded, PAGE, "left_anti").select(*[F.col(c).alias(f"_{c}") for c in spots])
    same = [F.col(c) == F.col(f"_{c}") for c in PAGE]
    left = rects.join(few, reduce(Column.__and__, [*same, whole(""), whole("_")], when), "left_anti")
    many = others.join(crowded, PAGE, "left_semi").select(*spots)
    return left.join(_met(rects.select(*spots), many, when, narrower, spots), spots, "left_anti").select(rects.columns)


def drop_blocks_in_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.6) -> DataFrame:
    """Blocks of which no table covers more than the share."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    mine, theirs = G.box(), G.box("_")
    covered = G.overlap(mine, theirs) > share * G.area(mine)
    return _without_met(blocks, tables, covered, _narrower(share))


def _narrower(share: float) -> int:
    """Levels by which a rectangle that covers so much of another may be narrower than it."""
    return 1 + math.ceil(math.log2(1 / share))


# Padding and limits of figure regions.
PADDING, MIN_WIDTH, MIN_HEIGHT, MIN_AREA, MAX_ASPECT = 4, 100, 80, 30_000, 8


def figure_candidates(drawings: DataFrame, tables: DataFrame) -> DataFrame:
    """Padded drawing regions large enough for a figure and not part of a table.

    drawings carry page_w and page_h besides the rectangle.
    """
    x0, y0, x1, y1 = G.box()
    zero = F.lit(0.0)
    padded = drawings.withColumns({
        "x0": F.greatest(x0 - PADDING, zero), "y0": F.greatest(y0 - PADDING, zero),
        "x1": F.least(x1 + PADDING, F.col("page_w")), "y1": F.least(y1 + PADDING, F.col("page_h")),
    })
    w, h = x1 - x0, y1 - y0
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0))
    big = padded.where((w >= MIN_WIDTH) & (h >= MIN_HEIGHT) & (G.area(G.box()) >= MIN_AREA) & (aspect <= MAX_ASPECT))
    mine, theirs = G.box(), G.box("_")
    in_table = G.overlap(mine, theirs) > 0.5 * F.least(G.area(mine), G.area(theirs))
    return _without_met(big, tables, in_table, None)


def suppress_contained(rects: DataFrame, share: float = 0.9) -> DataFrame:
    """Largest first, a rectangle mostly inside a kept one goes; output in (y0, x0) order per page.

    The choice depends on earlier choices. A page of few rectangles is folded in its row, in order of
    size; all larger pages are settled together, in rounds.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    columns = [*PAGE, "pos", *BOX]
    rects = rects.select(*columns)
    crowded = stored(_crowded(rects))
    kept = _folded(rects.join(broadcast_if_small(crowded), PAGE, "left_anti"), share)
    return kept if crowded.isEmpty() else kept.unionByName(_in_rounds(rects.join(broadcast_if_small(crowded), PAGE, "left_semi"), share))


def _folded(rects: DataFrame, share: float) -> DataFrame:
    item = F.struct((-G.area(G.box())).alias("a"), "pos", *BOX)
    pages = rects.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("_r"))  # FEW at most

    def step(kept, r):
        inner = (r["x0"], r["y0"], r["x1"], r["y1"])
        inside = F.exists(kept, lambda k: (r["a"] < 0) & (
            G.overlap(inner, (k["x0"], k["y0"], k["x1"], k["y1"])) / F.negative(r["a"]) >= share))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate(F.slice("_r", F.lit(2), F.size("_r")), F.slice("_r", 1, 1), step)
    return pages.select(*PAGE, F.inline(kept)).select(*PAGE, "pos", *BOX)


def _in_rounds(rects: DataFrame, share: float) -> DataFrame:
    """Rounds of two steps, each written; what a kept rectangle contains goes at once.

    First the FEW largest open rectangles of each page are folded, so every round settles that many
    whatever contains what; then each rectangle that no larger open one contains is kept, which
    settles all parts of a page side by side.
    """
    columns = rects.columns
    flat = ~F.coalesce(G.area(G.box()) > 0, F.lit(False))  # no area: neither contained nor containing
    rank = lambda p: F.struct(-G.area(G.box(p)), *[F.col(f"{p}{c}") for c in ("pos", *BOX)])
    holds = (rank("_") < rank("")) & (G.overlap(G.box(), G.box("_")) / G.area(G.box()) >= share)
    inside = lambda mine, others: _met(mine, others, holds, _narrower(share), columns)
    done, is_open = rects.where(flat), stored(rects.where(~flat).distinct())
    while not is_open.isEmpty():
        placed = is_open.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank(""))))
        head = stored(placed.where(F.col("_n") <= FEW).drop("_n"))
        stay = stored(_folded(head, share))
        rest = stored(is_open.join(head, columns, "left_anti").join(inside(is_open, stay), columns, "left_anti"))
        below = stored(inside(rest, rest))
        more = stored(rest.join(below, columns, "left_anti"))
        is_open = stored(below.join(inside(below, more), columns, "left_anti"))
        done = done.unionByName(stay).unionByName(more)
    return done


def reading_order(shapes: DataFrame, top: str = "y0", left: str | None = "x0", tie: str = "pos") -> DataFrame:
    """1-based order of the shapes of each page by top, then left; ties keep their order."""
    keys = [top] + ([left] if left else []) + [tie]
    return shapes.withColumn("order_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*keys)).cast("long"))


FIGURE_CAPTION = r"(?i)^(?:Figure|Fig\.?)\s*\d+\s*[:.|｜]"


def captions(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines that open a figure caption."""
    return lines.where(X.strip_blank(F.col(text)).rlike(FIGURE_CAPTION))
