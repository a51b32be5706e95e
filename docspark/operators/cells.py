"""Spreadsheet operators on the long cell table.

``cells(sheet STRING, row LONG, col LONG, value STRING, num DOUBLE, type STRING)``
holds one row per non-empty cell; ``type`` is str, int, float, bool, datetime,
date or time and ``num`` is set for numbers and booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import a1
from ..functions import intervals as IV
from ..functions.text import is_blank, strip_blank
from ..ordering import broadcast_if_small, map_of, stored

CELL_COLUMNS = ["sheet", "row", "col", "value", "num", "type"]
KEY = ["sheet", "row", "col"]


def _cell_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "date" if isinstance(t, T.DateType) else "str"


def from_table(df: DataFrame, sheet: str, row: Column, columns: list[str]) -> DataFrame:
    """Cells of a table: a header in row 1, data rows numbered by ``row`` (>= 2)."""
    types = {f.name: _cell_type(f.dataType) for f in df.schema.fields}

    def cell(i, name):
        c, kind = F.col(name), types[name]
        num = c.cast("double") if kind in ("int", "float", "bool") else F.lit(None).cast("double")
        return F.struct(
            F.lit(i + 1).cast("long").alias("col"), c.cast("string").alias("value"),
            num.alias("num"), F.lit(kind).alias("type"),
        )

    body = df.select(
        row.cast("long").alias("row"), F.inline(F.array(*[cell(i, n) for i, n in enumerate(columns)]))
    ).where(F.col("value").isNotNull())
    spark = df.sparkSession
    head = spark.range(1).select(
        F.lit(1).cast("long").alias("row"),
        F.inline(F.array(*[
            F.struct(F.lit(i + 1).cast("long").alias("col"), F.lit(n).alias("value"),
                     F.lit(None).cast("double").alias("num"), F.lit("str").alias("type"))
            for i, n in enumerate(columns)
        ])),
    )
    return head.unionByName(body).select(F.lit(sheet).alias("sheet"), "row", "col", "value", "num", "type")


def _inside(r0, c0, r1, c1) -> Column:
    """Rectangle test with open ends where a bound is None."""
    test = F.lit(True)
    for col, lo, hi in (("row", r0, r1), ("col", c0, c1)):
        if lo is not None:
            test = test & (F.col(col) >= lo)
        if hi is not None:
            test = test & (F.col(col) <= hi)
    return test


def _on(sheet: str) -> Column:
    return F.col("sheet") == sheet


def bounds(cells: DataFrame) -> DataFrame:
    """First and last row and column per sheet over all stored cells."""
    return cells.groupBy("sheet").agg(
        F.min("row").alias("min_row"), F.min("col").alias("min_col"),
        F.max("row").alias("max_row"), F.max("col").alias("max_col"),
    )


# ---- reading -------------------------------------------------------------


def read_range(
    cells: DataFrame, sheet: str, start: str = "A1", end: str | None = None, preview: bool = False
) -> DataFrame:
    """Cells of a rectangle; rows without a value do not appear.

    A missing end means the end of the data. ``preview`` keeps the first ten
    rows that hold a value.
    """
    got = cells.where(_on(sheet) & F.col("value").isNotNull() & _inside(*a1.parse_range(start, end)))
    if preview:
        # at most ten row numbers: safe to broadcast
        first = got.select("row").distinct().orderBy("row").limit(10)
        got = got.join(F.broadcast(first), "row", "left_semi")
    return got.select("row", "col", "value", "num", "type")


def _dense_rows(limits: DataFrame, keep: list[str], chunk: int = 65_536) -> DataFrame:
    """One row per number from ``min_row`` to ``max_row``, built in spread-out chunks."""
    starts = limits.select(*keep, "min_row", "max_row", F.explode(
        F.sequence("min_row", F.greatest("min_row", "max_row"), F.lit(chunk).cast("long"))).alias("_from"))
    return starts.repartition("_from").select(
        *keep, F.explode(F.sequence("_from", F.least(F.col("_from") + chunk - 1, "max_row"))).alias("row")
    )


def read_range_with_metadata(
    cells: DataFrame, sheet: str, start: str = "A1", end: str | None = None,
    rules: DataFrame | None = None, preview: bool = False,
) -> DataFrame:
    """One row per cell of the rectangle, empty cells included."""
    r0, c0, r1, c1 = a1.parse_range(start, end)
    lim = bounds(cells.where(_on(sheet)))
    open_end = r1 is None
    from_first = open_end and start.upper() == "A1"
    lim = lim.where((F.col("max_row") >= r0) & (F.col("max_col") >= c0)).select(
        (F.col("min_row") if from_first else F.lit(r0).cast("long")).alias("min_row"),
        (F.col("min_col") if from_first else F.lit(c0).cast("long")).alias("min_col"),
        (F.col("max_row") if open_end else F.lit(r1).cast("long")).alias("max_row"),
        (F.col("max_col") if open_end else F.lit(c1).cast("long")).alias("max_col"),
    )
    if preview:
        lim = lim.withColumn("max_row", F.least(F.col("max_row"), F.col("min_row") + 9))
    grid = _dense_rows(lim, ["min_col", "max_col"]).select(
        F.lit(sheet).alias("sheet"), "row", F.explode(F.sequence("min_col", "max_col")).alias("col")
    )
    # cells are made of rows, so their estimate says nothing: without the hint a long sheet is broadcast
    out = grid.join(cells.where(_on(sheet)).hint("merge"), KEY, "left")
    keep = ["row", "col", "value"]
    if rules is not None:
        out = validation_for_cells(out, rules)
        keep += ["validation_type", "rule_no"]
    return out.select(a1.address(F.col("row"), F.col("col")).alias("address"), *keep)


# ---- writing -------------------------------------------------------------


def block_cells(block: DataFrame, sheet: str, start: str = "A1") -> DataFrame:
    """A block of (i, j, value, num, type), 0-based, placed at a start cell."""
    r0, c0 = a1.parse_ref(start)
    return block.select(
        F.lit(sheet).alias("sheet"), (F.col("i") + r0).alias("row"), (F.col("j") + c0).alias("col"),
        "value", "num", "type",
    )


def upsert(cells: DataFrame, new: DataFrame) -> DataFrame:
    """New cells replace covered ones; a NULL value empties the cell."""
    kept = cells.join(broadcast_if_small(new.select(*KEY)), KEY, "left_anti")
    return kept.select(*CELL_COLUMNS).unionByName(new.where(F.col("value").isNotNull()).select(*CELL_COLUMNS))


def write_block(cells: DataFrame, block: DataFrame, sheet: str, start: str = "A1") -> DataFrame:
    """Ragged 2-D block over the sheet; an unknown sheet simply appears."""
    return upsert(cells, block_cells(block, sheet, start))


def block_from_rows(spark, rows: list[list]) -> DataFrame:
    """Small literal block given as a list of rows."""
    if not rows:
        raise ValueError("No data provided to write")
    out = []
    for i, row in enumerate(rows):
        if not isinstance(row, list):
            raise ValueError(f"Row {i} is not a list")
        for j, v in enumerate(row):
            kind = {bool: "bool", int: "int", float: "float"}.get(type(v), "str")
            num = float(v) if kind != "str" else None
            text = None if v is None else str(v).lower() if kind == "bool" else str(v)
            out.append((i, j, text, num, kind))
    return spark.createDataFrame(out, "i LONG, j LONG, value STRING, num DOUBLE, type STRING")


def copy_range(
    cells: DataFrame, sheet: str, start: str, end: str | None, target: str, target_sheet: str | None = None
) -> DataFrame:
    """Copy a rectangle; empty source cells empty their target.

    Cells are copied one after the other in row order, so a target that
    overlaps its own source further on repeats the leading strip.
    """
    r0, c0, r1, c1 = a1.parse_range(start, end)
    r1, c1 = (r0, c0) if r1 is None else (r1, c1)
    t_row, t_col = a1.parse_ref(target)
    dr, dc = t_row - r0, t_col - c0
    dest = target_sheet or sheet
    source = cells.where(_on(sheet) & _inside(r0, c0, r1, c1))
    same = dest == sheet
    forward = same and (dr > 0 or (dr == 0 and dc > 0))
    if same and dr == 0 and dc == 0:
        return cells
    if forward:

        def steps(pos, lo, hi, d):
            room = (F.lit(hi) - pos) if d > 0 else (pos - F.lit(lo))
            return F.floor(room / abs(d)).cast("int")

        def fewest(parts):
            return F.least(*parts) if len(parts) > 1 else parts[0]

        row, col = F.col("row"), F.col("col")
        axes = [(row, r0, r1, dr)] * (dr != 0) + [(col, c0, c1, dc)] * (dc != 0)
        back = fewest([steps(p, lo, hi, -d) for p, lo, hi, d in axes])
        ahead = fewest([steps(p, lo, hi, d) for p, lo, hi, d in axes])
        source = source.where(back == 0).withColumn("_k", F.explode(F.sequence(F.lit(1), ahead + 1)))
    else:
        source = source.withColumn("_k", F.lit(1))
    moved = source.select(
        F.lit(dest).alias("sheet"), (F.col("row") + F.col("_k") * dr).alias("row"),
        (F.col("col") + F.col("_k") * dc).alias("col"), "value", "num", "type",
    )
    rest = cells.where(~(_on(dest) & _inside(r0 + dr, c0 + dc, r1 + dr, c1 + dc)))
    return rest.select(*CELL_COLUMNS).unionByName(moved)


def _close_up(cells: DataFrame, sheet: str, axis: str, first: int, count: int) -> DataFrame:
    pos = F.col(axis)
    gone = _on(sheet) & pos.between(first, first + count - 1)
    moved = F.when(_on(sheet) & (pos >= first + count), pos - count).otherwise(pos)
    return cells.where(~gone).withColumn(axis, moved)


def delete_range(
    cells: DataFrame, sheet: str, start: str, end: str | None = None, shift_direction: str = "up"
) -> DataFrame:
    """Removes the whole rows (up) or whole columns (left) of the range."""
    if shift_direction not in ("up", "left"):
        raise ValueError(f"Invalid shift direction: {shift_direction}. Must be 'up' or 'left'")
    r0, c0, r1, c1 = a1.parse_range(start, end)
    r1, c1 = (r0, c0) if r1 is None else (r1, c1)
    if shift_direction == "up":
        return _close_up(cells, sheet, "row", r0, r1 - r0 + 1)
    return _close_up(cells, sheet, "col", c0, c1 - c0 + 1)


def _check_count(start: int, count: int) -> None:
    if start < 1 or count < 1:
        raise ValueError("Start and count must be 1 or greater")


def _insert(cells, sheet, axis, start, count):
    _check_count(start, count)
    pos = F.col(axis)
    return cells.withColumn(axis, F.when(_on(sheet) & (pos >= start), pos + count).otherwise(pos))


def insert_rows(cells: DataFrame, sheet: str, start: int, count: int = 1) -> DataFrame:
    return _insert(cells, sheet, "row", start, count)


def insert_cols(cells: DataFrame, sheet: str, start: int, count: int = 1) -> DataFrame:
    return _insert(cells, sheet, "col", start, count)


def _delete(cells, sheet, axis, start, count):
    _check_count(start, count)
    if cells.where(_on(sheet) & (F.col(axis) >= start)).isEmpty():
        raise ValueError(f"Start {axis} {start} exceeds worksheet bounds")
    return _close_up(cells, sheet, axis, start, count)


def delete_rows(cells: DataFrame, sheet: str, start: int, count: int = 1) -> DataFrame:
    return _delete(cells, sheet, "row", start, count)


def delete_cols(cells: DataFrame, sheet: str, start: int, count: int = 1) -> DataFrame:
    return _delete(cells, sheet, "col", start, count)


# ---- sheets --------------------------------------------------------------


def _has_sheet(cells: DataFrame, name: str) -> bool:
    return not cells.where(_on(name)).isEmpty()


def _need(cells, source, target=None):
    if not _has_sheet(cells, source):
        raise ValueError(f"Sheet {source!r} not found")
    if target is not None and _has_sheet(cells, target):
        raise ValueError(f"Target sheet {target!r} already exists")


def copy_sheet(cells: DataFrame, source: str, target: str) -> DataFrame:
    _need(cells, source, target)
    return cells.unionByName(cells.where(_on(source)).withColumn("sheet", F.lit(target)))


def rename_sheet(cells: DataFrame, old: str, new: str) -> DataFrame:
    _need(cells, old, new)
    return cells.withColumn("sheet", F.when(_on(old), F.lit(new)).otherwise(F.col("sheet")))


def delete_sheet(cells: DataFrame, name: str) -> DataFrame:
    _need(cells, name)
    rest = cells.where(~_on(name))
    if rest.isEmpty():
        raise ValueError("Cannot delete the only sheet in workbook")
    return rest


# ---- merged cells and bounds ---------------------------------------------


def merged_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of merges(sheet, r0, c0, r1, c1) with its top-left content."""
    return _grid(_tops(cells.where(~is_blank(F.col("value"))), merges))


def _tops(cells: DataFrame, merges: DataFrame) -> DataFrame:
    return broadcast_if_small(merges).join(
        cells.select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), "value", "num", "type"), ["sheet", "r0", "c0"])


def _grid(top: DataFrame) -> DataFrame:
    # a merged range may be a whole column: its rows are made in chunks
    rows = _dense_rows(top.withColumnsRenamed({"r0": "min_row", "r1": "max_row"}), ["sheet", "c0", "c1", "value", "num", "type"])
    return rows.withColumn("col", F.explode(F.sequence("c0", "c1"))).select(*CELL_COLUMNS)


def cells_in_ranges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells beside each of ranges(sheet, r0, c0, r1, c1, ..) that covers them; other columns of both stay.

    A range stands under the dyadic intervals of its rows, a cell asks for its interval on every
    level in use: equal keys, so only ranges that share the cell's rows are looked at. The key table
    is written, and where it is small the cells are not shuffled.
    """
    spans = stored(ranges.select(
        F.col("sheet").alias("_s"), *[c for c in ranges.columns if c != "sheet"], F.inline(IV.cover(F.col("r0"), F.col("r1"))).alias("_level", "_at")))
    levels = spans.agg(F.collect_set("_level").alias("_levels"))  # one row of at most LEVELS numbers
    asked = cells.join(F.broadcast(levels)).withColumn("_p", F.explode(IV.places(F.col("row"), F.col("_levels")))).drop("_levels")
    same = (F.col("sheet") == F.col("_s")) & (F.col("_p.level") == F.col("_level")) & (F.col("_p.at") == F.col("_at"))
    return asked.join(broadcast_if_small(spans), same & F.col("col").between(F.col("c0"), F.col("c1"))).drop("_p", "_s", "_level", "_at")


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Empty cells of a merged range take the top-left content.

    Only cells inside merged ranges are brought together with them; a cell outside, or one with
    a value, is passed on as it is.
    """
    merges = stored(merges.select("sheet", "r0", "c0", "r1", "c1"))
    inside = stored(cells_in_ranges(cells.select(*CELL_COLUMNS), merges))
    top = stored(_tops(inside.where(~is_blank(F.col("value")) & (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))).select(*CELL_COLUMNS).distinct(), merges))
    content = [F.col(f"_{c}").alias(c) for c in CELL_COLUMNS[3:]]
    named = top.select("sheet", "r0", "c0", "r1", "c1", *[F.col(c).alias(f"_{c}") for c in CELL_COLUMNS[3:]])
    blank = stored(inside.where(is_blank(F.col("value"))).join(broadcast_if_small(named), ["sheet", "r0", "c0", "r1", "c1"]).select(*KEY, *content))
    as_is = cells.select(*CELL_COLUMNS).where(~is_blank(F.col("value"))).unionByName(
        cells.select(*CELL_COLUMNS).where(is_blank(F.col("value"))).join(broadcast_if_small(blank.select(*KEY)), KEY, "left_anti"))
    new = _grid(top).join(inside.select(*KEY).distinct(), KEY, "left_anti")
    return as_is.unionByName(blank).unionByName(new)


def content_bounds(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Bounds over non-blank and merged cells, with the used range as text."""
    spots = cells.where(~is_blank(F.col("value"))).select(*KEY)
    if merges is not None:
        corners = merges.join(spots, (merges.sheet == spots.sheet) & (merges.r0 == spots.row) & (merges.c0 == spots.col))
        # the two corners bound the whole rectangle
        ends = F.array(
            F.struct(F.col("r0").alias("row"), F.col("c0").alias("col")),
            F.struct(F.col("r1").alias("row"), F.col("c1").alias("col")),
        )
        spots = spots.unionByName(corners.select(merges.sheet, F.inline(ends)))
    lim = bounds(spots)
    return lim.withColumn(
        "used_range", a1.range_text(F.col("min_row"), F.col("min_col"), F.col("max_row"), F.col("max_col"))
    )


def validate_ranges(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """requests(req_id, sheet, start_cell, end_cell): first failing rule or the data range."""
    lim = broadcast_if_small(bounds(cells).drop("min_row", "min_col"))
    start = F.when(F.col("end_cell").isNull(), F.split_part("start_cell", F.lit(":"), F.lit(1))).otherwise(F.col("start_cell"))
    inner = F.when(F.col("start_cell").contains(":"), F.split_part("start_cell", F.lit(":"), F.lit(2)))
    end = F.coalesce("end_cell", inner, start)
    df = requests.join(lim, "sheet", "left").withColumns({"_s": start, "_e": end})
    df = df.withColumns({
        "_r0": a1.ref_row(F.col("_s")), "_c0": a1.ref_col(F.col("_s")),
        "_r1": a1.ref_row(F.col("_e")), "_c1": a1.ref_col(F.col("_e")),
    })
    last_col = a1.index_to_letters(F.col("max_col"))
    error = (
        F.when(F.col("max_row").isNull(), F.concat(F.lit("Sheet '"), "sheet", F.lit("' not found")))
        .when(F.col("_r0").isNull(), F.concat(F.lit("Invalid cell reference: '"), "_s", F.lit("'")))
        .when(F.col("_r1").isNull(), F.concat(F.lit("Invalid cell reference: '"), "_e", F.lit("'")))
        .when(F.col("_r0") > F.col("max_row"),
              F.concat(F.lit("Start row "), "_r0", F.lit(" out of bounds (1-"), "max_row", F.lit(")")))
        .when(F.col("_c0") > F.col("max_col"),
              F.concat(F.lit("Start column "), a1.index_to_letters(F.col("_c0")),
                       F.lit(" out of bounds (A-"), last_col, F.lit(")")))
        .when(F.col("_r1") < F.col("_r0"), F.lit("End row cannot be before start row"))
        .when(F.col("_c1") < F.col("_c0"), F.lit("End column cannot be before start column"))
    )
    df = df.withColumn("error", error)
    ok = F.col("error").isNull()
    return df.select(
        "req_id", ok.alias("valid"), "error",
        F.when(ok, F.concat(F.lit("A1:"), last_col, F.col("max_row"))).alias("data_range"),
        F.when(ok, (F.col("_r1") > F.col("max_row")) | (F.col("_c1") > F.col("max_col"))).alias("extends_beyond_data"),
    )


# ---- formulas ------------------------------------------------------------

# Function names a formula may not call.
UNSAFE_FUNCTIONS = ["INDIRECT", "HYPERLINK", "WEBSERVICE", "DGET", "RTD"]


def formula_error(f: Column) -> Column:
    """First failing rule of a formula text, NULL when it is valid."""
    parens = F.split(F.regexp_replace(f, r"[^()]", ""), "")
    depth = F.aggregate(
        parens,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a["now"] + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)).alias("now"),
            F.least(a["low"], a["now"] + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)).alias("low"),
        ),
    )
    calls = F.regexp_extract_all(f, F.lit(r"([A-Z]+)\s*\("), F.lit(1))
    unsafe = F.get(F.filter(calls, lambda n: n.isin(UNSAFE_FUNCTIONS)), F.lit(0))
    return (
        F.when(~f.startswith("="), F.lit("Formula must start with '='"))
        .when(depth["low"] < 0, F.lit("Unmatched closing parenthesis"))
        .when(depth["now"] > 0, F.lit("Unclosed parenthesis"))
        .when(unsafe.isNotNull(), F.concat(F.lit("Unsafe function: "), unsafe))
    )


def lint_formulas(df: DataFrame, formula: str) -> DataFrame:
    error = formula_error(F.col(formula))
    return df.withColumn("message", F.coalesce(error, F.lit("Formula is valid"))).withColumn(
        "valid", F.col("message") == "Formula is valid"
    )


def match_formulas(formulas: DataFrame, cells: DataFrame) -> DataFrame:
    """formulas(sheet, cell, formula) against the stored cells."""
    f = F.col("formula")
    refs = F.regexp_extract_all(f, F.lit(r"([A-Z]+[0-9]+(?::[A-Z]+[0-9]+)?)"), F.lit(1))
    bad_ref = F.get(
        F.filter(refs, lambda r: F.exists(F.split(r, ":"), lambda p: ~p.rlike(a1.REF_PATTERN))), F.lit(0)
    )
    lint = formula_error(f)
    error = (
        F.when(~a1.valid_ref(F.col("cell")), F.concat(F.lit("Invalid cell reference: "), "cell"))
        .when(lint.isNotNull(), F.concat(F.lit("Invalid formula syntax: "), lint))
        .when(bad_ref.isNotNull(), F.concat(F.lit("Invalid cell reference in formula: "), bad_ref))
    )
    asked = formulas.withColumns(
        {"error": error, "row": a1.ref_row(F.col("cell")), "col": a1.ref_col(F.col("cell"))}
    )
    got = asked.join(cells.select(*KEY, F.col("value").alias("current")), KEY, "left")
    has_formula = F.coalesce(F.col("current").startswith("="), F.lit(False))
    same = has_formula & (F.col("current") == f)
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(same, F.lit("Formula is valid and matches cell content"))
        .when(has_formula, F.lit("Formula is valid but doesn't match cell content"))
        .otherwise(F.lit("Formula is valid but cell contains no formula"))
    )
    ok = F.col("error").isNull()
    return got.select("sheet", "cell", "formula", ok.alias("valid"), (ok & same).alias("matches"), message.alias("message"))


def _prepared(formulas: DataFrame) -> DataFrame:
    f = F.col("formula")
    fixed = F.when(f.startswith("="), f).otherwise(F.concat(F.lit("="), f))
    df = formulas.withColumn("formula", fixed)
    lint = formula_error(F.col("formula"))
    return df.withColumn(
        "error",
        F.when(~a1.valid_ref(F.col("cell")), F.concat(F.lit("Invalid cell reference: "), "cell"))
        .when(lint.isNotNull(), F.concat(F.lit("Invalid formula syntax: "), lint)),
    )


def apply_formulas(cells: DataFrame, formulas: DataFrame) -> DataFrame:
    """Cells after the valid formula texts are stored."""
    ok = _prepared(formulas).where(F.col("error").isNull())
    new = ok.select(
        "sheet", a1.ref_row(F.col("cell")).alias("row"), a1.ref_col(F.col("cell")).alias("col"),
        F.col("formula").alias("value"), F.lit(None).cast("double").alias("num"), F.lit("str").alias("type"),
    )
    return upsert(cells, new)


def formula_rejects(formulas: DataFrame) -> DataFrame:
    return _prepared(formulas).where(F.col("error").isNotNull()).select("sheet", "cell", "formula", "error")


# ---- validation rules ----------------------------------------------------


#: Rows of a sheet that share a join key with its rules, and rules up to which each cell of the block looks at all of them.
BLOCK_ROWS, FEW_RULES = 4096, 64


def validation_for_cells(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule, by number, whose range covers the cell.

    rules(rule_no, sheet, r0, c0, r1, c1, validation_type, ...). The join key is the sheet
    and a block of its rows, so a sheet of any length is spread; the few rules that touch a
    block, ranges of an open sheet included, travel as one array beside each of its cells.
    Cells of a block with more rules find theirs by the dyadic intervals of their rows.
    """
    ends = bounds(cells).select(F.col("sheet").alias("_s"), F.col("max_row").alias("_last"))
    inside = rules.join(broadcast_if_small(ends), F.col("sheet") == F.col("_s")).withColumn("r1", F.least("r1", "_last")).where("r0 <= r1")
    parts = ["rule_no", "r0", "c0", "r1", "c1", "validation_type"]
    blocks = F.sequence(F.floor(F.col("r0") / BLOCK_ROWS), F.floor(F.col("r1") / BLOCK_ROWS))
    touched = inside.select("sheet", *parts, F.explode(blocks).alias("_block"))
    counts = touched.groupBy("sheet", "_block").agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.where(F.col("_n") > FEW_RULES).select("sheet", "_block", F.lit(True).alias("_crowded"))
    per_block = touched.join(crowded, ["sheet", "_block"], "left_anti").groupBy("sheet", "_block").agg(
        F.sort_array(F.collect_list(F.struct(*parts))).alias("_rules"))
    placed = cells.withColumn("_block", F.floor(F.col("row") / BLOCK_ROWS))
    table = stored(per_block.select("*", F.lit(False).alias("_crowded")).unionByName(
        crowded.withColumn("_rules", F.array().cast(per_block.schema["_rules"].dataType))))
    joined = placed.join(broadcast_if_small(table), ["sheet", "_block"], "left")
    first = F.get(
        F.filter("_rules", lambda r: F.col("row").between(r["r0"], r["r1"]) & F.col("col").between(r["c0"], r["c1"])),
        F.lit(0),
    )
    columns = [F.col(c) for c in cells.columns]
    few = joined.where(~F.coalesce("_crowded", F.lit(False))).withColumn("_hit", first).select(*columns, "_hit.rule_no", "_hit.validation_type")
    many = joined.where("_crowded").select(*columns)
    asked = touched.join(crowded, ["sheet", "_block"], "left_semi").select("sheet", *parts).distinct()
    hits = cells_in_ranges(many.select(*KEY).distinct(), asked).groupBy(*KEY).agg(F.min(F.struct("rule_no", "validation_type")).alias("_hit"))
    return few.unionByName(many.join(hits.hint("merge"), KEY, "left").select(*columns, "_hit.rule_no", "_hit.validation_type"))


def rule_values(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """Allowed values of list rules as (rule_no, pos_row, pos_col, value)."""
    text = F.regexp_replace(strip_blank(F.col("formula1")), r'^"+|"+$', "")
    lists = rules.where((F.col("validation_type") == "list") & F.col("formula1").isNotNull()).select(
        "rule_no", "sheet", text.alias("text"))
    is_range = F.col("text").contains(":") | F.col("text").startswith("$")
    parts = F.transform(
        F.when(F.col("text").contains(","), F.split("text", ",")).otherwise(F.array("text")),
        lambda v: F.regexp_replace(strip_blank(v), r'^"+|"+$', ""),
    )
    literal = (
        lists.where(~is_range)
        .select("rule_no", F.posexplode(parts).alias("pos", "value"))
        .where(F.col("value") != "")
        .select("rule_no", F.lit(0).cast("long").alias("pos_row"), F.col("pos").cast("long").alias("pos_col"), "value")
    )
    ref = F.regexp_replace(F.regexp_replace("text", r"^=", ""), r"\$", "")
    ranged = lists.where(is_range).select(
        "rule_no", "sheet", "text",
        a1.ref_row(F.split_part(ref, F.lit(":"), F.lit(1))).alias("r0"),
        a1.ref_col(F.split_part(ref, F.lit(":"), F.lit(1))).alias("c0"),
        a1.ref_row(F.split_part(ref, F.lit(":"), F.lit(-1))).alias("r1"),
        a1.ref_col(F.split_part(ref, F.lit(":"), F.lit(-1))).alias("c1"),
    )
    found = cells_in_ranges(cells.where(F.col("value").isNotNull()).select("sheet", "row", "col", "value"), ranged)
    hits = found.select("rule_no", F.col("row").alias("pos_row"), F.col("col").alias("pos_col"), "value")
    none = ranged.join(hits.select("rule_no").distinct(), "rule_no", "left_anti").select(
        "rule_no", F.lit(0).cast("long").alias("pos_row"), F.lit(0).cast("long").alias("pos_col"),
        F.concat(F.lit("Range: "), "text", F.lit(" (empty or unresolvable)")).alias("value"),
    )
    return literal.unionByName(hits).unionByName(none)


# ---- summaries -----------------------------------------------------------

AGGREGATES = {
    "sum": F.sum, "average": F.avg, "count": F.count, "min": F.min, "max": F.max,
}


def _field(df: DataFrame, name: str) -> str:
    """Column for a field name that may carry an aggregate suffix, any case."""
    clean = name.strip()
    for agg in AGGREGATES:
        suffix = f" ({agg})"
        if clean.lower().endswith(suffix):
            clean = clean[: -len(suffix)]
            break
    for c in df.columns:
        if c.lower() == clean.lower():
            return c
    raise ValueError(f"Invalid field {name!r}. Available: {', '.join(sorted(df.columns))}")


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double") if isinstance(kind, T.BooleanType) else F.col(name)
    return F.lit(None).cast("double")


def summary_table(
    df: DataFrame, rows: list[str], values: list[str], columns: list[str] | None = None, agg_func: str = "sum",
    every_combination: bool = False,
) -> DataFrame:
    """One row per seen combination of the row-field values; groups without numbers give 0.

    ``every_combination`` also gives the unseen ones: their number is the product of the
    distinct values of the fields, built from the already aggregated groups.
    """
    agg = AGGREGATES.get(agg_func.lower())
    if agg is None:
        raise ValueError(f"Invalid aggregation function. Must be one of: {', '.join(sorted(AGGREGATES))}")
    row_fields = [_field(df, f) for f in rows]
    value_fields = [_field(df, f) for f in values]
    for f in columns or []:
        _field(df, f)
    named = [f"{v} ({agg_func.lower()})" for v in value_fields]
    text = [F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(f) for f in row_fields]
    nums = [_number(df, v).alias(f"_v{i}") for i, v in enumerate(value_fields)]
    groups = (
        df.select(*text, *nums).groupBy(*row_fields)
        .agg(*[agg(f"_v{i}").cast("double").alias(n) for i, n in enumerate(named)])
    )
    combos = None if every_combination else groups.select(*row_fields)
    for f in row_fields if every_combination else []:
        distinct = groups.select(f).distinct()
        combos = distinct if combos is None else combos.crossJoin(distinct)
    return combos.join(groups, row_fields, "left").select(
        *row_fields, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in named]
    )


def cross_tab(
    df: DataFrame, rows: list[str], column: str, value: str, agg_func: str = "sum", column_values: list | None = None
) -> DataFrame:
    """Row fields down, the values of one column across; empty groups give 0."""
    agg = AGGREGATES.get(agg_func.lower())
    if agg is None:
        raise ValueError(f"Invalid aggregation function. Must be one of: {', '.join(sorted(AGGREGATES))}")
    row_fields = [_field(df, f) for f in rows]
    wide = df.groupBy(*row_fields).pivot(_field(df, column), column_values).agg(agg(_field(df, value)).cast("double"))
    return wide.na.fill(0.0)


def cross_tab_map(df: DataFrame, rows: list[str], column: str, value: str, agg_func: str = "sum") -> DataFrame:
    """Row fields beside ``values``, a map from every value of one column (as text) to its number; empty groups give 0.

    The values are found by the query itself: each row's map is filled up from the one set of all of
    them, which is as large as a row. A NULL value has the key ``null``.
    """
    agg = AGGREGATES.get(agg_func.lower())
    if agg is None:
        raise ValueError(f"Invalid aggregation function. Must be one of: {', '.join(sorted(AGGREGATES))}")
    row_fields = [_field(df, f) for f in rows]
    key = F.coalesce(F.col(_field(df, column)).cast("string"), F.lit("null")).alias("_key")
    groups = df.select(*row_fields, key, F.col(_field(df, value)).alias("_value")).groupBy(*row_fields, "_key").agg(
        agg("_value").cast("double").alias("_value"))
    own = groups.groupBy(*row_fields).agg(map_of("_key", F.col("_value")).alias("_own"))
    keys = groups.agg(F.sort_array(F.collect_set("_key")).alias("_keys"))  # one row
    full = F.transform("_keys", lambda k: F.coalesce(F.element_at(F.col("_own"), k), F.lit(0.0)))
    return own.join(F.broadcast(keys)).select(*row_fields, F.map_from_arrays("_keys", full).alias("values"))


CHART_TYPES = ["line", "bar", "pie", "scatter", "area"]


def chart_series(df: DataFrame, category: str, series: list[str], chart_type: str = "line") -> DataFrame:
    """(series, category, value); a scatter chart takes the first column as x."""
    if chart_type not in CHART_TYPES:
        raise ValueError(f"Unsupported chart type: {chart_type}. Supported: {', '.join(CHART_TYPES)}")
    cat = F.col(category).cast("double" if chart_type == "scatter" else "string")
    return df.select(cat.alias("category"), *series).unpivot("category", series, "series", "value")


# ---- Markdown ------------------------------------------------------------


def general_format(x: Column) -> Column:
    """A double with six significant digits and no trailing zeros."""
    sci = F.format_string("%.5e", x)
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    fixed = F.regexp_replace(sci.cast("double").cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(sci, r"\.?0*e", "e")
    return F.when(x == 0, F.lit("0")).when(exp.between(-4, 5), fixed).otherwise(short)


def markdown_escape(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"\s*\n\s*", "<br>")
    return strip_blank(out)


def cell_text(value: Column, num: Column, kind: Column) -> Column:
    """Display text of a cell by its type; blank values give the empty text."""
    return (
        F.when(is_blank(value), F.lit(""))
        .when(kind == "bool", F.upper(value))
        .when(kind == "float", general_format(num))
        .when(kind == "datetime", F.date_format(F.to_timestamp(value), "yyyy-MM-dd HH:mm:ss"))
        .when(kind.isin("int", "date", "time"), value)
        .otherwise(markdown_escape(value))
    )


def _capped(cells: DataFrame, merges: DataFrame | None, max_rows: int, max_cols: int):
    """Filled cells inside the caps, and per sheet the bounds with the caps applied."""
    if max_rows < 0 or max_cols < 0:
        raise ValueError("max_rows and max_cols must not be negative")
    lim = content_bounds(cells, merges)
    row_cut = (F.col("max_row") - F.col("min_row") + 1 > max_rows) if max_rows else F.lit(False)
    col_cut = (F.col("max_col") - F.col("min_col") + 1 > max_cols) if max_cols else F.lit(False)
    lim = lim.withColumns({
        "rows_truncated": row_cut, "cols_truncated": col_cut,
        "last_row": F.when(row_cut, F.col("min_row") + max_rows - 1).otherwise(F.col("max_row")),
        "last_col": F.when(col_cut, F.col("min_col") + max_cols - 1).otherwise(F.col("max_col")),
    })
    lim = stored(lim)  # one row a sheet
    filled = cells if merges is None else fill_merged(cells, merges)
    filled = filled.where(~is_blank(F.col("value")))
    inside = filled.join(broadcast_if_small(lim.select("sheet", "min_row", "min_col", "last_row", "last_col")), "sheet")
    inside = inside.where((F.col("row") <= F.col("last_row")) & (F.col("col") <= F.col("last_col")))
    return inside, lim


def column_alignments(cells: DataFrame, merges: DataFrame | None = None, max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """``---:`` for columns whose values below the header are all numbers."""
    return _alignments(_grid_rows(_capped(cells, merges, max_rows, max_cols)[0]))


def _grid_rows(inside: DataFrame) -> DataFrame:
    """One row per grid row with the texts and kinds of its cells by column: all a table is made of."""
    return inside.groupBy("sheet", "row").agg(
        map_of("col", cell_text(F.col("value"), F.col("num"), F.col("type"))).alias("_m"),
        map_of("col", F.col("type").isin("int", "float")).alias("_numeric"),
        F.max("col").alias("_width"), F.first("min_row").alias("min_row"), F.first("last_row").alias("last_row"),
    )


def _alignments(rows: DataFrame) -> DataFrame:
    data = rows.where((F.col("row") > F.col("min_row")) | (F.col("last_row") == F.col("min_row")))
    return data.select("sheet", F.explode("_numeric").alias("col", "numeric")).groupBy("sheet", "col").agg(
        F.when(F.every("numeric"), F.lit("---:")).otherwise(F.lit("---")).alias("alignment")
    )


def markdown_table(
    cells: DataFrame, merges: DataFrame | None = None, max_rows: int = 0, max_cols: int = 0
) -> DataFrame:
    """Table lines (sheet, line_no, line): header, separator, then data rows.

    A sheet of any length stays one row per line; only the cells of one grid
    row, at most the column limit of a sheet, meet in one group.
    """
    inside, lim = _capped(cells, merges, max_rows, max_cols)
    rows = stored(_grid_rows(inside))
    width = rows.groupBy("sheet").agg(F.max("_width").alias("width_col"))
    frame = lim.join(width, "sheet").select(
        "sheet", "min_row", "min_col", F.col("last_row").alias("max_row"), "width_col")
    grid_rows = _dense_rows(frame, ["sheet", "min_col", "width_col"])
    first_row = frame.select("sheet", F.col("min_row").alias("first_row"))
    texts = rows.select("sheet", "row", "_m")
    joined = F.array_join(
        F.transform(F.sequence("min_col", "width_col"),
                    lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(""))), " | ")
    row_lines = (
        grid_rows.join(texts, ["sheet", "row"], "left").join(broadcast_if_small(first_row), "sheet")
        .select(
            "sheet",
            (F.col("row") - F.col("first_row") + F.when(F.col("row") == F.col("first_row"), 1).otherwise(2)).alias("line_no"),
            F.concat(F.lit("| "), joined, F.lit(" |")).alias("line"),
        )
    )
    aligned = _alignments(rows).groupBy("sheet").agg(
        map_of("col", F.col("alignment")).alias("_a"))
    marks = F.array_join(
        F.transform(F.sequence("min_col", "width_col"),
                    lambda c: F.coalesce(F.try_element_at(F.col("_a"), c), F.lit("---"))), " | ")
    separators = frame.join(aligned, "sheet", "left").select(
        "sheet", F.lit(2).cast("long").alias("line_no"), F.concat(F.lit("| "), marks, F.lit(" |")).alias("line"))
    return row_lines.unionByName(separators)


def workbook_report(
    cells: DataFrame, sheets: DataFrame, name: str, merges: DataFrame | None = None,
    max_rows: int = 0, max_cols: int = 0,
) -> DataFrame:
    """Report lines (sheet_pos, line_no, line) for sheets(sheet_pos, sheet, state).

    Position 0 holds the summary; hidden sheets are counted but not rendered.
    """
    visible = sheets.where(F.col("state") == "visible")
    names = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(F.col("state") == "visible", F.struct("sheet_pos", "sheet")))),
        lambda s: s["sheet"]), ", ")
    n_visible = F.count_if(F.col("state") == "visible")
    summary = sheets.agg(
        F.array(
            F.lit(f"# Spreadsheet Source: {name}"), F.lit(""), F.lit("## Workbook Summary"), F.lit(""),
            F.concat(F.lit("- Sheets: "), F.count(F.lit(1))),
            F.concat(F.lit("- Visible sheets: "), F.when(n_visible > 0, names).otherwise(F.lit("None"))),
            F.lit(""),
            F.lit("> Note: Formula cells are exported as cached values. This converter does not recalculate formulas."),
            F.lit(""),
        ).alias("a"),
        n_visible.alias("n"),
    ).select(
        F.lit(0).cast("long").alias("sheet_pos"),
        F.posexplode(F.when(F.col("n") > 0, F.col("a")).otherwise(
            F.concat("a", F.array(F.lit("_No visible sheets found._"), F.lit(""))))).alias("p", "line"),
    ).select("sheet_pos", (F.col("p") + 1).cast("long").alias("line_no"), "line")

    lim = content_bounds(cells, merges)
    row_cut = (F.col("max_row") - F.col("min_row") + 1 > max_rows) if max_rows else F.lit(False)
    col_cut = (F.col("max_col") - F.col("min_col") + 1 > max_cols) if max_cols else F.lit(False)
    notes = F.concat_ws(
        ", ", F.when(row_cut, F.lit(f"rows limited to {max_rows}")), F.when(col_cut, F.lit(f"columns limited to {max_cols}")))
    top = F.array(F.concat(F.lit("## Sheet: "), "sheet"), F.lit(""), F.lit("- State: visible"))
    detail = F.array(
        F.concat(F.lit("- Used range: "), "used_range"),
        F.concat(F.lit("- Rows: "), F.col("max_row") - F.col("min_row") + 1),
        F.concat(F.lit("- Columns: "), F.col("max_col") - F.col("min_col") + 1),
        F.lit(""),
    )
    cut_note = F.when(row_cut | col_cut, F.array(F.concat(F.lit("> Truncated: "), notes, F.lit(".")), F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    empty = F.array(F.lit(""), F.lit("_No content found._"), F.lit(""))
    heads = visible.join(lim, "sheet", "left").select(
        "sheet_pos", "sheet",
        F.when(F.col("max_row").isNull(), F.concat(top, empty)).otherwise(F.concat(top, detail, cut_note)).alias("h"),
    )
    head_lines = heads.select("sheet_pos", F.posexplode("h").alias("p", "line")).select(
        "sheet_pos", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    size = broadcast_if_small(heads.select("sheet_pos", "sheet", F.size("h").alias("n_head")))
    body = markdown_table(cells, merges, max_rows, max_cols).join(size, "sheet").select(
        "sheet_pos", (F.col("line_no") + F.col("n_head")).alias("line_no"), "line")
    return summary.unionByName(head_lines).unionByName(body)


# ---- plain tables and paragraphs -----------------------------------------


def table_previews(table_cells: DataFrame, rows: int | None = None) -> DataFrame:
    """Per (doc_id, table_no) sizes and the rows, or the first ``rows``, by 0-based row and col.

    One row per previewed table row; the cells of that row are joined in order.
    """
    sizes = table_cells.groupBy("doc_id", "table_no").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    first = (
        (table_cells if rows is None else table_cells.where(F.col("row") < rows))
        .groupBy("doc_id", "table_no", "row")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " | ").alias("preview"))
    )
    return sizes.join(first, ["doc_id", "table_no"])


def paragraph_list(docs: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs of each document with 0-based index and count, without a shuffle."""
    parts = F.split(F.col(text), "\n")
    return docs.select("doc_id", F.size(parts).cast("long").alias("paragraph_count"), F.posexplode(parts).alias("p", "text")).select(
        "doc_id", "paragraph_count", F.col("p").cast("long").alias("index"), "text")
