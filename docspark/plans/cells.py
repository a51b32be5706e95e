"""Section C: the long cell table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import a1
from ..operators import cells as C
from .registry import query, table

# ---- derived cells -------------------------------------------------------

_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]


def order_cells(spark, d):
    """Sheet ``orders``: urgent pending orders are empty rows, some priorities empty cells."""
    o = table(spark, d, "orders").withColumn("row", F.col("o_orderkey") + 2)
    hidden = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    o = o.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    o = o.select("row", *[F.when(~hidden | F.col("o_orderpriority").isNull(), F.col(c)).alias(c) for c in _ORDER_COLS])
    return C.from_table(o, "orders", F.col("row"), _ORDER_COLS)


def part_cells(spark, d):
    return C.from_table(table(spark, d, "part"), "part", F.col("p_partkey") + 2, _PART_COLS)


def all_cells(spark, d):
    return order_cells(spark, d).unionByName(part_cells(spark, d))


def _cells_sql(sheet, source, cols):
    parts = [
        f"SELECT '{sheet}' AS sheet, 1::BIGINT AS \"row\", {i + 1}::BIGINT AS \"col\", '{c}' AS value, "
        f"NULL::DOUBLE AS num, 'str' AS type" for i, (c, _) in enumerate(cols)
    ] + [
        f"SELECT '{sheet}', r, {i + 1}::BIGINT, CAST({c} AS VARCHAR), "
        + (f"CAST({c} AS DOUBLE)" if t != "str" else "NULL") + f", '{t}' FROM {source} WHERE {c} IS NOT NULL"
        for i, (c, t) in enumerate(cols)
    ]
    return " UNION ALL ".join(parts)


_O = """o AS (SELECT r, CASE WHEN k THEN o_orderkey END AS o_orderkey, CASE WHEN k THEN o_custkey END AS o_custkey,
  CASE WHEN k THEN o_orderstatus END AS o_orderstatus, CASE WHEN k THEN o_totalprice END AS o_totalprice,
  CASE WHEN k THEN p END AS o_orderpriority FROM (SELECT *, o_orderkey + 2 AS r,
    NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS k,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS p FROM orders) q)"""
_OC = _cells_sql("orders", "o", list(zip(_ORDER_COLS, ["int", "int", "str", "float", "str"])))
_PC = _cells_sql("part", "p", list(zip(_PART_COLS, ["int", "str", "str", "int", "float"])))
_P = "p AS (SELECT *, p_partkey + 2 AS r FROM part)"
ORDER_CELLS = f"{_O}, cells AS ({_OC})"
ALL_CELLS = f"{_O}, {_P}, cells AS ({_OC} UNION ALL {_PC})"
_OUT = 'sheet, "row", "col", value, num, type'

# SQL text for the letters of column index n
_LETTERS = """(CASE WHEN {n} > 702 THEN chr(CAST(65 + ({n} - 703) // 676 AS INT)) ELSE '' END ||
  CASE WHEN {n} > 26 THEN chr(CAST(65 + (({n} - 27) // 26) % 26 AS INT)) ELSE '' END ||
  chr(CAST(65 + ({n} - 1) % 26 AS INT)))"""


def letters_sql(n):
    return _LETTERS.format(n=n)


# ---- reading -------------------------------------------------------------


@query(
    "c01_range_read",
    f"""WITH {ALL_CELLS} SELECT "row", "col", value, num, type FROM cells
        WHERE sheet = 'orders' AND "row" >= 3 AND "col" BETWEEN 2 AND 5""",
)
def _(spark, d):
    return C.read_range(all_cells(spark, d), "orders", "B3:E")


@query(
    "c01_range_preview",
    f"""WITH {ALL_CELLS}, s AS (SELECT * FROM cells WHERE sheet = 'orders' AND "row" >= 5 AND "col" >= 5)
        SELECT "row", "col", value, num, type FROM s WHERE "row" IN (SELECT DISTINCT "row" FROM s ORDER BY "row" LIMIT 10)""",
)
def _(spark, d):
    return C.read_range(all_cells(spark, d), "orders", "E5", preview=True)


_RULES = [
    (1, "part", 2, 4, 1000, 4, "whole", "1", "allow"),
    (2, "part", 2, 2, 100000000, 5, "textLength", "40", "allow"),
    (3, "orders", 2, 5, 100000000, 5, "list", '"1-URGENT, 2-HIGH,3-MEDIUM ,,5-LOW"', "allow"),
    (4, "orders", 2, 3, 100000000, 5, "list", "$C$2:$C$12", "allow"),
    (5, "orders", 2, 1, 50, 1, "list", "=Z1:Z9", "allow"),
    (6, "orders", 2, 1, 50, 2, "list", "only", "allow"),
]


def validation_rules(spark):
    return spark.createDataFrame(
        _RULES, "rule_no LONG, sheet STRING, r0 LONG, c0 LONG, r1 LONG, c1 LONG, validation_type STRING, "
        "formula1 STRING, note STRING")


_RULES_SQL = "rules(rule_no, sheet, r0, c0, r1, c1, validation_type) AS (VALUES " + ", ".join(
    f"({r[0]}::BIGINT, '{r[1]}', {r[2]}, {r[3]}, {r[4]}, {r[5]}, '{r[6]}')" for r in _RULES) + ")"


@query(
    "c02_range_with_metadata",
    f"""WITH {ALL_CELLS}, {_RULES_SQL}, b AS (SELECT max("row") AS mr, max("col") AS mc FROM cells WHERE sheet = 'part'),
        g AS (SELECT r."row", c."col" FROM (SELECT unnest(range(1, mr + 1)) AS "row" FROM b) r,
              (SELECT unnest(range(1, mc + 1)) AS "col" FROM b) c),
        v AS (SELECT g."row", g."col", min(rule_no) AS rule_no FROM g LEFT JOIN rules ON sheet = 'part'
              AND g."row" BETWEEN r0 AND r1 AND g."col" BETWEEN c0 AND c1 GROUP BY ALL)
        SELECT {letters_sql('v."col"')} || v."row" AS address, v."row", v."col", c.value, rules.validation_type, v.rule_no
        FROM v LEFT JOIN cells c ON c.sheet = 'part' AND c."row" = v."row" AND c."col" = v."col"
        LEFT JOIN rules ON rules.rule_no = v.rule_no""",
)
def _(spark, d):
    return C.read_range_with_metadata(all_cells(spark, d), "part", "A1", rules=validation_rules(spark))


@query(
    "c03_reference_codec",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey + 1 AS rw, l_partkey % 16384 + 1 AS cl FROM lineitem),
        a AS (SELECT *, {letters_sql('cl')} || rw AS address FROM r),
        b AS (SELECT *, CASE l_linenumber WHEN 1 THEN lower(address) WHEN 2 THEN address || 'X' WHEN 3 THEN 'A0' || rw
                     ELSE address END AS ref FROM a)
        SELECT l_orderkey, l_linenumber, address, ref,
          CASE WHEN l_linenumber NOT IN (2, 3) THEN rw END AS row_no,
          CASE WHEN l_linenumber NOT IN (2, 3) THEN cl END AS col_no FROM b""",
)
def _(spark, d):
    adr = a1.address(F.col("l_suppkey") + 1, F.col("l_partkey") % 16384 + 1)
    n = F.col("l_linenumber")
    ref = (
        F.when(n == 1, F.lower(adr)).when(n == 2, F.concat(adr, F.lit("X")))
        .when(n == 3, F.concat(F.lit("A0"), F.col("l_suppkey") + 1)).otherwise(adr)
    )
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", adr.alias("address"), ref.alias("ref"))
    return refs.withColumns({"row_no": a1.ref_row(F.col("ref")), "col_no": a1.ref_col(F.col("ref"))})


# ---- writing -------------------------------------------------------------


@query(
    "c04_block_write",
    f"""WITH {ALL_CELLS}, new AS (
          SELECT 'orders' AS sheet, p_partkey + 5 AS "row", 3::BIGINT AS "col", p_name AS value, NULL::DOUBLE AS num, 'str' AS type FROM part
          UNION ALL SELECT 'orders', p_partkey + 5, 4, CASE WHEN p_size = 7 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END,
            CASE WHEN p_size = 7 THEN NULL ELSE p_retailprice END, 'float' FROM part WHERE p_size <= 25)
        SELECT {_OUT} FROM cells c WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.sheet = c.sheet AND n."row" = c."row" AND n."col" = c."col")
        UNION ALL SELECT {_OUT} FROM new WHERE value IS NOT NULL""",
)
def _(spark, d):
    part = table(spark, d, "part")
    names = part.select(
        F.col("p_partkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("p_name").alias("value"),
        F.lit(None).cast("double").alias("num"), F.lit("str").alias("type"))
    price = F.when(F.col("p_size") != 7, F.col("p_retailprice"))
    prices = part.where(F.col("p_size") <= 25).select(
        F.col("p_partkey").alias("i"), F.lit(1).cast("long").alias("j"), price.cast("string").alias("value"),
        price.alias("num"), F.lit("float").alias("type"))
    return C.write_block(all_cells(spark, d), names.unionByName(prices), "orders", "C5")


@query(
    "c05_range_copy_to_sheet",
    f"""WITH {ALL_CELLS} SELECT {_OUT} FROM cells
          WHERE NOT (sheet = 'part' AND "row" BETWEEN 4 AND 5002 AND "col" BETWEEN 2 AND 5)
        UNION ALL SELECT 'part', "row" + 2, "col" + 0, value, num, type FROM cells
          WHERE sheet = 'orders' AND "row" BETWEEN 2 AND 5000 AND "col" BETWEEN 2 AND 5""",
)
def _(spark, d):
    return C.copy_range(all_cells(spark, d), "orders", "B2", "E5000", "B4", "part")


@query(
    "c05_range_copy_overlapping",
    f"""WITH {ALL_CELLS}, t AS (SELECT r."row", c."col", 2 + (r."row" - 102) % 100 AS src
          FROM (SELECT unnest(range(102, 5101)) AS "row") r, (SELECT unnest([4, 5]) AS "col") c)
        SELECT {_OUT} FROM cells WHERE NOT (sheet = 'orders' AND "row" BETWEEN 102 AND 5100 AND "col" BETWEEN 4 AND 5)
        UNION ALL SELECT 'orders', t."row", t."col"::BIGINT, value, num, type FROM t JOIN cells c
          ON c.sheet = 'orders' AND c."row" = t.src AND c."col" = t."col\"""",
)
def _(spark, d):
    return C.copy_range(all_cells(spark, d), "orders", "D2", "E5000", "D102")


@query(
    "c06_range_delete_up",
    f"""WITH {ALL_CELLS} SELECT sheet, CASE WHEN sheet = 'orders' AND "row" > 60 THEN "row" - 51 ELSE "row" END AS "row",
        "col", value, num, type FROM cells WHERE NOT (sheet = 'orders' AND "row" BETWEEN 10 AND 60)""",
)
def _(spark, d):
    return C.delete_range(all_cells(spark, d), "orders", "B10", "C60")


@query(
    "c06_range_delete_left",
    f"""WITH {ALL_CELLS} SELECT sheet, "row", CASE WHEN sheet = 'orders' AND "col" > 3 THEN "col" - 2 ELSE "col" END AS "col",
        value, num, type FROM cells WHERE NOT (sheet = 'orders' AND "col" BETWEEN 2 AND 3)""",
)
def _(spark, d):
    return C.delete_range(all_cells(spark, d), "orders", "B10", "C60", "left")


@query(
    "c07_insert_rows_cols",
    f"""WITH {ALL_CELLS} SELECT sheet, CASE WHEN sheet = 'orders' AND "row" >= 20 THEN "row" + 3 ELSE "row" END AS "row",
        CASE WHEN sheet = 'part' AND "col" >= 2 THEN "col" + 1 ELSE "col" END AS "col", value, num, type FROM cells""",
)
def _(spark, d):
    return C.insert_cols(C.insert_rows(all_cells(spark, d), "orders", 20, 3), "part", 2)


@query(
    "c07_delete_rows_cols",
    f"""WITH {ALL_CELLS} SELECT sheet, CASE WHEN sheet = 'orders' AND "row" >= 24 THEN "row" - 4 ELSE "row" END AS "row",
        CASE WHEN sheet = 'part' AND "col" >= 3 THEN "col" - 1 ELSE "col" END AS "col", value, num, type FROM cells
        WHERE NOT (sheet = 'orders' AND "row" BETWEEN 20 AND 23) AND NOT (sheet = 'part' AND "col" = 2)""",
)
def _(spark, d):
    return C.delete_cols(C.delete_rows(all_cells(spark, d), "orders", 20, 4), "part", 2)


@query(
    "c08_sheet_copy",
    f"""WITH {ALL_CELLS} SELECT {_OUT} FROM cells UNION ALL
        SELECT 'parts 2', "row", "col", value, num, type FROM cells WHERE sheet = 'part'""",
)
def _(spark, d):
    return C.copy_sheet(all_cells(spark, d), "part", "parts 2")


@query(
    "c08_sheet_rename_delete",
    f"""WITH {ALL_CELLS} SELECT 'stock' AS sheet, "row", "col", value, num, type FROM cells WHERE sheet = 'part'""",
)
def _(spark, d):
    return C.delete_sheet(C.rename_sheet(all_cells(spark, d), "part", "stock"), "orders")


# ---- merges, bounds, validation ------------------------------------------


def order_merges(spark, d):
    """Three rows of E:G merged below every tenth order."""
    r = F.col("o_orderkey") + 2
    return table(spark, d, "orders").where(F.col("o_orderkey") % 10 == 0).select(
        F.lit("orders").alias("sheet"), r.alias("r0"), F.lit(5).cast("long").alias("c0"),
        (r + 2).alias("r1"), F.lit(7).cast("long").alias("c1"))


_MERGES = """merges AS (SELECT 'orders' AS sheet, o_orderkey + 2 AS r0, 5::BIGINT AS c0, o_orderkey + 4 AS r1, 7::BIGINT AS c1
             FROM orders WHERE o_orderkey % 10 = 0)"""


@query(
    "c09_merged_fill",
    f"""WITH {ALL_CELLS}, {_MERGES}, g AS (SELECT m.*, r0 + dr AS "row", c0 + dc AS "col"
           FROM merges m, (VALUES (0), (1), (2)) a(dr), (VALUES (0), (1), (2)) b(dc)),
         f AS (SELECT g.sheet, g."row", g."col", t.value, t.num, t.type FROM g JOIN cells t
               ON t.sheet = g.sheet AND t."row" = g.r0 AND t."col" = g.c0)
        SELECT {_OUT} FROM cells UNION ALL SELECT {_OUT} FROM f WHERE NOT EXISTS
          (SELECT 1 FROM cells c WHERE c.sheet = f.sheet AND c."row" = f."row" AND c."col" = f."col")""",
)
def _(spark, d):
    return C.fill_merged(all_cells(spark, d), order_merges(spark, d))


@query(
    "c10_content_bounds",
    f"""WITH {ALL_CELLS}, {_MERGES}, s AS (SELECT sheet, "row", "col" FROM cells UNION ALL
           SELECT m.sheet, r1, c1 FROM merges m JOIN cells t ON t.sheet = m.sheet AND t."row" = m.r0 AND t."col" = m.c0)
        SELECT sheet, min("row") AS min_row, min("col") AS min_col, max("row") AS max_row, max("col") AS max_col,
          chr(CAST(64 + min("col") AS INT)) || min("row") || ':' || chr(CAST(64 + max("col") AS INT)) || max("row") AS used_range
        FROM s GROUP BY sheet""",
)
def _(spark, d):
    return C.content_bounds(all_cells(spark, d), order_merges(spark, d))


@query(
    "c11_range_validation",
    f"""WITH {ALL_CELLS}, b AS (SELECT sheet, max("row") AS mr, max("col") AS mc FROM cells GROUP BY sheet),
        q AS (SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 2 = 0 THEN 'part' ELSE 'orders' END AS sheet,
                o_orderkey // 4 + 1 AS r0, o_custkey % 6 + 1 AS c0, o_custkey * 3 + 1 AS r1, o_custkey % 5 + 1 AS c1,
                o_orderkey % 7 AS k FROM orders),
        j AS (SELECT q.*, b.mr, b.mc FROM q LEFT JOIN b USING (sheet)),
        e AS (SELECT *, CASE WHEN mr IS NULL THEN 'Sheet ''' || sheet || ''' not found'
            WHEN k = 1 THEN 'Invalid cell reference: ''A0'''
            WHEN r0 > mr THEN 'Start row ' || r0 || ' out of bounds (1-' || mr || ')'
            WHEN c0 > mc THEN 'Start column ' || {letters_sql('c0')} || ' out of bounds (A-' || {letters_sql('mc')} || ')'
            WHEN k <> 2 AND r1 < r0 THEN 'End row cannot be before start row'
            WHEN k <> 2 AND c1 < c0 THEN 'End column cannot be before start column' END AS error FROM j)
        SELECT req_id, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN 'A1:' || {letters_sql('mc')} || mr END AS data_range,
          CASE WHEN error IS NULL THEN k <> 2 AND (r1 > mr OR c1 > mc) END AS extends_beyond_data FROM e""",
)
def _(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start = a1.address(F.floor(key / 4) + 1, cust % 6 + 1)
    end = a1.address(cust * 3 + 1, cust % 5 + 1)
    k = key % 7
    requests = table(spark, d, "orders").select(
        key.alias("req_id"),
        F.when(key % 11 == 0, F.lit("none")).when(key % 2 == 0, F.lit("part")).otherwise(F.lit("orders")).alias("sheet"),
        F.when(k == 1, F.lit("A0")).when(k == 3, F.concat(start, F.lit(":"), end)).otherwise(start).alias("start_cell"),
        F.when(k.isin(2, 3), F.lit(None)).otherwise(end).alias("end_cell"),
    )
    return C.validate_ranges(requests, all_cells(spark, d))


# ---- formulas ------------------------------------------------------------

_FORMULAS = [
    ("'=SUM(A1:B2)+' || p_size", "Formula is valid"),
    ("'=SUM(A1:B' || p_size", "Unclosed parenthesis"),
    ("'=A1)+(B' || p_size", "Unmatched closing parenthesis"),
    ("'SUM(A1)*' || p_size", "Formula must start with ''=''"),
    ("'=INDIRECT (\"A' || p_size || '\")'", "Unsafe function: INDIRECT"),
    ("'=IF(A1>' || p_size || ',RTD(B1),HYPERLINK(1))'", "Unsafe function: RTD"),
    ("'=LOG01(A1)*A0+' || p_size", "Formula is valid"),
    ("'=MYRTD(A1)+B' || (p_size + 1)", "Formula is valid"),
]


def part_formulas(spark, d):
    """One formula per part, sound and broken ones in turn."""
    k = F.col("p_partkey") % len(_FORMULAS)
    text = F.when(F.lit(False), F.lit(""))
    for i, (sql, _) in enumerate(_FORMULAS):
        text = text.when(k == i, F.expr(sql.replace("'SUM", "'SUM")))
    return table(spark, d, "part").select("p_partkey", "p_name", text.alias("formula"))


_F_SQL = "f AS (SELECT p_partkey, p_name, CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN {sql}" for i, (sql, _) in enumerate(_FORMULAS)) + " END AS formula, CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN '{msg}'" for i, (_, msg) in enumerate(_FORMULAS)) + " END AS message FROM part)"


@query(
    "c12_formula_lint",
    f"WITH {_F_SQL} SELECT p_partkey, formula, message = 'Formula is valid' AS valid, message FROM f",
)
def _(spark, d):
    return C.lint_formulas(part_formulas(spark, d), "formula").select("p_partkey", "formula", "valid", "message")


@query(
    "c13_formula_match",
    f"""WITH {_F_SQL}, s AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN formula WHEN 1 THEN '=1+1' ELSE p_name END AS stored FROM f),
        m AS (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN 'Invalid cell reference: 1A'
            WHEN message <> 'Formula is valid' THEN 'Invalid formula syntax: ' || message
            WHEN p_partkey % 8 = 6 THEN 'Invalid cell reference in formula: LOG01' END AS error FROM s)
        SELECT 'calc' AS sheet, CASE WHEN p_partkey % 17 = 0 THEN '1A' ELSE 'B' || (p_partkey + 1) END AS cell, formula,
          error IS NULL AS valid, error IS NULL AND stored = formula AND starts_with(stored, '=') AS matches,
          CASE WHEN error IS NOT NULL THEN error WHEN starts_with(stored, '=') AND stored = formula
            THEN 'Formula is valid and matches cell content' WHEN starts_with(stored, '=')
            THEN 'Formula is valid but doesn''t match cell content'
            ELSE 'Formula is valid but cell contains no formula' END AS message FROM m""",
)
def _(spark, d):
    f = part_formulas(spark, d)
    k = F.col("p_partkey") % 3
    stored = f.select(
        F.lit("calc").alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.lit(2).cast("long").alias("col"),
        F.when(k == 0, F.col("formula")).when(k == 1, F.lit("=1+1")).otherwise(F.col("p_name")).alias("value"))
    asked = f.select(
        F.lit("calc").alias("sheet"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit("1A")).otherwise(F.concat(F.lit("B"), F.col("p_partkey") + 1)).alias("cell"),
        "formula")
    return C.match_formulas(asked, stored)


def _to_apply(spark, d):
    return part_formulas(spark, d).select(
        F.lit("part").alias("sheet"), F.concat(F.lit("b"), F.col("p_partkey") + 2).alias("cell"), "formula")


@query(
    "c14_formula_apply",
    f"""WITH {ALL_CELLS}, {_F_SQL}, ok AS (SELECT p_partkey + 2 AS r, CASE WHEN starts_with(formula, '=') THEN formula
            ELSE '=' || formula END AS formula FROM f WHERE message = 'Formula is valid' OR p_partkey % 8 = 3)
        SELECT {_OUT} FROM cells c WHERE NOT (sheet = 'part' AND "col" = 2 AND EXISTS (SELECT 1 FROM ok WHERE ok.r = c."row"))
        UNION ALL SELECT 'part', r, 2, formula, NULL, 'str' FROM ok""",
)
def _(spark, d):
    return C.apply_formulas(all_cells(spark, d), _to_apply(spark, d))


@query(
    "c14_formula_rejects",
    f"""WITH {_F_SQL} SELECT 'part' AS sheet, 'b' || (p_partkey + 2) AS cell, formula, 'Invalid formula syntax: ' || message AS error
        FROM f WHERE message <> 'Formula is valid' AND p_partkey % 8 <> 3""",
)
def _(spark, d):
    return C.formula_rejects(_to_apply(spark, d))


@query(
    "c15_validation_lookup",
    f"""WITH {ALL_CELLS}, {_RULES_SQL}, v AS (SELECT c.sheet, c."row", c."col", c.value, min(r.rule_no) AS rule_no FROM cells c
          LEFT JOIN rules r ON r.sheet = c.sheet AND c."row" BETWEEN r0 AND r1 AND c."col" BETWEEN c0 AND c1 GROUP BY ALL)
        SELECT v.*, rules.validation_type FROM v LEFT JOIN rules ON rules.rule_no = v.rule_no""",
)
def _(spark, d):
    return C.validation_for_cells(all_cells(spark, d), validation_rules(spark)).select(
        "sheet", "row", "col", "value", "rule_no", "validation_type")


@query(
    "c15_rule_values",
    f"""WITH {ALL_CELLS} SELECT 3::BIGINT AS rule_no, 0::BIGINT AS pos_row, p::BIGINT AS pos_col, v AS value
          FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (4, '5-LOW')) t(p, v)
        UNION ALL SELECT 4, "row", "col", value FROM cells WHERE sheet = 'orders' AND "col" = 3 AND "row" BETWEEN 2 AND 12
        UNION ALL SELECT 5, 0, 0, 'Range: =Z1:Z9 (empty or unresolvable)' UNION ALL SELECT 6, 0, 0, 'only'""",
)
def _(spark, d):
    return C.rule_values(validation_rules(spark), all_cells(spark, d))


# ---- summaries -----------------------------------------------------------


@query(
    "c16_summary_table",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS "l_quantity (sum)",
              round(sum(l_extendedprice), 2) AS "l_extendedprice (sum)" FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    out = C.summary_table(
        table(spark, d, "lineitem"), ["l_returnflag", "L_LINESTATUS (sum)"], ["l_quantity", "l_extendedprice"])
    return out.select(
        "l_returnflag", "l_linestatus",
        *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in ("l_quantity (sum)", "l_extendedprice (sum)")])


for _agg in ("average", "count", "min", "max"):
    _fn = {"average": "avg"}.get(_agg, _agg)

    @query(
        f"c16_summary_{_agg}",
        f"""WITH g AS (SELECT p_brand, p_type, p_size, {_fn}(p_retailprice) AS v FROM part GROUP BY ALL),
            a AS (SELECT DISTINCT p_brand FROM part), b AS (SELECT DISTINCT p_type FROM part), c AS (SELECT DISTINCT p_size FROM part)
            SELECT a.p_brand, b.p_type, CAST(c.p_size AS VARCHAR) AS p_size,
                   round(coalesce(v, 0)::DOUBLE, 4) AS "p_retailprice ({_agg})", 0.0::DOUBLE AS "p_name ({_agg})"
            FROM a, b, c LEFT JOIN g ON g.p_brand = a.p_brand AND g.p_type = b.p_type AND g.p_size = c.p_size""",
    )
    def _(spark, d, agg=_agg):
        out = C.summary_table(
            table(spark, d, "part"), ["p_brand", "p_type", "p_size"], ["p_retailprice", "p_name"], agg_func=agg, every_combination=True)
        return out.withColumn(f"p_retailprice ({agg})", F.round(F.col(f"`p_retailprice ({agg})`"), 4))


@query(
    "c17_cross_tab",
    """SELECT l_linestatus, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2) AS A,
         round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 2) AS N,
         round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 2) AS R FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    return C.cross_tab(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "l_quantity", "sum", ["A", "N", "R"])


@query(
    "c17_cross_tab_found_values",
    """WITH g AS (SELECT l_linestatus, l_shipmode AS k, round(sum(l_quantity), 2) AS v FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'S' || l_orderkey % 7 || l_returnflag END AS l_shipmode FROM lineitem) GROUP BY ALL),
         a AS (SELECT l_linestatus, coalesce(k, 'null') AS k, v FROM g), f AS (SELECT l_linestatus, k FROM (SELECT DISTINCT l_linestatus FROM a), (SELECT DISTINCT k FROM a))
       SELECT f.l_linestatus, f.k, coalesce(v, 0) AS v FROM f LEFT JOIN a ON a.l_linestatus = f.l_linestatus AND a.k = f.k""",
)
def _(spark, d):
    kind = F.when(F.col("l_orderkey") % 7 != 0, F.concat(F.lit("S"), F.col("l_orderkey") % 7, "l_returnflag"))
    wide = C.cross_tab_map(table(spark, d, "lineitem").withColumn("kind", kind), ["l_linestatus"], "kind", "l_quantity")
    return wide.select("l_linestatus", F.explode("values").alias("k", "v")).withColumn("v", F.round("v", 2))


_MONTHLY = """SELECT strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f,
   round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY 1"""


def monthly_orders(spark, d):
    s = F.col("o_orderstatus")
    return (
        table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m"))
        .agg(F.round(F.sum(F.when(s == "F", F.col("o_totalprice"))), 2).alias("f"),
             F.round(F.sum(F.when(s == "O", F.col("o_totalprice"))), 2).alias("o"))
    )


@query(
    "c18_chart_series",
    f"""WITH w AS ({_MONTHLY}) SELECT 'f' AS series, m AS category, f AS value FROM w UNION ALL SELECT 'o', m, o FROM w""",
)
def _(spark, d):
    return C.chart_series(monthly_orders(spark, d), "m", ["f", "o"], "line")


@query(
    "c18_chart_series_scatter",
    """SELECT s AS series, p_size::DOUBLE AS category, CASE s WHEN 'p_retailprice' THEN p_retailprice ELSE p_partkey END AS value
       FROM part, (VALUES ('p_retailprice'), ('p_partkey')) t(s)""",
)
def _(spark, d):
    part = table(spark, d, "part").select("p_size", "p_retailprice", F.col("p_partkey").cast("double").alias("p_partkey"))
    return C.chart_series(part, "p_size", ["p_retailprice", "p_partkey"], "scatter")


# ---- Markdown ------------------------------------------------------------


@query(
    "c19_column_alignment",
    f"""WITH {ALL_CELLS} SELECT sheet, "col", CASE WHEN bool_and(type IN ('int', 'float')) THEN '---:' ELSE '---' END AS alignment
        FROM cells WHERE "row" > 1 GROUP BY ALL""",
)
def _(spark, d):
    return C.column_alignments(all_cells(spark, d))


def marked_parts(spark, d):
    """Parts with names that need escaping and blank brands."""
    k = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, F.lit(" |a\\b ")).when(k == 1, F.lit(" \r\n x \n")).otherwise(F.lit("")))
    return table(spark, d, "part").select(
        "p_partkey", name.alias("p_name"), F.when(k == 2, F.lit("  ")).otherwise(F.col("p_brand")).alias("p_brand"),
        (F.col("p_retailprice") * 1000).alias("price"), (k == 3).alias("flag"))


_MARKED = r"""m AS (SELECT p_partkey + 2 AS r, p_partkey::VARCHAR AS a,
   p_name || CASE p_partkey % 5 WHEN 0 THEN ' \|a\\b' WHEN 1 THEN '<br>x<br>' ELSE '' END AS b,
   CASE WHEN p_partkey % 5 = 2 THEN '' ELSE p_brand END AS c, printf('%g', p_retailprice * 1000) AS d,
   CASE WHEN p_partkey % 5 = 3 THEN 'TRUE' ELSE 'FALSE' END AS e FROM part)"""


@query(
    "c20_markdown_table",
    f"""WITH {_MARKED} SELECT 'part' AS sheet, r AS line_no, '| ' || concat_ws(' | ', a, b, c, d, e) || ' |' AS line
          FROM (SELECT r + 1 AS r, a, b, c, d, e FROM m)
        UNION ALL SELECT 'part', 1, '| p_partkey | p_name | p_brand | price | flag |'
        UNION ALL SELECT 'part', 2, '| ---: | --- | --- | ---: | --- |'""",
)
def _(spark, d):
    cells = C.from_table(
        marked_parts(spark, d), "part", F.col("p_partkey") + 2, ["p_partkey", "p_name", "p_brand", "price", "flag"])
    return C.markdown_table(cells)


@query(
    "c20_markdown_table_capped",
    f"""WITH {ALL_CELLS}, k AS (SELECT * FROM cells WHERE sheet = 'orders' AND "row" <= 2000 AND "col" <= 3),
        g AS (SELECT r, max(value) FILTER ("col" = 1) AS a, max(value) FILTER ("col" = 2) AS b, max(value) FILTER ("col" = 3) AS c
          FROM (SELECT unnest(range(1, least(2000, (SELECT max("row") FROM cells)) + 1)) AS r) LEFT JOIN k ON k."row" = r GROUP BY r)
        SELECT 'orders' AS sheet, CASE WHEN r = 1 THEN 1 ELSE r + 1 END AS line_no,
          '| ' || coalesce(a, '') || ' | ' || coalesce(b, '') || ' | ' || coalesce(c, '') || ' |' AS line FROM g
        UNION ALL SELECT 'orders', 2, '| ---: | ---: | --- |'""",
)
def _(spark, d):
    # the caps are the feature under test; the whole sheet is scanned for its bounds
    return C.markdown_table(order_cells(spark, d), max_rows=2000, max_cols=3)


@query(
    "c21_workbook_report",
    """WITH s AS (SELECT 0 AS sheet_pos, unnest(range(1, 10)) AS line_no, unnest(['# Spreadsheet Source: geo.xlsx', '', '## Workbook Summary', '',
            '- Sheets: 4', '- Visible sheets: region, nation, blank', '',
            '> Note: Formula cells are exported as cached values. This converter does not recalculate formulas.', '']) AS line),
        n AS (SELECT (SELECT count(*) FROM region) AS nr, (SELECT count(*) FROM nation) AS nn),
        h AS (SELECT 1 AS p, unnest(range(1, 11)) AS l, unnest(['## Sheet: region', '', '- State: visible', '- Used range: A1:B' || (nr + 1),
              '- Rows: ' || (nr + 1), '- Columns: 2', '', '| r_regionkey | r_name |', '| ---: | --- |', NULL]) AS line FROM n
            UNION ALL SELECT 2, unnest(range(1, 13)), unnest(['## Sheet: nation', '', '- State: visible', '- Used range: A1:C' || (nn + 1),
              '- Rows: ' || (nn + 1), '- Columns: 3', '', '> Truncated: rows limited to 20.', '',
              '| n_nationkey | n_name | n_regionkey |', '| ---: | --- | ---: |', NULL]) FROM n
            UNION ALL SELECT 4, unnest(range(1, 7)), unnest(['## Sheet: blank', '', '- State: visible', '', '_No content found._', '']))
        SELECT sheet_pos::BIGINT AS sheet_pos, line_no::BIGINT AS line_no, line FROM s UNION ALL SELECT p, l, line FROM h WHERE line IS NOT NULL
        UNION ALL SELECT 1, 10 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region
        UNION ALL SELECT 2, 12 + n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM nation WHERE n_nationkey < 19""",
)
def _(spark, d):
    geo = C.from_table(table(spark, d, "region"), "region", F.col("r_regionkey") + 2, ["r_regionkey", "r_name"])
    geo = geo.unionByName(C.from_table(
        table(spark, d, "nation"), "nation", F.col("n_nationkey") + 2, ["n_nationkey", "n_name", "n_regionkey"]))
    hidden = C.from_table(table(spark, d, "customer"), "hidden", F.col("c_custkey") + 2, ["c_custkey", "c_name"])
    sheets = spark.createDataFrame(
        [(1, "region", "visible"), (2, "nation", "visible"), (3, "hidden", "hidden"), (4, "blank", "visible")],
        "sheet_pos LONG, sheet STRING, state STRING")
    return C.workbook_report(geo.unionByName(hidden), sheets, "geo.xlsx", max_rows=20)


@query(
    "c22_paragraph_list",
    """SELECT doc_id, len(p)::BIGINT AS paragraph_count, i - 1 AS index, p[i] AS text
       FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""",
)
def _(spark, d):
    return C.paragraph_list(table(spark, d, "documents"))


@query(
    "c22_table_previews",
    """WITH c AS (SELECT conv_id AS doc_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS "row" FROM conversations),
        s AS (SELECT doc_id, role AS table_no, max("row") + 1 AS n_rows FROM c GROUP BY ALL)
        SELECT s.doc_id, s.table_no, s.n_rows, 2::BIGINT AS n_cols, c."row", c.turn || ' | ' || c.role AS preview
        FROM s JOIN c ON c.doc_id = s.doc_id AND c.role = s.table_no""",
)
def _(spark, d):
    from ..ordering import number_within

    turns = number_within(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"], "n")
    cells = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("table_no"), (F.col("n") - 1).alias("row"),
        F.inline(F.array(
            F.struct(F.lit(0).cast("long").alias("col"), F.col("turn").cast("string").alias("text")),
            F.struct(F.lit(1).cast("long").alias("col"), F.col("role").alias("text")))))
    return C.table_previews(cells)
