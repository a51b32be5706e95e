"""Section B: SQL over registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sqlops as S
from ..session import shared_dir
from .registry import query, table


def _sql_query(name, tables, sql, params=None, oracle=None):
    """Register a statement that reads the same in Spark and in DuckDB."""

    def run(spark, d):
        return S.run_sql(spark, {t: table(spark, d, t) for t in tables}, sql, params)

    query(name, oracle or sql)(run)


_sql_query(
    "b01_parameterised_select",
    ["orders"],
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderstatus = ? AND o_totalprice >= ? AND o_custkey % 2 = ?""",
    ["F", 100000.0, 1],
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice >= 100000.0 AND o_custkey % 2 = 1""",
)

_sql_query(
    "b02_inner_join",
    ["customer", "orders", "nation"],
    """SELECT n.n_name, o.o_orderstatus, count(*) AS n_orders,
              round(sum(CAST(o.o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS total
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
       GROUP BY n.n_name, o.o_orderstatus""",
)

_sql_query(
    "b02_left_join",
    ["customer", "orders"],
    """SELECT c.c_custkey, count(o.o_orderkey) AS n_orders
       FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'
       GROUP BY c.c_custkey""",
)

_sql_query(
    "b02_theta_join",
    ["nation", "region", "customer"],
    # unequal join against the fixed 5-row table; the equality on nation keeps it a hash join
    """SELECT r.r_name, count(*) AS n_customers
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON r.r_regionkey >= n.n_regionkey
       GROUP BY r.r_name""",
)

_sql_query(
    "b02_exists",
    ["customer", "orders"],
    """SELECT c_custkey, c_name FROM customer c
       WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""",
)

_sql_query(
    "b02_not_exists",
    ["customer", "orders"],
    """SELECT c_custkey, c_name FROM customer c
       WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
)

_sql_query(
    "b03_aggregate",
    ["lineitem"],
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp,
              sum(l_quantity) AS qty, round(avg(l_quantity), 6) AS avg_qty,
              min(l_shipdate)::DATE::VARCHAR AS first_ship, max(l_extendedprice) AS max_price
       FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""".replace("::VARCHAR", "::STRING"),
)

_sql_query(
    "b04_window",
    ["orders"],
    """SELECT o_orderkey, o_custkey,
              CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn,
              CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS price_rank,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey
                   ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3,
              lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_key
       FROM orders""",
)

for _op in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT"):
    _sql_query(
        f"b05_{_op.lower().replace(' ', '_')}",
        ["customer", "supplier"],
        f"""SELECT c_nationkey AS nationkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM customer
            {_op} SELECT s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT) FROM supplier""",
    )

_sql_query(
    "b06_sort_limit_offset",
    ["orders"],
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC LIMIT 50 OFFSET 10""",
)

_sql_query(
    "b06_top_nulls_first",
    ["orders"],
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS prio FROM orders
       ORDER BY prio ASC NULLS FIRST, o_orderkey LIMIT 40""",
)

_sql_query(
    "b07_correlated_subquery",
    ["part", "lineitem"],
    """SELECT p.p_brand, count(*) AS n FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
       WHERE l.l_quantity < (SELECT 0.9 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p.p_partkey)
       GROUP BY p.p_brand""",
)

_sql_query(
    "b07_cte_scalar_subquery",
    ["orders"],
    """WITH per_cust AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey)
       SELECT o_custkey, CAST(total AS DOUBLE) AS total FROM per_cust
       WHERE total > (SELECT avg(CAST(total AS DOUBLE)) * 1.5 FROM per_cust)""",
)

_sql_query(
    "b07_recursive_cte",
    ["customer"],
    """WITH RECURSIVE bands(lo) AS (
         SELECT -1000 AS lo UNION ALL SELECT lo + 1000 FROM bands WHERE lo < 9000)
       SELECT b.lo, count(c.c_custkey) AS n FROM bands b
       LEFT JOIN customer c ON CAST(floor(c.c_acctbal / 1000) * 1000 AS INT) = b.lo GROUP BY b.lo""",
)

_sql_query(
    "b08_scalar_functions",
    ["events"],
    """SELECT event_id, upper(event_type) AS kind, substr(event_type, 1, 3) AS head, length(props) AS n_props,
              CAST(get_json_object(props, '$.k') AS BIGINT) AS k, round(value) AS scaled,
              CAST(date_trunc('hour', ts) AS STRING) AS hour_start, coalesce(nullif(event_type, 'click'), '-') AS other
       FROM events""",
    None,
    """SELECT event_id, upper(event_type) AS kind, substr(event_type, 1, 3) AS head, length(props) AS n_props,
              CAST(props->>'$.k' AS BIGINT) AS k, round(value) AS scaled,
              CAST(date_trunc('hour', ts) AS VARCHAR) AS hour_start, coalesce(nullif(event_type, 'click'), '-') AS other
       FROM events""",
)


def _new_customers(spark, d):
    """Suppliers taken over as customers: the rows to insert."""
    return table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLY").alias("c_mktsegment"),
    )


@query(
    "b09_insert_rows",
    """SELECT * FROM customer UNION ALL
       SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLY' FROM supplier""",
)
def _(spark, d):
    return S.insert_rows(table(spark, d, "customer"), _new_customers(spark, d))


@query("b09_insert_changes", "SELECT count(*) AS changes FROM supplier")
def _(spark, d):
    return S.insert_changes(_new_customers(spark, d))


def _in_debt():
    return (F.col("c_acctbal") < 0) & (F.col("c_mktsegment") != "BUILDING")


@query(
    "b10_update_rows",
    """SELECT c_custkey, c_name, c_nationkey,
              CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal,
              CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment || '-RESET'
                   ELSE c_mktsegment END AS c_mktsegment
       FROM customer""",
)
def _(spark, d):
    return S.update_rows(
        table(spark, d, "customer"),
        _in_debt(),
        {"c_acctbal": F.lit(0.0), "c_mktsegment": F.concat("c_mktsegment", F.lit("-RESET"))},
    )


@query(
    "b10_update_changes",
    "SELECT count(*) AS changes FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'",
)
def _(spark, d):
    return S.matched_changes(table(spark, d, "customer"), _in_debt())


def _old_orders():
    # NULL for status P: those rows must stay
    return F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_totalprice") < 50000)


@query(
    "b11_delete_rows",
    "SELECT * FROM orders WHERE o_orderstatus = 'P' OR NOT (o_totalprice < 50000)",
)
def _(spark, d):
    return S.delete_rows(table(spark, d, "orders"), _old_orders())


@query(
    "b11_delete_changes",
    "SELECT count(*) AS changes FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice < 50000",
)
def _(spark, d):
    return S.matched_changes(table(spark, d, "orders"), _old_orders())


@query(
    "b12_create_table_as",
    """SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY o_custkey""",
)
def _(spark, d):
    summary = (
        table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    )
    return S.create_table_as(summary, shared_dir(spark))


# ---- recursion of any depth ----------------------------------------------


@query(
    "b07_recursive_chain",
    """WITH RECURSIVE hop AS (SELECT max(p_partkey) // 110 + 1 AS w FROM part), walk(k, depth, total) AS (
         SELECT p_partkey, 1, CAST(p_size AS BIGINT) FROM part, hop WHERE p_partkey <= w
         UNION SELECT p.p_partkey, depth + 1, (total + p.p_size) % 1000 FROM walk, hop, part p WHERE p.p_partkey = k + w)
       SELECT k AS p_partkey, depth, total FROM walk""",
)
def _(spark, d):
    """Chains of parts about 110 steps deep, whatever the scale: beyond the depth that Spark's own recursion allows."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    hop = S.stored(part.selectExpr("max(p_partkey) div 110 + 1 AS w"))
    return S.run_recursive_sql(
        spark, {"part": part, "hop": hop}, "walk",
        "SELECT p_partkey AS k, 1 AS depth, CAST(p_size AS BIGINT) AS total FROM part, hop WHERE p_partkey <= w",
        "SELECT p.p_partkey, depth + 1, (total + p.p_size) % 1000 FROM walk, hop, part p WHERE p.p_partkey = k + w",
        "SELECT k AS p_partkey, depth, total FROM walk",
    )


# ---- row changes of a stored table ---------------------------------------


def _stored_customers(spark, d):
    path = f"{shared_dir(spark)}/customers"
    table(spark, d, "customer").write.partitionBy("c_mktsegment").parquet(path)
    return path


_KEPT = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("b09_insert_stored", f"{_KEPT} UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLY' FROM supplier")
def _(spark, d):
    path = _stored_customers(spark, d)
    S.insert_stored(spark, path, ["c_mktsegment"], _new_customers(spark, d))
    return spark.read.schema(table(spark, d, "customer").schema).parquet(path)


@query(
    "b10_update_stored",
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment,
         (SELECT count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal < 0) AS changes FROM customer""",
)
def _(spark, d):
    path = _stored_customers(spark, d)
    where = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") < 0)
    changes = S.update_stored(spark, path, ["c_mktsegment"], where, {"c_acctbal": F.lit(0.0)})
    return spark.read.schema(table(spark, d, "customer").schema).parquet(path).join(F.broadcast(changes))


@query(
    "b11_delete_stored",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND c_acctbal < 0) AS changes
       FROM customer WHERE NOT (c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND c_acctbal < 0)""",
)
def _(spark, d):
    path = _stored_customers(spark, d)
    where = (F.col("c_mktsegment") == "MACHINERY") | ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0))
    changes = S.delete_stored(spark, path, ["c_mktsegment"], where)
    return spark.read.schema(table(spark, d, "customer").schema).parquet(path).join(F.broadcast(changes))
