"""SQL over registered tables, row changes with counts, table catalogue."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..ordering import broadcast_if_small, stored
from ..session import shared_dir


def run_sql(
    spark: SparkSession, tables: dict[str, DataFrame], sql: str, params: list | None = None
) -> DataFrame:
    """Run one statement over the named frames with positional ``?`` binds.

    The names hold for this statement only: views of the session that have such a name are
    put back as soon as the statement is analysed.
    """
    if not sql.strip():
        raise ValueError("sql must not be empty")
    views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in views}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql, args=params) if params else spark.sql(sql)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


# ---- recursion -----------------------------------------------------------

#: Written parts of a fixpoint that are put together to one.
FAN = 8


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written and read back, with the rows that the write has seen."""
    seen = Observation()
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True) -> DataFrame:
    """Rows of ``start`` and of ``step`` applied again and again to the newest rows, until it gives none.

    ``distinct`` (UNION) drops rows that were seen before, else (UNION ALL) all count. A round reads
    the newest rows only and is written, so neither depth nor size is limited and nothing is computed twice;
    eight written parts become one, so rows seen before are few tables however deep it goes. Columns are
    matched by place and take the types of ``start``. A step that always finds new rows never ends.
    """
    names, types = start.columns, [t for _, t in start.dtypes]
    newest, n = _counted(start.distinct() if distinct else start)
    parts: list[list[DataFrame]] = [[newest]]  # parts[i]: of FAN ** i rounds each
    together = lambda: reduce(DataFrame.union, [p for level in parts for p in level])
    while n:
        found = step(newest).toDF(*names)
        found = found.select(*[F.col(c).cast(t).alias(c) for c, t in zip(names, types, strict=True)])
        if distinct:
            # rows seen before are small files for long: without the hint each round would broadcast all of them
            old = together().toDF(*[f"_{i}" for i in range(len(names))]).hint("merge")
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(names)])
            found = found.distinct().join(old, same, "left_anti")
        newest, n = _counted(found)
        if n:
            parts[0].append(newest)
        for i, level in enumerate(parts):
            if len(level) >= FAN:
                whole = stored(reduce(DataFrame.union, level))
                parts[i] = []
                if i + 1 == len(parts):
                    parts.append([])
                parts[i + 1].append(whole)
    return together()


def run_recursive_sql(
    spark: SparkSession, tables: dict[str, DataFrame], name: str, start: str, step: str, statement: str,
    distinct: bool = True, params: list | None = None,
) -> DataFrame:
    """``WITH RECURSIVE name AS (start UNION [ALL] step) statement`` of any depth and size.

    ``step`` refers to ``name`` for the newest rows, ``statement`` for all of them; ``params`` bind the
    latter. See :func:`fixpoint`.
    """
    if name in tables:
        raise ValueError(f"{name} is a table already")
    rows = fixpoint(run_sql(spark, tables, start), lambda newest: run_sql(spark, tables | {name: newest}, step), distinct)
    return run_sql(spark, tables | {name: rows}, statement, params)


# ---- row changes ---------------------------------------------------------


def insert_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """All rows after the insert; columns are matched by name."""
    return df.unionByName(new.select(*df.columns))


def insert_changes(new: DataFrame) -> DataFrame:
    return new.agg(F.count(F.lit(1)).alias("changes"))


def update_rows(df: DataFrame, where: Column, assignments: dict[str, Column]) -> DataFrame:
    """All rows after the update; every assignment reads the old values."""
    unknown = set(assignments) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    hit = F.coalesce(where, F.lit(False))
    return df.select(
        *[
            F.when(hit, assignments[c]).otherwise(F.col(c)).cast(t).alias(c) if c in assignments else F.col(c)
            for c, t in df.dtypes
        ]
    )


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    """Rows left after the delete; a NULL predicate keeps the row."""
    return df.where(~F.coalesce(where, F.lit(False)))


def matched_changes(df: DataFrame, where: Column) -> DataFrame:
    """Number of rows an update or delete with this predicate touches."""
    return df.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("changes"))


# ---- row changes of a stored table ---------------------------------------


def insert_stored(spark: SparkSession, path: str, partition_by: list[str], new: DataFrame) -> DataFrame:
    """Appends rows to the partitioned table at ``path``; one row: ``changes``. Files that are there stay as they are."""
    table = spark.read.parquet(path)
    rows, n = _counted(new.select(*table.columns))
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
    return _changes(spark, n)


def update_stored(spark: SparkSession, path: str, partition_by: list[str], where: Column, assignments: dict[str, Column]) -> DataFrame:
    """Updates the table at ``path`` in place; one row: ``changes``. Only partitions with matches are written anew."""
    fixed = set(assignments) & set(partition_by)
    if fixed:
        raise ValueError(f"partition columns can't be updated: {', '.join(sorted(fixed))}")
    return _rewrite(spark, path, partition_by, where, lambda rows: update_rows(rows, where, assignments))


def delete_stored(spark: SparkSession, path: str, partition_by: list[str], where: Column) -> DataFrame:
    """Deletes rows of the table at ``path``; one row: ``changes``. Only partitions with matches are written anew."""
    return _rewrite(spark, path, partition_by, where, lambda rows: delete_rows(rows, where))


def _rewrite(spark: SparkSession, path: str, partition_by: list[str], where: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the partitions that hold a match, changed and written in place of these partitions.

    The new rows are written aside first, so a job that is lost leaves the table as it was; the
    partitions are then overwritten, and those without rows are removed.
    """
    table = spark.read.parquet(path)
    if not partition_by:
        raise ValueError("a table without partitions is written as a whole")
    hits = stored(table.where(F.coalesce(where, F.lit(False))).groupBy(*partition_by).agg(F.count(F.lit(1)).alias("_n")))
    touched = hits.select(*[F.col(c).alias(f"_{c}") for c in partition_by])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition_by])
    rows = change(table.join(broadcast_if_small(touched), same, "left_semi"))
    aside = f"{shared_dir(spark)}/rows"
    rows.write.partitionBy(*partition_by).parquet(aside)
    left = spark.read.schema(table.schema).parquet(aside)
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    kept = left.select(*[F.col(c).alias(f"_{c}") for c in partition_by]).distinct()
    same = reduce(Column.__and__, [F.col(f"t._{c}").eqNullSafe(F.col(f"k._{c}")) for c in partition_by])
    for folder in touched.alias("t").join(kept.alias("k"), same, "left_anti").toLocalIterator():  # partitions that lost all rows
        _remove(spark, path, partition_by, folder)
    return hits.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("changes"))


def _remove(spark: SparkSession, path: str, partition_by: list[str], values) -> None:
    """Removes the folder of one partition, found by the values it stands for."""
    table = spark.read.parquet(path)
    mine = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(values[f"_{c}"])) for c in partition_by])
    for file in table.where(mine).select(F.col("_metadata.file_path").alias("f")).distinct().toLocalIterator():
        found = spark._jvm.org.apache.hadoop.fs.Path(file["f"])
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, False)


def _changes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1).select(F.lit(n).cast("long").alias("changes"))


def create_table_as(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the rows as a new table at ``path`` and read it back."""
    df.write.format(fmt).mode("errorifexists").save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def table_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Name and CREATE text of each table, sorted by name."""
    rows = []
    for name in sorted(tables):
        if name.startswith("sqlite_"):
            continue
        cols = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in tables[name].schema.fields)
        rows.append((name, f"CREATE TABLE {name} ({cols})"))
    return spark.createDataFrame(rows, "name STRING, schema STRING")
