"""Shared helpers: written intermediate tables, checked broadcasts, components of link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Stored size in bytes of a written table up to which it may be broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def written(df: DataFrame) -> DataFrame:
    """``df`` stored below the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing computed later depends on: their readers are written themselves."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_to).getParent()
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table read from storage, as the file index has them."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a *written* table whose files prove it small; else unchanged (a shuffled join)."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _marks(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, root)`` for every id that occurs in a link; root is the smallest id reachable.

    Alternating large-star and small-star rounds; every round is an aggregate with
    map-side combine and a join that AQE may split at a hub. Each round is written
    below the shared folder. Links of an id with itself are ignored, so an id that
    has no other link is absent. NULL ids are ignored.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = written(edges)
    seen = _marks(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = written(large)
        discard(edges)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            large.join(lowest, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        edges = written(star)
        discard(large)
        now = _marks(edges)
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct().join(roots.select("id"), "id", "left_anti"))
