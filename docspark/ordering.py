"""Order and numbering helpers that stay distributed when one key is hot."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import shared_dir

#: Upper bound in bytes under which a side may be broadcast on purpose.
BROADCAST_BYTES = 64 * 1024 * 1024


#: Plan nodes after which the optimizer's size estimate says nothing: they can make many rows of one.
UNSOUND = re.compile(r"Generate|Expand|Join (?!Left(Semi|Anti))|MapIn|MapPartitions|FlatMap|Python|Arrow|ExternalRDD|LogicalRDD")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the size of the files behind ``df`` proves it small.

    Where the plan makes rows (explode, joins, Python) or stands on no files, there is no
    hint: Spark shuffles both sides, and AQE decides by the sizes it then sees.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if UNSOUND.search(plan.toString()):
        return df
    return F.broadcast(df) if int(str(plan.stats().sizeInBytes())) <= limit else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read back: what is used again is computed once."""
    path = f"{shared_dir(df.sparkSession)}/stored"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` dealt into sampled ranges of ``columns`` and written below the shared folder, ``_part`` ascending with them.

    Ranges are cut by rows, not by values: they follow any ordering column, and the rows of
    a hot key are spread over as many ranges as they fill. The input is computed once.
    """
    return stored(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()))


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based row number per key in ``order`` without sending a whole key to one task.

    Rows are dealt into sampled ranges, sorted and written with their place in the range. A key is one run
    of places in a range, so its number is the place, less the run's first place, plus the key's rows in the
    ranges before: the rows themselves are shuffled once, and only the list of runs is grouped.
    """
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.col("_at")  # the range in the upper bits, the place in the lower 33
    cut = stored(cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.call_function("shiftright", at, F.lit(33))))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(
        cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_shift")
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        cut.join(broadcast_if_small(shift), same)
        .withColumn(out, F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_p", "_shift", *[f"_k{i}" for i in range(len(keys))])
    )


def running_offsets(counts: DataFrame, key: str, count_col: str, out: str) -> DataFrame:
    """Exclusive running sum of ``count_col`` in order of ``key``, which may be of any ordered type.

    Sampled ranges are summed first, the list of their totals (one row a partition) is
    accumulated, then each range accumulates on its own.
    """
    cut = _ranged(counts, [key])
    acc = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("_part").agg(F.sum(count_col).alias("_t")).select(
        "_part", F.coalesce(F.sum("_t").over(acc), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(base, "_part")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(count_col).over(inner), F.lit(0)))
        .drop("_part", "_base")
    )


def ordered_concat(value: Column | str, order: Column | str, sep: str) -> Column:
    """Aggregate texts of a bounded group in order (NULL texts are skipped)."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.sort_array(F.collect_list(F.struct(o.alias("o"), v.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def map_of(key: Column | str, value: Column) -> Column:
    """Aggregate a map of a bounded group; of values of one key the largest stays, so repeated keys do no harm."""
    k = F.col(key) if isinstance(key, str) else key
    pairs = F.sort_array(F.collect_list(F.struct(k.alias("k"), value.alias("v"))))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["k"] != p["k"], F.lit(True)))
    return F.map_from_entries(last)


def spread_if_few(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` only when the input has fewer splits than there are slots.

    Large inputs keep their own splits and are not shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(slots, *keys) if splits < slots else df


def spread_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys`` over as many tasks as ``df`` has splits, or as there are slots if these are more.

    For short rows that are costly to work on: AQE deals by bytes and would bring all of them to a few
    tasks, but keeps a number of partitions that is given.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.select(*keys).repartition(max(slots, splits), *keys).distinct()
