"""Order-dependent steps without a single-task sort.

A window over one key puts that key's rows into one task. Where a key may hold a large share of the
data, rows are range-partitioned over (keys, order) instead, so a hot key spreads over many ordered
blocks. The block id is stored by a reliable checkpoint before it is used, so every later read sees
the same blocks. What crosses block borders is carried by a table of one row per (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

BLOCK = "_block"


def ordered_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows split into contiguous blocks of ``order``. ``order`` must end in a unique column."""
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = df.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id())
    return cut_lineage(split)


def _offsets(counts: DataFrame, keys: Sequence[str], size: str, name: str) -> DataFrame:
    """Rows of a key in earlier blocks; at most one row per block and key reaches a task."""
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(size).over(earlier), F.lit(0)))


def with_rank(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    keys: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """0-based position of each row in ``order``, within ``keys`` or overall."""
    keys = list(keys)
    placed = ordered_blocks(df, [*keys, *order], blocks)
    group = [*keys, BLOCK]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, keys, "_n", "_before").drop("_n")
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(offsets, group)
        .withColumn(name, F.col("_before") + F.col("_local") - 1)
        .drop("_local", "_before", BLOCK)
    )


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """``value`` of the next row of the same key; null on the key's last row."""
    keys = list(keys)
    placed = ordered_blocks(df, [*keys, *order])
    group = [*keys, BLOCK]
    inside = Window.partitionBy(*group).orderBy(*order)
    firsts = placed.groupBy(*group).agg(F.min(F.struct(*order, value))[value].alias("_first"))
    following = firsts.withColumn(
        "_following", F.lead("_first").over(Window.partitionBy(*keys).orderBy(BLOCK))
    ).drop("_first")
    return (
        placed.withColumn("_inner", F.lead(value).over(inside))
        .withColumn("_last", F.lead(F.lit(True)).over(inside).isNull())
        .join(following, group)
        .withColumn(name, F.when(F.col("_last"), F.col("_following")).otherwise(F.col("_inner")))
        .drop("_inner", "_last", "_following", BLOCK)
    )


def smallest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of ``order``, exactly, without gathering them in one task."""
    return with_rank(df, order, "_rank").filter(F.col("_rank") < n).drop("_rank")


def exact_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact median of each value column per key, one row per key.

    Equal values are counted together before anything moves, then ranked over ordered blocks: a hot
    key is spread, and its two middle values are found from running block counts.
    """
    keys = list(keys)
    long = df.select(*keys, F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_which", "_value"))
    counted = long.filter(F.col("_value").isNotNull()).groupBy(*keys, "_which", "_value").agg(F.count(F.lit(1)).alias("_n"))
    group = [*keys, "_which"]
    placed = ordered_blocks(counted, [*group, "_value"])
    totals = placed.groupBy(*group, BLOCK).agg(F.sum("_n").alias("_in_block"))
    offsets = _offsets(totals, group, "_in_block", "_before")
    whole = Window.partitionBy(*group)
    offsets = offsets.withColumn("_total", F.sum("_in_block").over(whole)).drop("_in_block")
    running = Window.partitionBy(*group, BLOCK).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")

    def holds(rank: Column) -> Column:
        return (F.col("_from") <= rank) & (rank < F.col("_to"))

    middles = (
        placed.withColumn("_upto", F.sum("_n").over(running))
        .join(offsets, [*group, BLOCK])
        .withColumn("_to", F.col("_before") + F.col("_upto"))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .filter(holds(low) | holds(high))
        .groupBy(*group)
        .agg(((F.min("_value") + F.max("_value")) / 2).alias("_median"))
    )
    return middles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_which") == i, F.col("_median"))).alias(f"{v}_median") for i, v in enumerate(values)]
    )
