"""Seeded sampling, shuffling and splitting by a hash of the row id."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import seeded_hash
from chatloom.operators.ordering import smallest, with_rank

#: Draws are whole numbers below this; see ``seeded_hash``.
DRAWS = 1 << 60
BUCKETS = 1 << 16


def _drawn(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    return df.withColumn("_draw", seeded_hash(seed, *[F.col(c) for c in ids]))


def _border(drawn: DataFrame, wanted: Callable[[int], int]) -> tuple[int, int, int, int]:
    """Rows, first draw and end of the bucket in which the smallest ``wanted(rows)`` draws end, and how many of it.

    One pass counts draws by their leading bits; a bucket holds one row in ``BUCKETS``.
    """
    width = DRAWS // BUCKETS
    counts = drawn.groupBy(F.floor(F.col("_draw") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()
    total = sum(r["n"] for r in counts)
    left = wanted(total)
    for row in counts:
        if left <= row["n"]:
            return total, row["bucket"] * width, (row["bucket"] + 1) * width, left
        left -= row["n"]
    return total, DRAWS, DRAWS, left


def sample_exact(df: DataFrame, n: int, ids: Sequence[str] = ("msg_id",), seed: int = 21635) -> DataFrame:
    """Exactly ``n`` rows without replacement; an error where there are fewer.

    Rows with smaller draws than those of the border bucket are in; only its rows are ranked.
    """
    drawn = _drawn(df, ids, seed)
    total, low, high, rest = _border(drawn, lambda _: n)
    if total < n:
        raise ValueError(f"cannot take {n} rows out of {total}")
    sure = drawn.filter(F.col("_draw") < low)
    if not rest:
        return sure.drop("_draw")
    edge = drawn.filter((F.col("_draw") >= low) & (F.col("_draw") < high))
    return sure.unionByName(smallest(edge, ["_draw", *ids], rest)).drop("_draw")


def shuffled(df: DataFrame, ids: Sequence[str] = ("msg_id",), seed: int = 3352) -> DataFrame:
    return _drawn(df, ids, seed).orderBy("_draw", *ids).drop("_draw")


def train_test_split(
    df: DataFrame, test_size: float = 0.1, ids: Sequence[str] = ("msg_id",), seed: int = 9873
) -> DataFrame:
    """Adds ``split``: the ``ceil(test_size * n)`` rows drawn first are ``test``, the rest ``train``.

    Rows stay where they are, but for those of the one bucket of draws in which the test part ends.
    """
    drawn = _drawn(df, ids, seed)
    total, low, high, rest = _border(drawn, lambda rows: math.ceil(test_size * rows))
    inside = (F.col("_draw") >= low) & (F.col("_draw") < high)
    split = drawn.filter(~inside).withColumn("split", F.when(F.col("_draw") < low, "test").otherwise("train"))
    edge = with_rank(drawn.filter(inside), ["_draw", *ids], "_rank")
    edge = edge.withColumn("split", F.when(F.col("_rank") < rest, "test").otherwise("train")).drop("_rank")
    return split.unionByName(edge).drop("_draw")


def contrastive_pairs(chat: DataFrame) -> DataFrame:
    """Each cleaned message paired with itself."""
    return chat.select("msg_id", F.col("message_clean").alias("text_a"), F.col("message_clean").alias("text_b"))
