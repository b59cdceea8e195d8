"""Term counts per topic, class-based weighting and term descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import text
from chatloom.operators.ordering import with_next
from chatloom.session import stored

BLOCK_TOPICS = 500  # topics of one term that are multiplied with each other under one key
CHUNK_WORDS = 1_000_000  # words a task counts at a time


def default_stop_words() -> list[str]:
    """French and English words, plain and capitalised, each also with the word mark."""
    words = StopWordsRemover.loadDefaultStopWords("french") + StopWordsRemover.loadDefaultStopWords("english")
    words = words + [w.capitalize() for w in words]
    return words + ["▁" + w for w in words] + ["▁"]


def with_kept_words(
    messages: DataFrame, stop_words: Sequence[str], column: str = "message_clean", name: str = "words"
) -> DataFrame:
    """Folded words of each message without stop words; stop words go first, so pairs bridge them."""
    words = messages.withColumn(name, text.term_words(F.col(column)))
    return words.withColumn(name, text.without_stop_words(name, stop_words))


def term_vocabulary(
    messages: DataFrame, stop_words: Sequence[str], column: str = "message_clean", min_df: int = 1
) -> DataFrame:
    """Distinct one- and two-word terms of single messages with the number of messages they are in."""
    words = with_kept_words(messages.select(column), stop_words, column)
    terms = words.select(F.explode(F.array_distinct(text.terms_of(F.col("words")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)


def _inner_counts(words: DataFrame) -> DataFrame:
    """``labels, term, n`` of the one- and two-word terms inside messages, counted in each task chunk by chunk."""

    def counted(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        arrays = rows["words"].combine_chunks()
        sizes = pc.list_value_length(arrays).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(arrays)
        labels = rows["labels"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        first = pa.array(np.delete(np.arange(len(flat)), np.cumsum(sizes) - 1))  # all words but the last of each message
        pairs = pc.binary_join_element_wise(flat.take(first), flat.take(pc.add(first, 1)), " ")
        table = pa.table({"labels": pa.concat_arrays([labels, labels.take(first)]), "term": pa.concat_arrays([flat, pairs])})
        table = table.group_by(["labels", "term"]).aggregate([([], "count_all")])
        return table.select(["labels", "term", "count_all"]).rename_columns(["labels", "term", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.list_value_length(batch.column("words"))).as_py() or 0
            if size >= CHUNK_WORDS:
                yield from counted(held).to_batches()
                held, size = [], 0
        if size:
            yield from counted(held).to_batches()

    schema = T.StructType([words.schema["labels"], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    return words.select("labels", "words").mapInArrow(count, schema)


def topic_term_counts(
    messages: DataFrame,
    stop_words: Sequence[str],
    vocabulary: DataFrame | None = None,
    column: str = "message_clean",
) -> DataFrame:
    """Term counts of the joined text of each topic: ``labels, term, n``.

    Inside a message all terms are counted where they are, and shuffled once, by term. A two-word term may also straddle two
    messages that follow each other in the topic: for these only the outer words of each message
    travel. ``vocabulary`` limits the terms; without it, terms seen in single messages count.
    """
    rows = messages.select("labels", "published_datetime", "msg_id", column)
    # inner terms, the sampling of blocks and the blocks themselves all read the folded words
    words = stored(with_kept_words(rows, stop_words, column).drop(column), "words").filter(F.size("words") > 0)
    outer = words.select(
        "labels",
        "published_datetime",
        "msg_id",
        F.get("words", F.lit(0)).alias("first"),
        F.element_at("words", -1).alias("last"),
    )
    follow = with_next(outer, ["labels"], ["published_datetime", "msg_id"], "first", "next")
    across = follow.filter(F.col("next").isNotNull()).select(
        "labels", F.concat_ws(" ", "last", "next").alias("term"), F.lit(1).cast("bigint").alias("n")
    )
    both = _inner_counts(words).withColumn("_seen", F.lit(True)).unionByName(across.withColumn("_seen", F.lit(False))).repartition("term")
    counts = both.groupBy("labels", "term").agg(F.sum("n").alias("n"), F.max("_seen").alias("_seen"))
    if vocabulary is not None:
        return stored(counts.drop("_seen").join(vocabulary.select("term"), "term", "left_semi"), "terms")
    # a term has at most one row per topic here
    known = F.max("_seen").over(Window.partitionBy("term"))
    # weighting, ranking and similarity each pass over the counts several times
    return stored(counts.withColumn("_known", known).filter("_known").select("labels", "term", "n"), "terms")


def ctfidf(counts: DataFrame, seed_words: Sequence[str] = (), multiplier: float = 1.2) -> DataFrame:
    """Adds ``importance``: share of the topic's terms times ``log(1 + mean topic size / term total)``."""
    sizes = counts.groupBy("labels").agg(F.sum("n").alias("_size"))
    mean_size = F.floor(sizes.select(F.avg("_size")).scalar())
    total = F.sum("n").over(Window.partitionBy("term"))  # a term has at most one row per topic
    idf = F.log(1 + F.col("_mean") / F.col("_total"))
    if seed_words:
        idf = idf * F.when(F.col("term").isin(*seed_words), F.lit(multiplier)).otherwise(F.lit(1.0))
    return (
        counts.withColumns({"_total": total, "_mean": mean_size})
        .join(sizes, "labels")
        .select("labels", "term", "n", (F.col("n") / F.col("_size") * idf).alias("importance"))
    )


def top_terms(weighted: DataFrame, by: str = "n", count: int = 10) -> DataFrame:
    """Best terms per topic with their 1-based rank; ties in text order."""
    order = Window.partitionBy("labels").orderBy(F.col(by).desc(), "term")
    return weighted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def terms_wide(weighted: DataFrame, by: str = "n", count: int = 10) -> DataFrame:
    """One row per topic: number of terms, then term and whole-number weight of each rank."""
    best = top_terms(weighted, by, count)
    wide = best.groupBy("labels").pivot("rank", list(range(1, count + 1))).agg(
        F.first("term").alias("term"), F.first(F.col(by).cast("int")).alias("freq")
    )
    columns = []
    for i in range(1, count + 1):
        columns.append(F.coalesce(F.col(f"{i}_term"), F.lit("")).alias(f"term_{i}"))
        columns.append(F.coalesce(F.col(f"{i}_freq"), F.lit(0)).alias(f"term_{i}_freq"))
    distinct_terms = weighted.filter(F.col(by) != 0).groupBy("labels").agg(F.count(F.lit(1)).alias("terms_nunique"))
    return wide.join(distinct_terms, "labels").select(F.col("labels").alias("labels_"), "terms_nunique", *columns)


def topic_labels(weighted: DataFrame, by: str = "n", count: int = 5) -> DataFrame:
    """The leading terms of each topic as one text."""
    best = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top_terms(weighted, by, count).groupBy("labels").agg(
        text.terms_label(F.transform(best, lambda t: t["term"]), count).alias("terms")
    )


def topic_similarity(weighted: DataFrame, by: str = "n", block_topics: int = BLOCK_TOPICS) -> DataFrame:
    """Cosine of every two topics that share a term (the others are 0).

    A sparse product in blocks: the topics of a term are dealt into pieces of about ``block_topics``, and each pair
    of pieces is a join key of its own, so no key yields many more than ``block_topics`` squared products however
    many topics use a term. Each pair of topics is multiplied once and mirrored at the end. Terms of one piece meet
    themselves where the pieces were counted, without another shuffle.
    """
    value = F.col(by).cast("double")
    pieces = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("term")) / block_topics).cast("int")
    dealt = weighted.select("term", "labels", value.alias("value"), pieces.alias("pieces"))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("labels"), F.col("pieces")).cast("int"))
    alone, dealt = dealt.filter("pieces = 1"), dealt.filter("pieces > 1")
    own = alone.select("term", F.col("labels").alias("l"), F.col("value").alias("a")).join(
        alone.select("term", F.col("labels").alias("r"), F.col("value").alias("b")), "term"
    ).filter("l <= r")
    # a row as the smaller piece of a pair, and as the larger one
    left = dealt.select("term", F.col("labels").alias("l"), F.col("value").alias("a"), F.col("piece").alias("p"),
                        F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("q"))
    right = dealt.select("term", F.col("labels").alias("r"), F.col("value").alias("b"), F.col("piece").alias("q"),
                         F.explode(F.sequence(F.lit(0), "piece")).alias("p"))
    met = left.join(right, ["term", "p", "q"]).filter((F.col("p") < F.col("q")) | (F.col("l") <= F.col("r")))
    met = met.select("l", "r", "a", "b").unionByName(own.select("l", "r", "a", "b"))
    dots = met.groupBy(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    sides = F.when(F.col("l") == F.col("r"), F.array(F.struct(F.col("l").alias("labels_a"), F.col("r").alias("labels_b")))).otherwise(
        F.array(F.struct(F.col("l").alias("labels_a"), F.col("r").alias("labels_b")), F.struct(F.col("r").alias("labels_a"), F.col("l").alias("labels_b")))
    )
    both = dots.select("dot", F.inline(sides))
    norms = weighted.groupBy("labels").agg(F.sqrt(F.sum(value * value)).alias("norm"))
    return (
        both.join(norms.select(F.col("labels").alias("labels_a"), F.col("norm").alias("norm_a")), "labels_a")
        .join(norms.select(F.col("labels").alias("labels_b"), F.col("norm").alias("norm_b")), "labels_b")
        .select("labels_a", "labels_b", (F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("similarity"))
    )
