"""Silhouettes, label order and per-label measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text
from chatloom.functions.times import micros, seconds_between
from chatloom.operators.neighbors import BLOCK_ROWS, SUM_ROWS, _distances, _matrix, label_distance_sums
from chatloom.operators.ordering import with_rank
from chatloom.schema import SUPER_CLUSTER_MEASURES
from chatloom.session import cut_lineage

# Numbers a centroid table may hold to be sent to every task (32 MB of doubles).
CENTROID_LIMIT = 4_000_000


def _score(own, other, size):
    """``(b - a) / max(a, b)``; 0 for a label of one row or where both are 0."""
    larger = F.greatest(own, other)
    return F.when((size <= 1) | (larger == 0) | other.isNull(), F.lit(0.0)).otherwise((other - own) / larger)


def silhouette_exact(points: DataFrame, block_rows: int = SUM_ROWS) -> DataFrame:
    """Silhouette of each row over all pairs: ``msg_id, labels, silhouette``. Quadratic."""
    sizes = points.groupBy("labels").agg(F.count(F.lit(1)).alias("size"))
    sums = label_distance_sums(points.select("msg_id", "labels", "vector"), block_rows)
    means = (
        sums.join(sizes.withColumnRenamed("labels", "other"), "other")
        .join(points.select("msg_id", "labels"), "msg_id")
        .withColumn("own", F.col("other") == F.col("labels"))
    )
    both = means.groupBy("msg_id", "labels").agg(
        F.max(F.when(F.col("own"), F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~F.col("own"), F.col("total") / F.col("size"))).alias("b"),
        F.max(F.when(F.col("own"), F.col("size"))).alias("size"),
    )
    return both.select("msg_id", "labels", _score(F.col("a"), F.col("b"), F.col("size")).alias("silhouette"))


def label_centroids(points: DataFrame) -> DataFrame:
    """Mean vector and size per label; vector sums are partial before the shuffle."""
    return points.groupBy("labels").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))).alias("centroid"),
        F.count(F.lit(1)).alias("size"),
    )


def _against_centroids(points: DataFrame, centroids: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs ``kernel(rows, labels, matrix)`` on batches of rows and the (checked) centroid table.

    A table over ``CENTROID_LIMIT`` numbers is cut into chunks that rows visit one by one; the
    caller merges what the chunks say about a row.
    """
    centroids = centroids.select("labels", "centroid")
    width = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    chunks = -(-(width["n"] * (width["d"] or 1)) // CENTROID_LIMIT)
    rows = points.select("msg_id", "labels", F.col("vector").cast("array<double>").alias("vector"))
    if chunks <= 1:
        table = centroids.orderBy("labels").collect()
        names = np.asarray([r["labels"] for r in table], dtype=np.int64)
        matrix = np.asarray([r["centroid"] for r in table], dtype=np.float64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf) and len(names):
                    yield kernel(pdf, names, matrix)

        return rows.mapInPandas(run, schema)
    pieces = max(1, -(-rows.count() // BLOCK_ROWS))
    left = rows.withColumn("piece", text.seeded_hash(3, F.col("msg_id")) % pieces).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    right = centroids.select(
        F.col("labels").alias("other"),
        F.col("centroid").alias("mean"),
        F.pmod(F.xxhash64("labels"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))).alias("piece"),
    )

    columns = [part.split()[0] for part in schema.split(", ")]

    def run_chunk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            ordered = b.sort_values("other")
            return kernel(a, ordered["other"].to_numpy(), _matrix(ordered["mean"]))
        return pd.DataFrame(columns=columns)

    place = ["piece", "chunk"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(run_chunk, schema)


def silhouette_simplified(points: DataFrame) -> DataFrame:
    """Silhouette against label centroids, linear in the rows: ``msg_id, labels, silhouette``."""
    centroids = cut_lineage(label_centroids(points))  # one row per label, read three times

    def measure(pdf: pd.DataFrame, names: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
        gaps = _distances(_matrix(pdf["vector"]), matrix)
        own = pdf["labels"].to_numpy()[:, None] == names[None, :]
        a = np.where(own, gaps, np.inf).min(axis=1)
        b = np.where(own, np.inf, gaps).min(axis=1)
        return pd.DataFrame({"msg_id": pdf["msg_id"].to_numpy(), "labels": pdf["labels"].to_numpy(), "a": a, "b": b})

    gaps = _against_centroids(points, centroids, measure, "msg_id bigint, labels int, a double, b double")
    infinite = F.lit(float("inf"))
    best = gaps.groupBy("msg_id", "labels").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    best = best.withColumn("b", F.when(F.col("b") != infinite, F.col("b")))
    return best.join(centroids.select("labels", "size"), "labels").select(
        "msg_id", "labels", _score(F.col("a"), F.col("b"), F.col("size")).alias("silhouette")
    )


def soft_membership(points: DataFrame) -> DataFrame:
    """Share of each topic in each row: inverse centroid distances, scaled to 1; noise has no share."""
    centroids = label_centroids(points.filter(F.col("labels") != -1))

    def weigh(pdf: pd.DataFrame, names: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
        weights = 1.0 / np.maximum(_distances(_matrix(pdf["vector"]), matrix), 1e-12)
        return pd.DataFrame({
            "msg_id": np.repeat(pdf["msg_id"].to_numpy(), len(names)),
            "labels": np.tile(names, len(pdf)).astype(np.int32),
            "weight": weights.ravel(),
        })

    weights = _against_centroids(points, centroids, weigh, "msg_id bigint, labels int, weight double")
    total = F.sum("weight").over(Window.partitionBy("msg_id"))
    return weights.withColumn("total", total).select("msg_id", "labels", (F.col("weight") / F.col("total")).alias("probability"))


def label_order(messages: DataFrame) -> DataFrame:
    """0-based order of the labels by their first message, noise included."""
    firsts = messages.groupBy("labels").agg(F.min("published_datetime").alias("_first"))
    return with_rank(firsts, ["_first", "labels"], "order").select("labels", F.col("order").cast("int").alias("order"))


def elapsed_in_label(messages: DataFrame) -> DataFrame:
    """Adds seconds since the first message of the row's label."""
    firsts = messages.groupBy("labels").agg(F.min(micros("published_datetime")).alias("_first"))
    return messages.join(firsts, "labels").withColumn(
        "elapsed_time_label", seconds_between(F.col("_first"), micros("published_datetime"))
    ).drop("_first")


def prepare_clusters(messages: DataFrame, silhouettes: DataFrame) -> DataFrame:
    """Messages with silhouette, label order and elapsed time; noise takes part in all of them."""
    scored = messages.join(silhouettes.select("msg_id", "silhouette"), "msg_id")
    return elapsed_in_label(scored.join(label_order(messages), "labels"))


def modal_first_word(messages: DataFrame, word: str | None = None) -> DataFrame:
    """Most used first word per label, of the message or in the column ``word``; ties in text order."""
    first = F.col(word) if word else text.first_word(F.col("message"))
    words = messages.select("labels", first.alias("first_word"))
    counts = words.groupBy("labels", "first_word").agg(F.count("first_word").alias("n"))
    best = counts.groupBy("labels").agg(F.min(F.struct((-F.col("n")).alias("n"), "first_word")).alias("best"))
    return best.select("labels", F.col("best.first_word").alias("first_word"), (-F.col("best.n")).alias("first_word_count"))


def cluster_count(messages: DataFrame) -> DataFrame:
    """Number of labels and of messages without a topic."""
    return messages.agg(
        F.count_distinct("labels").alias("clusters"), F.count_if(F.col("labels") == -1).alias("messages_without_cluster")
    )


def mean_silhouette(prepared: DataFrame) -> DataFrame:
    return prepared.filter(F.col("labels") != -1).groupBy("labels").agg(F.avg("silhouette").alias("silhouette"))


def message_previews(messages: DataFrame, count: int = 20) -> DataFrame:
    """The first messages of each label as one preview text; only ``count`` rows per label travel."""
    ordered = Window.partitionBy("labels").orderBy("published_datetime", "msg_id")
    first = messages.select("labels", "published_datetime", "msg_id", text.shorten(F.col("message_clean")).alias("m"))
    first = first.withColumn("_n", F.row_number().over(ordered)).filter(F.col("_n") <= count)
    texts = F.array_sort(F.collect_list(F.struct("_n", "m")))
    return first.groupBy("labels").agg(F.array_join(F.transform(texts, lambda t: t["m"]), "<br>").alias("message_clean"))


def mean_coordinates(prepared: DataFrame) -> DataFrame:
    """Mean place, time and order of each label."""
    return prepared.groupBy("labels").agg(
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.timestamp_micros(F.avg(micros("published_datetime")).cast("bigint")).alias("published_datetime"),
        F.avg("order").alias("order"),
    )


def mean_label_points(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    """Mean coordinates with message preview and, where the label has one, its term text."""
    return mean_coordinates(prepared).join(message_previews(prepared), "labels").join(terms, "labels", "left")


def label_points_over_time(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    """Messages with the display name of their topic."""
    named = terms.withColumn("selection", F.concat_ws("_", F.col("labels").cast("string"), "terms"))
    return prepared.join(named, "labels")


def super_clusters(profile: DataFrame, k: int = 20, seed: int = 129, measures=SUPER_CLUSTER_MEASURES) -> DataFrame:
    """Adds ``km_labels`` from the scaled measures; missing measures count as 0."""
    profile = cut_lineage(profile)  # one row per label; training passes over it many times
    filled = profile.select("labels", *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in measures])
    rows = VectorAssembler(inputCols=list(measures), outputCol="_raw").transform(filled)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled").fit(rows)
    scaled = scaler.transform(rows).select("labels", "_scaled")
    different = scaled.groupBy(vector_to_array("_scaled").alias("_values")).agg(F.min("labels").alias("_first"))
    if different.limit(k + 1).count() <= k:
        # no more different profiles than groups: each is its own
        alone = with_rank(different, ["_first"], "_id").select("_values", F.col("_id").cast("int").alias("km_labels"))
        named = scaled.withColumn("_values", vector_to_array("_scaled")).join(alone, "_values")
        return profile.join(named.select("labels", "km_labels"), "labels")
    model = KMeans(k=k, seed=seed, initSteps=5, featuresCol="_scaled", predictionCol="km_labels").fit(scaled)
    return profile.join(model.transform(scaled).select("labels", "km_labels"), "labels")


def super_cluster_profile(profile: DataFrame, measures=SUPER_CLUSTER_MEASURES) -> DataFrame:
    """Mean of each measure and number of labels per super-cluster."""
    return profile.groupBy("km_labels").agg(
        *[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("label_count")
    )


def label_map(messages: DataFrame) -> DataFrame:
    return messages.select("labels", "km_labels").distinct()
