"""Chat, clusters and vectors derived by Spark from the given tables.

Every line or sentence of every document becomes one message, whole; the event it is mapped to gives
time, channel and user. Mentions, links, emotes and punctuation are added by row number so that all
cleaning rules have something to act on. One topic holds a third of all messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_BREAK = r"\n+|[.!?]+ +"

# Expressions that read the same in Spark SQL and in the SQL the results are checked against.
CHAT_COLUMNS = {
    "username": "CASE WHEN user_id = 7 THEN 'moobot' WHEN msg_id % 97 = 0 THEN NULL "
    "ELSE concat('u', CAST(user_id AS STRING)) END",
    "channel_2": "concat('#', channel)",
    "message": "concat(CASE WHEN msg_id % 11 = 0 THEN '!' ELSE '' END, "
    "CASE WHEN msg_id % 4 = 0 THEN concat('@u', CAST(msg_id % 50 AS STRING), ' ') ELSE '' END, "
    "CASE WHEN msg_id % 53 = 0 THEN '@a @b @c @d ' ELSE '' END, line, "
    "CASE WHEN msg_id % 7 = 0 THEN concat(' https://ex.org/p/', CAST(msg_id % 100 AS STRING)) ELSE '' END, "
    "CASE WHEN msg_id % 9 = 0 THEN ' LUL' WHEN msg_id % 10 = 0 THEN ' KappaPride' ELSE '' END, "
    "CASE WHEN msg_id % 5 = 0 THEN ' ?' WHEN msg_id % 6 = 0 THEN '!' ELSE '' END)",
}
MSG_ID = "doc_id * 1000000 + pos"
EVENT_KEY = "doc_id * 7919 + pos"
VECTOR_KEY = "doc_id * 31 + pos"
LABELS = "CAST(CASE WHEN msg_id % 17 = 0 THEN -1 WHEN msg_id % 3 = 0 THEN 0 ELSE label END AS INT)"
KM_LABELS = "CAST((labels + 1) % 20 AS INT)"
#: Numbers a lookup of embeddings may hold to be sent to every task (48 MB of floats, a few times that on the driver);
#: larger ones are joined by shuffles. A row's key, label, place and hash entry count as ``ROW_NUMBERS``.
VECTOR_NUMBERS = 12_000_000
ROW_NUMBERS = 16
EMOTES = ["KappaPride", "Kappa", "LUL", ":/", "<3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input comes in fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chat with ``msg_id``: see the module text."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("channel"))
    total = events.count()
    lines = (
        spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "line"))
        .filter(F.col("line") != "")
        .withColumn("msg_id", F.expr(MSG_ID))
        .withColumn("event_id", F.expr(f"({EVENT_KEY}) % {total}"))
    )
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("doc_id") + F.col("pos")) % 8 * 1_000_000)
    joined = lines.join(events, "event_id").withColumn("published_datetime", at)
    return joined.select(
        "msg_id",
        "published_datetime",
        "channel",
        *[F.expr(e).alias(n) for n, e in CHAT_COLUMNS.items()],
    )


def embedding_lookup(vectors: DataFrame, whole: bool = True) -> DataFrame:
    """The embeddings, marked for sending to every task where they are few enough: messages then stay where they are.

    Not ``whole``: the vectors themselves are not among them.
    """
    size = vectors.select(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    each = ROW_NUMBERS + (max(size["d"] or 1, 1) if whole else 0)
    return F.broadcast(vectors) if size["n"] * each <= VECTOR_NUMBERS else vectors


def with_clusters(chat: DataFrame, spark: SparkSession, sf_dir: str, vector: bool = True) -> DataFrame:
    """Adds ``labels, km_labels, x, y`` and, if asked for, ``vector`` from the embeddings table."""
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.count()
    places = embedding_lookup(vectors.withColumns({
        "x": F.col("embedding")[0].cast("double"), "y": F.col("embedding")[1].cast("double"),
    }), vector)  # queries that need no vector then carry none
    if not vector:
        places = places.drop("embedding")
    key = F.expr(f"((msg_id div 1000000) * 31 + msg_id % 1000000) % {total}")
    return (
        chat.withColumn("vec_id", key)
        .join(places, "vec_id")
        .withColumn("labels", F.expr(LABELS))
        .withColumn("km_labels", F.expr(KM_LABELS))
        .withColumnRenamed("embedding", "vector")
        .drop("vec_id", "label")
    )


def vectors_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as clustered rows: ``msg_id, labels, vector``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("msg_id"),
        F.col("label").cast("int").alias("labels"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
