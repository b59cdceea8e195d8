"""The user-facing tasks. Each reads stage tables and writes stage tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import schema
from chatloom.operators import clusters, neighbors, prepare, sampling, spectral, terms, timeline, tokens, unigram, vectors, windows
from chatloom.operators.profile import cluster_profile, describe_topics
from chatloom.session import cut_lineage, ready, stored
from chatloom.sources import readers, writers

Vectorizer = Callable[[DataFrame], DataFrame]


def _clean_stage(spark: SparkSession, in_path: str, mention_filter: int, count_url_filter: int) -> DataFrame:
    rows = prepare.filter_spam(readers.read_stage(ready(spark), in_path), mention_filter, count_url_filter)
    return prepare.clean_messages(rows)


def data(
    spark: SparkSession,
    csv_path: str,
    channels: Sequence[str],
    out_path: str,
    on_bad_file: str = "drop_file",
    multi_line: bool = False,
) -> list[str]:
    """Chat files of the channels to one prepared table, ordered by channel and time.

    Returns the names of files left out because they are damaged: a few, by their nature.
    """
    raw = readers.read_chat_csv(ready(spark), csv_path, channels, on_bad_file, multi_line)
    prepared = prepare.prepare_chat(readers.with_message_ids(raw))
    writers.write_stage(prepared.orderBy("channel", "published_datetime", "msg_id"), out_path)
    return sorted(r["file"] for r in readers.damaged_files(spark, csv_path, channels).collect())


def train_tokenizer(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    vocab_size: int = 8_000,
    max_length: int = 500,
    time_window_freq: str = "5s",
    mention_filter: int = 3,
    count_url_filter: int = 3,
    special_tokens: Sequence[str] = tuple(schema.SPECIAL_TOKENS),
) -> None:
    """Sub-word vocabulary of the window documents."""
    rows = windows.with_time_bin(_clean_stage(spark, in_path, mention_filter, count_url_filter), time_window_freq)
    packed = windows.pack_messages(rows, "message_length", "message_length_window", max_length)
    documents = windows.documents(packed, "message_length_window")
    writers.write_stage(unigram.train_vocabulary(documents, vocab_size, special_tokens), out_path)


def long_window_text(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    max_length: int = 500,
    time_window_freq: str = "5s",
    mention_filter: int = 3,
    count_url_filter: int = 3,
) -> None:
    """Text corpus per channel, from windows of at least ``max_length`` characters."""
    rows = windows.long_windows(_clean_stage(spark, in_path, mention_filter, count_url_filter), max_length, time_window_freq)
    writers.write_corpus(windows.window_texts(rows), out_path)


def tokenize(texts: DataFrame, vocabulary: DataFrame, add_special_tokens: bool = False) -> DataFrame:
    """Tokens of the ``message_clean`` column."""
    return unigram.encode_unigram(texts, vocabulary, markers=add_special_tokens)


def mlm_data(
    spark: SparkSession,
    in_path: str,
    vocabulary_path: str,
    out_path: str,
    max_length: int = 250,
    time_window_freq: str = "5s",
    mention_filter: int = 3,
    count_url_filter: int = 3,
    special_tokens: Sequence[str] = tuple(schema.SPECIAL_TOKENS),
) -> None:
    """Shuffled and split window documents (``train``, ``test``) and their masked examples."""
    rows = _clean_stage(spark, in_path, mention_filter, count_url_filter)
    vocabulary = readers.read_stage(spark, vocabulary_path)
    binned = windows.with_time_bin(rows, time_window_freq)
    coded = cut_lineage(unigram.encode_unigram(binned, vocabulary, special_tokens, max_length=max_length))
    packed = windows.pack_messages(coded, "message_tokenized_length", "message_tokenized_length_window", max_length)
    documents = windows.token_documents(packed, "message_tokenized_length_window")
    keys = ["channel", "published_datetime", "message_tokenized_length_window"]
    writers.write_stage(documents, f"{out_path}/documents", by_channel=False)
    documents = readers.read_stage(spark, f"{out_path}/documents").select(*keys, "input_ids")
    split = sampling.train_test_split(documents, 0.1, keys)
    reserved = vocabulary.filter(F.col("token").isin(*special_tokens)).select("id", "token").collect()
    ids = {row["token"]: row["id"] for row in reserved}
    for part in ("train", "test"):
        chosen = sampling.shuffled(split.filter(F.col("split") == part), keys)
        writers.write_training_set(chosen, f"{out_path}/{part}")
        examples = tokens.mlm_examples(chosen, keys, vocabulary.count(), ids["<mask>"], sorted(ids.values()))
        examples.select("input_ids", "labels").write.mode("overwrite").parquet(f"{out_path}/{part}_masked")


def contrastive_data(
    spark: SparkSession, in_path: str, out_path: str, n_sample: int = 1_000_000, mention_filter: int = 3, count_url_filter: int = 3
) -> None:
    """Self-pairs of exactly ``n_sample`` cleaned messages."""
    sample = sampling.sample_exact(_clean_stage(spark, in_path, mention_filter, count_url_filter), n_sample)
    writers.write_stage(sampling.contrastive_pairs(sample), out_path)


def broadcast_stats(
    spark: SparkSession,
    in_path: str,
    vocabulary: DataFrame,
    channels: Sequence[str],
    date: str,
    limit: int | None = None,
    max_length: int = 500,
    time_window_freq: str = "5s",
) -> DataFrame:
    """One evening broadcast (19:00 to 23:00), cleaned, encoded, windowed and packed."""
    chat = readers.read_stage(ready(spark), in_path)
    rows = prepare.broadcast_slice(chat, channels, f"{date} 19:00:00", f"{date} 23:00:00")
    rows = prepare.clean_messages(prepare.filter_spam(rows)).withColumn("index", F.col("msg_id"))
    binned = windows.with_window_id(windows.with_time_bin(rows, time_window_freq))
    coded = cut_lineage(unigram.encode_unigram(binned, vocabulary))
    packed = windows.pack_messages(coded, "message_tokenized_length", "message_tokenized_length_window", max_length)
    return sampling.smallest(packed, ["published_datetime", "msg_id"], limit) if limit else packed


def topic_model(
    stats: DataFrame,
    dimension: int,
    scale: int | None = None,
    epsilon: float = 0.5,
    min_cluster_size: int = 5,
    components: int = 10,
    stop_words: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Labelled messages with coordinates, and their term counts. ``stats`` holds ``vector``.

    Without ``scale`` time plays no part. Labels come from the reduced vectors, not from ``x, y``.
    """
    timed = vectors.add_time_feature(stats, scale, dimension) if scale else vectors.with_elapsed(stats)
    placed = vectors.layout(timed, dimension, components)
    labels = neighbors.density_clusters(placed.select("msg_id", F.col("reduced").alias("vector")), epsilon, min_cluster_size)
    labelled = placed.join(stored(labels, "labels"), "msg_id")  # rows and term counts both read them
    words = terms.default_stop_words() if stop_words is None else stop_words
    return labelled, terms.topic_term_counts(labelled, words)


def cluster_topics(
    spark: SparkSession,
    in_path: str,
    vocabulary_path: str,
    out_path: str,
    channels: Sequence[str],
    date: str,
    emotes: Sequence[str],
    vectorize: Vectorizer = vectors.hashed_vectors,
    limit: int | None = None,
    scales: Sequence[int | None] = (None, 600, 1800, 3600),
    super_cluster_count: int = 20,
    exact_silhouette: bool = True,
    epsilon: float = 0.5,
) -> None:
    """Topics of one broadcast per time scale: messages, profile, super-clusters, term similarity, report."""
    vocabulary = readers.read_stage(spark, vocabulary_path)
    stats = broadcast_stats(spark, in_path, vocabulary, channels, date, limit)
    writers.write_stage(stats.join(vectorize(stats), "msg_id"), f"{out_path}/stats", by_channel=False)
    stats = readers.read_stage(spark, f"{out_path}/stats")
    dimension = stats.select(F.size("vector")).first()[0]
    for scale in scales:
        folder = f"{out_path}/{'no_scale' if scale is None else f'scale_{scale}'}"
        labelled, counts = topic_model(stats, dimension, scale, epsilon)
        writers.write_stage(labelled, f"{folder}/labelled", by_channel=False)
        writers.write_stage(counts, f"{folder}/term_counts", by_channel=False)
        labelled = readers.read_stage(spark, f"{folder}/labelled")
        counts = readers.read_stage(spark, f"{folder}/term_counts")
        score = clusters.silhouette_exact if exact_silhouette else clusters.silhouette_simplified
        full = clusters.prepare_clusters(labelled, score(labelled.select("msg_id", "labels", "vector")))
        writers.write_stage(full, f"{folder}/prepared", by_channel=False)
        full = readers.read_stage(spark, f"{folder}/prepared")
        profile = describe_topics(cluster_profile(full, emotes), terms.terms_wide(counts))
        profile = clusters.super_clusters(profile, super_cluster_count)
        writers.write_stage(profile, f"{folder}/profile", by_channel=False)
        profile = readers.read_stage(spark, f"{folder}/profile")
        writers.write_decimal_csv(profile.orderBy("published_datetime_min"), f"{folder}/description_clusters")
        writers.write_decimal_csv(clusters.super_cluster_profile(profile), f"{folder}/description_clusters_with_km")
        described = full.join(clusters.label_map(profile), "labels")
        writers.write_decimal_csv(described.drop("vector", "reduced"), f"{folder}/pd_stats")
        writers.write_stage(terms.topic_similarity(prepare.without_noise(counts)), f"{folder}/topic_similarity", by_channel=False)
        writers.write_cluster_report(writers.cluster_report(full, counts), f"{folder}/print_clusters")


STATS_COLUMNS = (
    "msg_id bigint, published_datetime timestamp, message string, input_ids array<int>, message_tokenized_length int, "
    "count_mention int, x double, y double, labels int, km_labels int"
)
PROFILE_COLUMNS = (
    "labels int, first_word string, first_word_mean double, term_1 string, term_1_freq int, term_2 string, term_2_freq int, "
    "term_3 string, term_3_freq int"
)


def topics_over_time(
    spark: SparkSession,
    clustering_path: str,
    vocabulary_path: str,
    out_path: str,
    start: str,
    end: str,
    scale: int = 600,
    window_time_sec: int | None = None,
    top_n: int = 10,
    exclude: Sequence[str] = (),
    race: bool = False,
) -> None:
    """Most discussed topics of one range, or of hopping windows with their ranks."""
    ready(spark)
    folder = f"{clustering_path}/scale_{scale}"
    rows = readers.read_decimal_csv(spark, f"{folder}/pd_stats", STATS_COLUMNS)
    profile = readers.read_decimal_csv(spark, f"{folder}/description_clusters", PROFILE_COLUMNS)
    profile = profile.na.fill("", ["first_word", "term_1", "term_2", "term_3"])
    vocabulary = readers.read_stage(spark, vocabulary_path)
    messages = timeline.regroup(rows, timeline.regroup_lookup(spark, scale))
    descriptions = timeline.best_descriptions(rows, profile, vocabulary, subwords=True)
    for moment in (start, end):
        dt.datetime.strptime(moment, "%Y-%m-%d %H:%M")
    if not race:
        stats = timeline.range_stats(messages, descriptions, start, end, exclude)
        writers.write_stage(timeline.top_range(stats, top_n), f"{out_path}/top_topics", by_channel=False)
        return
    width = window_time_sec or scale
    stats = timeline.hopping_stats(messages, descriptions, start, end, width, 300, top_n, exclude)
    writers.write_stage(stats, f"{out_path}/timeline", by_channel=False)
    stats = readers.read_stage(spark, f"{out_path}/timeline")
    ranks = timeline.period_ranks(timeline.timeline_long(stats))
    writers.write_stage(ranks, f"{out_path}/ranks", by_channel=False)


def layout_parameters(
    spark: SparkSession,
    stats_path: str,
    out_path: str,
    channel: str,
    date: str,
    limit: int | None = None,
) -> None:
    """Coordinates of one broadcast for the whole parameter grid, in long form."""
    stats = readers.read_stage(ready(spark), stats_path)
    if limit:
        stats = sampling.smallest(stats, ["published_datetime", "msg_id"], limit)
    dimension = stats.select(F.size("vector")).first()[0]
    sweep = spectral.spectral_sweep(
        stats, dimension, schema.SWEEP_SCALES, schema.SWEEP_NEIGHBORS, schema.SWEEP_MIN_DISTS, channel, date
    )
    writers.write_stage(sweep, out_path, by_channel=False)
