"""Fixed schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

CHAT_RAW = T.StructType(
    [
        T.StructField("published_datetime", T.TimestampType()),
        T.StructField("channel", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("channel_2", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# Patterns, tags and special tokens that decide results.
MENTION_PATTERN = r"@\S+"
URL_PATTERN = (
    r"(http|ftp|https):\/\/([\w\-_]+(?:(?:\.[\w\-_]+)+))"
    r"([\w\-\.,@?^=%&:/~\+#]*[\w\-\@?^=%&/~\+#])?"
)
MENTION_TAG = "<mention>"
URL_TAG = "<url>"
SPECIAL_TOKENS = ["<mask>", "<sep>", "<unk>", "<cls>", "<pad>", "<mention>", "<url>"]
BOT_NAME = "moobot"

# The measures super-clusters are built on.
SUPER_CLUSTER_MEASURES = [
    "message_tokenized_length_mean",
    "message_tokenized_length_std",
    "elapsed_time_label_max",
    "elapsed_time_label_std",
    "elapsed_time_label_median",
    "count_mention_mean",
    "endswith_question_mean",
    "endswith_exclamation_mean",
    "startswith_command_mean",
    "count_emotes_mean",
    "count_messages_count",
    "username_nunique",
    "silhouette_mean",
    "silhouette_std",
    "first_word_mean",
    "term_1_freq",
    "term_2_freq",
    "term_3_freq",
    "terms_nunique_mean",
]

# Super-cluster groups per time scale (id, name, colour, member ids).
REGROUPINGS = {
    300: [
        ("2", "LUL", "#a6cee3", [8]),
        ("3", "Quizz", "#1f78b4", [9, 15]),
        ("4", "Commandes", "#b2df8a", [10]),
        ("5", "Emotes", "#33a02c", [13, 4]),
        ("6", "Exclamation", "#fb9a99", [11, 17]),
        ("7", "Reactions", "#e31a1c", [6, 3, 16]),
        ("8", "Question", "#fdbf6f", [2]),
        ("9", "Opinion", "#ff7f00", [0, 19, 7, 5, 14, 12, 18]),
    ],
    600: [
        ("2", "LUL", "#a6cee3", [5]),
        ("3", "Quizz", "#1f78b4", [6, 10]),
        ("4", "Commandes", "#b2df8a", [8, 19]),
        ("5", "Emotes", "#33a02c", [9, 17]),
        ("6", "Exclamation", "#fb9a99", [15, 16]),
        ("7", "Reactions", "#e31a1c", [4, 12, 11, 13]),
        ("8", "Question", "#fdbf6f", [2]),
        ("9", "Opinion", "#ff7f00", [18, 7, 14, 1, 0]),
    ],
}

# The layout parameter grid (50 is listed twice on purpose).
SWEEP_SCALES = [0, 300, 600, 1800, 3600]
SWEEP_NEIGHBORS = [5, 10, 20, 50, 50, 100]
SWEEP_MIN_DISTS = [0.05, 0.1, 0.25, 0.5, 0.8, 0.99]
