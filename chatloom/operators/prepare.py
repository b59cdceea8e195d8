"""Row filters and derived columns of the chat table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text
from chatloom.schema import BOT_NAME


def prepare_chat(raw: DataFrame) -> DataFrame:
    """Rows with time, channel and message, plus day, counters and the raw message length."""
    return raw.dropna(subset=["published_datetime", "channel", "message"]).withColumns(
        {
            "published_date": F.date_trunc("day", F.col("published_datetime").cast("timestamp")),
            "count_mention": text.count_mentions(F.col("message")),
            "message_length": F.length("message"),
            "count_url": text.count_urls(F.col("message")),
        }
    )


def filter_spam(chat: DataFrame, mention_filter: int = 3, count_url_filter: int = 3) -> DataFrame:
    return chat.filter(
        (F.col("count_mention") <= mention_filter) & (F.col("count_url") <= count_url_filter)
    )


def clean_messages(chat: DataFrame) -> DataFrame:
    return chat.withColumn("message_clean", text.clean_message(F.col("message")))


def broadcast_slice(
    chat: DataFrame, channels: Sequence[str], start: str, end: str, bot: str = BOT_NAME
) -> DataFrame:
    """One broadcast: both ends included, the bot left out, null usernames kept, mentions removed."""
    at = F.col("published_datetime").cast("timestamp")
    return (
        chat.filter(F.col("channel").isin(*channels))
        .filter((at >= F.lit(start).cast("timestamp")) & (at <= F.lit(end).cast("timestamp")))
        .filter(~F.col("username").eqNullSafe(F.lit(bot)))
        .withColumn("message", text.strip(text.replace_mention(F.col("message"), "")))
    )


def between(df: DataFrame, start: str, end: str, column: str = "published_datetime") -> DataFrame:
    """Half-open time range ``[start, end)``."""
    at = F.col(column).cast("timestamp")
    return df.filter((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))


def message_shape(chat: DataFrame, emotes: Sequence[str]) -> DataFrame:
    """First word, question, exclamation and command flags, and the emote count of each message."""
    stripped = text.strip(F.col("message"))
    return chat.withColumns(
        {
            "first_word": text.first_word(F.col("message")),
            "endswith_question": F.endswith(stripped, F.lit("?")),
            "endswith_exclamation": F.endswith(stripped, F.lit("!")),
            "startswith_command": F.startswith(stripped, F.lit("!")),
            "count_emotes": text.count_emotes(F.col("message"), emotes),
        }
    )


def keep_labels(df: DataFrame, labels: Sequence[int] | DataFrame, column: str = "labels") -> DataFrame:
    """Rows of the listed labels; a list that is itself a table becomes a semi join."""
    if isinstance(labels, DataFrame):
        return df.join(labels.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(*labels))


def without_noise(df: DataFrame, column: str = "labels") -> DataFrame:
    return df.filter(F.col(column) != -1)


def highlight_labels(df: DataFrame, labels: Sequence[int], filler: int = -2) -> DataFrame:
    """Display columns of selected labels; the others share ``filler``."""
    selected = F.col("labels").isin(*labels) if labels else F.lit(False)
    return df.withColumns(
        {
            "is_selected": selected,
            "labels_x": F.when(selected, F.col("labels")).otherwise(F.lit(filler)),
            "alpha": F.when(selected, F.lit(0.8)).otherwise(F.lit(0.4)),
            "size": F.when(selected, F.lit(1.0)).otherwise(F.lit(0.5)),
            "color": F.when(selected, F.lit("important")).otherwise(F.lit("not important")),
        }
    )
