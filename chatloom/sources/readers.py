"""Chat files, stage tables, exported tables and emote lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.ordering import with_rank
from chatloom.schema import CHAT_RAW, SPECIAL_TOKENS
from chatloom.sources.quoted_lines import read_records


def read_chat_csv(
    spark: SparkSession,
    path: str,
    channels: Sequence[str] = (),
    on_bad_file: str = "drop_file",
    multi_line: bool = False,
) -> DataFrame:
    """Headerless ``;`` separated chat files: the columns of the raw chat table and ``file``.

    A doubled quote is a quote and a backslash is a plain character. With ``channels``, only files
    ``{channel}.csv*`` of the folder are read. Compressed files that break off or are damaged are left out
    whole, see :func:`damaged_files`. A file with a date that cannot be parsed is left out whole
    (``drop_file``) or loses these rows (``drop_rows``). ``multi_line`` reads line breaks inside quotes, by many tasks per file, see :mod:`chatloom.sources.quoted_lines`.
    """
    if on_bad_file not in ("drop_file", "drop_rows"):
        raise ValueError(f"unknown on_bad_file {on_bad_file!r}")
    names = CHAT_RAW.fieldNames()
    schema, dialect = ", ".join(f"{n} string" for n in names), {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    glob = "{" + ",".join(channels) + "}.csv*" if channels else None
    if multi_line:
        raw = read_records(spark, path, glob).withColumn("_of", F.from_csv("record", schema, dialect)).select("_of.*", "file", "_block", "_row")
    else:
        reader = spark.read.schema(schema).options(**dialect).option("ignoreCorruptFiles", True)  # the rows before the damage go below, with their file
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        raw = reader.csv(path).withColumn("file", F.col("_metadata.file_path")).withColumn(
            "_block", F.col("_metadata.file_block_start")
        ).withColumn("_row", F.monotonically_increasing_id())
    raw = raw.join(damaged_files(spark, path, channels), "file", "left_anti")
    parsed = raw.withColumn("_at", F.try_to_timestamp("published_datetime"))
    unparsed = F.col("published_datetime").isNotNull() & F.col("_at").isNull()
    if on_bad_file == "drop_file":
        parsed = parsed.join(parsed.filter(unparsed).select("file").distinct(), "file", "left_anti")
    else:
        parsed = parsed.filter(~unparsed)
    return parsed.select(F.col("_at").alias("published_datetime"), *names[1:], "file", "_block", "_row")


def damaged_files(spark: SparkSession, path: str, channels: Sequence[str] = ()) -> DataFrame:
    """``file`` of each gzip file that cannot be read to its end; empty where all can.

    Each file is unpacked piece by piece in the task that holds it, and nothing of it is kept.
    """
    pattern = "{" + ",".join(channels) + "}.csv*.gz" if channels else "*.gz"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(path)

    def check(batches):
        for batch in batches:
            bad = [not _whole_gzip(content) for content in batch["content"]]
            yield batch.loc[bad, ["file"]]

    return files.select(F.col("_metadata.file_path").alias("file"), "content").mapInPandas(check, "file string")


def _whole_gzip(content: bytes, piece: int = 1 << 20) -> bool:
    import zlib

    left = bytes(content)
    while left:
        member, at = zlib.decompressobj(wbits=31), 0
        try:
            while not member.eof and at < len(left):
                data, at = left[at : at + piece], at + piece
                while data and not member.eof:
                    member.decompress(data, piece)
                    data = member.unconsumed_tail
        except zlib.error:
            return False
        if not member.eof:
            return False
        left = member.unused_data + left[at:]
    return bool(content)


def with_message_ids(chat: DataFrame) -> DataFrame:
    """``msg_id`` in channel and time order; ties keep the order of the file."""
    order = ["channel", "published_datetime", "file", "_block", "_row"]
    return with_rank(chat, order, "msg_id").drop("file", "_block", "_row")


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_decimal_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Re-reads an exported table: decimal commas, and arrays written as ``[1, 2]``."""
    target = spark.createDataFrame([], schema).schema
    text = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    columns = []
    for field in target:
        value, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind.startswith("array"):
            value = F.from_json(value, kind)
        elif kind in ("double", "float"):
            value = F.replace(value, F.lit(","), F.lit(".")).cast(kind)
        elif kind != "string":
            value = value.cast(kind)
        columns.append(value.alias(field.name))
    return text.select(*columns)


def read_emotes(spark: SparkSession, path: str) -> DataFrame:
    """Emote names in file order: a JSON list of objects with ``name``, or such a list under ``data``."""
    rows = spark.read.option("multiLine", True).json(path)
    if "data" in rows.columns:
        rows = rows.select(F.explode(F.transform("data", lambda e: e["name"])).alias("name"))
    return rows.select("name")


def special_tokens(spark: SparkSession, global_path: str, channel_paths: Sequence[str]) -> list[str]:
    """Global emotes, emotes of each channel, then the fixed tokens; repeated names are kept.

    Emote lists are small by nature: they end up as reserved tokens of one vocabulary.
    """
    names: list[str] = []
    for path in [global_path, *channel_paths]:
        names += [row["name"] for row in read_emotes(spark, path).collect()]
    return names + SPECIAL_TOKENS
