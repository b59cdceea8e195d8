"""What the operators share: inputs, per-process stores, the shared folder, lineage cuts."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import cut_lineage, ready

#: Words are runs of anything but these six ASCII blanks; bytes.split() cuts at the same ones.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def whole_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` with null texts as empty ones; other columns cannot clash afterwards."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def per_process(key: tuple, build: Callable):
    """``build()`` once per Python process: functions travel by value, so module globals don't last."""
    store = vars(sys).setdefault("_chatloom_store", {})
    if key not in store:
        store[key] = build()
    return store[key]


def map_batches(df: DataFrame, function: Callable[[dict], dict], schema: str, rows: int | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """One call per Arrow batch, lists of values in, lists of values out, row by row in order.

    With ``rows`` a call gets at most so many of a batch; ``done`` is called at the end of a task.
    """
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromJson(kind))
        try:
            for batch in batches:
                step = rows or max(1, batch.num_rows)
                for start in range(0, max(1, batch.num_rows), step):
                    out = function(batch.slice(start, step).to_pydict())
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)
        finally:
            if done is not None:
                done()

    kind = _parse_datatype_string(schema).jsonValue()
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: lineage ends here, executors may be lost."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sha256_text(column: Column) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


__all__ = ["WORD_BREAK", "cut_lineage", "map_batches", "per_process", "sha256_text", "shared_folder", "stored", "whole_texts"]
