"""Delimited files whose quoted fields hold line breaks, read by many tasks per file.

A split of such a file cannot know whether it begins inside quotes. So physical lines are read in parallel, and each
block of lines answers for both cases: in which state it ends and how many records begin in it. The answers of the
blocks of a file, a few numbers each, are put together in order, which gives every block the state it begins in and
the record it continues. Then each block cuts its lines into records; only the first and the last piece of a block
can have parts elsewhere, and only these meet by a shuffle.

A line is a map of two states, outside and inside of quotes. Lines without quotes change nothing, and maps are
composed for whole batches at once: the state behind a line follows from the last line whose end does not depend on
its start, and the number of lines since then that turn the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

ENTRY = "file string, _block bigint, inside boolean, owner_block bigint, owner_row bigint"


def line_ends(line: str, sep: str = ";", quote: str = '"') -> tuple[bool, bool]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside.

    A quote opens a field only at its start; two are one quote; behind a closing one the field goes on to the
    next separator.
    """

    def closing(at: int) -> int:
        while (at := line.find(quote, at)) >= 0:
            if not line.startswith(quote, at + 1):
                return at + 1
            at += 2
        return -1

    def from_field(at: int) -> bool:
        while True:
            if line.startswith(quote, at) and (at := closing(at + 1)) < 0:
                return True
            if (at := line.find(sep, at)) < 0:
                return False
            at += 1

    end = closing(0)
    if end < 0:
        return from_field(0), True
    at = line.find(sep, end)
    return from_field(0), at >= 0 and from_field(at + 1)


def states_before(lines: pa.Array, sep: str, quote: str) -> tuple[np.ndarray, np.ndarray]:
    """For both starting states: the state in front of each line and, last, behind them all."""
    n = len(lines)
    behind = np.zeros((2, n), bool)
    behind[1] = True
    for at in np.flatnonzero(pc.match_substring(lines, quote).to_numpy(zero_copy_only=False)):
        behind[0, at], behind[1, at] = line_ends(lines[int(at)].as_py(), sep, quote)
    fixed, turns = behind[0] == behind[1], behind[0] & ~behind[1]
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    turned = np.cumsum(turns)
    since = (turned - np.where(last >= 0, turned[last], 0)) % 2 == 1 if n else np.zeros(0, bool)
    out = []
    for start in (False, True):
        out.append(np.r_[start, np.where(last >= 0, behind[0][last], start) ^ since] if n else np.array([start]))
    return out[0], out[1]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Parts of a batch that belong to one block of a file, in order."""
    files, blocks = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1), batch.num_rows]
    for s, e in zip(cuts, cuts[1:]):
        if e > s:
            yield files[s], int(blocks[s]), batch.column(0).slice(s, e - s)


def _entries(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """``ENTRY`` of each block: the state it begins in and the record that its first lines continue."""

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ends, begun, out = None, [False, True], [0, 0], []
        for batch in batches:
            for file, block, part in _blocks(batch):
                if here != (file, block):
                    if here:
                        out.append((*here, *ends, *begun))
                    here, ends, begun = (file, block), [False, True], [0, 0]
                states = states_before(part, sep, quote)
                begun = [n + int(np.count_nonzero(~states[int(e)][:-1])) for n, e in zip(begun, ends)]
                ends = [bool(states[int(e)][-1]) for e in ends]
        if here:
            out.append((*here, *ends, *begun))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["file", "_block", "end_out", "end_in", "begun_out", "begun_in"]), preserve_index=False)

    def together(blocks: pd.DataFrame) -> pd.DataFrame:
        inside, owner, rows = False, (-1, -1), []
        for r in blocks.sort_values("_block").itertuples(index=False):
            rows.append((r.file, r._1, inside, *owner))
            begun = r.begun_in if inside else r.begun_out
            if begun:
                owner = (r._1, begun - 1)
            inside = r.end_in if inside else r.end_out
        return pd.DataFrame(rows, columns=["file", "_block", "inside", "owner_block", "owner_row"])

    kinds = "file string, _block bigint, end_out boolean, end_in boolean, begun_out bigint, begun_in bigint"
    return lines.mapInArrow(answer, kinds).groupBy("file").applyInPandas(together, ENTRY)


def read_records(spark: SparkSession, path: str, glob: str | None = None, sep: str = ";", quote: str = '"') -> DataFrame:
    """``record, file, _block, _row``: the text of each record and its place, line breaks inside quotes included.

    Lines end with a line feed, with or without a carriage return before it. Empty records are left out. A quote that
    is never closed makes one record of all that follows in its file, as in any reader.
    """
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    # one row per block of a file, a hundred bytes for each of, say, 128 MB
    entries = cut_lineage(_entries(lines, sep, quote))
    starts = {(r.file, r["_block"]): (r.inside, r.owner_block, r.owner_row) for r in entries.filter("inside").collect()}

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "file", "_block", "_row", "piece", "border"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        here, inside, begun, held = None, False, 0, []  # held: lines of the record that is open at the end of a batch
        owner, first = None, False

        def piece(border: bool) -> tuple:
            block, row = owner
            return "\n".join(held), here[0], block, row, here[1], border

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows = []
            for file, block, part in _blocks(batch):
                if here != (file, block):
                    if held:
                        rows.append(piece(True))
                    here, begun, held, first = (file, block), 0, [], True
                    inside, *owner = starts.get(here, (False, block, 0))
                before = states_before(part, sep, quote)[int(inside)]
                values = part.to_pylist()
                at = [*np.flatnonzero(~before[:-1]).tolist(), len(values)]
                held += values[: at[0]]  # lines in front of the first record that begins here
                for s, e in zip(at, at[1:]):
                    if held:
                        rows.append(piece(first))
                        first = False
                    owner, held = (block, begun), values[s:e]
                    begun += 1
                    first = False
                inside = bool(before[-1])
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([piece(True)])

    cut_up = lines.mapInArrow(cut, "record string, file string, _block bigint, _row bigint, piece bigint, border boolean")
    cut_up = cut_up.withColumn("record", F.regexp_replace("record", "\r$", ""))
    whole = cut_up.filter("not border").select("record", "file", "_block", "_row")
    # at most two pieces per block
    parts = cut_up.filter("border").groupBy("file", "_block", "_row").agg(F.array_sort(F.collect_list(F.struct("piece", "record"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "file", "_block", "_row")
    return whole.unionByName(joined).filter("record <> ''")
