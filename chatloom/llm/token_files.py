"""Token ids as word-aligned Simple-8b files, and back.

Documents are range-partitioned by id; each task encodes its share in ascending order and writes files
of about ``FILE_IDS`` ids. Written files are listed in a stored table of one row per file; a document's
start is the running total over the files before its own plus its place inside.

A file: magic, packed words, exceptions, word and exception offsets of the blocks, then per document id,
whether there is an id, and number of ids, then five sizes and the magic again. All little-endian.

Null and empty texts hold the end id only. Rows with equal or null ids are kept, null ids first, equal
ones in order of their texts. Empty tables give no file and no row. Texts of any length stay whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.base import per_process, shared_folder, stored, whole_texts
from chatloom.llm.files import WholeFile, place
from chatloom.llm.simple8b import pack, unpack

MAGIC = b"WORDS8B1"
FILE_IDS = 2_000_000
TEXT_BYTES = 8_000_000
MEMO = 1_600_000
CLOSING = b".,!?;:"
FILES = "part int, seq int, path string, n_docs bigint, n_ids bigint"


class WordEncoder:
    """Ids of a text by the tokenizers library, one call per distinct run of non-blanks.

    The library drops ASCII blanks and nothing it matches spans one, so the ids of a text are those of
    its runs one after the other. It also cuts between a letter and closing marks at a run's end, which
    are looked up on their own. Runs are kept in two generations of ``limit / 2`` at most.
    """

    def __init__(self, path: str, limit: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.half = limit // 2

    def _learn(self, runs: set[bytes]) -> None:
        """Ids of runs that are not known, as little-endian 32-bit integers."""
        if len(self.known) + len(runs) > self.half:
            self.old, self.known = self.known, {}
        known, old, fresh, composed = self.known, self.old, [], []
        for run in runs:
            ids = old.get(run)
            if ids is not None:
                known[run] = ids
                continue
            body = run.rstrip(CLOSING)
            if len(body) < len(run) and body and body[-1:].isalpha():  # bytes: ASCII letters only
                composed.append((run, body, run[len(body) :]))
            else:
                fresh.append(run)
        parts = {part for _, *both in composed for part in both}.difference(known, fresh)
        for part in list(parts):
            if part in old:
                known[part] = old[part]
                parts.discard(part)
        fresh += parts
        for start in range(0, len(fresh), 20_000):
            some = fresh[start : start + 20_000]
            found = self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            known.update(zip(some, (struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found)))
        known.update((run, known[body] + known[tail]) for run, body, tail in composed)

    def __call__(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text with ``end`` behind. Runs are cut and numbered by Arrow; only different ones are looked up."""
        import pyarrow.compute as pc

        cut = pc.ascii_split_whitespace(texts)
        numbered = cut.flatten().dictionary_encode()
        runs = numbered.dictionary.cast(pa.binary()).to_pylist()
        fresh = set(runs).difference(self.known)
        if len(self.known) + len(fresh) > self.half:
            fresh = set(runs)  # the young generation starts anew with all that is wanted now
        self._learn(fresh - {b""})
        self.known[b""] = b""  # what stands before a leading and behind a trailing blank
        found = [*map(self.known.__getitem__, runs), np.array([end], "<u4").tobytes()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        borders = np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))
        order = np.insert(numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), borders, len(runs))
        many = sizes[order]
        upto = np.cumsum(many)
        out = ids[np.repeat(starts[order] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        ends = upto[borders + np.arange(len(borders))]  # behind the end id of each text
        return np.split(out, ends[:-1]) if len(ends) else []


def write_ids(folder: str, name: str, doc_ids: list, ids: list[np.ndarray]) -> str:
    """One file; its URI."""
    counts = np.array([len(x) for x in ids], "<i8")
    words, exceptions, offsets, exception_offsets = pack(np.concatenate(ids) if ids else np.zeros(0, np.uint64))
    there = np.array([d is not None for d in doc_ids], "u1")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    file = WholeFile(folder, name)
    with file as out:
        out.write(MAGIC)
        for part in (words.astype("<u8"), exceptions.astype("<u8"), offsets.astype("<i8"), exception_offsets.astype("<i8"), names, there, counts):
            out.write(part.tobytes())
        out.write(struct.pack("<5Q", len(words), len(exceptions), len(offsets), len(doc_ids), int(counts.sum())) + MAGIC)
    return file.uri


def read_ids(uri: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, numbers of ids and all ids of a file."""
    store, path = place(uri)
    with store.open_input_stream(path, compression=None) as stream:
        raw = stream.read()
    tail = struct.calcsize("<5Q") + len(MAGIC)
    if raw[: len(MAGIC)] != MAGIC or raw[-len(MAGIC) :] != MAGIC:
        raise ValueError(f"{uri} is not a complete file of token ids")
    n_words, n_exceptions, n_offsets, n_docs, n_ids = struct.unpack("<5Q", raw[-tail : -len(MAGIC)])
    at, parts = len(MAGIC), []
    for kind, n in (("<u8", n_words), ("<u8", n_exceptions), ("<i8", n_offsets), ("<i8", n_offsets), ("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs)):
        parts.append(np.frombuffer(raw, kind, n, at))
        at += parts[-1].nbytes
    words, exceptions, offsets, exception_offsets, names, there, counts = parts
    values = unpack(words, exceptions, offsets, exception_offsets, n_ids).astype(np.uint32)
    return [int(d) if t else None for d, t in zip(names, there)], counts, values


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``TEXT_BYTES`` together, or of one longer text."""
    import pyarrow.compute as pc

    sizes, start, held = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > TEXT_BYTES:
            yield start, at
            start, held = at, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def write_token_files(docs: DataFrame, tokenizer_path: str, end: int, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """The table of written files, in document order by ``part, seq``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = per_process(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        part, rows = TaskContext.get().partitionId(), []
        held_docs, held, size = [], [], 0

        def flush():
            uri = write_ids(folder, f"ids-{part:06d}-{len(rows):05d}.s8b", held_docs, held)
            rows.append((part, len(rows), uri, len(held_docs), size))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, stop in stretches(batch.column(1)):
                for doc_id, ids in zip(doc_ids[start:stop], encode(batch.column(1).slice(start, stop - start), end)):
                    held_docs.append(doc_id)
                    held.append(ids)
                    size += len(ids)
                    if size >= file_ids:
                        flush()
                        held_docs, held, size = [], [], 0
        if held:
            flush()
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            names = ["part", "seq", "path", "n_docs", "n_ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ordered = whole_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files, in one row per document."""
    # one row per writing task, not per document, is ordered in one place
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = files.withColumn("inside", inside).join(before, "part")
    placed = placed.select("path", (F.col("before") + F.col("inside")).alias("base"))
    # a number keeps Spark from merging these few small rows: each stands for a file to read
    placed = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, counts, values = read_ids(path)
                ends = np.cumsum(counts)
                little = values.astype("<u4")
                sums = [zlib.crc32(little[e - c : e].tobytes()) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Files written to ``folder`` (new, in the shared one, by default) and read back."""
    folder = folder or shared_folder(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, tokenizer_path, end, folder))
