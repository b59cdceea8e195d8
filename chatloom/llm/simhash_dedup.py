"""Near duplicates by SimHash, with candidates from Golay-code fuzzy hashing.

A fingerprint has 64 bits over 3-word shingles; texts link where fingerprints differ in at most 3. Equal
fingerprints are one from the start. A fingerprint is cut into four segments of 16 bits. With at most 3
wrong bits some segment is right while the next one (cyclically) has at most one wrong bit: otherwise
every right segment would be followed by one with two or more wrong bits, of which there can be only one,
so three segments would be wrong with at least four bits. Each key is therefore a whole segment and a
Golay codeword number near the next one; the code makes words one bit apart share a number. That is 4
times 1 or 6 keys of 28 bits, 21 a fingerprint on average.

Keys held by two fingerprints give their pair at once. Larger groups are cut into blocks, and each pair of
blocks yields links that span its connected parts, never all pairs; no rows are dropped. Links are
verified by their differing bits, and components are found by star steps.

Null and empty texts, and texts of blanks only, have the fingerprint zero, which is linked like any other.
One or two words make one shingle. A group's id is its smallest non-null ``doc_id``, null if it has none.
Repeated rows fall into the same group. Texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import golay
from chatloom.llm.base import stored
from chatloom.operators.neighbors import connected_components

RADIUS = 3
SEED = 42
WORDS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
BLOCK_ROWS = 2_000
CHUNK = 50_000


def fingerprint(text: str) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # only A-Z change, only ASCII blanks split
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(WORDS))) if len(words) >= WORDS else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        octets = hashes[start : start + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print``: the fingerprint as a signed long; ``text_key`` hashes the text."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["doc_id", "text_key", "print"])

    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, print bigint")


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """``key, print``: every key of every fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                signed = batch.column(0).slice(at, CHUNK).to_numpy(zero_copy_only=False).astype(np.int64)
                whole = signed.view(np.uint64)
                parts = [((whole >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64) for s in range(SEGMENTS)]
                keys, owners = [], []
                for s in range(SEGMENTS):
                    near = golay.keys(parts[(s + 1) % SEGMENTS])
                    row, column = np.nonzero(near >= 0)
                    keys.append(s << (SEGMENT_BITS + golay.DATA) | parts[s][row] << golay.DATA | near[row, column])
                    owners.append(signed[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (keys, owners)], names=["key", "print"])

    return prints.select("print").mapInArrow(run, "key bigint, print bigint")


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` that connect what all such links would; each print is reached once."""
    left, lefts, rights = prints.view(np.uint64), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = np.bitwise_count(left ^ here) <= radius
            if near.any():
                reached = left[near]
                left = left[~near]
                lefts.append(np.full(len(reached), here))
                rights.append(reached)
                frontier.extend(reached)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *lefts]).view(np.int64), np.concatenate([none, *rights]).view(np.int64)


def near_links(prints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that give the same components as all links."""
    keyed = stored(fuzzy_keys(prints), "fuzzy-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
    sizes = stored(sizes.filter("n > 1"), "shared-keys")
    pairs = sizes.filter("n = 2").select("a", "b").filter(F.bit_count(F.expr("a ^ b")) <= RADIUS)
    crowded = sizes.filter("n > 2").select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    members = keyed.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    # each pair of blocks meets once; a block of a group that has only one meets itself
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")))
    members = members.withColumn("other", F.explode(others))
    members = members.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(group["print"].to_numpy(np.int64))
        return pd.DataFrame({"a": a, "b": b})

    spans = members.groupBy("key", "i", "j").applyInPandas(link, "a bigint, b bigint")
    both = pairs.unionByName(spans)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print, component, component_id`` of every row.

    ``component`` is a fingerprint that stands for the group.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    reached = connected_components(near_links(distinct))
    placed = distinct.join(reached, distinct["print"] == reached["node"], "left")
    placed = placed.select("print", "first", F.coalesce("component", "print").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = stored(placed.join(least, "component").select("print", "component", "component_id"), "placed-fingerprints")
    return rows.join(placed, "print")


def near_duplicate_summary(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, the fingerprint as 16 hex digits."""
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return near_duplicate_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each ``component`` of ``groups`` the row of ``docs`` with the smallest ``doc_id`` and text hash, once."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stay = groups.groupBy("component").agg(F.min(order).alias("stay")).select("stay.doc_id", "stay.text_key")
    # the row travels in one struct: its columns may have any names
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    same = rows["doc_id"].eqNullSafe(stay["doc_id"]) & (rows["text_key"] == stay["text_key"])
    return rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text_key"]).select("row.*")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group: the smallest ``doc_id``, of equal ones the smallest text hash, once."""
    return keep_first(docs, near_duplicate_groups(docs))
