"""Benchmark items inside documents, by SimHash of item-sized windows.

Items and texts become lower-cased words without punctuation at their ends. A window has as many words
as the item it is compared with (a shorter text is one window). Items are handled in blocks of a bounded
number of words and items, so what a task holds of them never grows with their number; every block sees
all texts, whole.

A window that reaches the similarity shares a 5-word shingle with the item, so windows are made around
shared shingles only. Each gets the SimHash of its shingles, counted as often as they occur. Fingerprints
are looked up in a multi-index: cut into four parts, two that differ in at most ``RADIUS`` = 4 * 4 + 2 bits
differ in at most 4 bits in one of the first three parts or in at most 3 in the last, as more everywhere
would make 3 * 5 + 4 = 19. All values that near to an item's part are listed under it. What is found by a
part and lies within the radius is verified by weighted Jaccard similarity of the shingles. Windows of
similarity 0.8 differ in 10 bits on average with a deviation of 3, and shifted windows are tried as well.

Null and empty texts match nothing, nor do items without words. An item of fewer than five words is one
shingle, and found where its words stand in a row. Repeated items are matched under each of their ids, and
repeated texts in each row. Without items or texts the result is empty.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import per_process, stored, whole_texts

WORDS = 5
LEAST = 0.8
RADIUS = 18
REACH = (4, 4, 4, 3)
PART_BITS = 16
BLOCK_WORDS, BLOCK_ITEMS = 200_000, 1_000
MEMO = 300_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[str]:
    stripped = (w.strip(string.punctuation) for w in text.lower().split())
    return [w for w in stripped if w]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxh64_intdigest(word.encode())
        return value


def hashed(words: list[str]) -> np.ndarray:
    known = per_process(("word-hashes",), WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of each run of ``size`` words, or of all of them where there are fewer."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * MULTIPLIERS[i]
        out ^= out >> np.uint64(29)
    return out


def bit_sums(hashed_shingles: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 per bit; row ``b`` minus row ``a`` are the sums over ``a..b``."""
    bits = np.unpackbits(hashed_shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashed_shingles) + 1, 64), np.int32)
    np.cumsum(2 * bits.astype(np.int32) - 1, axis=0, out=sums[1:])
    return sums


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard: shingles count as often as they occur."""
    a, counts_a = np.unique(left, return_counts=True)
    b, counts_b = np.unique(right, return_counts=True)
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(counts_a[at], counts_b[bt]).sum()) if len(common) else 0
    return shared / (len(left) + len(right) - shared)


def around(bits: int, reach: int) -> np.ndarray:
    masks = [0]
    for n in range(1, reach + 1):
        masks += [sum(1 << b for b in which) for which in combinations(range(bits), n)]
    return np.array(masks, np.int64)


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], least: float):
        rows = [(item_id, words_of(text or "")) for item_id, text in rows]
        rows = [(item_id, words) for item_id, words in rows if words]
        self.least = least
        self.ids = [item_id for item_id, _ in rows]
        self.lengths = np.array([len(words) for _, words in rows], np.int64)
        self.shingles = [shingles(hashed(words)) for _, words in rows]
        self.prints = np.array([packed(bit_sums(s)[-1:])[0] for s in self.shingles], np.uint64)
        owners = np.repeat(np.arange(len(rows)), [len(s) for s in self.shingles])
        every = np.concatenate([np.zeros(0, np.uint64), *self.shingles])
        order = np.argsort(every, kind="stable")
        self.every, self.owners = every[order], owners[order]
        #: Shingles are of five words, or of as many as a shorter item has.
        self.sizes = sorted({min(int(n), WORDS) for n in self.lengths})
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.every & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.index = [self._listed(part, reach) for part, reach in enumerate(REACH)]

    def _part(self, prints: np.ndarray, part: int) -> np.ndarray:
        return ((prints >> np.uint64(PART_BITS * part)) & np.uint64((1 << PART_BITS) - 1)).astype(np.int32)

    def _listed(self, part: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """All part values near those of the items, in order, with their items."""
        near = (self._part(self.prints, part)[:, None] ^ around(PART_BITS, reach)[None, :]).astype(np.uint16)
        owners = np.repeat(np.arange(len(self.prints), dtype=np.int32), near.shape[1])
        order = np.argsort(near.ravel(), kind="stable")
        return near.ravel()[order], owners[order]

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items whose fingerprints are within the radius."""
        windows, items = [], []
        for part, (values, owners) in enumerate(self.index):
            wanted = self._part(prints, part).astype(np.uint16)
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            found = high - low
            window = np.repeat(np.arange(len(prints)), found)
            item = owners[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found - low, found)]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            windows.append(window[near])
            items.append(item[near].astype(np.int64))
        both = np.unique(np.stack([np.concatenate(windows), np.concatenate(items)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def shared(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``wanted`` shingles that an item has, and the item of each."""
        places = np.flatnonzero(self.sieve[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low = np.searchsorted(self.every, wanted[places], "left")
        found = np.searchsorted(self.every, wanted[places], "right") - low
        item = self.owners[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found - low, found)]
        return np.repeat(places, found), item

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """``item_id, similarity, first word, words`` of the best window of each item that is found."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        hashes = hashed(words)
        best: dict[int, tuple[float, int]] = {}
        for size in self.sizes:
            of = shingles(hashes, size)
            places, owners = self.shared(of)
            right = np.minimum(self.lengths[owners], WORDS) == size
            places, owners = places[right], owners[right]
            for length in np.unique(self.lengths[owners]).tolist():
                width = min(length, len(words)) - min(size, len(words)) + 1  # shingles of a window
                at = np.unique(places[self.lengths[owners] == length])
                last = len(of) - width
                starts = np.unique(np.clip(at[:, None] - np.arange(width)[None, :], 0, last))
                self._try_windows(of, starts, width, length, best)
        return [(self.ids[i], s, start, int(min(self.lengths[i], len(words)))) for i, (s, start) in sorted(best.items())]

    def _try_windows(self, of: np.ndarray, starts: np.ndarray, width: int, length: int, best: dict) -> None:
        for chunk in np.split(starts, range(4_000, len(starts), 4_000)):
            low, high = int(chunk[0]), int(chunk[-1]) + width
            for some in np.split(chunk, np.flatnonzero(np.diff(chunk) > width) + 1) if high - low > 50_000 else [chunk]:
                first = int(some[0])
                sums = bit_sums(of[first : int(some[-1]) + width])
                windows, items = self.lookup(packed(sums[some - first + width] - sums[some - first]))
                same = self.lengths[items] == length
                for window, item in zip(windows[same].tolist(), items[same].tolist()):
                    start = int(some[window])
                    alike = similarity(of[start : start + width], self.shingles[item])
                    if alike >= self.least and alike > best.get(item, (0.0, 0))[0]:
                        best[item] = (alike, start)


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """``item_id, text`` in blocks of about ``BLOCK_WORDS`` words and ``BLOCK_ITEMS`` items."""
    rows = stored(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    n, words = rows.agg(F.count(F.lit(1)), F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-int(words or 0) // BLOCK_WORDS))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [rows.filter(place == block) for block in range(blocks)]


def _fetched(block: DataFrame) -> list[tuple[int, str]]:
    """The rows of one block: bounded by its size."""
    return sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: one row per text and item found in it."""
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def search(rows: list[tuple[int, str]]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(rows, least)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found += [(doc_id, *match) for match in block.matches(text.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        return run

    parts = [whole_texts(docs).mapInArrow(search(_fetched(block)), schema) for block in item_blocks(items)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item. No shuffle: each block filters in turn."""
    at = docs.columns.index("text")

    def sieve(rows: list[tuple[int, str]]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(rows, least)
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        return run

    for block in item_blocks(items):
        docs = docs.mapInArrow(sieve(_fetched(block)), docs.schema)
    return docs
