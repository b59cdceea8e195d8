"""Alignment of two tokenizers' tokens over the same bytes, by skipping along diagonals.

A is a byte-level tokenizer of the tokenizers library, B a SentencePiece model. Both encode a text behind one
space; the end offsets of their tokens are compared in order. Where both end arrays agree at the current index
shift, steps of 1, 2, 4, ... entries are compared at once, so a stretch of one-to-one groups costs few
comparisons; the step that fails is halved until the first difference is found. What differs is an irregular
group: its ends are merged one by one up to the next common end, and the shift is what the two indices differ by
from there on.

Groups lie between common ends. A link is a pair of tokens whose bytes overlap: one in a one-to-one group, and
one for each step of the merge in an irregular group. Corpus-wide counts of linked id pairs are summed per task
and then by Spark, stored as sorted files of ``CHUNK_PAIRS`` pairs, and looked up file by file by the tasks that
hold the documents' links, so memory has a bound however many pairs there are.

Null and empty texts have no tokens. So have texts whose tokens of A or of B do not spell the space and the text
again (B writes a blank for its blank sign, for instance). Such rows have zeros and an empty ``groups_sha256``.
Repeated rows are counted and returned each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import per_process, shared_folder, stored, whole_texts
from chatloom.llm.files import WholeFile, place

#: Characters of text that are encoded at once (one longer text goes alone).
BATCH_CHARS = 2_000_000
CHUNK_PAIRS = 1_000_000
HELD_CHUNKS = 8
HELD_LINKS = 4_000_000
#: A failed step up to this size is searched entry by entry.
LINEAR = 4
SPACE = "▁"
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
CHUNKS = "path string, low bigint, high bigint"


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and its byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class TokenizerPair:
    """Both tokenizers, with the bytes and sizes of their entries.

    ``ranks`` names a rank file of A's vocabulary and its pattern: tiktoken then encodes texts of Latin letters, for
    which the two libraries agree on all character classes, and the tokenizers library all others.
    """

    def __init__(self, a_path: str, b_path: str, ranks: tuple[str, str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.a_fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.a_fast = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, n in vocabulary.items():
            self.a_bytes[n] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace(SPACE, " ").encode() for n, p in enumerate(pieces)]
        self.a_texts, self.b_texts = id_texts(len(self.a_bytes), "|"), id_texts(len(self.b_bytes), ";")
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none for both where the bytes are not those of the space and the text."""
        none = np.zeros(0, np.int64)
        slow = [n for n, t in enumerate(texts) if self.a_fast is None or BEYOND_LATIN.search(t)]
        by_library = dict(zip(slow, (e.ids for e in self.a.encode_batch_fast([" " + texts[n] for n in slow], add_special_tokens=False))))
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for n, (text, b) in enumerate(zip(texts, self.b.encode(texts, num_threads=1))):
            raw, a = b" " + text.encode(), by_library.get(n)
            same = text and b"".join(map(b_bytes, b)) == raw
            if a is None:
                a = self.a_fast.encode_ordinary(" " + text)  # ranks of all bytes: tiktoken drops and changes none
            else:
                same = same and b"".join(map(a_bytes, a)) == raw
            yield (np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))) if same else (none, none)


def walked(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Stretches ``i, i_end, j, j_end, groups``, one behind the other, and the links of irregular groups by side.

    A stretch is either a run of one-to-one groups (``groups`` of them) or one irregular group. Both arrays
    rise and end at the same offset.
    """
    n, i, j = len(a_ends), 0, 0
    stretches, a_odd, b_odd = [], [], []
    add, a_add, b_add = stretches.extend, a_odd.append, b_odd.append
    while i < n:
        i0, j0, step = i, j, 1
        while i < n and a_ends[i : i + step] == b_ends[j : j + step]:
            i += step
            j += step
            step *= 2
        while step > LINEAR:  # the failed step holds the first difference: halve it, then go entry by entry
            step //= 2
            if a_ends[i : i + step] == b_ends[j : j + step]:
                i += step
                j += step
        if i >= n:  # slices end with the arrays, which end together
            i, j = n, len(b_ends)
        while i < n and a_ends[i] == b_ends[j]:
            i += 1
            j += 1
        if i > i0:
            add((i0, i, j0, j, i - i0))
            if i == n:
                break
        i0, j0, x, y = i, j, a_ends[i], b_ends[j]
        while x != y:
            a_add(i)
            b_add(j)
            if x < y:
                i += 1
                x = a_ends[i]
            else:
                j += 1
                y = b_ends[j]
        a_add(i)
        b_add(j)
        i += 1
        j += 1
        add((i0, i, j0, j, 1))
    return stretches, a_odd, b_odd


def linked_places(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as two arrays of token places, and the stretches of :func:`walked`, a row each."""
    flat, a_odd, b_odd = walked(a_ends, b_ends)
    stretches = np.array(flat, np.int64).reshape(-1, 5)
    i, i_end, j, j_end, n = stretches.T
    odd = (i_end - i != n) | (j_end - j != n)
    links = np.where(odd, i_end - i + j_end - j - 1, n)  # an irregular group: one for each end in it
    ahead = np.cumsum(links) - links
    places, merged = np.arange(int(links.sum())), np.repeat(odd, links)
    a_links, b_links = (places + np.repeat(first - ahead, links) for first in (i, j))
    a_links[merged], b_links[merged] = a_odd, b_odd
    return a_links, b_links, stretches


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[tuple[int, int, int, int, int]]]:
    """:func:`linked_places` as lists."""
    a_links, b_links, stretches = linked_places(a_ends, b_ends)
    return a_links.tolist(), b_links.tolist(), [tuple(s) for s in stretches.tolist()]


def id_texts(size: int, last: str) -> tuple[np.ndarray, np.ndarray]:
    """Each id below ``size`` with the comma that follows it in its group, and with ``last``, which ends its side.

    Texts are filled up with zeros to 8 bytes and held as numbers; ids have 24 bits, those beyond 7 digits are not known.
    """
    if size > 10_000_000:
        raise ValueError("ids of more than 7 digits")
    return tuple(np.array([f"{n}{sign}" for n in range(size)], "S8").view(np.uint64) for sign in (",", last))


def group_text(a: np.ndarray, b: np.ndarray, stretches: np.ndarray, a_texts: tuple, b_texts: tuple) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, from the two :func:`id_texts` (``|`` and ``;``)."""
    i, i_end, j, j_end, n = np.asarray(stretches, np.int64).reshape(-1, 5).T
    a_sizes = np.repeat(np.where(n > 1, 1, i_end - i), n)  # of each group; a stretch of several holds one-to-one ones
    b_sizes = np.repeat(np.where(n > 1, 1, j_end - j), n)
    a_upto, b_upto = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_words, b_words = a_texts[0][a], b_texts[0][b]
    a_words[a_upto - 1], b_words[b_upto - 1] = a_texts[1][a[a_upto - 1]], b_texts[1][b[b_upto - 1]]
    words = np.empty(len(a) + len(b), np.uint64)
    words[np.arange(len(a)) + np.repeat(b_upto - b_sizes, a_sizes)] = a_words
    words[np.arange(len(b)) + np.repeat(a_upto, b_sizes)] = b_words
    return words.tobytes().translate(None, b"\0")[:-1].decode()


def packed_links(keys: np.ndarray) -> bytes:
    """Distinct sorted pair keys as differences by bytes of equal weight, and how often each stands, compressed."""
    import zstandard

    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    distinct, counts = keys[at], np.diff(np.r_[at, len(keys)])
    gaps = np.diff(distinct, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:6]
    few = np.minimum(counts, 255).astype(np.uint8)
    many = counts[counts >= 255].astype("<u4")
    body = np.ascontiguousarray(gaps).tobytes() + few.tobytes() + many.tobytes()
    return struct.pack("<I", len(distinct)) + zstandard.compress(body, 1)


def unpacked_links(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    (n,) = struct.unpack_from("<I", blob)
    body = zstandard.decompress(blob[4:])
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(body, np.uint8, 6 * n).reshape(6, n).T
    counts = np.frombuffer(body, np.uint8, n, 6 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, "<u4", -1, 7 * n)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), counts


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, ranks: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and the packed ``links`` of every row, stored."""

    def one(pair: TokenizerPair, a: np.ndarray, b: np.ndarray) -> tuple:
        if not len(a):
            return 0, 0, 0, 0, "", None
        a_links, b_links, stretches = linked_places(np.cumsum(pair.a_size[a]).tolist(), np.cumsum(pair.b_size[b]).tolist())
        keys = (a[a_links] << 24 | b[b_links]).view(np.uint64)
        digest = hashlib.sha256(group_text(a, b, stretches, pair.a_texts, pair.b_texts).encode()).hexdigest()
        return len(a), len(b), int(stretches[:, 4].sum()), len(a_links), digest, packed_links(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = per_process(("tokenizer pair", a_path, b_path, ranks), lambda: TokenizerPair(a_path, b_path, ranks))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
        names = [c.split()[0] for c in ALIGNED.split(", ")]

        def out(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = [(doc_id, *one(pair, a, b)) for doc_id, (a, b) in zip(ids, pair.encode(texts))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if texts and size + len(text) > BATCH_CHARS:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text)
            if texts:
                yield out(ids, texts)

    return stored(whole_texts(docs).mapInArrow(run, ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold each id pair, ``a << 24 | b``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[at], np.add.reduceat(counts, at)

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for blob in batch.column(0):
                held.append(unpacked_links(blob.as_py()))
                size += len(held[-1][0])
                if size >= HELD_LINKS:
                    keys, counts = merged()
                    if len(keys) > HELD_LINKS // 2:  # too many to go on with: Spark adds up the rest
                        yield out(keys, counts)
                        held, size = [], 0
                    else:
                        held, size = [(keys, counts)], len(keys)
        if held:
            yield out(*merged())

    linked = aligned.filter("links is not null").select("links").mapInArrow(run, "pair bigint, n bigint")
    return linked.groupBy("pair").agg(F.sum("n").alias("n"))


def count_chunks(counts: DataFrame, folder: str) -> DataFrame:
    """Sorted files of pairs, counts and whether the count is the highest of the pair's B id; ``path, low, high``."""
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND((1 << 24) - 1)), "pair-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    ranked = counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    ordered = ranked.repartitionByRange("pair").sortWithinPartitions("pair")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), []
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_PAIRS):
                keys, n, top = (c.to_numpy(zero_copy_only=False) for c in batch.slice(start, CHUNK_PAIRS).columns)
                file = WholeFile(folder, f"pairs-{part:06d}-{len(rows):06d}.bin")
                with file as out:
                    out.write(struct.pack("<Q", len(keys)) + keys.astype("<i8").tobytes() + n.astype("<i8").tobytes() + top.astype("u1").tobytes())
                rows.append((file.uri, int(keys[0]), int(keys[-1])))
        if rows:
            columns = zip(zip(*rows), [pa.string(), pa.int64(), pa.int64()])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["path", "low", "high"])

    return stored(ordered.mapInArrow(run, CHUNKS), "pair-chunks")


def read_chunk(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    store, path = place(uri)
    with store.open_input_stream(path, compression=None) as stream:
        raw = stream.read()
    (n,) = struct.unpack_from("<Q", raw)
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n), np.frombuffer(raw, "u1", n, 8 + 16 * n).astype(bool)


def link_sums(aligned: DataFrame, chunks: DataFrame) -> DataFrame:
    """``aligned`` without its links, with ``n_best`` and ``count_sum``."""
    # one row per file: at most |A| * |B| / CHUNK_PAIRS of them and one per task
    files = [(r.path, r.low, r.high) for r in chunks.orderBy("low").collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}

        def chunk(uri: str) -> tuple:
            if uri not in held:
                while len(held) >= HELD_CHUNKS:
                    held.pop(next(iter(held)))
                held[uri] = read_chunk(uri)
            return held[uri]

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                opened = [unpacked_links(b.as_py()) if b.is_valid else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for b in part.column(6)]
                owner = np.repeat(np.arange(len(opened)), [len(k) for k, _ in opened])
                keys = np.concatenate([k for k, _ in opened]).astype(np.int64)
                times = np.concatenate([n for _, n in opened])
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                for uri, low, high in files:
                    s, e = np.searchsorted(keys, low), np.searchsorted(keys, high, "right")
                    if s < e:
                        known, n, top = chunk(uri)
                        at = np.searchsorted(known, keys[s:e])
                        counts[s:e], best[s:e] = n[at], top[at]
                times, owner = times[order], owner[order]
                sums, tops = np.zeros(len(opened), np.int64), np.zeros(len(opened), np.int64)
                np.add.at(sums, owner, times * counts)
                np.add.at(tops, owner, times * best)
                columns = dict(zip([c.split()[0] for c in ALIGNED.split(", ")], part.columns)) | {"n_best": pa.array(tops), "count_sum": pa.array(sums)}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    kinds = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'bigint'}" for n in names)
    return aligned.mapInArrow(run, kinds)


def token_alignment(
    docs: DataFrame, a_path: str, b_path: str, ranks: tuple[str, str] | None = None, folder: str | None = None
) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    aligned = aligned_documents(docs, a_path, b_path, ranks)
    chunks = count_chunks(pair_counts(aligned), folder or shared_folder(docs.sparkSession, "pair-files"))
    return link_sums(aligned, chunks)
