"""SentencePiece encoding by an agenda of symbol pairs, and decoding.

A text is normalised as the model says, cut into segments no merge can cross, and each segment is
encoded by an agenda: all adjacent pairs that form a piece wait in a heap by score, the best and then
leftmost is merged, and the pairs it forms with its neighbours join the heap. Symbols without a piece
become their UTF-8 bytes. Every segment with a part that is new to a worker is checked against the
sentencepiece library, batch by batch. Where the library has other ids these are taken, and the batch is encoded
again; ``agrees`` tells of each text whether that was needed for none of its segments.

Null and empty texts give the end id only. Repeated rows give repeated results. A text of any length
is encoded whole; work is n log n in the longest segment. Other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import map_batches, per_process, whole_texts
from chatloom.llm.pieces import SPACE, Memo, PieceModel

SHIFT = 40
LEFT = (1 << SHIFT) - 1
NONE, GONE = (1 << 30) - 1, (1 << 30) - 2
PART_MEMO, SEGMENT_MEMO = 1_000_000, 500_000
CALL_ROWS = 1_000  # texts a worker holds normalised at a time


def agenda_encode(part: str, model: PieceModel) -> tuple[int, ...]:
    """Ids of a part: best score first, then leftmost."""
    pairs, number = model.pairs.get, model.symbol.get
    whole = len(part)
    symbols = [number(c, NONE) for c in part]
    agenda = []
    for i in range(whole - 1):
        found = pairs(symbols[i] << 32 | symbols[i + 1])
        if found is not None:
            agenda.append(found[0] << SHIFT | i)
    if agenda:
        heapify(agenda)
        after = list(range(1, whole + 1))
        before = list(range(-1, whole - 1))
        while agenda:
            entry = heappop(agenda)
            left = entry & LEFT
            right = after[left]
            if right >= whole:
                continue
            # a symbol merged away is GONE, and a pair that has changed has another order or none
            found = pairs(symbols[left] << 32 | symbols[right])
            if found is None or found[0] != entry >> SHIFT:
                continue
            merged = symbols[left] = found[1]
            symbols[right] = GONE
            follower = after[left] = after[right]
            if follower < whole:
                before[follower] = left
                found = pairs(merged << 32 | symbols[follower])
                if found is not None:
                    heappush(agenda, found[0] << SHIFT | left)
            leader = before[left]
            if leader >= 0:
                found = pairs(symbols[leader] << 32 | merged)
                if found is not None:
                    heappush(agenda, found[0] << SHIFT | leader)
    out: list[int] = []
    for i, symbol in enumerate(symbols):
        if symbol != GONE:
            text = part[i] if symbol == NONE else model.known[symbol]
            known = model.ids.get(text)
            if known is None:
                out.extend(model.byte_ids[b] for b in text.encode())
            else:
                out.append(known)
    return tuple(out)


class Codec:
    """Encodes and decodes texts in one Python process."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.parts = Memo(self._part, PART_MEMO)
        self.segments = Memo(self._segment, SEGMENT_MEMO)
        self.fresh: set[str] = set()
        self.new_part = False
        self.wrong: dict[str, tuple[int, ...]] = {}  # the library's ids of segments that came out otherwise
        self.end = self.model.library.eos_id()
        self.digits = [str(i) for i in range(self.model.library.get_piece_size())]

    def _part(self, part: str) -> tuple[int, ...]:
        self.new_part = True
        return agenda_encode(part, self.model)

    def _segment(self, segment: str) -> tuple[int, ...]:
        if segment in self.wrong:
            return self.wrong[segment]
        self.new_part = False
        parts = self.model.parts(segment)
        ids = self.parts[segment] if len(parts) == 1 else tuple(chain.from_iterable(map(self.parts.__getitem__, parts)))
        if self.new_part:
            self.fresh.add(segment)
        return ids

    def ids(self, normalized: str) -> list[int]:
        found = list(chain.from_iterable(map(self.segments.__getitem__, self.model.segments(normalized))))
        found.append(self.end)
        return found

    def check(self) -> bool:
        """Whether all segments with parts that were new since the last check are as the library has them."""
        # the library puts a blank sign in front of a text, and gives a lone one no ids
        fresh, self.fresh = [s for s in self.fresh if s[0] == SPACE != s], set()
        found = self.model.library.encode([s[1:].replace(SPACE, " ") for s in fresh], num_threads=1)
        right = True
        for segment, ids in zip(fresh, found):
            if tuple(chain.from_iterable(map(self.parts.__getitem__, self.model.parts(segment)))) != tuple(ids):
                self.wrong[segment] = tuple(ids)
                self.segments.forget(segment)
                right = False
        return right

    def release(self) -> None:
        """Gives the memory of the memos back; they fill again as texts come."""
        self.parts.empty()
        self.segments.empty()
        gc.collect()  # freed tuples wait in free lists until then, and pin the blocks around them

    def agrees(self, normalized: str) -> bool:
        return not self.wrong or self.wrong.keys().isdisjoint(self.model.segments(normalized))


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, agrees``: ids of each whole text with the end id behind."""

    def run(batch: dict) -> dict:
        codec = per_process(("codec", model_path), lambda: Codec(model_path))
        normalized = codec.model.library.normalize(batch["text"])
        ids = [codec.ids(t) for t in normalized]
        if not codec.check():
            ids = [codec.ids(t) for t in normalized]
        return {"doc_id": batch["doc_id"], "ids": ids, "agrees": [codec.agrees(t) for t in normalized]}

    return map_batches(whole_texts(docs), run, "doc_id bigint, ids array<int>, agrees boolean")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``, by the library's own decoder. Null ids give an empty text."""

    def run(batch: dict) -> dict:
        codec = per_process(("codec", model_path), lambda: Codec(model_path))
        texts = codec.model.library.decode([ids or [] for ids in batch["ids"]], num_threads=1) if batch["ids"] else []
        return {"doc_id": batch["doc_id"], "text": texts}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str, keep_memos: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, agrees`` in one pass, ids never leaving the worker.

    Without ``keep_memos`` a worker gives its memos back at the end of a task: an idle one lives on for a minute,
    beside whatever runs next on its executor.
    """

    def done() -> None:
        per_process(("codec", model_path), lambda: Codec(model_path)).release()

    def run(batch: dict) -> dict:
        codec = per_process(("codec", model_path), lambda: Codec(model_path))
        library, digits = codec.model.library, codec.digits
        normalized = library.normalize(batch["text"])

        def rows() -> dict:
            out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in normalized:
                ids = codec.ids(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(library.decode(ids).encode()).hexdigest())
            return out

        out = rows()
        if not codec.check():
            out = rows()
        return out | {"agrees": [codec.agrees(t) for t in normalized]}

    return map_batches(
        whole_texts(docs), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean",
        CALL_ROWS, None if keep_memos else done,
    )


def encoding_summary(docs: DataFrame, model_path: str, keep_memos: bool = True) -> DataFrame:
    """Digest columns of :func:`round_trip` for every row of ``documents``."""
    return round_trip(docs, model_path, keep_memos).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("agrees"))
