"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

Symbols of a stretch of text form a linked list; all adjacent pairs that are in the vocabulary wait in
a heap by rank. The lowest rank, then leftmost, is merged until none is left: the count is the number
of symbols at the start minus the merges. For a SentencePiece model symbols are characters, and one
without a piece starts as its UTF-8 bytes; for a rank file they are bytes.

Null and empty texts have no tokens. Repeated rows give repeated results. Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import map_batches, per_process, whole_texts
from chatloom.llm.pieces import Memo, PieceModel, pair_table

SHIFT = 40
MASK = (1 << SHIFT) - 1
NONE, GONE = (1 << 30) - 1, (1 << 30) - 2
MEMO = 800_000


def merges(symbols: list[int], pairs: dict) -> int:
    """Merges that byte-pair encoding makes of a run of symbol numbers; see ``pieces.pair_table``."""
    n, lookup = len(symbols), pairs.get
    heap = []
    for i in range(n - 1):
        found = lookup(symbols[i] << 32 | symbols[i + 1])
        if found is not None:
            heap.append(found[0] << SHIFT | i)
    if not heap:
        return 0
    heapify(heap)
    following = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    done = 0
    while heap:
        top = heappop(heap)
        at = top & MASK
        gone = following[at]
        if gone >= n:
            continue
        found = lookup(symbols[at] << 32 | symbols[gone])
        if found is None or found[0] != top >> SHIFT:
            continue
        done += 1
        merged = symbols[at] = found[1]
        symbols[gone] = GONE
        right = following[at] = following[gone]
        if right < n:
            previous[right] = at
            found = lookup(merged << 32 | symbols[right])
            if found is not None:
                heappush(heap, found[0] << SHIFT | at)
        left = previous[at]
        if left >= 0:
            found = lookup(symbols[left] << 32 | merged)
            if found is not None:
                heappush(heap, found[0] << SHIFT | left)
    return done


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts as a SentencePiece model's, without begin and end."""
    model = PieceModel(path)
    ids, number, pairs = model.ids, model.symbol.get, model.pairs

    def of_part(part: str) -> int:
        start = sum(1 if c in ids else len(c.encode()) for c in part)
        return start - (merges([number(c, NONE) for c in part], pairs) if len(part) > 1 else 0)

    parts = Memo(of_part, MEMO)

    def of_segment(segment: str) -> int:
        return sum(map(parts.__getitem__, model.parts(segment)))

    segments = Memo(of_segment, MEMO)
    return lambda texts: [sum(map(segments.__getitem__, model.segments(t))) for t in model.library.normalize(texts)]


def rank_counter(path: str, pattern: str) -> Callable[[list[str]], list[int]]:
    """Counts as those of a file of base64 byte strings and ranks, after cutting by ``pattern``."""
    import base64

    import regex

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    cut = regex.compile(pattern)
    symbol, pairs, _ = pair_table(ranks)

    def of_stretch(stretch: str) -> int:
        raw = stretch.encode()
        return 1 if raw in ranks else len(raw) - merges([symbol[raw[i : i + 1]] for i in range(len(raw))], pairs)

    stretches = Memo(of_stretch, MEMO)
    return lambda texts: [sum(map(stretches.__getitem__, cut.findall(t))) for t in texts]


def token_counts(docs: DataFrame, path: str, limit: int, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``. ``pattern`` is needed for rank files only."""

    def run(batch: dict) -> dict:
        count = per_process(("counter", path), lambda: piece_counter(path) if pattern is None else rank_counter(path, pattern))
        texts = batch["text"]
        return {"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": count(texts) if texts else []}

    counted = map_batches(whole_texts(docs), run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
