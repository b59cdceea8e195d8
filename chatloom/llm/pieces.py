"""Vocabulary of a merge-type SentencePiece model, as the merging operators need it."""

from __future__ import annotations

import re
from operator import add

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def pair_table(order: dict) -> tuple[dict, dict, list]:
    """Symbol numbers, ``left << 32 | right`` to ``(merge order, merged symbol)``, and symbols by number.

    Symbols are all pieces, and their single characters (or bytes) where those are no pieces themselves.
    """
    known = list(order)
    known += sorted({piece[i : i + 1] for piece in order for i in range(len(piece))} - set(order))
    symbol = {piece: n for n, piece in enumerate(known)}
    pairs = {}
    for piece, rank in order.items():
        for i in range(1, len(piece)):
            left, right = symbol.get(piece[:i]), symbol.get(piece[i:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = (rank, symbol[piece])
    return symbol, pairs, known


class PieceModel:
    """Pieces, merge order (0 merges first, equal scores share an order) and byte ids of a model file.

    ``joined`` holds each pair of neighbouring characters of any piece. A merge never crosses a border
    whose two characters are not in it, so the parts between such borders are encoded on their own.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        library = self.library
        ids = range(library.get_piece_size())
        plain = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        self.ids = {library.id_to_piece(i): i for i in plain}
        scores = sorted({library.get_score(i) for i in plain}, reverse=True)
        rank = {score: n for n, score in enumerate(scores)}
        self.order = {piece: rank[library.get_score(i)] for piece, i in self.ids.items()}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joined = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.symbol, self.pairs, self.known = pair_table(self.order)
        #: No piece has a blank sign behind another character: words can be cut before blank signs.
        self.words_apart = all(b != SPACE or a == SPACE for a, b in (tuple(x) for x in self.joined))

    def parts(self, segment: str) -> list[str]:
        """The segment, cut where no merge can cross."""
        joined, start, out = self.joined, 0, []
        if joined.issuperset(map(add, segment, segment[1:])):
            return [segment]
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in joined:
                out.append(segment[start:i])
                start = i
        out.append(segment[start:])
        return out

    def segments(self, normalized: str) -> list[str]:
        return SEGMENT.findall(normalized) if self.words_apart else [normalized] if normalized else []


class Memo(dict):
    """Results of a pure function by argument; at most ``limit`` are held, in two generations.

    When the young generation is full it becomes the old one, and what is asked for again moves back.
    """

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.half, self.old = function, limit // 2, {}

    def forget(self, key) -> None:
        self.pop(key, None)
        self.old.pop(key, None)

    def empty(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
