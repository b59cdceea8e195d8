"""Secrets in texts: three patterns, and random strings told by how badly a vocabulary packs them.

A byte-pair vocabulary spends few tokens on anything people write often and about one token per
character or two on random strings. Candidates are runs of key-like characters; those with fewer than
``ratio`` characters per token are secrets unless they are a known kind of identifier: a digest of a usual
length, a UUID, a version, date or number, or a name made of words that pack well themselves. Of a run that
packs well as a whole the windows of 16 characters that don't are secrets. Spans of the patterns always
stay; what they leave of a run is judged by itself.

Null and empty texts have no spans. Offsets count code points, ends are exclusive. Repeated rows give
repeated results; texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import accumulate

from pyspark.sql import DataFrame

from chatloom.llm.base import map_batches, per_process, whole_texts

KINDS = ("assign", "access", "hex", "random")
#: The three base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

LEAST_RUN = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN
RATIO = 1.9
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX_ANY = r"(?:0x)?[0-9a-fA-F]+"
#: Words of one case with at most a short number behind, joined by separators: paths, slugs, constants.
NAME = r"[_/+=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d{1,8})(?:[_/+=-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d{1,8}))*[_/+=-]*"

LEAST_WORD = 4


class Scanner:
    def __init__(self, ranks_path: str, pattern: str, ratio: float):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ratio = ratio
        self.assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
        self.access = re.compile(ACCESS)
        # a run is as long as it can be, so asking for its length at once gives the same matches
        self.hex = re.compile(HEX[:-1] + "{%d,}" % LEAST_HEX)
        self.candidate = re.compile(CANDIDATE)
        self.uuid, self.hex_any, self.name = (re.compile(p) for p in (UUID, HEX_ANY, NAME))
        self.letters, self.parts = re.compile("[A-Za-z]+"), re.compile("[A-Za-z0-9]+")

    def base(self, text: str) -> list[tuple[int, int, int]]:
        spans = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        spans += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(spans)

    def known(self, run: str) -> bool:
        """Digests and identifiers that are random by nature but no secrets."""
        return self.identifier(run) or bool(self.name.fullmatch(run) and self.readable(run))

    def identifier(self, run: str) -> bool:
        if self.uuid.fullmatch(run):
            return True
        return bool(self.hex_any.fullmatch(run)) and len(run.removeprefix("0x")) in DIGEST_LENGTHS

    def readable(self, name: str) -> bool:
        """Whether the words of a name pack like words; shorter ones than ``LEAST_WORD`` tell nothing."""
        words = [w for w in self.letters.findall(name) if len(w) >= LEAST_WORD]
        return sum(map(len, words)) >= self.ratio * sum(len(self.vocabulary.encode_ordinary(w)) for w in words)

    def random(self, run: str) -> bool:
        if self.known(run):
            return False
        return len(run) < self.ratio * len(self.vocabulary.encode_ordinary(run))

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Parts of a run that are random: the whole, or what its windows of ``LEAST_RUN`` characters cover.

        Windows start and end between tokens and may span separators; identifiers inside the run are left out.
        """
        if self.random(run):
            return [(0, len(run))]
        if self.identifier(run):
            return []
        out, at = [], 0
        kept = [m.span() for m in self.uuid.finditer(run)] + [m.span() for m in self.parts.finditer(run) if self.identifier(m[0])]
        for start, end in [*sorted(kept), (len(run), len(run))]:
            if start - at >= LEAST_RUN:
                out += self.windows(run, at, start)
            at = max(at, end)
        return out

    def windows(self, run: str, start: int, end: int) -> list[tuple[int, int]]:
        tokens = self.vocabulary.decode_tokens_bytes(self.vocabulary.encode_ordinary(run[start:end]))
        edges = [*accumulate(map(len, tokens), initial=start)]
        out, last = [], 0
        for first, left in enumerate(edges):
            while last < len(edges) and edges[last] - left < LEAST_RUN:
                last += 1
            if last == len(edges):
                break
            right = edges[last]
            if right - left < self.ratio * (last - first) and not self.known(run[left:right]):
                if out and left <= out[-1][1]:
                    out[-1] = (out[-1][0], right)
                else:
                    out.append((left, right))
        return out

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found, seen, reach = [], 0, 0
        for match in self.candidate.finditer(text):
            start, end = match.span()
            at, pieces = max(start, reach), []
            while seen < len(base) and base[seen][0] < end:
                pieces.append((at, base[seen][0]))
                reach, seen = max(reach, base[seen][2]), seen + 1
                at = max(at, reach)
            for left, right in [*pieces, (at, end)]:
                if right - left >= LEAST_RUN:
                    found += [(left + s, 3, left + e) for s, e in self.stretches(text[left:right])]
        return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` of each whole text."""

    def run(batch: dict) -> dict:
        scanner = per_process(("scanner", ranks_path, pattern, ratio), lambda: Scanner(ranks_path, pattern, ratio))
        out = {name: [] for name in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
        for text in batch["text"]:
            base = scanner.base(text)
            added = scanner.added(text, base)
            for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(k == kind for _, k, _ in base))
            out["n_random"].append(len(added))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(sorted(base + added)))
        return {"doc_id": batch["doc_id"], **out}

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    return map_batches(whole_texts(docs), run, schema)
