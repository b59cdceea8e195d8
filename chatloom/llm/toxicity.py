"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

One dictionary is trained on windows of ordinary texts. The other is trained on toxic text: on the stretches of
labelled toxic texts that tell them apart, those whose ``GRAM``-byte strings are ``RATIO`` times as frequent among
toxic as among ordinary texts. Both hold the ordinary content at the same distance, so windows without anything
toxic come out equally long and what differs is what the toxic content saves. A text's windows (whole words up to
``WINDOW`` bytes) are compressed with both; the mean saving, the shares of windows past savings of 1, 2 and 3
bytes, and the logarithms of total saving and of windows go into a logistic calibration.

The fit sees a bounded sample of labelled rows: ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` at most, those of smallest
hash of their ids, two thirds for the dictionaries and the rest for the calibration, which is corrected to the share
of toxic rows among all labelled training rows. Scoring reads every text whole, and needs no shuffle.

Null, empty and blank texts have no windows and get the calibrated score of no saving. Without toxic or ordinary
training rows every score is the share of toxic rows (0 without labels). A ``doc_id`` labelled more than once counts
as toxic if any of its rows says so; null labels are left out. Repeated rows get equal scores. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import per_process, whole_texts

WINDOW = 64
GRAM = 5
RATIO = 20
#: A string counts in so many toxic texts of the sample, as a share and at least.
LEAST_SHARE, LEAST_TEXTS = 0.007, 5
TOXIC_ROWS, ORDINARY_ROWS = 3_000, 9_000
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 3_072
ORDINARY_WINDOWS = 100_000
LEVEL = 9
THRESHOLD = 0.3
SEED = 42


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the dictionaries and the calibration; some 40 KB."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # the last one stands alone

    @property
    def key(self) -> str:
        return hashlib.sha256(self.ordinary + b"|" + self.toxic).hexdigest()


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in small letters, as words up to ``size`` bytes; longer words are cut."""
    out, held, length = [], [], 0
    for word in text.encode().lower().split():
        if len(word) > size:
            if held:
                out.append(b" ".join(held))
                held, length = [], 0
            out += [word[i : i + size] for i in range(0, len(word), size)]
            continue
        held.append(word)
        length += len(word) + 1
        if length >= size:
            out.append(b" ".join(held))
            held, length = [], 0
    if held:
        out.append(b" ".join(held))
    return out


class Meter:
    """Bytes that the toxic dictionary saves against the ordinary one, by window."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int = LEVEL):
        import zstandard

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        self.plain, self.both = compressor(ordinary), compressor(toxic + ordinary)

    def measures(self, text: str) -> tuple[float, ...]:
        plain, both = self.plain, self.both
        saved = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], np.float64)
        if not len(saved):
            return (0.0,) * 6
        shares = [float((saved >= n).mean()) for n in (1, 2, 3)]
        return (float(saved.mean()), *shares, math.log1p(max(float(saved.sum()), 0.0)), math.log1p(len(saved)))


def grams(raw: bytes) -> np.ndarray:
    """Each ``GRAM``-byte string as a number."""
    text = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(text) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | text[i : len(text) - GRAM + 1 + i]
    return out


def telling_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stretches of toxic texts made of strings that are much more frequent there, with repeats."""

    def texts_with(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(grams(t)) for t in texts]]), return_counts=True)

    (known, n), (others, m) = texts_with(toxic), texts_with(ordinary)
    at = np.minimum(np.searchsorted(others, known), max(len(others) - 1, 0))
    there = np.where(others[at] == known, m[at], 0) if len(others) else np.zeros(len(known))
    often = n >= max(LEAST_TEXTS, LEAST_SHARE * len(toxic))
    telling = known[often & (n * len(ordinary) >= RATIO * (there + 1) * len(toxic))]
    out = []
    for text in toxic:
        hits = np.flatnonzero(np.isin(grams(text), telling))
        steps = np.zeros(len(text) + 1, np.int64)
        np.add.at(steps, hits, 1)
        np.add.at(steps, hits + GRAM, -1)
        borders = np.flatnonzero(np.diff(np.r_[False, np.cumsum(steps[:-1]) > 0, False].astype(np.int8)))
        out += [text[s:e] for s, e in borders.reshape(-1, 2)]
    return out


def dictionary_content(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; samples too few or too alike for the trainer stand for themselves."""
    import zstandard

    if sum(map(len, samples)) > size:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def calibrated(measures: np.ndarray, toxic: np.ndarray, share: float, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic model by Newton steps, its constant moved to the given share of toxic rows."""
    mean, spread = measures.mean(axis=0), measures.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    x = np.column_stack([(measures - mean) / spread, np.ones(len(measures))])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - toxic) + ridge * len(x) * np.r_[weights[:-1], 0] / 100
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) / 100 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    own = toxic.mean()
    constant = weights[-1] + math.log(share / (1 - share)) - math.log(own / (1 - own))
    scaled = weights[:-1] / spread
    return (*scaled.tolist(), float(constant - scaled @ mean))


def fit_texts(toxic: list[str], ordinary: list[str], share: float) -> ToxicityModel:
    """A model from sampled texts. Every third text of either kind is for the calibration alone."""
    if not toxic or not ordinary:
        constant = -30.0 if not toxic else 30.0
        return ToxicityModel(b"", b"", (*(0.0,) * 6, constant))
    joined = lambda texts: list(dict.fromkeys(b" " + b" ".join(windows(t)) + b" " for t in texts))
    part = lambda texts, third: [t for n, t in enumerate(texts) if (n % 3 == 2) == third or len(texts) < 3]
    samples = [w for t in part(ordinary, False) for w in windows(t)]
    every = -(-len(samples) // ORDINARY_WINDOWS)
    content = dictionary_content(samples[:: max(1, every)], ORDINARY_BYTES, WINDOW)
    stretches = telling_stretches(joined(part(toxic, False)), joined(part(ordinary, False)))
    special = dictionary_content(stretches, TOXIC_BYTES, 20)
    meter = Meter(content, special)
    texts = [(t, 1.0) for t in part(toxic, True)] + [(t, 0.0) for t in part(ordinary, True)]
    measures = np.array([meter.measures(t) for t, _ in texts])
    return ToxicityModel(content, special, calibrated(measures, np.array([y for _, y in texts]), share))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from labelled rows that are not held out."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = min(max(counts.get(1, 0) / max(total, 1), 1e-6), 1 - 1e-6)
    draw = F.xxhash64("doc_id", F.lit(SEED))
    chosen = [rows.filter(F.col("toxic") == t).orderBy(draw, "doc_id").limit(n) for t, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    # at most 12,000 ids: texts stay where they are and are not shuffled
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    sample = texts.join(wanted, "doc_id").dropDuplicates(["doc_id"]).collect()
    sample.sort(key=lambda r: (hashlib.sha256(str(r.doc_id).encode()).digest(), r.doc_id))
    return fit_texts([r.text for r in sample if r.toxic == 1], [r.text for r in sample if r.toxic == 0], share)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    weights, key = np.array(model.weights), model.key

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = per_process(("toxicity", key), lambda: Meter(model.ordinary, model.toxic))
        for batch in batches:
            measures = np.array([meter.measures(t.as_py()) for t in batch.column(1)]).reshape(-1, len(weights) - 1)
            score = 1 / (1 + np.exp(-np.clip(measures @ weights[:-1] + weights[-1], -30, 30)))
            columns = [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return whole_texts(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: scores of a model fitted on the labelled rows of the same table."""
    scores = toxicity_scores(docs, fit_toxicity(docs, labels))
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
