import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.llm import token_alignment, toxicity, whitening
from chatloom.llm.queries import BYTES, PIECES, RANKS, REGISTRY
from chatloom.llm.spectrum_slicing import count_above, leading_eigenpairs
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.001"


# op 11 -------------------------------------------------------------------------------------------------------

def alignment_by_hand(rows):
    """All columns of op 11 by set operations on offsets, with the two libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255)]
    letters = {chr(256 + odd.index(c)) if c in odd else chr(c): c for c in range(256)}
    found, pairs = [], Counter()
    for doc_id, text in rows:
        raw = b" " + (text or "").encode()
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, map(b.id_to_piece, b_ids))]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            a_ids, b_ids, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes], dtype=int), np.cumsum([len(x) for x in b_bytes], dtype=int)
        overlap = lambda i, j: a_ends[i] > b_ends[j] - len(b_bytes[j]) and b_ends[j] > a_ends[i] - len(a_bytes[i])
        every = np.union1d(a_ends, b_ends)
        linked = list(zip(np.searchsorted(a_ends, every), np.searchsorted(b_ends, every)))
        if len(a_ids) < 60:
            assert sorted(linked) == sorted((i, j) for i in range(len(a_ids)) for j in range(len(b_ids)) if overlap(i, j))
        ids = [(a_ids[i], b_ids[j]) for i, j in linked]
        pairs.update(ids)
        cuts = np.intersect1d(a_ends, b_ends)
        groups = []
        of = [np.split(np.array(names, object), np.searchsorted(ends, cuts, "right")[:-1]) if len(cuts) else [] for names, ends in ((a_ids, a_ends), (b_ids, b_ends))]
        groups = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*of)]
        found.append((doc_id, len(a_ids), len(b_ids), len(cuts), ids, hashlib.sha256(";".join(groups).encode()).hexdigest() if a_ids else ""))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [(d, x, y, g, len(ids), sum(pairs[p] == best[p[1]] for p in ids), sum(pairs[p] for p in ids), digest) for d, x, y, g, ids, digest in found]


def as_rows(frame):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


HOSTILE = [
    (20, "a ▁ b"), (21, "<|endoftext|> <s> </s> <unk> <0x0A>"), (22, "\n\n  x\t\ty  "), (23, "don't I'LL"), (24, " "),
    (25, "漢字かな 😀🏽‍♂️ é"), (26, "\x00\x01"), (27, "ﬁ Ⅻ ㎏"), (28, "x" * 5000), (29, "日本" * 900), (30, "ẍ̌͒ Ǆ ʼn"), (31, "1234567890 3.14"),
]


def test_alignment_of_odd_rows_matches_brute_force(spark, odd, none):
    extra = spark.createDataFrame([(i, t, "s", 1, "k", "r") for i, t in HOSTILE], odd.schema)
    docs = odd.unionByName(extra).withColumnRenamed("_row", "links")
    want = alignment_by_hand([(r[0], r[1]) for r in ODD] + HOSTILE)
    for ranks in (None, (RANKS, public_tokenizers.PATTERN)):
        assert order(as_rows(token_alignment.token_alignment(docs, BYTES, PIECES, ranks))) == order(want)
    assert token_alignment.token_alignment(none, BYTES, PIECES).count() == 0


def test_alignment_query_matches_brute_force(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = order(alignment_by_hand(rows))
    assert order(as_rows(REGISTRY["op11_token_alignment"](spark, SMALL))) == want
    monkeypatch.setattr(token_alignment, "CHUNK_PAIRS", 97)  # many files of pairs, few held
    monkeypatch.setattr(token_alignment, "HELD_CHUNKS", 2)
    monkeypatch.setattr(token_alignment, "HELD_LINKS", 5_000)
    assert order(as_rows(REGISTRY["op11_token_alignment"](spark, SMALL))) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.floats(0, 1), st.floats(0, 1))
def test_skipping_finds_every_common_end(seed, n, common, lone):
    r = random.Random(seed)
    a, b = [], []
    for end in range(1, n + 1):
        both = r.random() < common
        if both or r.random() < lone:
            a.append(end)
        if both or r.random() < lone:
            b.append(end)
    a, b = [*a, n + 1], [*b, n + 1]
    a_links, b_links, stretches = token_alignment.align(a, b)
    every = np.union1d(a, b)
    assert a_links == np.searchsorted(a, every).tolist() and b_links == np.searchsorted(b, every).tolist()
    assert sum(s[4] for s in stretches) == len(set(a) & set(b))
    assert [s[1] for s in stretches][:-1] == [s[0] for s in stretches][1:] and stretches[-1][1] == len(a)


def test_packed_links_keep_pairs_and_counts():
    keys = np.array([5, 5, (50_256 << 24) + 31_999, 7, *[9] * 300, *[11] * 255], np.uint64)
    distinct, counts = token_alignment.unpacked_links(token_alignment.packed_links(keys))
    assert dict(zip(distinct.tolist(), counts.tolist())) == Counter(keys.tolist())


# op 12 -------------------------------------------------------------------------------------------------------

def whitened_by_hand(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = np.array([[float((n * a - s)) / n for a, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], axes[:, ::-1]


def check_whitening(rows, vectors, components=8):
    deviation, centred, values, axes = whitened_by_hand(list(vectors.values()))
    at = {v: i for i, v in enumerate(vectors)}
    k = min(components, len(values))
    got = np.full((len(vectors), k), np.nan)
    for r in rows:
        assert r.n == len(vectors) and r.deviation == deviation[at[r.vec_id]] == r.deviation_exact
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
        got[at[r.vec_id], r.component - 1] = r.whitened
    assert len(rows) == len(vectors) * k
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-7


def test_whitening_query_matches_numpy(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    check_whitening(REGISTRY["op12_whitening"](spark, SMALL).collect(), vectors)


def test_whitening_takes_odd_rows(spark):
    r = np.random.default_rng(3)
    good = {n: (r.standard_normal(3) * [1, 5, 0.3] - 2).tolist() for n in range(40)}
    rows = [(n, v, 1, "w") for n, v in good.items()]
    rows += [(90, None, 1, "w"), (91, [1.0, None, 2.0], 1, "w"), (92, [1.0, float("nan"), 2.0], 1, "w"), (93, [float("inf"), 0.0, 0.0], 1, "w"), (94, [], 1, "w")]
    schema = "vec_id bigint, embedding array<double>, n int, whitened string"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    check_whitening(whitening.whitened_embeddings(frame).collect(), good)
    none = whitening.whitened_embeddings(frame.filter("vec_id >= 90"))
    assert none.count() == 0 and none.columns[:4] == ["vec_id", "component", "n", "deviation"]
    twice = whitening.whitened_embeddings(frame.filter("vec_id < 9").unionByName(frame.filter("vec_id < 9")))
    assert twice.count() == 18 * 3 and twice.agg({"identity_error": "max"}).first()[0] < 1e-9
    flat = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 2.0]), (2, [3.0, 2.0])], "vec_id bigint, embedding array<float>")
    out = whitening.whitened_embeddings(flat).collect()
    assert [r.whitened is None for r in sorted(out, key=lambda r: r.component)] == [False] * 3 + [True] * 3
    one = whitening.whitened_embeddings(flat.filter("vec_id = 1")).collect()
    assert [(r.deviation, r.whitened, r.explained) for r in one] == [(0, None, 0.0)] * 2
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>").repartition(2)
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened_embeddings(mixed)


def test_sums_beyond_doubles_stay_exact(spark):
    vectors = {n: [float(x) for x in v] for n, v in enumerate([(3e12, 1.5, -7e11), (-2e12, 0.25, 1e11), (1e12, -3.0, 5e11), (4e12, 9.0, 0.0)])}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>").repartition(3)
    deviation = whitened_by_hand(list(vectors.values()))[0]
    for r in whitening.whitened_embeddings(frame).collect():
        assert int(r.deviation_exact) == deviation[r.vec_id] and r.deviation is None and r.identity_error < 1e-6


def test_slicing_counts_and_pairs():
    r = np.random.default_rng(1)
    for trial in range(45):
        n = int(r.integers(1, 40))
        values = [r.exponential(1, n), np.round(r.exponential(2, n)), np.r_[np.full(n // 2, 5.0), r.exponential(1, n - n // 2)]][trial % 3]
        axes, _ = np.linalg.qr(r.standard_normal((n, n)))
        matrix = (axes * values) @ axes.T
        matrix = (matrix + matrix.T) / 2
        shift = r.uniform(-1, 6)
        assert count_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
        found, vectors = leading_eigenpairs(matrix, 8)
        assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-12 * max(1, values.max())
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12 and np.abs(matrix @ vectors - vectors * found).max() < 1e-11
    assert count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


# op 13 -------------------------------------------------------------------------------------------------------

def planted(spark, n, seed=1):
    r = random.Random(seed)
    parts = ["an", "the", "ing", "er", "ou", "st", "ly", "re", "wh", "ti", "ea", "on"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(30, 200))], i % 5 == 0
        if toxic:
            for _ in range(3 + len(words) // 40):
                words.insert(r.randrange(len(words)), r.choice(["zorgbat", "quimpf", "blaxxor", "vundrek"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_toxic_texts_are_found(spark):
    docs, labels = planted(spark, 1_500)
    truth = dict(labels.collect())
    rows = toxicity.scored_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    assert np.mean([p for t, p in out if t]) >= 0.9 and np.mean([not p for t, p in out if not t]) >= 0.95


def test_held_out_labels_do_not_reach_the_model(spark):
    docs, labels = planted(spark, 300)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit_toxicity(docs, labels) == toxicity.fit_toxicity(docs.repartition(7), turned.repartition(3))


def test_scores_of_odd_rows(spark, odd, none):
    docs, labels = planted(spark, 300)
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.toxicity_scores(odd, model).collect()
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(rows) == len(ODD) and len(blank) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 8}) == 1
    assert toxicity.toxicity_scores(none, model).count() == 0
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.scored_documents(odd, no_labels).collect()} == {0}
    all_toxic = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (8, 1)], "doc_id bigint, toxic int")
    assert toxicity.scored_documents(odd, all_toxic).count() == len(ODD)


def test_windows_hold_the_whole_text():
    text = "Some WORDS " * 50 + "y" * 200 + " end\n\tof it"
    cut = toxicity.windows(text)
    assert b"".join(cut).replace(b" ", b"") == "".join(text.lower().split()).encode() and max(map(len, cut)) <= 2 * toxicity.WINDOW


def test_toxicity_query_scores_every_document(spark):
    rows = REGISTRY["op13_toxicity"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [r.predicted for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    found = [r.predicted for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    assert len(rows) == 1_000 and np.mean(clean) <= 0.05 and np.mean(found) >= 0.5


def test_group_texts_are_written_from_tables_of_ids():
    import random

    import numpy as np

    from chatloom.llm import token_alignment as T

    draw = random.Random(5)
    a_texts, b_texts = T.id_texts(60, "|"), T.id_texts(60, ";")
    for _ in range(200):
        ends = sorted(draw.sample(range(1, 80), draw.randint(1, 40)))
        a_ends, b_ends = (sorted({*draw.sample(ends, draw.randint(1, len(ends))), ends[-1]}) for _ in "ab")
        a, b = (np.array([draw.randrange(60) for _ in side], np.int64) for side in (a_ends, b_ends))
        _, _, stretches = T.align(a_ends, b_ends)
        groups, start = [], 0
        for end in sorted({*a_ends} & {*b_ends}):
            sides = ([str(n) for n, at in zip(ids, at_ends) if start < at <= end] for ids, at_ends in ((a, a_ends), (b, b_ends)))
            groups.append("|".join(map(",".join, sides)))
            start = end
        assert T.group_text(a, b, stretches, a_texts, b_texts) == ";".join(groups)


def test_links_and_group_texts_are_made_of_whole_stretches():
    import numpy as np

    from chatloom.llm import token_alignment as T

    a_links, b_links, stretches = T.linked_places([1, 3, 4, 6, 9, 10], [1, 2, 5, 6, 9, 10])
    assert a_links.tolist() == [0, 1, 1, 2, 3, 3, 4, 5] and b_links.tolist() == [0, 1, 2, 2, 2, 3, 4, 5]
    assert stretches.tolist() == [[0, 1, 0, 1, 1], [1, 4, 1, 4, 1], [4, 6, 4, 6, 2]]
    a, b = np.array([0, 199_999, 10, 7, 5, 100_000]), np.array([3, 99_999, 0, 99, 2, 1])
    text = T.group_text(a, b, stretches, T.id_texts(200_000, "|"), T.id_texts(100_000, ";"))
    assert text == "0|3;199999,10,7|99999,0,99;5|2;100000|1"
