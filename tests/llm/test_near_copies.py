import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from chatloom.llm import near_copies
from tests.llm.test_dedup import prose


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def staying(rows):
    """Smallest id of each group, by all pairs."""
    group = {d: d for d, _ in rows}
    for i, (d, a) in enumerate(rows):
        for e, b in rows[i + 1 :]:
            if group[d] != group[e] and similarity(a, b) >= 0.8:
                low, high = sorted((group[d], group[e]))
                group = {k: low if g == high else g for k, g in group.items()}
    return sorted(set(group.values()))


def copies(seed=5):
    draw = random.Random(seed)
    texts = [prose(draw, draw.randint(40, 160)) for _ in range(20)]
    passage = prose(draw, 25)
    for text in texts[:12]:
        words = text.split(" ")
        for _ in range(4):
            near = list(words)
            for _ in range(draw.randint(1, 2)):
                near[draw.randrange(len(near))] = f"new{draw.randrange(1_000)}"
            texts.append(" ".join(near))
    texts += [f"{prose(draw, 10)} {passage} {prose(draw, 10)}" for _ in range(15)]
    return [*enumerate(texts)]


def groups_by_hand(rows):
    """Group of each id, by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    group = {d: d for d, _ in rows}
    for i, (d, _) in enumerate(rows):
        for e, _ in rows[i + 1 :]:
            if group[d] != group[e] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                low, high = sorted((group[d], group[e]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


@pytest.mark.parametrize("block_rows", [3, 1_000])
def test_groups_lie_inside_those_of_all_pairs_and_hold_nearly_all(spark, block_rows):
    rows = copies()
    frame = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id bigint, text string, source string").repartition(3)
    want, found = groups_by_hand(rows), defaultdict(list)
    for r in near_copies.near_copy_groups(frame, block_rows).collect():
        found[r.component].append(r.doc_id)
    assert all(len({want[d] for d in members}) == 1 for members in found.values())
    removable = len(rows) - len(set(want.values()))
    assert removable > 30 and len(rows) - len(found) >= 0.9 * removable
    if block_rows > 3:
        out = sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, frame, "").collect())
        assert out == sorted(map(min, found.values())) and set(staying(rows)) <= set(out)


def test_recall_by_similarity():
    """Share of pairs with a common key, as the docstring states it."""
    draw, found = np.random.default_rng(2), defaultdict(list)
    from chatloom.llm import golay

    def keys(hashes):
        parts = near_copies.fingerprint(hashes).view("<u2").astype(np.int64)
        near = [golay.keys(parts[[(s + 1) % near_copies.SEGMENTS]])[0] for s in range(near_copies.SEGMENTS)]
        return {(s, int(parts[s]), int(k)) for s in range(near_copies.SEGMENTS) for k in near[s] if k >= 0}

    for similarity_, changed in ((0.8, 50), (0.9, 21)):
        for _ in range(150):
            both = draw.integers(0, 1 << 64, 400, dtype=np.uint64)
            a, b = (np.concatenate([both, draw.integers(0, 1 << 64, changed, dtype=np.uint64)]) for _ in range(2))
            found[similarity_].append(bool(keys(a) & keys(b)))
    assert np.mean(found[0.9]) >= 0.98 and np.mean(found[0.8]) >= 0.75


def test_the_border_is_part_of_the_similarity(spark):
    words = [f"w{i}" for i in range(49)]  # 45 shingles; one word in the middle changed: 40 of 50
    other = words[:20] + ["x"] + words[21:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:20] + ["y"] + words[21:-1]))]
    assert similarity(rows[0][1], rows[1][1]) == 0.8 > similarity(rows[0][1], rows[2][1])
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id bigint, text string, source string")
    sets = near_copies.fingerprints(docs)
    key = {r.doc_id: r.set_key for r in sets.collect()}
    pairs = spark.createDataFrame([(key[1], key[2]), (key[1], key[3])], "a bigint, b bigint")
    assert [tuple(r) for r in near_copies.verified(pairs, docs, sets).collect()] == [(key[1], key[2])]


def test_larger_tables_are_not_sent(spark, monkeypatch):
    rows = copies(7)
    frame = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id bigint, text string, source string").repartition(3)
    groups = lambda: sorted(map(tuple, near_copies.near_copy_groups(frame).select("doc_id", "component").collect()))
    sent = groups()
    monkeypatch.setattr(near_copies, "SENT_ROWS", 0)
    monkeypatch.setattr(near_copies, "BLOCK_PAIRS", 2)
    assert [d for d, _ in groups()] == [d for d, _ in sent] and len({c for _, c in groups()}) == len({c for _, c in sent})
