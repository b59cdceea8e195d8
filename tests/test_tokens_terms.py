import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import terms, tokens, unigram


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(["le chat dort bien", "le chien dort", "chat <mention> content", "le chat <url>", "日本 chat"] * 8)]
    return spark.createDataFrame(rows, "msg_id bigint, message_clean string").withColumn("channel", F.lit("a"))


def test_word_tokens_round_trip(texts):
    vocabulary = tokens.word_vocabulary(texts)
    rows = {r.id: r.token for r in vocabulary.collect()}
    assert len(set(rows.values())) == len(rows) and rows[0] == "<mask>"
    coded = tokens.encode_words(texts, vocabulary)
    first = coded.filter("msg_id = 2").first()
    assert first.tokens == ["<cls>", "chat", "<mention>", "content", "<sep>"]
    assert [rows[i] for i in first.input_ids] == first.tokens and first.message_tokenized_length == 5
    assert tokens.decode(coded.filter("msg_id = 1"), ["msg_id"], vocabulary).first().text == "<cls> le chien dort <sep>"
    sizes = {r.tokens: r.size for r in tokens.tokens_by_channel(coded).collect()}
    assert sizes["chat"] == 32 and sizes["<cls>"] == 40
    counted = tokens.most_used_first(tokens.word_uses_by_channel(texts, vocabulary)).collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, tokens.tokens_by_channel(coded).collect()))
    assert [(r.channel, -r.size) for r in counted] == sorted((r.channel, -r.size) for r in counted)


def test_masked_examples(spark):
    rows = spark.range(200).select(F.col("id").alias("msg_id"), F.sequence(F.lit(0), F.lit(59)).alias("input_ids"))
    found = tokens.mlm_examples(rows, ["msg_id"], 60, 0, [0, 1, 2]).orderBy("msg_id").collect()
    again = tokens.mlm_examples(rows.repartition(7), ["msg_id"], 60, 0, [0, 1, 2]).orderBy("msg_id").collect()
    assert found == again
    chosen = masked = kept = total = 0
    for r in found:
        for position, (token, label) in enumerate(zip(r.input_ids, r.labels)):
            if position < 3:
                assert label == -100 and token == position
                continue
            total += 1
            assert label in (-100, position) and (label != -100 or token == position)
            chosen += label != -100
            masked += label != -100 and token == 0
            kept += label != -100 and token == position
    assert chosen / total == pytest.approx(0.15, abs=0.02)
    assert masked / chosen == pytest.approx(0.8, abs=0.05) and kept / chosen == pytest.approx(0.1, abs=0.05)


def test_unigram_training_and_encoding(spark, texts):
    trace = []
    vocabulary = unigram.train_vocabulary(texts, 40, trace=trace)
    rows = vocabulary.collect()
    assert len(rows) <= 40 and [r.id for r in rows] == list(range(len(rows)))
    assert [r.token for r in rows[:4]] == ["<mask>", "<sep>", "<unk>", "<cls>"]
    assert trace[1] >= trace[0]
    coded = unigram.encode_unigram(texts, vocabulary)
    for r in coded.limit(5).collect():
        assert r.tokens[0] == "<cls>" and r.tokens[-1] == "<sep>" and len(r.input_ids) == r.message_tokenized_length
    decoded = tokens.decode(
        coded.withColumn("input_ids", F.expr("slice(input_ids, 2, size(input_ids) - 2)")), ["msg_id"], vocabulary, subwords=True
    )
    plain = {r.msg_id: r.text for r in decoded.collect()}
    assert plain[0] == "le chat dort bien" and plain[1] == "le chien dort"
    assert "<mention>" in coded.filter("msg_id = 2").first().tokens
    short = unigram.encode_unigram(texts, vocabulary, max_length=4).first()
    assert short.message_tokenized_length <= 4 and short.tokens[-1] == "<sep>"
    strange = spark.createDataFrame([(1, "☃☃ chat")], "msg_id bigint, message_clean string")
    unknown = unigram.encode_unigram(strange, vocabulary, markers=False).first()
    assert unknown.input_ids.count(2) == 1


def test_words_side_by_side_have_the_counts_of_all_their_splits():
    pieces = sorted(["a", "b", "n", "s", "an", "na", "ana", "ban", "nas", "\U0001f600"])
    logs = {p: math.log((k + 2) / 60) for k, p in enumerate(pieces)}
    words, counts = ["banana", "ananas", "b", "nab", "as\U0001f600", "xa", "bananabanana"], np.array([3, 2, 5, 1, 4, 7, 1])
    trie, nodes = unigram.piece_trie(pieces)
    scores = unigram.node_scores(trie, nodes, np.array([logs[p] for p in pieces]))

    def splits(word):
        if not word:
            return [[]]
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in logs for rest in splits(word[k:])]

    expected, likelihood, taken = dict.fromkeys(pieces, 0.0), 0.0, dict.fromkeys(pieces, 0)
    for word, count in zip(words, counts.tolist()):
        chances = [math.exp(sum(logs[p] for p in split)) for split in splits(word)]
        if chances:
            likelihood += count * math.log(sum(chances))
        for split, chance in zip(splits(word), chances):
            for piece in split:
                expected[piece] += count * chance / sum(chances)
        for piece in unigram.best_path(word, logs, 3, -30.0):
            if piece in taken:
                taken[piece] += count
    sums, uses, found = np.zeros(len(scores)), np.zeros(len(scores), np.int64), 0.0
    for at, codes in unigram.same_size(words):
        found += unigram.add_expected(codes, counts[at], trie, scores, sums)
        unigram.add_uses(codes, counts[at], trie, scores, -30.0, uses)
    assert found == pytest.approx(likelihood)
    assert sums[nodes] == pytest.approx([expected[p] for p in pieces])
    assert uses[nodes].tolist() == [taken[p] for p in pieces]
    lost = unigram.losses(nodes, np.full(len(nodes), 2), trie, scores, -30.0)
    for piece, loss in zip(pieces, lost):
        other = unigram.best_path(piece, logs, 3, -30.0, skip=piece)
        assert loss == pytest.approx(2 * (logs[piece] - sum(logs[p] for p in other)) if len(piece) > 1 else 0.0)


def test_best_path_picks_the_likeliest_split():
    logs = {"a": -3.0, "b": -3.0, "ab": -4.0, "c": -1.0}
    assert unigram.best_path("abc", logs, 2, -20.0) == ["ab", "c"]
    assert unigram.best_path("abc", logs, 2, -20.0, skip="ab") == ["a", "b", "c"]


def messages(spark):
    rows = [(1, 10.0, 0, "le chat noir"), (2, 20.0, 0, "dort"), (3, 30.0, 0, "le"), (4, 40.0, 0, "chat noir"), (5, 5.0, 1, "noir dort")]
    frame = spark.createDataFrame(rows, "msg_id bigint, s double, labels int, message_clean string")
    return frame.withColumn("published_datetime", F.timestamp_seconds("s"))


def test_term_counts_straddle_messages_when_the_pair_is_known(spark):
    counts = {(r.labels, r.term): r.n for r in terms.topic_term_counts(messages(spark), ["le"]).collect()}
    # "noir dort" is seen inside message 5, so it also counts across messages 1 and 2 of topic 0;
    # "dort chat" is seen nowhere inside a message
    assert counts == {
        (0, "chat"): 2, (0, "noir"): 2, (0, "dort"): 1, (0, "chat noir"): 2, (0, "noir dort"): 1,
        (1, "noir"): 1, (1, "dort"): 1, (1, "noir dort"): 1,
    }
    vocabulary = spark.createDataFrame([("dort chat",), ("chat",)], "term string")
    limited = {(r.labels, r.term): r.n for r in terms.topic_term_counts(messages(spark), ["le"], vocabulary).collect()}
    assert limited == {(0, "chat"): 2, (0, "dort chat"): 1}


def test_weighting_and_description(spark):
    counts = terms.topic_term_counts(messages(spark), ["le"])
    weighted = {(r.labels, r.term): r.importance for r in terms.ctfidf(counts, ["chat"]).collect()}
    assert weighted[(0, "chat")] == pytest.approx(2 / 8 * math.log(1 + 5 / 2) * 1.2)
    assert weighted[(1, "dort")] == pytest.approx(1 / 3 * math.log(1 + 5 / 2))
    wide = {r.labels_: r for r in terms.terms_wide(counts).collect()}
    assert (wide[0].term_1, wide[0].term_1_freq, wide[0].terms_nunique) == ("chat", 2, 5)
    assert (wide[1].term_4, wide[1].term_4_freq) == ("", 0)
    same = {(r.labels_a, r.labels_b): r.similarity for r in terms.topic_similarity(counts).collect()}
    assert same[(0, 0)] == pytest.approx(1.0) and same[(0, 1)] == pytest.approx(same[(1, 0)])
    assert terms.topic_labels(counts).filter("labels = 1").first().terms == "dort / noir / noir dort"


@pytest.mark.parametrize("block", [1, 3, 500])
def test_similarity_of_topics_that_share_a_term(spark, block):
    draw = np.random.default_rng(3)
    table = draw.integers(0, 4, (17, 6))
    table[:, 0] = 1 + draw.integers(0, 3, 17)  # one term in all topics
    rows = [(int(t), f"w{w}", int(n)) for t, line in enumerate(table) for w, n in enumerate(line) if n]
    counts = spark.createDataFrame(rows, "labels int, term string, n bigint")
    found = {(r.labels_a, r.labels_b): r.similarity for r in terms.topic_similarity(counts, block_topics=block).collect()}
    unit = table / np.linalg.norm(table, axis=1)[:, None]
    assert len(found) == 17 * 17
    assert all(value == pytest.approx(unit[a] @ unit[b]) for (a, b), value in found.items())
    assert terms.topic_similarity(counts.limit(0)).count() == 0


def test_uses_in_order(spark):
    counts = spark.createDataFrame([("a", 5, "x", 2), ("a", 6, "y", 9), ("a", 4, "b", 2), ("c", 5, "x", 1)], "channel string, input_ids int, tokens string, size bigint")
    ranks = {(r["channel"], r["tokens"]): r["rank"] for r in tokens.ranked_uses(counts).collect()}
    assert ranks == {("a", "y"): 1, ("a", "b"): 2, ("a", "x"): 3, ("c", "x"): 1}
