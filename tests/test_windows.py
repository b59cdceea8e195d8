import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import prepare, windows
from chatloom.operators.ordering import exact_medians, smallest, with_next, with_rank
from chatloom.operators import sampling


def greedy(lengths, limit):
    group, total, out = 0, 0, []
    for value in lengths:
        if total + value > limit:
            group, total = group + 1, 0
        total += value
        out.append(group)
    return out


def test_prepare_and_spam_filter(chat):
    rows = prepare.prepare_chat(chat([
        (1, 86_400.5, "a", "u", "@x @y @z @w hi"), (2, 1.0, "a", None, "ok"), (3, 2.0, None, "u", "no channel"), (4, 3.0, "a", "u", None),
    ]))
    assert {r.msg_id: r.count_mention for r in rows.collect()} == {1: 4, 2: 0}
    assert rows.filter("msg_id = 1").selectExpr("unix_micros(published_date)").first()[0] == 86_400_000_000
    assert [r.msg_id for r in prepare.filter_spam(rows).collect()] == [2]


def test_broadcast_slice(chat):
    day = 1_636_054_000 - 1_636_054_000 % 86_400  # midnight
    rows = chat([
        (1, day + 19 * 3600, "a", None, "@x  hello @y"), (2, day + 23 * 3600, "a", "moobot", "bot"),
        (3, day + 23 * 3600, "a", "u", "last"), (4, day + 23 * 3600 + 1, "a", "u", "late"), (5, day + 20 * 3600, "b", "u", "other"),
    ])
    date = rows.selectExpr("date_format(min(published_datetime), 'yyyy-MM-dd')").first()[0]
    kept = prepare.broadcast_slice(prepare.prepare_chat(rows), ["a"], f"{date} 19:00:00", f"{date} 23:00:00").collect()
    assert {r.msg_id: r.message for r in kept} == {1: "hello", 3: "last"}
    assert {r.msg_id: r.count_mention for r in kept} == {1: 2, 3: 0}


def test_origin_is_the_first_kept_message(chat):
    rows = chat([(1, 0.0, "b", "u", "@a @b @c @d"), (2, 3.0, "a", "u", "x"), (3, 7.9, "b", "u", "y"), (4, 8.0, "a", "u", "z"), (5, 40.0, "a", "u", "w")])
    kept = prepare.filter_spam(prepare.prepare_chat(rows))
    binned = windows.with_window_id(windows.with_time_bin(kept, "5s"))
    assert {r.msg_id: r.window_bin for r in binned.collect()} == {2: 0, 3: 0, 4: 1, 5: 7}
    assert {r.msg_id: r.time_window for r in binned.collect()} == {2: 0, 4: 1, 5: 2, 3: 3}


@pytest.mark.parametrize("lengths, expected", [([300, 100, 200, 50], [0, 0, 1, 1]), ([600, 10], [1, 2]), ([499, 1, 1], [0, 0, 1]), ([0, 0], [0, 0])])
def test_packing_literals(chat, lengths, expected):
    rows = chat([(i, 0.001 * i, "a", "u", "x" * n) for i, n in enumerate(lengths)])
    binned = windows.with_time_bin(prepare.prepare_chat(rows), "5s")
    packed = windows.pack_messages(binned, "message_length", "g", 500)
    assert [r.g for r in packed.orderBy("msg_id").collect()] == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_windows_pack_like_small_ones(chat, seed):
    draw = random.Random(seed)
    # one window of one channel holds most rows, many at the same instant
    rows = [(i, 0.0 if draw.random() < 0.4 else draw.random() * 4, "hot", "u", "x" * draw.choice([0, 3, 9, 40, 70])) for i in range(600)]
    rows += [(1_000 + i, draw.random() * 60, "cold", "u", "x" * draw.randrange(60)) for i in range(80)]
    binned = windows.with_time_bin(prepare.prepare_chat(chat(rows)), "5s")
    wide = windows.pack_messages(binned, "message_length", "g", 50).orderBy("published_datetime", "msg_id").collect()
    whole = {}
    for r in wide:
        whole.setdefault((r.channel, r.window_bin), []).append((r.message_length, r.g))
    assert sum(map(len, whole.values())) == 680
    for pairs in whole.values():
        assert [g for _, g in pairs] == greedy([n for n, _ in pairs], 50)


def test_block_tables_agree_with_packing():
    draw = random.Random(3)
    for limit in (0, 7, 40):
        lengths = np.array([draw.choice([0, 1, 5, 9, 60]) for _ in range(30)])
        sums, steps = windows._block_table(lengths, limit)
        for entry in range(limit + 2):
            starts, left = windows.group_starts(lengths, entry, limit)
            assert (min(left, limit + 1), len(starts)) == (sums[entry], steps[entry])


def test_documents_join_in_time_order_and_count_named_users(chat):
    rows = chat([(2, 1.0, "a", None, "second"), (1, 1.0, "a", "u", "first"), (3, 0.5, "a", "v", "zero @x")])
    packed = windows.pack_messages(windows.with_time_bin(prepare.clean_messages(prepare.prepare_chat(rows)), "5s"), "message_length", "g")
    doc = windows.documents(packed, "g").first()
    assert doc.message_clean == "zero <mention> first second" and doc.count_messages == 2 and doc.message_length == 18


def test_long_windows_keep_whole_windows(chat):
    rows = chat([(1, 0.0, "a", "u", "x" * 6), (2, 1.0, "a", "u", "y" * 4), (3, 6.0, "a", "u", "z" * 9)])
    kept = windows.long_windows(prepare.clean_messages(prepare.prepare_chat(rows)), 10, "5s")
    assert sorted(r.msg_id for r in kept.collect()) == [1, 2]
    assert windows.window_texts(kept).first().text == "x" * 6 + "\n" + "y" * 4 + "\n\n"


def test_rank_next_and_median_match_plain_python(spark):
    draw = random.Random(5)
    rows = [(i, "hot" if draw.random() < 0.7 else draw.choice("ab"), draw.randrange(50), draw.choice([0.5, 1.5, draw.random()])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id bigint, k string, o int, v double").repartition(7)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    ranks = {r.id: r.r for r in with_rank(frame, ["o", "id"], "r").collect()}
    assert ranks == {r[0]: i for i, r in enumerate(order)}
    following, seen = {}, {}
    for r in reversed(order):
        following[r[0]] = seen.get(r[1])
        seen[r[1]] = r[3]
    assert {r.id: r.n for r in with_next(frame, ["k"], ["o", "id"], "v", "n").collect()} == following
    import statistics

    medians = {r.k: r.v_median for r in exact_medians(frame, ["k"], ["v", "o"]).collect()}
    for key, found in medians.items():
        assert found == pytest.approx(statistics.median(r[3] for r in rows if r[1] == key))
    assert sorted(r.id for r in smallest(frame, ["o", "id"], 9).collect()) == sorted(r[0] for r in order[:9])


def test_sampling_does_not_depend_on_partitions(spark):
    one = spark.range(1_000).withColumnRenamed("id", "msg_id").repartition(1)
    many = one.repartition(8)
    picks = [sorted(r.msg_id for r in sampling.sample_exact(f, 50, seed=4).collect()) for f in (one, many)]
    assert picks[0] == picks[1] and len(picks[0]) == 50
    with pytest.raises(ValueError):
        sampling.sample_exact(one, 1_001)
    split = [sorted((r.msg_id, r.split) for r in sampling.train_test_split(f).collect()) for f in (one, many)]
    assert split[0] == split[1] and sum(s == "test" for _, s in split[0]) == 100
    assert [r.msg_id for r in sampling.shuffled(one).collect()] == [r.msg_id for r in sampling.shuffled(many).collect()]
