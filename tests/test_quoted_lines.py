import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.sources import quoted_lines, readers

FIELD = st.text(alphabet='ab";\n \\', max_size=8)


def one_by_one(line, inside, sep=";", quote='"'):
    """State behind a line, character by character."""
    state, at = "quoted" if inside else "start", 0
    while at < len(line):
        c = line[at]
        if state == "start":
            state = "quoted" if c == quote else "start" if c == sep else "plain"
        elif state == "plain":
            state = "start" if c == sep else "plain"
        elif c == quote:
            if line[at + 1 : at + 2] == quote:
                at += 1
            else:
                state = "plain"
        at += 1
    return state == "quoted"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a";', max_size=14))
def test_ends_of_a_line(line):
    assert quoted_lines.line_ends(line) == (one_by_one(line, False), one_by_one(line, True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a";', max_size=6), max_size=12))
def test_states_of_a_batch(lines):
    import pyarrow as pa

    for start, got in zip((False, True), quoted_lines.states_before(pa.array(lines, pa.string()), ";", '"')):
        want = [start]
        for line in lines:
            want.append(one_by_one(line, want[-1]))
        assert got.tolist() == want


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def chat_file(path, n=400, seed=3, end="\n"):
    draw, rows = random.Random(seed), []
    parts = ["hello", "a;b", 'say "hi"', "one\ntwo", '"\n"', ";\n;", "", " x ", 'q"uote', "\n\n", "tail\\", "é漢"]
    with open(path, "w", encoding="utf-8", newline="") as out:
        for i in range(n):
            message = " ".join(draw.choice(parts) for _ in range(draw.randint(1, 5))) if i != n // 2 else 'long\n"x" ' * 300
            rows.append((f"2021-05-01 10:{i // 60 % 60:02d}:{i % 60:02d}", "c", f"u{i}", "#c", message))
            plain = not any(c in message for c in '";\n') and message.strip() == message and message
            out.write(";".join([*rows[-1][:4], message if plain else quoted(message)]) + end)
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_read_what_one_reads(spark, small_splits, tmp_path, end):
    rows = chat_file(tmp_path / "c.csv", end=end)
    records = quoted_lines.read_records(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert records.count() == len(rows)
    read = readers.read_chat_csv(spark, str(tmp_path), multi_line=True)
    got = {r.username: r.message for r in read.collect()}
    whole = spark.read.options(sep=";", quote='"', escape='"', multiLine=True).csv(str(tmp_path)).collect()
    # Spark's own reader of whole files leaves the carriage return of a line end in an unquoted last field
    assert got == {r._c2: r._c4 and r._c4.removesuffix("\r") for r in whole} and len(whole) == len(rows)
    assert {u: m or "" for u, m in got.items()} == {u: m for _, _, u, _, m in rows}
    ordered = read.orderBy("file", "_block", "_row").select("username").collect()
    assert [r.username for r in ordered] == [r[2] for r in rows]


def test_files_stay_apart_and_odd_files_are_read(spark, small_splits, tmp_path):
    rows = {name: chat_file(tmp_path / f"{name}.csv", 60, seed) for seed, name in enumerate(("a", "b"))}
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "open.csv").write_text('2021-05-01 10:00:00;c;last;#c;"never closed\n' + "line\n" * 200)
    (tmp_path / "stray.csv").write_text('2021-05-01 10:00:00;c;s1;#c;a "quoted" word\n\n2021-05-01 10:00:00;c;s2;#c;"x"y\n2021-05-01 10:00:00;c;s3;#c;"one ""two"" three"')
    got = [(r.file.rsplit("/", 1)[1], r.username, r.message) for r in readers.read_chat_csv(spark, str(tmp_path), multi_line=True).collect()]
    for name, want in rows.items():
        assert sorted((u, m or "") for f, u, m in got if f == f"{name}.csv") == sorted((r[2], r[4]) for r in want)
    assert [m.count("line") for f, u, m in got if u == "last"] == [200]
    assert {u: m for f, u, m in got if f == "stray.csv"} == {"s1": 'a "quoted" word', "s2": '"x"y', "s3": 'one "two" three'}
    assert readers.read_chat_csv(spark, str(tmp_path), ["b"], multi_line=True).count() == 60
