import json
import random

import pytest
from pyspark.sql import functions as F

from chatloom.plans import jobs
from chatloom.sources import readers, writers


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    return tmp_path_factory.mktemp("jobs")


@pytest.fixture(scope="module")
def prepared(spark, workspace):
    draw = random.Random(9)
    phrases = ["le chat dort bien", "oui merci beaucoup", "quelle question", "table ronde pour la soirée", "lul lul lul",
               "non jamais de la vie", "bonjour tout le monde", "encore une pause"]
    folder = workspace / "csv"
    folder.mkdir()
    for channel in ("alpha", "beta"):
        lines = []
        for i in range(400):
            at = f"2021-11-04 {19 + i // 110}:{(i // 2) % 60:02d}:{i % 60:02d}"
            message = draw.choice(phrases) + draw.choice(["", " ?", " !", " @bob"])
            lines.append(f'"{at}";"{channel}";"u{i % 9}";"#{channel}";"{message}"')
        (folder / f"{channel}.csv").write_text("\n".join(lines) + "\n")
    (folder / "gamma.csv").write_text('"never";"gamma";"u";"#gamma";"broken"\n"2021-11-04 19:00:00";"gamma";"u";"#gamma";"fine"\n')
    out = str(workspace / "prepared")
    jobs.data(spark, str(folder), ["alpha", "beta", "gamma", "missing"], out)
    return out


def test_csv_dialect(spark, tmp_path):
    rows = [
        '"2021-03-12 10:00:00";"a";"u";"#a";"say ""hi""; ok"',
        '"2021-03-12 10:00:01";"a";"";"#a";"ends with \\"',
        '"2021-03-12 10:00:02.250";"a";"u";"#a";"in \\x side"',
        '"bad date";"a";"u";"#a";"dropped"',
    ]
    (tmp_path / "a.csv.1").write_text("\n".join(rows) + "\n")
    kept = readers.read_chat_csv(spark, str(tmp_path), ["a"], "drop_rows")
    found = readers.with_message_ids(kept).orderBy("msg_id").collect()
    assert [r.message for r in found] == ['say "hi"; ok', "ends with \\", "in \\x side"]
    assert [r.msg_id for r in found] == [0, 1, 2] and found[2].published_datetime.microsecond == 250_000
    assert readers.read_chat_csv(spark, str(tmp_path), ["a"]).count() == 0
    with pytest.raises(ValueError):
        readers.read_chat_csv(spark, str(tmp_path), on_bad_file="ignore")


def test_emote_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"data": [{"name": "Kappa", "id": 1}, {"name": "LUL", "id": 2}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"name": "LUL"}]))
    found = readers.special_tokens(spark, str(tmp_path / "g.json"), [str(tmp_path / "c.json")])
    assert found[:3] == ["Kappa", "LUL", "LUL"] and found[-1] == "<url>" and len(found) == 10


def test_decimal_csv_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1.5, 'a "b", c', [1, 2]), (2, -0.25, "d", [])], "i int, d double, s string, a array<int>")
    writers.write_decimal_csv(frame, str(tmp_path / "t"))
    assert writers.decimal_csv(frame).filter("i = '1'").first().d == "1,5"
    back = readers.read_decimal_csv(spark, str(tmp_path / "t"), "a array<int>, d double, s string, i int")
    assert sorted((r.i, r.d, r.s, r.a) for r in back.collect()) == [(1, 1.5, 'a "b", c', [1, 2]), (2, -0.25, "d", [])]


def test_data_job(spark, prepared):
    rows = spark.read.parquet(prepared)
    assert {r.channel: r["count"] for r in rows.groupBy("channel").count().collect()} == {"alpha": 400, "beta": 400}
    assert rows.select("msg_id").distinct().count() == 800
    assert {"published_date", "count_mention", "message_length", "count_url"} <= set(rows.columns)


@pytest.fixture(scope="module")
def vocabulary(spark, workspace, prepared):
    out = str(workspace / "vocabulary")
    jobs.train_tokenizer(spark, prepared, out, vocab_size=80)
    return out


def test_long_window_text_job(spark, workspace, prepared):
    out = str(workspace / "corpus")
    jobs.long_window_text(spark, prepared, out, 20, "60s")
    text = "\n".join(p.read_text() for p in (workspace / "corpus" / "channel=alpha").glob("*.txt"))
    assert text.count("\n\n") > 10 and "@bob" not in text and "<mention>" in text


def test_tokenize_job(spark, vocabulary):
    texts = spark.createDataFrame([(1, "le chat")], "msg_id bigint, message_clean string")
    assert "".join(jobs.tokenize(texts, spark.read.parquet(vocabulary)).first().tokens) == "▁le▁chat"


def test_mlm_and_contrastive_jobs(spark, workspace, prepared, vocabulary):
    out = str(workspace / "mlm")
    jobs.mlm_data(spark, prepared, vocabulary, out, max_length=60)
    train, test = spark.read.parquet(f"{out}/train"), spark.read.parquet(f"{out}/test")
    total = spark.read.parquet(f"{out}/documents").count()
    assert train.count() + test.count() == total and test.count() == -(-total // 10)
    assert train.columns == ["input_ids"] and train.select(F.max(F.size("input_ids"))).first()[0] <= 60
    assert spark.read.parquet(f"{out}/train_masked").count() == train.count()
    jobs.contrastive_data(spark, prepared, str(workspace / "pairs"), 50)
    assert spark.read.parquet(str(workspace / "pairs")).filter("text_a = text_b").count() == 50


def test_topics_and_timeline_jobs(spark, workspace, prepared, vocabulary):
    out = str(workspace / "topics")
    jobs.cluster_topics(spark, prepared, vocabulary, out, ["alpha", "beta"], "2021-11-04", ["lul", ":/"], limit=500,
                        scales=(600,), super_cluster_count=20, epsilon=0.3)
    folder = f"{out}/scale_600"
    labelled = spark.read.parquet(f"{folder}/prepared")
    assert labelled.count() == 500 and labelled.select("labels").distinct().count() > 3
    profile = spark.read.parquet(f"{folder}/profile")
    assert profile.agg(F.sum("count_messages_count")).first()[0] == 500
    report = spark.read.text(f"{folder}/print_clusters")
    assert report.filter(F.col("value").startswith("silouhette moyenne")).count() == profile.filter("labels <> -1").count()
    base = str(workspace / "timeline")
    jobs.topics_over_time(spark, out, vocabulary, base, "2021-11-04 19:00", "2021-11-04 22:00", 600, race=True)
    stats = spark.read.parquet(f"{base}/timeline")
    assert stats.groupBy("start_of_period").count().agg(F.max("count")).first()[0] <= 10
    assert spark.read.parquet(f"{base}/ranks").filter("rank = 1").count() >= stats.select("start_of_period").distinct().count()
    jobs.topics_over_time(spark, out, vocabulary, base, "2021-11-04 19:00", "2021-11-04 22:00", 600, top_n=3)
    assert spark.read.parquet(f"{base}/top_topics").count() <= 3
    sweep = str(workspace / "sweep")
    jobs.layout_parameters(spark, f"{out}/stats", sweep, "alpha", "2021-11-04", limit=40)
    assert spark.read.parquet(sweep).count() == 180 * 40


def test_damaged_files_go_whole_and_are_named(spark, tmp_path):
    import gzip

    line = '"2021-03-12 10:00:{:02d}";"{}";"u";"#c";"{}"\n'
    folder = tmp_path / "csv"
    folder.mkdir()
    whole = gzip.compress("".join(line.format(i % 60, "a", "fine") for i in range(5_000)).encode())
    noise = random.Random(2)
    torn = gzip.compress("".join(line.format(i % 60, "b", noise.random()) for i in range(5_000)).encode())
    (folder / "a.csv.gz").write_bytes(whole + whole)  # two members are one file
    (folder / "b.csv.gz").write_bytes(torn[: len(torn) // 2])
    (folder / "c.csv").write_text('"2021-03-12 10:00:00";"c";"u";"#c";"two\nlines"\n')
    named = jobs.data(spark, str(folder), ["a", "b", "c"], str(tmp_path / "out"), multi_line=True)
    assert [n.rsplit("/", 1)[1] for n in named] == ["b.csv.gz"]
    rows = readers.read_stage(spark, str(tmp_path / "out"))
    assert {r.channel: r["count"] for r in rows.groupBy("channel").count().collect()} == {"a": 10_000, "c": 1}
    assert rows.filter("channel = 'c'").first().message == "two\nlines"
