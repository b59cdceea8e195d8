import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import clusters, neighbors, timeline, vectors
from chatloom.operators.prepare import highlight_labels, keep_labels


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(4, 5)) * 4
    rows = np.concatenate([c + draw.normal(size=(60, 5)) * s for c, s in zip(centers, (0.2, 0.4, 0.6, 1.5))])
    rows[:20] = rows[0]  # a group of copies
    labels = [int(i // 60) - 1 for i in range(len(rows))]
    data = [(i, labels[i], [float(x) for x in row]) for i, row in enumerate(rows)]
    return rows, np.asarray(labels), spark.createDataFrame(data, "msg_id bigint, labels int, vector array<double>").repartition(5)


def pairwise(rows):
    return np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbors_match_brute_force(points, metric):
    rows, _, frame = points
    found = neighbors.nearest_neighbors(frame, 4, metric, pivots=6, block_rows=25).collect()
    if metric == "cosine":
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        gaps = 1 - unit @ unit.T
    else:
        gaps = pairwise(rows)
    np.fill_diagonal(gaps, np.inf)
    assert len(found) == len(rows) * 4
    best = np.sort(gaps, axis=1)[:, :4]
    for r in found:
        assert r.distance == pytest.approx(best[r.msg_id, r["rank"] - 1], abs=1e-9)
        assert gaps[r.msg_id, r.neighbor] == pytest.approx(r.distance, abs=1e-9)


def components(gaps, epsilon):
    parent = list(range(len(gaps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(gaps <= epsilon)):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(gaps))]


@pytest.mark.parametrize("epsilon", [0.5, 1.0])
def test_density_clusters_match_brute_force(points, epsilon):
    rows, _, frame = points
    parts = components(pairwise(rows), epsilon)
    sizes = sorted({(-parts.count(p), p) for p in parts if parts.count(p) >= 5})
    expected = [{p: i for i, (_, p) in enumerate(sizes)}.get(p, -1) for p in parts]
    found = {r.msg_id: r.labels for r in neighbors.density_clusters(frame, epsilon, 5, pivots=6, block_rows=25).collect()}
    assert [found[i] for i in range(len(rows))] == expected
    assert -1 in expected and max(expected) >= 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in neighbors.connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def silhouette(gaps, labels):
    out = []
    for i, own in enumerate(labels):
        means = {k: gaps[i, labels == k].sum() / max((labels == k).sum() - (k == own), 1) for k in set(labels)}
        a = means.pop(own)
        b = min(means.values())
        out.append(0.0 if (labels == own).sum() == 1 else (b - a) / max(a, b))
    return np.asarray(out)


def test_silhouettes_match_brute_force(points, monkeypatch):
    rows, labels, frame = points
    expected = silhouette(pairwise(rows), labels)
    found = {r.msg_id: r.silhouette for r in clusters.silhouette_exact(frame, block_rows=25).collect()}
    assert [found[i] for i in range(len(rows))] == pytest.approx(list(expected), abs=1e-9)
    centers = {k: rows[labels == k].mean(0) for k in set(labels)}
    near = []
    for row, own in zip(rows, labels):
        gaps = {k: np.linalg.norm(row - c) for k, c in centers.items()}
        a = gaps.pop(own)
        b = min(gaps.values())
        near.append((b - a) / max(a, b))
    for limit in (4_000_000, 6):  # the second cuts the centroids into chunks
        monkeypatch.setattr(clusters, "CENTROID_LIMIT", limit)
        found = {r.msg_id: r.silhouette for r in clusters.silhouette_simplified(frame).collect()}
        assert [found[i] for i in range(len(rows))] == pytest.approx(near, abs=1e-9)
        shares = clusters.soft_membership(frame).groupBy("msg_id").agg(F.sum("probability").alias("p"), F.count("*").alias("n"))
        assert all(r.p == pytest.approx(1.0) and r.n == 3 for r in shares.collect())


def test_single_member_label_scores_zero(spark):
    frame = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [5.0])], "msg_id bigint, labels int, vector array<double>")
    for score in (clusters.silhouette_exact, clusters.silhouette_simplified):
        assert {r.msg_id: r.silhouette for r in score(frame).collect()}[2] == 0.0


def test_layout_keeps_time_apart(points):
    rows, _, frame = points
    timed = frame.withColumn("published_datetime", F.timestamp_micros(F.col("msg_id") * 1_000_000))
    timed = vectors.add_time_feature(vectors.add_time_feature(timed, 7, 5), 20, 5)
    assert {r.s for r in timed.select(F.size("vector").alias("s")).distinct().collect()} == {6}
    placed = vectors.layout(timed, 5, 3)
    row = placed.filter("msg_id = 40").first()
    assert len(row.reduced) == 4 and row.reduced[3] == 2.0 and row.x is not None
    assert vectors.layout(frame, 5, 3, only_first=True).columns == ["msg_id", "labels", "vector", "x", "y"]
    sweep = vectors.layout_sweep(timed, 5, [0, 300], [5, 50, 50], [0.1, 0.2], "c", "2021-11-04", 3)
    assert sweep.count() == len(rows) * 2 * 6 and sweep.distinct().count() == len(rows) * 2 * 4


def test_sweep_reduces_the_embedding_once(points, monkeypatch):
    """the scales share one reduction of the messages and give what each scale's own layout gives."""
    _, _, frame = points
    timed = frame.withColumn("published_datetime", F.timestamp_micros(F.col("msg_id") * 1_000_000))
    plain = {}
    for scale in (0, 20, 300):
        own = vectors.layout(timed, 5, only_first=True) if scale == 0 else vectors.layout(vectors.add_time_feature(timed, scale, 5), 5, 3)
        plain |= {(scale, r.msg_id): (r.x, r.y) for r in own.collect()}
    reduced, reduce_vectors = [], vectors.reduce_vectors
    monkeypatch.setattr(vectors, "reduce_vectors", lambda df, k, column, *a: reduced.append(column) or reduce_vectors(df, k, column, *a))
    sweep = vectors.layout_sweep(timed, 5, [0, 20, 300], [5], [0.1], "c", "2021-11-04", 3).collect()
    assert reduced.count("_embedding") == 1 and len(sweep) == len(plain)
    assert all(np.allclose((r.x, r.y), plain[r.scale_time, r["index"]], rtol=1e-9, atol=1e-9) for r in sweep)


def test_mean_pool_handles_masks(spark):
    frame = spark.createDataFrame(
        [(1, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 0, [9.0, 9.0]), (2, 0, [5.0, 5.0])], "msg_id bigint, mask int, vector array<double>"
    )
    assert {r.msg_id: r.vector for r in vectors.mean_pool(frame).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_model_vectors_and_word2vec(spark):
    texts = spark.createDataFrame([(i, f"mot{i % 3} chat") for i in range(30)], "msg_id bigint, message_clean string")

    def load():
        return lambda batch: np.asarray([[len(t), 1.0] for t in batch])

    assert {r.msg_id: r.vector for r in vectors.model_vectors(texts, load, 4).collect()}[4] == [9.0, 1.0]
    assert vectors.word2vec_vectors(texts, 4).count() == 30
    unit = vectors.hashed_vectors(texts, 64).first().vector
    assert len(unit) == 64 and np.linalg.norm(unit) == pytest.approx(1.0)


def test_label_order_words_and_display(chat):
    rows = chat([(1, 5.0, "a", "u", "Oui toi"), (2, 1.0, "a", "u", "non"), (3, 2.0, "a", "u", "oui"), (4, 2.0, "a", "u", "bof")])
    rows = rows.withColumn("labels", F.expr("case msg_id when 1 then 3 when 2 then -1 else 3 end"))
    assert {r.labels: r.order for r in clusters.label_order(rows).collect()} == {-1: 0, 3: 1}
    assert {r.labels: (r.first_word, r.first_word_count) for r in clusters.modal_first_word(rows).collect()} == {-1: ("non", 1), 3: ("oui", 2)}
    assert {r.msg_id: r.elapsed_time_label for r in clusters.elapsed_in_label(rows).collect()} == {1: 3.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.msg_id: r.labels_x for r in highlight_labels(rows, [3], 0).collect()} == {1: 3, 2: 0, 3: 3, 4: 3}
    listed = rows.select("labels").filter("labels = 3")
    assert keep_labels(rows, listed).count() == 3


def test_hopping_windows(chat, spark):
    rows = chat([(i, s, "a", "u", f"m{i}") for i, s in enumerate([0, 299, 300, 599, 600, 899, 1199, 1200, -1])])
    rows = rows.withColumn("labels", F.lit(1)).withColumn("km_labels", F.lit(5))
    rows = timeline.regroup(rows, timeline.regroup_lookup(spark, 600))
    names = spark.createDataFrame([(1, "one")], "labels int, best_textual_description string")
    start, end = "1970-01-01 00:00:00", "1970-01-01 00:10:00"
    found = timeline.hopping_stats(rows, names, start, end, 600, 300, 10).collect()
    assert {r.start_of_period.minute: r.message_count for r in found} == {0: 4, 5: 4, 10: 3}
    assert timeline.hopping_stats(rows, names, start, end, 600, 300, 10, ["LUL"]).count() == 0
    assert timeline.top_range(timeline.range_stats(rows, names, start, end), 5).first().message_count == 4
    wide = timeline.timeline_wide(timeline.hopping_stats(rows, names, start, end))
    assert wide.columns == ["start_of_period", "one"]
    with pytest.raises(ValueError):
        timeline.regroup_lookup(spark, 900)
    other = rows.drop("regroupement_id", "definition", "color").withColumn("km_labels", F.lit(3))
    assert timeline.regroup(other, timeline.regroup_lookup(spark, 600)).count() == 0


@pytest.mark.parametrize("width, step", [(700, 300), (200, 300)])
def test_hopping_windows_of_any_width(chat, spark, width, step):
    seconds = list(range(0, 2_000, 37))
    rows = chat([(i, float(s), "a", "u", f"m{i}") for i, s in enumerate(seconds)])
    rows = timeline.regroup(rows.withColumn("labels", F.lit(1)).withColumn("km_labels", F.lit(2)), timeline.regroup_lookup(spark, 600))
    names = spark.createDataFrame([(1, "one")], "labels int, best_textual_description string")
    found = timeline.hopping_stats(rows, names, "1970-01-01 00:00:00", "1970-01-01 00:16:00", width, step)
    counts = {int(r.start_of_period.minute * 60 + r.start_of_period.second): r.message_count for r in found.collect()}
    expected = {s: sum(s <= x < s + width for x in seconds) for s in range(0, 961, step)}
    assert counts == {s: n for s, n in expected.items() if n}
