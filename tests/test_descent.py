import numpy as np
import pytest

from chatloom.operators import descent
from chatloom.operators import neighbors as N
from chatloom.operators import reachability
from chatloom.operators import sampling


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "msg_id bigint, vector array<double>").repartition(4)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_recall_on_clustered_rows(spark, metric):
    draw = np.random.default_rng(1)
    centers = draw.standard_normal((12, 16)) * 3
    points = frame(spark, centers[draw.integers(0, 12, 1_500)] + draw.standard_normal((1_500, 16)))
    found = descent.neighbor_descent(points, 15, metric).cache()
    exact = N.nearest_neighbors(points, 15, metric)
    assert descent.recall(found, exact) >= 0.9
    rows = found.collect()
    assert len(rows) == 1_500 * 15 and all(r.msg_id != r.neighbor for r in rows)
    assert max(r["rank"] for r in rows) == 15
    true = {(r.msg_id, r.neighbor): r.distance for r in exact.collect()}
    assert all(abs(true[k] - r.distance) < 1e-9 for r in rows if (k := (r.msg_id, r.neighbor)) in true)


def test_descent_of_few_or_equal_rows(spark):
    assert descent.neighbor_descent(frame(spark, np.zeros((1, 3)))).count() == 0
    few = descent.neighbor_descent(frame(spark, np.eye(3)), 15).collect()
    assert len(few) == 6
    same = descent.neighbor_descent(frame(spark, np.ones((300, 4))), 5).collect()
    assert len(same) == 1_500 and max(r.distance for r in same) < 1e-12


def labels_by_hand(x, epsilon, min_samples, size):
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(gaps, axis=1)[:, min_samples]
    group = np.arange(len(x))
    for i in range(len(x)):
        for j in range(i):
            if max(gaps[i, j], core[i], core[j]) <= epsilon:
                group[group == group[i]] = group[j]
    out = np.full(len(x), -1)
    sizes = {g: sum((group == g) & (core <= epsilon)) for g in set(group)}
    named = sorted((-n, min(np.flatnonzero((group == g) & (core <= epsilon))), g) for g, n in sizes.items() if n >= size)
    for label, (_, _, g) in enumerate(named):
        out[(group == g) & (core <= epsilon)] = label
    return out.tolist()


def test_core_distances_keep_bridges_out(spark):
    draw = np.random.default_rng(5)
    dense = [draw.standard_normal((60, 2)) * 0.2 + c for c in ((0, 0), (6, 0))]
    bridge = np.column_stack([np.linspace(0.8, 5.2, 12), np.zeros(12)])
    x = np.vstack([*dense, bridge, dense[0][:20]])  # with copies
    points = frame(spark, x)
    plain = {r.msg_id: r.labels for r in N.density_clusters(points, 0.45).collect()}
    assert plain[0] == plain[60]
    for min_samples in (4, 8):
        found = {r.msg_id: r.labels for r in N.density_clusters(points, 0.45, min_samples=min_samples, pivots=4, block_rows=30).collect()}
        assert [found[i] for i in range(len(x))] == labels_by_hand(x, 0.45, min_samples, 5)
        assert found[0] != found[60]
    assert {r.labels for r in N.density_clusters(points, 1e-6, min_samples=30).collect()} == {-1}


def prim(x, min_samples):
    """Sorted link lengths of the spanning tree over different vectors, copies counted in core distances."""
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(gaps, axis=1)[:, min(min_samples, len(x) - 1)]
    first = np.unique(x, axis=0, return_index=True)[1]
    mutual = np.maximum(np.maximum(gaps, core[:, None]), core)[np.ix_(first, first)]
    best, out, inside = mutual[0].copy(), [], np.zeros(len(first), bool)
    inside[0] = True
    while not inside.all():
        nearest = np.where(inside, np.inf, best).argmin()
        out.append(best[nearest])
        inside[nearest] = True
        best = np.minimum(best, mutual[nearest])
    return np.sort(out)


@pytest.mark.parametrize("min_samples", [1, 4])
def test_reachability_tree_equals_prim_and_cuts_like_the_clusters(spark, min_samples):
    draw = np.random.default_rng(8)
    x = np.vstack([draw.standard_normal((60, 2)) * s + c for s, c in ((0.1, (0, 0)), (0.6, (5, 0)), (2.0, (0, 30)))])
    x = np.vstack([x, x[:25], np.repeat(x[70:71], 7, axis=0), np.array([[i, -9.0] for i in range(12)])])  # copies and ties
    points = frame(spark, x)
    nodes, links = reachability.reachability_tree(points, min_samples, pivots=5, block_rows=100)
    found = links.collect()
    want = prim(x, min_samples)
    assert len(found) == len(want) and np.allclose(sorted(r.distance for r in found), want, rtol=1e-12, atol=1e-12)
    assert N.connected_components(links).select("component").distinct().count() == 1
    for epsilon in (0.15, 0.7, 3.0):
        cut = {r.msg_id: r.labels for r in reachability.cut_tree(points, nodes, links, epsilon).collect()}
        assert [cut[i] for i in range(len(x))] == labels_by_hand(x, epsilon, min_samples, 5)


def test_reachability_tree_of_few_rows(spark):
    for x, count in ((np.zeros((0, 3)), 0), (np.ones((4, 3)), 0), (np.eye(3), 2)):
        points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "msg_id bigint, vector array<double>")
        nodes, links = reachability.reachability_tree(points, 5)
        assert links.count() == count and nodes.count() == len(np.unique(x, axis=0))
        assert reachability.cut_tree(points, nodes, links, 2.0, 2).count() == len(x)


def test_samples_and_splits_do_not_move_all_rows(spark):
    rows = spark.range(3_000).withColumnRenamed("id", "msg_id").withColumn("text", sampling.F.lit("x")).repartition(7)
    ranked = sorted((r[0], r[1]) for r in sampling._drawn(rows, ["msg_id"], 21635).select("_draw", "msg_id").collect())
    for n in (0, 1, 777, 3_000):
        assert sorted(r.msg_id for r in sampling.sample_exact(rows, n).collect()) == sorted(i for _, i in ranked[:n])
    with pytest.raises(ValueError):
        sampling.sample_exact(rows, 3_001)
    twice = rows.unionByName(rows)
    assert sampling.sample_exact(twice, 1_001).count() == 1_001
    drawn = sorted((r[0], r[1]) for r in sampling._drawn(rows, ["msg_id"], 9873).select("_draw", "msg_id").collect())
    split = {r.msg_id: r.split for r in sampling.train_test_split(rows).collect()}
    assert {i for i, s in split.items() if s == "test"} == {i for _, i in drawn[:300]} and len(split) == 3_000
    plan = sampling.train_test_split(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan.split("Union")[1].split("+-")[1]
    same = spark.range(50).selectExpr("1 as msg_id", "id as other")
    assert sampling.sample_exact(same, 7).count() == 7
