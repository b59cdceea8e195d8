"""Exact neighbour search and distance sums over blocks of rows.

Rows are put into cells around pivot rows; a row visits another cell only if the triangle inequality
allows a hit there. Cells are cut into blocks of at most ``BLOCK_ROWS`` rows on average and so are
the visitors of a block, so neither a dense cell nor a popular one ends up in a single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import vectors as V
from chatloom.functions.text import seeded_hash
from chatloom.functions.times import int_div
from chatloom.operators.ordering import with_rank
from chatloom.session import cut_lineage, stored

BLOCK_ROWS = 8_192
SUM_ROWS = 16_384
PIVOT_ROWS = 8_192
MAX_PIVOTS = 1_024
SLICE_NUMBERS = 2_000_000  # distances a task holds at a time
VISIT_ROWS = 20_000  # visits a task makes at a time
AXIS_ROWS = 128  # rows of a block that look for links together
_SLACK = 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.asarray(vectors.tolist(), dtype=np.float64)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of ``left`` against rows of ``right``.

    Differences are taken in slices of the left side, which keeps equal rows at exactly 0.
    """
    out = np.empty((len(left), len(right)))
    step = max(1, 4_000_000 // max(1, right.size))
    for start in range(0, len(left), step):
        gap = left[start : start + step, None, :] - right[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _pair_distances(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As :func:`_distances`, for the pairs of rows ``i`` and ``j`` alone."""
    out = np.empty(len(i))
    for start in range(0, len(i), 65_536):
        gap = left[i[start : start + 65_536]] - right[j[start : start + 65_536]]
        out[start : start + 65_536] = np.sqrt(np.einsum("ik,ik->i", gap, gap))
    return out


def _rough_squares(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray, float]]:
    """Squared distances by a matrix product, in slices of the left side, with the most they may be off.

    Whoever decides by them looks at pairs within that error again by their differences.
    """
    own, other = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    step = max(1, SLICE_NUMBERS // max(1, len(right)))
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        error = 8 * np.finfo(np.float64).eps * (left.shape[1] + 8) * (own[part].max() + other.max(initial=0.0))
        if np.isfinite(error):
            squares = left[part] @ right.T
            squares *= -2
            squares += own[part, None]
            squares += other
        else:  # numbers too large to be squared, or none
            squares, error = np.square(_distances(left[part], right)), 0.0
        yield part, squares, float(error)


def _distance_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of the distances of each left row to all right rows; short ones are taken from differences."""
    out = np.empty(len(left))
    for part, squares, error in _rough_squares(left, right):
        i, j = np.nonzero(squares <= 1e9 * error)
        gaps = np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
        gaps[i, j] = _pair_distances(left[part], right, i, j)
        out[part] = gaps.sum(axis=1)
    return out


def _nearest(left: np.ndarray, right: np.ndarray, ids: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left row, right row and exact distance of the ``k`` nearest, ties by ``ids``, in this order; ``without`` are left ids to skip."""
    found = []
    for part, squares, error in _rough_squares(left, right):
        if without is not None:
            squares[without[part, None] == ids] = np.inf
        at = min(k, squares.shape[1]) - 1
        farthest = np.partition(squares, at, axis=1)[:, at] + 2 * error
        i, j = np.nonzero((squares <= farthest[:, None]) & np.isfinite(squares))
        gaps = _pair_distances(left[part], right, i, j)
        order = np.lexsort((ids[j], gaps, i))
        i, j, gaps = i[order], j[order], gaps[order]
        first = np.searchsorted(i, i, side="left")
        kept = np.arange(len(i)) - first < k
        found.append((i[kept] + part.start, j[kept], gaps[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


@dataclass(frozen=True)
class Cells:
    """Rows with their cell and block, and the (small, bounded) cell table on the driver."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    pieces: np.ndarray


def _unit(vector):
    length = V.norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def build_cells(points: DataFrame, pivots: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7) -> Cells:
    """``points`` holds ``msg_id, vector``. The number of pivots bounds all that reaches the driver.

    Unless given, there is one pivot per ``PIVOT_ROWS`` rows, at most ``MAX_PIVOTS``: where nothing can be pruned,
    each row travels once per cell.
    """
    if pivots is None:
        pivots = max(1, min(MAX_PIVOTS, points.count() // PIVOT_ROWS))
    drawn = points.withColumn("_draw", seeded_hash(seed, F.col("msg_id")))
    chosen = [row["vector"] for row in drawn.orderBy("_draw", "msg_id").limit(pivots).select("vector").collect()]
    centers = np.unique(np.asarray(chosen, dtype=np.float64), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, gap = np.zeros(len(pdf), np.int32), np.full(len(pdf), np.inf)
                i, j, near = _nearest(_matrix(pdf["vector"]), centers, np.arange(len(centers)), 1)
                cell[i], gap[i] = j, near
                yield pdf.assign(cell=cell, gap=gap)

    placed = points.select("msg_id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(
        assign, "msg_id bigint, vector array<double>, cell int, gap double"
    )
    placed = stored(placed, "cells")
    radius, pieces = np.full(len(centers), -1.0), np.zeros(len(centers), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("gap").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[row["cell"]] = row["r"]
        pieces[row["cell"]] = -(-row["n"] // block_rows)
    table = F.array(*[F.lit(int(max(p, 1))) for p in pieces])
    rows = placed.withColumn("piece", (seeded_hash(seed, F.col("msg_id")) % F.get(table, F.col("cell"))).cast("int"))
    return Cells(rows, centers, radius, pieces)


def _visits(cells: Cells, reach: DataFrame, upward: bool = False) -> DataFrame:
    """A row (``msg_id, vector, reach``) for each cell that may hold a point within ``reach``.

    With ``upward`` rows bring their ``cell`` and visit only it and later ones: of two cells, rows of the first one
    meet those of the second, which is enough where all have one reach and a pair counts in either direction.
    """
    centers, radius, pieces = cells.pivots, cells.radius, cells.pieces

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            step = max(1, VISIT_ROWS // max(1, len(centers)))  # a row may visit every cell
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                limit = part["reach"].to_numpy()[:, None] * (1 + _SLACK) + _SLACK
                wanted = np.empty((len(part), len(centers)), bool)
                for some, squares, error in _rough_squares(_matrix(part["vector"]), centers):
                    # distances are taken for as short as they may be
                    gaps = np.sqrt(np.maximum(squares - error, 0.0))
                    wanted[some] = (gaps - radius[None, :] <= limit[some]) & (pieces[None, :] > 0)
                if upward:
                    wanted &= np.arange(len(centers)) >= part["cell"].to_numpy()[:, None]
                who, cell = np.nonzero(wanted)
                yield part.iloc[who].assign(cell=cell.astype(np.int32))

    return reach.mapInPandas(go, "msg_id bigint, vector array<double>, reach double, cell int")


def _meet(cells: Cells, visits: DataFrame, kernel, schema: str, block_rows: int, of_row: DataFrame | None = None) -> DataFrame:
    """Runs ``kernel(visitors, residents)`` for each (cell, piece, visitor share).

    Columns of ``of_row`` (``msg_id, ...``) join both sides; residents have them as ``its_...``.
    """
    visits = stored(visits, "visits")
    shares = {
        row["cell"]: -(-row["n"] // block_rows)
        for row in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    count = len(cells.pivots)
    share_table = F.array(*[F.lit(int(shares.get(c, 1))) for c in range(count)])
    piece_table = F.array(*[F.lit(int(max(p, 1))) for p in cells.pieces])
    guests = visits.withColumn(
        "share", (seeded_hash(11, F.col("msg_id")) % F.get(share_table, F.col("cell"))).cast("int")
    ).withColumn("piece", F.explode(F.sequence(F.lit(0), F.get(piece_table, F.col("cell")) - 1)))
    residents = cells.rows.select(
        F.col("msg_id").alias("id"), F.col("vector").alias("point"), F.col("cell").alias("cell"), F.col("piece").alias("piece")
    ).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.get(share_table, F.col("cell")) - 1))
    )
    if of_row is not None:
        guests = guests.join(of_row, "msg_id")
        theirs = [F.col(c).alias("id" if c == "msg_id" else f"its_{c}") for c in of_row.columns]
        residents = residents.join(of_row.select(*theirs), "id")
    place = ["cell", "piece", "share"]
    return guests.groupBy(*place).cogroup(residents.groupBy(*place)).applyInPandas(kernel, schema)


def nearest_neighbors(
    points: DataFrame,
    k: int = 15,
    metric: str = "cosine",
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest other rows of each row: ``msg_id, neighbor, distance, rank`` (exact).

    Unit vectors are searched by Euclidean distance, which orders them as the cosine distance does.
    A first pass inside the row's own block bounds the search radius of the second.
    """
    if metric == "cosine":
        points = points.withColumn("vector", _unit(F.col("vector")))
    cells = build_cells(points.select("msg_id", "vector"), pivots, block_rows)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _matrix(pdf["vector"])
        reach = np.full(len(rows), np.inf)
        if len(rows) > k:
            # the row itself is among the k + 1 smallest
            for part, squares, error in _rough_squares(rows, rows):
                reach[part] = np.sqrt(np.maximum(np.partition(squares, k, axis=1)[:, k], 0.0) + error)
        return pdf[["msg_id", "vector"]].assign(reach=reach)

    reach = cells.rows.groupBy("cell", "piece").applyInPandas(own, "msg_id bigint, vector array<double>, reach double")

    def search(guests: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"msg_id": [], "near": []})
        if len(guests) and len(residents):
            ids, mine = residents["id"].to_numpy(), guests["msg_id"].to_numpy()
            i, j, gaps = _nearest(_matrix(guests["vector"]), _matrix(residents["point"]), ids, k, mine)
            near: list[list[tuple[float, int]]] = [[] for _ in range(len(mine))]
            for row, gap, other in zip(i.tolist(), gaps.tolist(), ids[j].tolist()):
                near[row].append((gap, other))
            found = pd.DataFrame({"msg_id": mine, "near": near})
        return found

    near = _meet(
        cells, _visits(cells, reach), search, "msg_id bigint, near array<struct<distance:double,neighbor:bigint>>", block_rows
    )
    merged = near.groupBy("msg_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    long = merged.select("msg_id", F.posexplode("near").alias("rank", "n"))
    distance = F.col("n.distance")
    if metric == "cosine":
        distance = distance * distance / 2
    return long.select("msg_id", F.col("n.neighbor").alias("neighbor"), distance.alias("distance"), (F.col("rank") + 1).alias("rank"))


def _spanning(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, epsilon: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within ``epsilon``; pairs are looked at by slices, never all held.

    Both sides are put in order of the component that spreads most: a slice meets the rows within ``epsilon`` of it there.
    """
    names, place = np.unique(np.concatenate([left_ids, right_ids]), return_inverse=True)
    mine, theirs = place[: len(left)], place[len(left) :]
    axis = int(np.argmax(right.max(axis=0) - right.min(axis=0)))
    order, at = np.argsort(left[:, axis]), np.argsort(right[:, axis])
    left, mine, right, theirs = left[order], mine[order], right[at], theirs[at]
    reach = epsilon * (1 + _SLACK) + _SLACK
    first, last = (np.searchsorted(right[:, axis], left[:, axis] + r, side=s) for r, s in ((-reach, "left"), (reach, "right")))
    group, kept = np.arange(len(names)), []
    for start in range(0, len(left), AXIS_ROWS):
        some = slice(start, start + AXIS_ROWS)
        near = slice(int(first[some][0]), int(last[some][-1]))
        for part, squares, error in _rough_squares(left[some], right[near]):
            within = squares <= epsilon * epsilon
            i, j = np.nonzero(np.abs(squares - epsilon * epsilon) <= error + 1e-12 * epsilon * epsilon)
            within[i, j] = _pair_distances(left[some][part], right[near], i, j) <= epsilon
            for row, hits in zip(mine[some][part].tolist(), within):
                hits = np.flatnonzero(hits)
                found = group[theirs[near][hits]]
                new = found != group[row]
                if new.any():
                    merged, one = np.unique(found[new], return_index=True)
                    kept += [(int(names[row]), int(names[c])) for c in theirs[near][hits[new][one]]]
                    gone = np.zeros(len(names), bool)
                    gone[merged] = True
                    group[gone[group]] = group[row]
    return kept


def close_links(
    points: DataFrame, epsilon: float, pivots: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Links ``a, b`` that join the same rows as all pairs within ``epsilon`` do.

    Each task reduces its pairs to a spanning forest first, so a dense region yields one link per
    row and block instead of all its pairs.
    """
    cells = build_cells(points.select("msg_id", "vector"), pivots, block_rows)
    reach = cells.rows.select("msg_id", "vector", F.lit(float(epsilon)).alias("reach"), "cell")

    def link(guests: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        if len(guests) and len(residents):
            kept = _spanning(_matrix(guests["vector"]), _matrix(residents["point"]), guests["msg_id"].to_numpy(), residents["id"].to_numpy(), epsilon)
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return _meet(cells, _visits(cells, reach, upward=True), link, "a bigint, b bigint", block_rows)


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable id per node: ``node, component``, for nodes that have a link.

    Large-star and small-star steps (Kiveris et al. 2014): links are pointed at ever smaller ids
    until only stars are left. Each step is a partial minimum and a join on the node.
    """
    pairs = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    pairs = cut_lineage(pairs)
    state = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))
        )
        pairs = cut_lineage(small.filter(F.col("a") != F.col("b")).distinct())
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError("links did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def core_distances(
    points: DataFrame, copies: DataFrame, min_samples: int, reach: float, pivots: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``msg_id, core``: distance to the ``min_samples``-th other row, where it is at most ``reach``.

    ``points`` are different vectors and ``copies`` (``msg_id, n``) tells how many rows each stands for. Each block
    sends a row's distances to its nearest ``min_samples`` residents and their copies.
    """
    cells = build_cells(points.select("msg_id", "vector"), pivots, block_rows)
    visits = _visits(cells, cells.rows.select("msg_id", "vector", F.lit(float(reach)).alias("reach")))

    def near(guests: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(residents):
            return pd.DataFrame({"msg_id": [], "other": [], "distance": []})
        ids = residents["id"].to_numpy()
        rows, columns, gaps = _nearest(_matrix(guests["vector"]), _matrix(residents["point"]), ids, min_samples + 1)
        kept = gaps <= reach
        return pd.DataFrame({"msg_id": guests["msg_id"].to_numpy()[rows[kept]], "other": ids[columns[kept]], "distance": gaps[kept]})

    met = _meet(cells, visits, near, "msg_id bigint, other bigint, distance double", block_rows)
    counted = met.join(copies.select(F.col("msg_id").alias("other"), "n"), "other")
    # a row does not count itself, its copies do
    counted = counted.withColumn("n", F.when(F.col("msg_id") == F.col("other"), F.col("n") - 1).otherwise(F.col("n")))
    upto = F.sum("n").over(Window.partitionBy("msg_id").orderBy("distance", "other"))
    return counted.withColumn("upto", upto).filter(F.col("upto") >= min_samples).groupBy("msg_id").agg(F.min("distance").alias("core"))


def named_groups(rows: DataFrame, placed: DataFrame, min_cluster_size: int) -> DataFrame:
    """``msg_id, labels``: groups of ``placed`` (``vector, _copies, component``) by size, largest first; small ones are -1."""
    sizes = placed.groupBy("component").agg(F.sum("_copies").alias("_size"))
    large = sizes.filter(F.col("_size") >= min_cluster_size).withColumn("_order", -F.col("_size"))
    named = with_rank(large, ["_order", "component"], "labels").select("component", F.col("labels").cast("int").alias("labels"))
    labelled = placed.join(named, "component").select("vector", "labels")
    return rows.join(labelled, "vector", "left").select("msg_id", F.coalesce("labels", F.lit(-1)).alias("labels"))


def density_clusters(
    points: DataFrame,
    epsilon: float = 0.5,
    min_cluster_size: int = 5,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    min_samples: int | None = None,
) -> DataFrame:
    """``msg_id, labels``: rows linked through gaps of at most ``epsilon``; small groups are -1.

    With ``min_samples`` gaps are mutual reachability distances, the largest of the distance and both core distances
    (to the ``min_samples``-th other row): rows in thinner places than ``epsilon`` are noise and link nothing, so
    chains of single rows do not join dense groups. Labels are numbered by size, largest first. Equal vectors are
    collapsed to one row beforehand.
    """
    rows = points.select("msg_id", F.col("vector").cast("array<double>").alias("vector"))
    unique = rows.groupBy("vector").agg(F.min("msg_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    unique = stored(unique, "different")
    singles = unique.select(F.col("_first").alias("msg_id"), "vector")
    if min_samples:
        copies = unique.select(F.col("_first").alias("msg_id"), F.col("_copies").alias("n"))
        cores = cut_lineage(core_distances(singles, copies, min_samples, epsilon, pivots, block_rows))
        singles = cut_lineage(singles.join(cores.select("msg_id"), "msg_id"))
        dense = singles.select(F.col("msg_id").alias("_core"))
    if min_samples and singles.isEmpty():
        return rows.select("msg_id", F.lit(-1).alias("labels"))
    parts = connected_components(close_links(singles, epsilon, pivots, block_rows))
    placed = unique.join(parts, unique["_first"] == parts["node"], "left")
    if min_samples:
        placed = placed.join(dense, F.col("_first") == F.col("_core"), "left_semi")
    placed = placed.select("vector", "_copies", F.coalesce("component", "_first").alias("component"))
    return named_groups(rows, placed, min_cluster_size)


def label_distance_sums(points: DataFrame, block_rows: int = SUM_ROWS) -> DataFrame:
    """Sum of Euclidean distances from each row to all rows of each label.

    ``points`` holds ``msg_id, labels, vector``. Blocks hold one label each, so a pair of blocks
    gives one partial sum per row; partial sums are added up per row and label.
    """
    sizes = points.groupBy("labels").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("pieces", F.ceil(F.col("_n") / block_rows).cast("int"))
    blocks = sizes.select("labels", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    # one entry per block of rows; the list is as long as the quadratic work is wide
    targets = blocks.agg(F.array_sort(F.collect_list(F.struct("labels", "piece")))).scalar()
    rows = points.join(sizes.select("labels", "pieces"), "labels").select(
        "msg_id",
        "labels",
        F.col("vector").cast("array<double>").alias("vector"),
        (seeded_hash(5, F.col("msg_id")) % F.col("pieces")).cast("int").alias("piece"),
    )
    rows = stored(rows, "sums")
    own = F.struct("labels", "piece")
    spread = rows.withColumn("_targets", targets).withColumn("_own", own)
    left = spread.select("msg_id", "vector", F.col("_own").alias("here"), F.explode("_targets").alias("there"))
    right = spread.select("msg_id", "vector", F.explode("_targets").alias("here"), F.col("_own").alias("there"))

    def add(key: tuple[Any, ...], a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total = _distance_sums(_matrix(a["vector"]), _matrix(b["other"])) if len(a) and len(b) else np.zeros(len(a))
        return pd.DataFrame({"msg_id": a["msg_id"].to_numpy(), "other": key[1], "total": total})

    place = ["here.labels", "there.labels", "here.piece", "there.piece"]
    keys = [F.col(p).alias(n) for p, n in zip(place, ["la", "lb", "pa", "pb"])]
    sums = (
        left.select("msg_id", "vector", *keys)
        .groupBy("la", "lb", "pa", "pb")
        .cogroup(right.select(F.col("vector").alias("other"), *keys).groupBy("la", "lb", "pa", "pb"))
        .applyInPandas(add, "msg_id bigint, other int, total double")
    )
    return sums.groupBy("msg_id", "other").agg(F.sum("total").alias("total"))
