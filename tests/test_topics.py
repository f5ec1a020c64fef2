"""Neighbours, topics and layout against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import celltree, knn, layout, spanning, topics

from . import brute


def frame(spark, rows, order=None):
    ids = [f"{i:05d}" for i in range(len(rows))]
    data = [(i, [float(v) for v in r]) for i, r in zip(ids, rows)]
    if order is not None:
        data = [data[i] for i in order]
    return spark.createDataFrame(data, "page_id string, vector array<float>")


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 8))
    rows = [c + 0.05 * rng.normal(size=(12, 8)) for c in centres] + [rng.normal(size=(6, 8))]
    return np.vstack(rows)


@pytest.fixture(scope="module")
def copies(planted):
    """A third of all rows are copies of one vector; three rows are zero."""
    return np.vstack([planted, np.repeat(planted[:1], 20, axis=0),
                      np.repeat(planted[13:15], 3, axis=0), np.zeros((3, 8))])


def found(df):
    groups = {}
    for row in df.collect():
        if row["cluster_id"] >= 0:
            groups.setdefault(row["cluster_id"], set()).add(int(row["page_id"]))
    return groups


@pytest.mark.parametrize("block_rows", [1024, 9])
def test_neighbours_with_copies(spark, copies, block_rows):
    k = 4
    got = knn.nearest_pages(frame(spark, copies), k, block_rows=block_rows).collect()
    dist = brute.distance_matrix(copies)
    zero = ~np.asarray(copies).any(axis=1)
    cosine = np.where(zero[:, None] | zero[None], 1.0, dist ** 2 / 2)
    cosine[np.ix_(zero, zero)] = 0.0
    cosine = np.round(cosine, 7)
    lists = {}
    for r in got:
        lists.setdefault(int(r["page_id"]), {})[r["rank"]] = r
    assert set(lists) == set(range(len(copies)))
    for i, near in lists.items():
        assert sorted(near) == list(range(1, k + 1))
        want = sorted(cosine[i, j] for j in range(len(copies)) if j != i)[:k]
        assert np.allclose([near[r]["distance"] for r in range(1, k + 1)], want, atol=1e-6)
        names = [int(near[r]["neighbour_id"]) for r in range(1, k + 1)]
        assert len(set(names)) == k and i not in names
        assert np.allclose([cosine[i, j] for j in names], want, atol=1e-6)


@pytest.mark.parametrize("block_rows", [1024, 9])
def test_core_distances_count_copies(spark, copies, block_rows):
    points = knn.collapse(frame(spark, copies))
    lists = celltree.neighbour_lists(celltree.build(points, knn.EUCLIDEAN, block_rows), 3)
    cores = knn.core_distances(points, lists, 3)
    want = brute.core(brute.distance_matrix(copies), 3)
    for r in points.members.join(cores, "pid").collect():
        assert abs(r["core"] - want[int(r["page_id"])]) < 1e-6


def test_planted_topics(spark, planted):
    order = np.random.default_rng(1).permutation(len(planted))
    groups = found(topics.cluster_pages(frame(spark, planted, order), 5))
    assert {frozenset(g) for g in groups.values()} == brute.leaf_topics(planted, 5)
    assert {frozenset(range(i, i + 12)) for i in (0, 12, 24)} <= {
        frozenset(x for x in g if x < 36) for g in groups.values()}
    # numbered by smallest page id
    firsts = [min(groups[c]) for c in sorted(groups)]
    assert firsts == sorted(firsts) and sorted(groups) == list(range(len(groups)))


def test_topics_with_copies_in_small_blocks(spark, copies):
    groups = found(topics.cluster_pages(frame(spark, copies), 4, block_rows=9))
    assert {frozenset(g) for g in groups.values()} == brute.leaf_topics(copies, 4)


def test_unstructured_vectors(spark):
    rows = np.random.default_rng(3).normal(size=(80, 4))
    groups = found(topics.cluster_pages(frame(spark, rows), 3, block_rows=25))
    assert {frozenset(g) for g in groups.values()} == brute.leaf_topics(rows, 3)


@pytest.mark.parametrize("kind,block_rows,samples", [
    ("planted", 1024, 3), ("far", 20, 3), ("none", 9, 6), ("scaled", 9, 3)])
def test_spanning_tree_equals_brute_force(spark, planted, kind, block_rows, samples):
    """Weights of the tree, also where lists end inside a group and exits must be looked for."""
    rng = np.random.default_rng(4)
    centres = np.eye(4)[np.repeat(np.arange(4), 30)]
    rows = {"planted": planted, "far": centres + 0.01 * rng.normal(size=(120, 4)), "none": rng.normal(size=(90, 5)),
            "scaled": np.vstack([planted, planted[:8] * 2, planted[:8] * 4, np.zeros((1, 8))])}[kind]
    points = knn.collapse(frame(spark, rows))
    cores, levels = topics.spanning_levels(points, samples, block_rows)
    got = spanning.edges(levels, spark).collect()
    dist = brute.distance_matrix(rows)
    near = brute.core(dist, samples)
    reach = np.maximum(dist, np.maximum(near[:, None], near[None, :]))
    inside, best, want = np.zeros(len(rows), bool), reach[0].copy(), []
    inside[0] = True
    for _ in range(len(rows) - 1):
        at = int(np.where(inside, np.inf, best).argmin())
        want.append(best[at])
        inside[at] = True
        best = np.minimum(best, reach[at])
    assert len(got) == len(rows) - 1 and len({(r.lo, r.hi) for r in got}) == len(got)
    assert np.allclose(sorted(r.w for r in got), sorted(want), atol=1e-6)
    assert all(abs(reach[int(r.lo), int(r.hi)] - r.w) < 1e-6 and r.lo < r.hi for r in got)
    home = list(range(len(rows)))
    for r in got:
        a, b = home[int(r.lo)], home[int(r.hi)]
        assert a != b
        home = [a if h == b else h for h in home]


def test_scaled_copies_in_small_blocks(spark, planted):
    """Vectors of one direction and different length are separate points at distance 0."""
    rows = np.vstack([planted, planted[:8] * 2, planted[:8] * 4])
    groups = found(topics.cluster_pages(frame(spark, rows), 4, block_rows=5))
    assert {frozenset(g) for g in groups.values()} == brute.leaf_topics(
        rows, 4, copies_first=False)


def test_one_group_is_all_noise(spark):
    rows = [[1.0, 0.01 * i] for i in range(12)]
    got = topics.cluster_pages(frame(spark, rows), 5)
    assert got.count() == 12 and got.filter(F.col("cluster_id") >= 0).isEmpty()


def test_layout_keeps_neighbours_and_repeats(spark):
    rng = np.random.default_rng(0)
    label = np.repeat(np.arange(3), 20)
    rows = rng.normal(size=(3, 8))[label] + 0.2 * rng.normal(size=(60, 8))
    runs = [layout.neighbour_layout(frame(spark, rows), n_neighbors=8, tolerance=0.02)
            .orderBy("page_id").toPandas() for _ in range(2)]
    assert runs[0].equals(runs[1])
    xy = runs[0][["x", "y"]].to_numpy()
    dist = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    near = dist.argsort(axis=1)[:, :5]
    assert (label[near] == label[:, None]).mean() > 0.9


def brute_trust(rows, xy, k):
    n = len(rows)
    near = brute.distance_matrix(rows)
    flat = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(near, -1)
    np.fill_diagonal(flat, -1)
    rank = near.argsort(axis=1).argsort(axis=1)
    shown = flat.argsort(axis=1)[:, 1:k + 1]
    excess = sum(max(0, rank[i, j] - k) for i in range(n) for j in shown[i])
    return 1 - 2 * excess / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("block_rows", [1024, 20])
def test_trustworthiness_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(90, 6))
    pages = frame(spark, rows)
    for xy in (rng.normal(size=(90, 2)), rows[:, :2]):
        xy = xy.astype(np.float32)
        placed = spark.createDataFrame([(f"{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                       "page_id string, x float, y float")
        got = layout.trustworthiness(pages, placed, k=7, block_rows=block_rows).first()
        assert (got.points, got.asked) == (90, 90)
        assert abs(got.trust - brute_trust(rows, xy.astype(float), 7)) < 1e-9


def test_trustworthiness_asks_every_point(spark, monkeypatch):
    """More points than one task's, many of them badly placed: no point's ranks are left out."""
    monkeypatch.setattr(knn, "LEAST", 1024)
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(4200, 3)).astype(np.float32)
    xy = np.where(rng.random(4200)[:, None] < 0.3, rng.normal(size=(4200, 2)), rows[:, :2]).astype(np.float32)
    placed = spark.createDataFrame([(f"{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                   "page_id string, x float, y float")
    got = layout.trustworthiness(frame(spark, rows), placed, k=3, block_rows=256).first()
    assert (got.points, got.asked) == (4200, 4200)
    assert abs(got.trust - brute_trust(rows, xy.astype(float), 3)) < 1e-6


def test_curve_constants():
    a, b = layout.curve(0.1)
    assert abs(a - 1.577) < 0.001 and abs(b - 0.895) < 0.001


def test_only_points_that_look_for_an_exit_are_held(spark, monkeypatch):
    """Blocks pass by whole; of the others, a search of the spanning tree moves the asked points alone."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 6))
    seen, meet = [], knn.meet

    def watched(asked, passing, *rest, **named):
        if "limits" in asked.columns:
            limits = [x for r in asked.select("limits").collect() for x in r.limits]
            seen.append((len(limits), min(limits, default=0.0), passing.agg(F.sum(F.size("pids"))).first()[0]))
        return meet(asked, passing, *rest, **named)

    monkeypatch.setattr(knn, "meet", watched)
    _, levels = topics.spanning_levels(knn.collapse(frame(spark, rows)), 3, 32)
    assert seen and all(least >= 0 and every == 300 for _, least, every in seen)
    assert min(held for held, _, _ in seen) < 300
    got = spanning.edges(levels, spark).agg(F.count("w").alias("n"), F.sum("w").alias("w")).first()
    dist = brute.distance_matrix(rows)
    core = np.sort(dist, axis=1)[:, 3]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None]))
    inside, far, total = np.zeros(300, dtype=bool), reach[0].copy(), 0.0
    inside[0] = True
    for _ in range(299):
        nearest = np.where(inside, np.inf, far).argmin()
        total += far[nearest]
        inside[nearest] = True
        far = np.minimum(far, reach[nearest])
    assert got["n"] == 299 and abs(got["w"] - total) < 1e-4


def test_the_fewer_points_are_held_the_fewer_tiles():
    assert knn.grid(600_000, 600_000) == (7, 7)
    assert knn.grid(12 * knn.TILE, 12 * knn.TILE) == (12, 4)
    assert knn.grid(10_000, 600_000) == (1, knn.CELLS)
    assert knn.grid(0, 0) == (1, knn.CELLS)
    for held in (1, 1_000, 100_000, 600_000):
        tiles, streams = knn.grid(held, 600_000)
        assert knn.CELLS <= tiles * streams and tiles * 600_000 + streams * held <= 14 * 600_000
