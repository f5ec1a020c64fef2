"""Two-dimensional projections of page vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import vectors as vx
from lacuna.operators import celltree, knn
from lacuna.operators.lineage import cut

# Constants of the layout's force model.
NEGATIVE_RATE = 5
CLIP = 4.0
NEAR_ZERO = 0.001
MIN_SCALE = 1e-3
START_SPAN = 10.0

# The step falls by this factor an epoch; the layout is done when the mean move of a point is below the
# tolerance, in units of the start layout's width.
DECAY = 0.9
TOLERANCE = 0.005

# Repulsion is measured against this many points, drawn anew every few epochs.
POOL = 256
POOL_EPOCHS = 5


def principal_axes(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, x, y): first two principal components of the unit vectors."""
    unit = rows.select(id_col, array_to_vector(vx.l2_normalize(F.col("vector"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(unit)
    point = vector_to_array("p")
    return model.transform(unit).select(
        id_col, point[0].cast("float").alias("x"), point[1].cast("float").alias("y"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to a flat top of ``min_dist`` and a tail."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    target = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        power = d ** (2 * b)
        fit = 1.0 / (1.0 + a * power)
        slope = np.stack([-power, -2 * a * power * np.log(d)], axis=1) * (fit ** 2)[:, None]
        move = np.linalg.lstsq(slope, target - fit, rcond=None)[0]
        a, b = max(a + move[0], 1e-3), max(b + move[1], 1e-3)
        if np.abs(move).max() < 1e-10:
            break
    return float(a), float(b)


@F.pandas_udf(T.StructType().add("rho", T.DoubleType()).add("sigma", T.DoubleType()))
def _scale(dists: pd.Series, neighbours: pd.Series) -> pd.DataFrame:
    """Nearest positive distance, and the width at which memberships sum to log2(k)."""
    out = []
    for row, k in zip(dists, neighbours):
        d = np.asarray(row, dtype=np.float64)
        positive = d[d > 0]
        rho = positive.min() if len(positive) else 0.0
        target, low, high, sigma = np.log2(k), 0.0, np.inf, 1.0
        gap = np.maximum(d - rho, 0.0)
        for _ in range(64):
            total = np.exp(-gap / sigma).sum()
            if abs(total - target) < 1e-5:
                break
            if total > target:
                high = sigma
                sigma = (low + high) / 2
            else:
                low = sigma
                sigma = sigma * 2 if np.isinf(high) else (low + high) / 2
        floor = MIN_SCALE * (d.mean() if len(d) else 1.0)
        out.append((rho, max(sigma, floor, 1e-12)))
    return pd.DataFrame(out, columns=["rho", "sigma"])


def fuzzy_graph(lists: DataFrame, n_neighbors: int) -> DataFrame:
    """(i, j, w) in both directions: probability that i or j holds the other as near."""
    scales = lists.groupBy("pid").agg(F.sort_array(F.collect_list("dist")).alias("d")).select(
        "pid", _scale("d", F.lit(n_neighbors)).alias("s"))
    member = F.exp(-F.greatest(F.col("dist") - F.col("s.rho"), F.lit(0.0)) / F.col("s.sigma"))
    one_way = lists.join(scales, "pid").select("pid", "nbr", member.alias("m"))
    zero = F.lit(0.0)
    both = one_way.select(F.inline(F.array(
        F.struct(F.col("pid").alias("i"), F.col("nbr").alias("j"),
                 F.col("m").alias("out"), zero.alias("back")),
        F.struct(F.col("nbr").alias("i"), F.col("pid").alias("j"),
                 zero.alias("out"), F.col("m").alias("back")))))
    # a point's edges lie together, so tasks of every epoch sum its pulls up before they move
    return both.repartition("i").groupBy("i", "j").agg(F.sum("out").alias("a"), F.sum("back").alias("b")).select(
        "i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def _clip(force: Column) -> Column:
    return F.greatest(F.least(force, F.lit(CLIP)), F.lit(-CLIP))


def _pull(edges: DataFrame, coords: DataFrame, a: float, b: float) -> DataFrame:
    """Weighted mean attraction of every point, combined map-side."""
    head = coords.select(F.col("pid").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    tail = coords.select(F.col("pid").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    met = edges.join(head, "i").join(tail, "j").withColumns({
        "dx": F.col("xi") - F.col("xj"), "dy": F.col("yi") - F.col("yj")})
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    size = F.when(square > 0, -2.0 * a * b * F.pow(square, b - 1) / (1.0 + a * F.pow(square, b))
                  ).otherwise(0.0)
    met = met.withColumn("g", size)
    return met.groupBy("i").agg(
        (F.sum(F.col("w") * _clip(F.col("g") * F.col("dx"))) / F.sum("w")).alias("fx"),
        (F.sum(F.col("w") * _clip(F.col("g") * F.col("dy"))) / F.sum("w")).alias("fy"))


def _push(pool: np.ndarray, a: float, b: float):
    """Mean repulsion from a small pool of points."""
    @F.pandas_udf("rx double, ry double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        dx = x.to_numpy()[:, None] - pool[None, :, 0]
        dy = y.to_numpy()[:, None] - pool[None, :, 1]
        square = dx * dx + dy * dy
        size = np.where(square > 0, 2.0 * b / ((NEAR_ZERO + square) * (1.0 + a * square ** b)), 0.0)
        return pd.DataFrame({"rx": np.clip(size * dx, -CLIP, CLIP).mean(axis=1),
                             "ry": np.clip(size * dy, -CLIP, CLIP).mean(axis=1)})
    return run


def _start(points: DataFrame) -> DataFrame:
    axes = principal_axes(points, "pid")
    span = axes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                    F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    width = max(span["x1"] - span["x0"], span["y1"] - span["y0"], 1e-12)
    return axes.select(
        "pid",
        ((F.col("x").cast("double") - span["x0"]) / width * START_SPAN).alias("x"),
        ((F.col("y").cast("double") - span["y0"]) / width * START_SPAN).alias("y"))


def neighbour_layout(pages: DataFrame, n_neighbors: int = 15, min_dist: float = 0.1,
                     random_state: int = 42, tolerance: float = TOLERANCE,
                     block_rows: int = knn.BLOCK_ROWS) -> DataFrame:
    """(page_id, x, y): layout that keeps cosine neighbours together.

    Every epoch moves all points at once by the mean pull of their neighbours and
    the mean push of a seeded pool of points, with a falling step, until the mean move of a point is
    below ``tolerance`` times the width of the start layout. Forces are clipped, so the falling step ends
    every layout. Equal vectors share a position. The same seed gives the same layout.
    """
    points = knn.collapse(pages)
    lists = cut(celltree.neighbour_lists(celltree.build(points, knn.COSINE, block_rows), n_neighbors - 1))
    edges = cut(fuzzy_graph(lists, n_neighbors))
    a, b = curve(min_dist)
    coords = cut(_start(points.rows))
    pool = np.zeros((0, 2))
    epoch, move = 0, float("inf")
    while move > tolerance * START_SPAN:
        if epoch % POOL_EPOCHS == 0:
            drawn = coords.orderBy(
                F.xxhash64(F.lit(random_state), F.lit(epoch), "pid"), "pid").limit(POOL)
            pool = drawn.select("x", "y").toPandas().to_numpy()
        alpha = DECAY ** epoch
        push = _push(pool, a, b)("x", "y")
        pull = _pull(edges, coords, a, b).withColumnRenamed("i", "pid")
        moved = coords.withColumn("push", push).join(pull, "pid", "left")

        def step(pulled: str, pushed: str) -> Column:
            return F.lit(alpha) * (2.0 * F.coalesce(pulled, F.lit(0.0))
                                   + float(NEGATIVE_RATE) * F.col(pushed))

        # rounding keeps the result independent of the order of float sums
        steps = moved.select("pid", "x", "y", step("fx", "push.rx").alias("dx"), step("fy", "push.ry").alias("dy"))
        table = cut(steps.select(
            "pid", F.round(F.col("x") + F.col("dx"), 9).alias("x"), F.round(F.col("y") + F.col("dy"), 9).alias("y"),
            F.round(F.hypot("dx", "dy"), 6).cast("decimal(18,6)").alias("move")))
        move = float(table.agg(F.avg("move")).first()[0] or 0.0)
        coords, epoch = table.select("pid", "x", "y"), epoch + 1
    return points.members.join(coords, "pid").select(
        "page_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))


def _apart(batches):
    """(pid, d): cosine distances of given pairs."""
    for pdf in batches:
        if len(pdf):
            a, b = (knn.unit_rows(np.concatenate(pdf[c].to_numpy()), len(pdf), knn.COSINE) for c in ("v", "w"))
            square = ((a - b) ** 2).sum(axis=1)
            yield pd.DataFrame({"pid": pdf["pid"], "d": square / 2})


class _Nearer:
    """(key, slot, n): passing points nearer to a held point than each of its distances ``far``."""

    def __init__(self, held):
        self.keys = np.array([r.block for r in held], dtype=np.int64)
        self.code, names = pd.factorize(np.array([r.pid for r in held], dtype=object))
        self.numbers = pd.Index(names)
        self.held = knn.Held(knn.unit_rows(np.concatenate([r.flat for r in held]), len(held), knn.COSINE))
        self.sizes = np.array([len(r.far) for r in held])
        far = np.full((len(held), self.sizes.max()), -np.inf)
        far[np.arange(far.shape[1]) < self.sizes[:, None]] = np.concatenate([r.far for r in held])
        self.least = self.held.square[:, None] / 2.0 - (far - knn.SLACK)
        self.limit = np.sqrt(2.0 * far.max(axis=1))
        self.count = np.zeros(far.shape, dtype=np.int64)

    def meets(self, row) -> None:
        code = self.numbers.get_indexer(np.asarray(row.pids, dtype=object))
        known = np.flatnonzero(code >= 0)
        for part, product in self.held.dots(knn.unit_rows(row.flat, len(row.pids), knn.COSINE), self.limit):
            # no point is nearer to itself
            i, j = np.nonzero(self.code[part][:, None] == code[known])
            product[i, known[j]] = -np.inf
            for slot in range(self.count.shape[1]):
                self.count[part, slot] += (product > self.least[part, slot][:, None]).sum(axis=1)

    def answers(self):
        for at in range(0, len(self.keys), 1 << 13):
            i, slot = np.nonzero(np.arange(self.count.shape[1]) < self.sizes[at:at + (1 << 13), None])
            yield pd.DataFrame({"key": self.keys[at + i], "slot": slot, "n": self.count[at + i, slot]})


def trustworthiness(pages: DataFrame, placed: DataFrame, k: int = 10,
                    block_rows: int = knn.BLOCK_ROWS) -> DataFrame:
    """(points, asked, trust): how far neighbours in a layout (page_id, x, y) are neighbours among the vectors.

    1 less the mean rank excess of a point's k layout neighbours that are not among its k nearest by cosine distance,
    scaled so that 0 is the worst layout. Every point is asked for the ranks of its layout neighbours, and ranks are
    counted over all points, by tasks that hold some points while all blocks pass by. Equal vectors are one point.
    """
    points = knn.collapse(pages)
    tree = celltree.build(points, knn.COSINE, block_rows)
    near = celltree.neighbour_lists(tree, k).select("pid", "nbr")
    flat = placed.withColumnRenamed("page_id", "pid").join(points.rows.select("pid"), "pid", "left_semi").select(
        "pid", F.lit(1).cast("bigint").alias("weight"), F.array("x", "y").cast("array<float>").alias("vector"))
    shown = celltree.build(knn.Points(cut(flat), None, points.count, True), knn.PLAIN, block_rows)
    missed = cut(celltree.neighbour_lists(shown, k).select("pid", "nbr").join(near, ["pid", "nbr"], "left_anti"))
    pairs = (missed.join(points.rows.select("pid", F.col("vector").alias("v")), "pid")
             .join(points.rows.select(F.col("pid").alias("nbr"), F.col("vector").alias("w")), "nbr"))
    far = cut(pairs.select("pid", "v", "w").mapInPandas(_apart, "pid string, d double"))
    asked = cut(far.groupBy("pid").agg(F.sort_array(F.collect_list("d")).alias("far"))
                .join(points.rows.select("pid", "vector"), "pid")
                .select(F.xxhash64("pid", "vector").alias("block"), "pid", F.col("vector").alias("flat"), "far"))
    held = asked.count()
    met = knn.meet(asked, tree.rows.select("block", "pids", "flat"), points.count,
                   *knn.grid(held, points.count), held=held)
    counts = cut(met.mapInPandas(knn.searched(_Nearer), "key bigint, slot int, n bigint"), knn.BATCH)
    # a rank is one more than the number of nearer points
    ranks = counts.groupBy("key", "slot").agg((F.sum("n") + 1).alias("rank"))
    excess = ranks.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).first()[0] or 0
    worst = points.count * k * max(1, 2 * points.count - 3 * k - 1) / 2
    return pages.sparkSession.createDataFrame(
        [(points.count, points.count, 1.0 - excess / worst if points.count else 1.0)],
        "points bigint, asked bigint, trust double")
