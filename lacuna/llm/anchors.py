"""Metric trees of balls by the anchors hierarchy, and finding the owners of whole balls.

A tree is built middle-out. About sqrt(n) anchors are chosen, each the point farthest from its present
anchor, and take over the points that are nearer to them; each anchor's points make a subtree in the same
way, and the anchors are joined, always the two that fit into the smallest ball. A ball caches
number, sum, centre and radius of its points, which lie next to each other in tree order.

To find every point's nearest entry of a codebook, balls are visited from the root. A ball inherits the list
of entries that may own points of its parent and drops those that another entry beats for all
of its points. When one is left, the ball is owned as a whole and its cached sum and number are used.
"""

from __future__ import annotations

import io

import numpy as np

#: Points of a ball that is not divided.
LEAF = 16


def _assigned(points: np.ndarray, anchors: int) -> np.ndarray:
    """Number of the anchor that each point ends at."""
    owner = np.zeros(len(points), dtype=np.int64)
    distance = ((points - points[0]) ** 2).sum(axis=1)
    for new in range(1, anchors):
        at = int(distance.argmax())
        if distance[at] == 0:
            break
        # a point nearer to its anchor than half the way between two anchors stays
        gap = ((points - points[at]) ** 2).sum(axis=1)
        nearer = gap < distance
        owner[nearer] = new
        distance[nearer] = gap[nearer]
    return owner


class _Builder:
    """Balls as parallel lists; a ball's points are a run of the tree order."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.order: list[np.ndarray] = []
        self.placed = 0
        self.start: list[int] = []
        self.end: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []

    def _ball(self, start: int, end: int, left: int = -1, right: int = -1) -> int:
        for column, value in ((self.start, start), (self.end, end), (self.left, left), (self.right, right)):
            column.append(value)
        return len(self.start) - 1

    def build(self, rows: np.ndarray) -> int:
        """The ball of ``rows``, after all balls inside it."""
        points = self.points[rows]
        groups = []
        if len(rows) > self.leaf:
            owner = _assigned(points, max(2, round(len(rows) ** 0.5)))
            groups = [rows[owner == g] for g in np.unique(owner)]
        if len(groups) < 2:
            self.order.append(rows)
            self.placed += len(rows)
            return self._ball(self.placed - len(rows), self.placed)
        return self._divide(groups)

    def _divide(self, groups: list[np.ndarray]) -> int:
        """Join groups pairwise into a tree of groups, then build it from its left end."""
        n = np.array([len(g) for g in groups], dtype=np.float64)
        centre = np.stack([self.points[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(((self.points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre)])
        tree: list = list(groups)
        alive = np.ones(len(groups), dtype=bool)
        far = np.full((len(groups), len(groups)), np.inf)

        def fit(i: int) -> None:
            gap = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
            size = (gap + radius + radius[i]) / 2  # radius of a ball around both
            size[~alive] = np.inf
            size[i] = np.inf
            far[i, :] = far[:, i] = size

        for i in range(len(groups)):
            fit(i)
        for _ in range(len(groups) - 1):
            i, j = divmod(int(far.argmin()), len(groups))
            both = n[i] + n[j]
            middle = (centre[i] * n[i] + centre[j] * n[j]) / both
            reach = max(np.sqrt(((centre[k] - middle) ** 2).sum()) + radius[k] for k in (i, j))
            tree[i], tree[j] = (tree[i], tree[j]), None
            n[i], centre[i], radius[i], alive[j] = both, middle, reach, False
            far[j, :] = far[:, j] = np.inf
            fit(i)
        return self._grow(tree[int(np.flatnonzero(alive)[0])])

    def _grow(self, tree) -> int:
        # an explicit stack, as a chain of joins may be as deep as there are groups
        done: list[int] = []
        todo = [(tree, False)]
        while todo:
            node, joined = todo.pop()
            if not isinstance(node, tuple):
                done.append(self.build(node))
            elif joined:
                right, left = done.pop(), done.pop()
                done.append(self._ball(self.start[left], self.end[right], left, right))
            else:
                todo += [(node, True), (node[1], False), (node[0], False)]
        return done[0]


class BallTree:
    """Tree of the rows of ``points``, whole numbers as doubles.

    Squared distances have to stay below 2 ** 50, where doubles hold them and sums of a few exactly.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, balls: np.ndarray, sums: np.ndarray,
                 centres: np.ndarray, radii: np.ndarray):
        self.points, self.order, self.balls = points, order, balls
        self.sums, self.centres, self.radii = sums, centres, radii

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> BallTree:
        builder = _Builder(points, leaf)
        builder.build(np.arange(len(points)))
        order = np.concatenate(builder.order)
        points = points[order]
        balls = np.array([builder.start, builder.end, builder.left, builder.right], dtype=np.int64)
        total = np.concatenate((np.zeros((1, points.shape[1])), np.cumsum(points, axis=0)))
        sums = total[balls[1]] - total[balls[0]]
        centres = sums / (balls[1] - balls[0])[:, None]
        radii = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max())
                          for a, b, c in zip(balls[0].tolist(), balls[1].tolist(), centres)])
        return cls(points, order, balls, sums, centres, radii)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points.astype(np.int32), order=self.order.astype(np.int32),
                 balls=self.balls.astype(np.int32), sums=self.sums.astype(np.int64),
                 centres=self.centres, radii=self.radii)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> BallTree:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        return cls(held["points"].astype(np.float64), held["order"], held["balls"].astype(np.int64),
                   held["sums"].astype(np.float64), held["centres"], held["radii"])

    def _nearest(self, codebook: np.ndarray):
        """Yield (balls, owners) of wholly owned balls, then (points, owners) of what is left in undivided ones.

        Of equally near entries the first owns a point.
        """
        size = (codebook ** 2).sum(axis=1)
        apart = np.sqrt(((codebook[:, None] - codebook[None]) ** 2).sum(axis=2))
        entry = np.arange(len(codebook))
        level = np.array([self.balls.shape[1] - 1])
        listed = np.ones((1, len(codebook)), dtype=bool)
        points, masks = [], []
        while len(level):
            centre = self.centres[level]
            gap = size - 2 * (centre @ codebook.T)  # squared distance, less the centre's own size
            best = np.where(listed, gap, np.inf).argmin(axis=1)
            # over a ball, an entry's squared distance exceeds the best one's by this or more; both are whole
            least = gap - gap[np.arange(len(level)), best][:, None] - 2 * self.radii[level][:, None] * apart[best]
            slack = 1e-9 * (np.abs(gap).max(axis=1, initial=0.0)[:, None] + size.max())
            beaten = (least - slack > 0) | ((least > slack - 1) & (entry > best[:, None]))
            beaten[np.arange(len(level)), best] = False
            listed &= ~beaten
            owned = listed.sum(axis=1) == 1
            if owned.any():
                yield level[owned], best[owned], None
            level, listed = level[~owned], listed[~owned]
            left, right = self.balls[2, level], self.balls[3, level]
            whole = left < 0
            for ball, mask in zip(level[whole].tolist(), listed[whole]):
                a, b = self.balls[0, ball], self.balls[1, ball]
                points.append(np.arange(a, b))
                masks.append(np.repeat(mask[None], b - a, axis=0))
            level = np.concatenate((left[~whole], right[~whole]))
            listed = np.concatenate((listed[~whole], listed[~whole]))
        if points:
            at = np.concatenate(points)
            far = size - 2 * (self.points[at] @ codebook.T)
            yield None, np.where(np.concatenate(masks), far, np.inf).argmin(axis=1), at

    def totals(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry, the number and the sum of the points it owns."""
        counts = np.zeros(len(codebook), dtype=np.int64)
        sums = np.zeros(codebook.shape, dtype=np.float64)
        for balls, owner, at in self._nearest(codebook):
            if at is None:
                np.add.at(counts, owner, self.balls[1, balls] - self.balls[0, balls])
                np.add.at(sums, owner, self.sums[balls])
            else:
                counts += np.bincount(owner, minlength=len(codebook))
                np.add.at(sums, owner, self.points[at])
        return counts, sums.astype(np.int64)

    def owners(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, squared distance to it) of every point, in the order they were given."""
        found = np.zeros(len(self.points), dtype=np.int64)
        for balls, owner, at in self._nearest(codebook):
            if at is None:
                for ball, entry in zip(balls.tolist(), owner.tolist()):
                    found[self.balls[0, ball]:self.balls[1, ball]] = entry
            else:
                found[at] = owner
        out = np.empty_like(found)
        out[self.order] = found
        error = np.empty(len(found), dtype=np.int64)
        error[self.order] = ((self.points - codebook[found]) ** 2).sum(axis=1).astype(np.int64)
        return out, error
