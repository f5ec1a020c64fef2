"""Codes of vector parts against plain rounds of assigning and averaging."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from lacuna.llm import codes
from lacuna.llm.anchors import BallTree

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error int, v int, kept int, trees int, of int"


def vectors(n=300, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    rows = [(int(i), (centres[i % 7] + 0.2 * rng.normal(size=width)).astype("float32").tolist(), (None, 1, 2)[i % 3])
            for i in rng.permutation(n)]
    same = rows[5][1]
    rows += [(1000 + i, same, 9) for i in range(120)]  # copies
    rows += [rows[0], rows[0], (None, same, None), (2000, rows[1][1][:9], 1), (2001, [], 1)]
    rows += [(-1, None, 1), (-2, [0.0] * (width - 1) + [float("nan")], 1), (-3, [float("inf")] * width, None),
             (-4, [None] * width, 1)]
    return rows


def brute_force(rows, parts=8, entries=16, rounds=6):
    kept = [(k, [math.floor(4096 * x) for x in v], label) for k, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = -(-max(len(v) for _, v, _ in kept) // parts)
    table = [(k, v + [0] * (parts * each - len(v)), label) for k, v, label in kept]

    def part(v, p):
        return v[p * each:(p + 1) * each]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    books = [[part(v, p) for _, v, _ in table[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            owned = defaultdict(list)
            for _, v, _ in table:
                owned[nearest(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*owned[i])] if owned[i] else e for i, e in enumerate(book)]
    out, by_label = [], defaultdict(int)
    for k, v, label in table:
        found = [nearest(part(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    numbers = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    return [(k, code, error, by_label[label], digest) for k, code, error, label in out]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("count", [300, 9])
def test_codes_equal_brute_force(spark, monkeypatch, count):
    monkeypatch.setattr(codes, "BLOCK", 50)
    rows = vectors(count) if count > 20 else vectors(count)[:count]
    got = codes.compress(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_force(rows), key=repr)


def test_no_usable_vectors_and_large_ones(spark):
    out = codes.compress(table(spark, [(1, None, 2), (2, [float("nan")], 2)]))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    assert codes.compress(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [1e9], 2)]))
    assert codes.compress(table(spark, [(1, [], 2)])).first().code == "00" * 8


def test_trees_own_what_a_scan_owns():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, width, spread, k = (int(rng.integers(a, b)) for a, b in ((1, 300), (1, 9), (1, 200), (1, 17)))
        points = rng.integers(-spread, spread + 1, (n, width)).astype(float)
        if trial % 3 == 0:
            points[:n // 2] = points[0]
        book = points[rng.integers(0, n, k)] if trial % 2 else rng.integers(-spread, spread + 1, (k, width)).astype(float)
        tree = BallTree.from_bytes(BallTree.build(points, leaf=4).to_bytes())
        assert sorted(tree.order.tolist()) == list(range(n))
        gaps = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        owner = gaps.argmin(axis=1)
        counts, sums = tree.totals(book)
        assert counts.tolist() == np.bincount(owner, minlength=k).tolist()
        assert sums.tolist() == [points[owner == i].sum(axis=0).tolist() for i in range(k)]
        found, error = tree.owners(book)
        assert found.tolist() == owner.tolist() and error.tolist() == gaps.min(axis=1).tolist()


def test_balls_hold_their_points_and_are_owned_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 51, (400, 4)) + c for c in ([0] * 4, [3000] * 4, [-3000, 3000, 0, 0])]).astype(float)
    tree = BallTree.build(points)
    for a, b, centre, radius, total in zip(*tree.balls[:2], tree.centres, tree.radii, tree.sums):
        inside = tree.points[a:b]
        assert (inside.sum(axis=0) == total).all()
        assert np.sqrt(((inside - centre) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12)
    book = np.array([[0.0] * 4, [3000.0] * 4, [-3000.0, 3000.0, 0, 0]])
    whole = [int((tree.balls[1, balls] - tree.balls[0, balls]).sum()) for balls, _, at in tree._nearest(book) if at is None]
    assert sum(whole) == len(points)  # far apart: no point is looked at by itself
