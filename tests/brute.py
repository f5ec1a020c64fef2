"""Plain in-memory versions of the iterative jobs, for small inputs."""

import numpy as np


def distance_matrix(rows):
    rows = np.asarray(rows, dtype=np.float32).astype(float)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(size > 0, size, 1)
    return np.round(np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1)), 12)


def core(dist, k):
    n = len(dist)
    others = np.sort(dist + np.where(np.eye(n) > 0, -1, 0), axis=1)[:, 1:]
    return others[:, min(k, n - 1) - 1]


def leaf_topics(rows, size, copies_first=True):
    """Leaf topics as a set of frozensets of row numbers.

    Among edges of equal weight, copies of one vector merge first unless told
    otherwise.
    """
    dist = distance_matrix(rows)
    near = core(dist, size)
    reach = np.maximum(dist, np.maximum(near[:, None], near[None, :]))
    n = len(dist)
    edges = sorted((reach[i, j], copies_first and dist[i, j] > 0, i, j) for i in range(n) for j in range(i + 1, n))
    parts = {i: ([i], "leaf" if size <= 1 else "small") for i in range(n)}
    home = list(range(n))
    topics = set()
    for _, _, i, j in edges:
        a, b = home[i], home[j]
        if a == b:
            continue
        (ma, sa), (mb, sb) = parts.pop(a), parts.pop(b)
        if len(ma) >= size and len(mb) >= size:
            topics |= {frozenset(m) for m, s in ((ma, sa), (mb, sb)) if s == "leaf"}
            state = "split"
        elif len(ma) >= size:
            state = sa
        elif len(mb) >= size:
            state = sb
        else:
            state = "leaf" if len(ma) + len(mb) >= size else "small"
        parts[a] = (ma + mb, state)
        for m in mb:
            home[m] = a
    return topics
