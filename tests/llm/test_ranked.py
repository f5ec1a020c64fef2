"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from lacuna.llm import ranked

from .data import documents, odd_rows, texts

ITEMS = "item_id bigint, text string, doc_id int, query int, score int, rank int"


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def brute_force(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def queries():
    rng = random.Random(2)
    pool = [t for t in texts() if t]
    items = [(i, " ".join(rng.sample(pool[i % len(pool)].split(), min(12, len(pool[i % len(pool)].split()))))) for i in range(40)]
    return items + [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (None, "W1 w399"), (90, None), (91, ""), (92, "nowhere"), (93, "日本語 ZOë ZOË"),
                    (94, "w1 " * 5000), (95, " ".join(f"w{i}" for i in range(400)))]


def ask(spark, docs, items, **how):
    table = spark.createDataFrame([(*i, 1, 2, 3, 4) for i in items], ITEMS)
    out = ranked.search(documents(spark, docs).repartition(3), table, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"width": 7, "k": 3}, {"batch_terms": 20}], ids=["wide", "narrow", "batches"])
def test_search_equals_brute_force(spark, how):
    docs, items = odd_rows(), queries()
    assert ask(spark, docs, items, **how) == brute_force(docs, items, how.get("k", 10))


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 4)
    docs = [(i, "same text here") for i in range(50, 0, -1)] + [(0, "other words"), (None, "same text here")]
    items = [(1, "same words"), (2, "here"), (3, "other")]
    got = ask(spark, docs, items)
    assert got == brute_force(docs, items)
    assert [d for i, _, d, _ in got if i == 2] and {d for i, _, d, _ in got if i == 2} == set(range(1, 11))


def test_empty_tables(spark):
    assert ask(spark, [], queries()) == []
    assert ask(spark, odd_rows(), []) == []
    assert ask(spark, [(1, None), (2, " .,")], queries()) == []


def test_bounds_spare_most_documents(spark):
    """A sketch's bound never lies below the score, and rare matches leave few documents to score."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    docs = [" ".join(rng.choice([f"c{j}" for j in range(50)]) for _ in range(60)) + f" only{i}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(docs)], names=["doc_id", "text"])
    profile = next(ranked._profiles(iter([batch]), 1 << 16))
    sums = [sum(c) for c in profile.column(3).to_pylist()]
    assert sums == [61] * 300 and all(max(m) >= 1 for m in profile.column(5).to_pylist())
    for width in (5, 1 << 16):
        sketch = next(ranked._profiles(iter([batch]), width))
        for row, text in zip(zip(sketch.column(4).to_pylist(), sketch.column(5).to_pylist()), docs):
            folded = dict(zip(*row))
            for term, count in Counter(terms(text)).items():
                assert folded[int(ranked._places([term.encode()], width)[0])] >= count
    assert np.asarray(sketch.column(4).flatten()).max() < 1 << 16
