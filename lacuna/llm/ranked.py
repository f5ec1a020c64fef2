"""Exact ranked search with bounds from hashed maximum sketches.

A document's profile holds its terms and how often each occurs. Its sketch folds them into a fixed number of
coordinates, chosen by a hash of the term; a coordinate keeps the largest count that falls on it.
A term's impact rises with its count, so a query's terms, looked up in the sketch, give an upper
bound of its score. Every task takes its documents in blocks, looks up all queries of a batch at once
and computes exact scores in descending order of the bounds, until no bound reaches the
query's k-th score so far.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import words
from lacuna.operators.lineage import cut

#: Coordinates of a sketch; only those that a document's terms fall on are stored.
WIDTH = 1 << 16
#: Documents whose bounds are looked up at a time.
BLOCK = 512
#: Distinct query terms of a batch of queries, about; a batch holds one query at least.
BATCH_TERMS = 1 << 13
#: Groups in which the tasks' results for one query meet first.
SALTS = 16

#: Term characters are letters and digits of ASCII and everything beyond it; the rest separates.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_PROFILE = "doc_id bigint, n bigint, terms array<string>, counts array<int>, places array<int>, most array<int>"


def split_terms(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8, lower-cased in ASCII alone."""
    return (text or "").encode().translate(_FOLD).split()


def _places(terms: list[bytes], width: int) -> np.ndarray:
    return (np.array([xxhash.xxh32_intdigest(t) for t in terms], dtype=np.uint32) % width).astype(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Profile and sketch of every text with a term."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            keys: list[int | None] = []
            lengths, sizes, terms, counts = [], [0], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                split = split_terms(text.as_py())
                if split:
                    found = Counter(split)
                    keys.append(key)
                    lengths.append(len(split))
                    terms += found
                    counts += found.values()
                    sizes.append(len(terms))
            ends = np.array(sizes, dtype=np.int32)
            count = np.array(counts, dtype=np.int32)
            # one number per document and coordinate, in order
            cell = np.repeat(np.arange(len(keys)), np.diff(ends)) * width + _places(terms, width)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            cells = cell[order][starts]
            most = np.maximum.reduceat(count[order], starts) if len(starts) else count
            folded = pa.array(np.searchsorted(cells, np.arange(len(keys) + 1) * width), pa.int32())
            offsets = pa.array(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(count)),
                 pa.ListArray.from_arrays(folded, pa.array((cells % width).astype(np.int32))),
                 pa.ListArray.from_arrays(folded, pa.array(most))],
                names=["doc_id", "n", "terms", "counts", "places", "most"])


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Table of the profiles and sketches of all documents that have a term, built once for any queries."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return cut(rows.mapInArrow(words.tidy(_profiles, width), _PROFILE), BLOCK)


class Corpus(NamedTuple):
    """Documents with a term, and all their terms with repeats."""
    documents: int
    terms: int


class _Query(NamedTuple):
    terms: np.ndarray  # numbers of its terms in the batch
    weights: np.ndarray
    places: np.ndarray  # its terms' rows in the table of bounds


class _Batch(NamedTuple):
    numbers: list[int]
    queries: list[_Query]
    terms: pa.Array
    row_of: np.ndarray  # row of each coordinate in the table of bounds, or -1
    rows: int


def _impact(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * lengths)


def _table(rows: np.ndarray, counts: np.ndarray, of: np.ndarray, length: np.ndarray, height: int) -> np.ndarray:
    """Impacts by row and document; rows below 0 are left out.

    Doubles hold impacts, weights and their sums exactly below 2 ** 53.
    """
    out = np.zeros((height, len(length)))
    hit = rows >= 0
    out[rows[hit], of[hit]] = _impact(counts[hit], length[of[hit]])
    return out


def _owners(lists: pa.ListArray) -> np.ndarray:
    """Number of the list that each element is in."""
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def _weights(frequencies: dict[str, int], documents: int) -> dict[str, int]:
    return {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in frequencies.items()}


class _Best:
    """The k best (score, document) of one query so far, and the score a newcomer must reach."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, keys: list[int | None]) -> None:
        self.rows += [(-score, key is None, key or 0) for score, key in zip(scores.tolist(), keys) if score >= self.least]
        self.rows.sort()
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.least = max(1, -self.rows[-1][0])


def _search(batches: Iterator[pa.RecordBatch], shared, corpus: Corpus, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of this task for each query."""
    batch: _Batch = shared.value
    best = [_Best(k) for _ in batch.queries]
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            part = whole.slice(at, BLOCK)
            length = 10 + 90 * np.asarray(part.column(1)) * corpus.documents // corpus.terms
            places, most = part.column(4), part.column(5)
            sketches = _table(batch.row_of[np.asarray(places.flatten())], np.asarray(most.flatten()),
                              _owners(places), length, batch.rows)
            bounds = np.stack([q.weights @ sketches[q.places] for q in batch.queries])
            open_ = bounds >= np.array([top.least for top in best])[:, None]
            chosen = np.flatnonzero(open_.any(axis=0))
            if not len(chosen):
                continue
            rows = part.take(pa.array(chosen))
            terms, counts = rows.column(2), rows.column(3)
            number = pc.index_in(terms.flatten(), value_set=batch.terms)
            exact = _table(np.asarray(number.fill_null(-1)), np.asarray(counts.flatten()), _owners(terms),
                           length[chosen], len(batch.terms))
            keys = rows.column(0).to_pylist()
            bounds, open_ = bounds[:, chosen], open_[:, chosen]
            for i in np.flatnonzero(open_.any(axis=1)):
                query, top = batch.queries[i], best[i]
                listed = np.flatnonzero(open_[i])
                listed = listed[np.argsort(-bounds[i, listed], kind="stable")]
                step = 2 * k
                while len(listed) and bounds[i, listed[0]] >= top.least:
                    now, listed = listed[:step], listed[step:]
                    scores = (query.weights @ exact[query.terms[:, None], now]).astype(np.int64)
                    top.add(scores, [keys[j] for j in now])
    out = [(number, None if nameless else key, -score)
           for number, top in zip(batch.numbers, best) for score, nameless, key in top.rows]
    task = TaskContext.get().partitionId()
    columns = list(zip(*out)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array([task] * len(out), pa.int32()),
         pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
        names=["query", "task", "doc_id", "score"])


def _prepared(asked: list[tuple[int, int | None, list[str]]], weights: dict[str, int], width: int) -> _Batch:
    """The queries of a batch, without the terms that no document has."""
    terms = sorted(weights)
    number = {t: i for i, t in enumerate(terms)}
    place = _places([t.encode() for t in terms], width)
    used = np.unique(place)
    row_of = np.full(width, -1, dtype=np.int64)
    row_of[used] = np.arange(len(used))
    queries = []
    for *_, own in asked:
        own = [t for t in own if t in weights]
        numbers = np.array([number[t] for t in own], dtype=np.int64)
        queries.append(_Query(numbers, np.array([weights[t] for t in own], dtype=np.float64), row_of[place[numbers]]))
    return _Batch([n for n, *_ in asked], queries, pa.array(terms, pa.string()), row_of, len(used))


def _frequencies(index: DataFrame, terms: set[str]) -> dict[str, int]:
    """In how many documents each of ``terms`` occurs; those in none are left out."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string")
    found = index.select(F.explode("terms").alias("term")).join(F.broadcast(wanted), "term")
    return {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}


def search(docs: DataFrame, queries: DataFrame, k: int = 10, width: int = WIDTH,
           batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with score above 0 of each row of ``queries``.

    Both inputs have a text; documents have doc_id, queries item_id. Terms are maximal runs of ASCII letters and
    digits and all characters beyond ASCII, A-Z lower-cased. A term in df of N documents with a term weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms, of L in all, has m = 10 + 90nN div L; a score
    is the sum of w * (10^9 tf div (1000 tf + 8m)) over the query's different terms. Equal scores
    go by doc_id, null last. Null texts and texts without terms match nothing. Repeated documents
    are all ranked; each repeated row of ``queries`` is answered by itself. Other columns are ignored, and empty
    tables give no rows. Sums are exact for queries of up to 400 000 different terms.

    Documents are read once, for a table of profiles that any queries can use. Queries come in batches
    of about ``batch_terms`` different terms, which bound what is broadcast; a batch is one pass over
    the profiles. Only each task's k best per query are shuffled, first by query and task group.
    """
    spark = docs.sparkSession
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    index = profiles(docs, width)
    sums = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    corpus = Corpus(sums["documents"], sums["terms"] or 0)
    out = None
    # the driver holds the terms of one batch
    asked: list[tuple[int, int | None, list[str]]] = []
    held: set[str] = set()

    def answer() -> DataFrame:
        batch = _prepared(asked, _weights(_frequencies(index, held), corpus.documents), width)
        shared = spark.sparkContext.broadcast(batch)
        rows = index.mapInArrow(words.tidy(_search, shared, corpus, k), "query int, task int, doc_id bigint, score bigint")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        by_task = Window.partitionBy("query", F.col("task") % SALTS).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(by_task)).filter(F.col("rank") <= k)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        names = spark.createDataFrame([(n, item) for n, item, _ in asked], "query int, item_id bigint")
        found = cut(rows.filter(F.col("rank") <= k).join(F.broadcast(names), "query")
                    .select("item_id", "rank", "doc_id", "score"), BLOCK)
        shared.destroy()
        return found

    asking = queries.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    for number, row in enumerate(asking.toLocalIterator() if corpus.documents else ()):
        terms = sorted({t.decode() for t in split_terms(row["text"])})
        if terms:
            asked.append((number, row["item_id"], terms))
            held.update(terms)
        if len(held) >= batch_terms:
            part = answer()
            out = part if out is None else out.unionByName(part)
            asked, held = [], set()
    if asked:
        part = answer()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
