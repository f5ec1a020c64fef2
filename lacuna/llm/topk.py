"""Exact top-k inner products by distributed histogram selection.

Queries are taken in chunks of bounded size. For a chunk, every task scores all of its
candidates against all queries and counts the scores in histograms; the summed histograms
tell in which bin each query's k-th score lies, and the next round looks into that bin
alone, until a bin holds one value. A last scoring keeps what lies above the k-th
score and, of the rows that equal it, those with the smallest ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.lineage import work_folder

BINS = 1024
CHUNK = 4096
#: Candidates scored at a time; with CHUNK queries the scores take 64 MB.
ROWS = 2048

_EXACT = 2.0 ** 53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: float = 256.0) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as longs; unusable vectors are left out.

    A vector takes no part when it is null or holds a null, NaN or infinite component.
    """
    infinite = float("inf")
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < infinite))
    return vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & usable).select(
        F.col(id_col).alias("vec_id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``lists`` as a matrix of ``width`` columns; short rows end in zeros."""
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    for row, (start, length) in enumerate(zip(starts, lengths)):
        out[row, :min(length, width)] = flat[start:start + min(length, width)]
    return out


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray,
            queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores [query, candidate], usable pairs) of every block of candidates."""
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    size = np.abs(queries).sum(axis=1, dtype=np.float64).max(initial=0.0)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            own = np.asarray(part.column(0))
            rows = _matrix(part.column(1), queries.shape[1])
            # doubles hold these sums exactly below 2 ** 53
            exact = size * np.abs(rows.astype(np.float64)).max(initial=0.0) < _EXACT
            kind = np.float64 if exact else np.int64
            scores = (queries.astype(kind) @ rows.T.astype(kind)).astype(np.int64)
            usable = np.ones(scores.shape, dtype=bool)
            left = np.searchsorted(ranked, own, "left")
            right = np.searchsorted(ranked, own, "right")
            for column in np.flatnonzero(right > left):
                usable[order[left[column]:right[column]], column] = False
            yield own, scores, usable


def _top_bins(spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, bin) of the highest bins that together hold k scores, or all bins with any."""
    above = np.cumsum(spread[:, ::-1], axis=1)[:, ::-1] - spread
    return np.nonzero((spread > 0) & (above < k))


def _histogram(cand: DataFrame, shared: Broadcast, k: int, bins: int) -> DataFrame:
    """(query, bin, n): scores of [low, high) per bin of ``width``, as far down as k reaches.

    ``shared`` holds (ids, queries, low, high, width).
    """
    def count(batches):
        ids, queries, low, high, width = shared.value
        spread = np.zeros((len(ids), bins), dtype=np.int64)
        base = np.arange(len(ids))[:, None] * bins
        for _, scores, usable in _scored(batches, ids, queries):
            at = (scores - low[:, None]) // width[:, None]
            hit = usable & (at >= 0) & (scores < high[:, None])
            spread += np.bincount((base + at)[hit], minlength=spread.size).reshape(spread.shape)
        query, bin_ = _top_bins(spread, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(bin_, pa.int32()),
             pa.array(spread[query, bin_], pa.int64())], names=["query", "bin", "n"])

    return (cand.mapInArrow(count, "query int, bin int, n bigint")
            .groupBy("query", "bin").agg(F.sum("n").alias("n")))


def _kth_bin(spread: DataFrame, need: DataFrame) -> list:
    """Per query: the bin of its k-th score and how many scores lie in higher bins."""
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    return (spread.join(F.broadcast(need), "query")
            .withColumn("upto", F.sum("n").over(down))
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .select("query", "bin", (F.col("upto") - F.col("n")).alias("above")).collect())


def _chunk_top(cand: DataFrame, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray,
               k: int, bins: int, path: str) -> None:
    """Append the results of one chunk of queries to the table at ``path``; its broadcasts end with it."""
    spark = cand.sparkSession
    low, high = -bound, bound + 1  # scores lie in [low, high)
    need = np.full(len(ids), k, dtype=np.int64)
    open_ = np.ones(len(ids), dtype=bool)  # the k-th score is not yet known
    few = np.zeros(len(ids), dtype=bool)  # fewer than k candidates: all are results
    while open_.any():
        at = np.flatnonzero(open_)
        width = np.maximum(1, -((low[at] - high[at]) // bins))
        wanted = spark.createDataFrame(
            [(i, int(n)) for i, n in enumerate(need[at])], "query int, need bigint")
        shared = spark.sparkContext.broadcast((ids[at], queries[at], low[at], high[at], width))
        found = _kth_bin(_histogram(cand, shared, k, bins), wanted)
        shared.destroy()
        missing = np.ones(len(at), dtype=bool)
        for query, bin_, above in found:
            i = at[query]
            missing[query] = False
            need[i] -= above
            low[i] += bin_ * width[query]
            high[i] = low[i] + width[query]
        few[at[missing]] = True
        open_ &= ~few & (high - low > 1)
    low[few] = -bound[few]
    shared = spark.sparkContext.broadcast((ids, queries, low))

    def select(batches):
        ids, queries, kth = shared.value
        kept: dict[int, list[tuple[int, int]]] = {}
        for own, scores, usable in _scored(batches, ids, queries):
            for query in np.flatnonzero((usable & (scores >= kth[:, None])).any(axis=1)):
                hit = np.flatnonzero(usable[query] & (scores[query] >= kth[query]))
                rows = kept.get(query, []) + [(-int(scores[query, i]), int(own[i])) for i in hit]
                kept[query] = sorted(rows)[:k]
        flat = [(int(ids[q]), int(q), v, -s) for q, rows in kept.items() for s, v in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(
                zip(*flat) if flat else [[]] * 4,
                (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["query_id", "query", "vec_id", "score"])

    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    (cand.mapInArrow(select, "query_id bigint, query int, vec_id bigint, score bigint")
     .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
     .select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path))
    shared.destroy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bins: int = BINS,
          chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Both inputs hold (vec_id, v) as ``quantised`` makes them. Ties go to the smaller
    vec_id. Rows with the query's own vec_id are its own and no candidates; each repeated
    query row is answered, and repeated candidates count separately. Vectors of
    unlike lengths meet as if the shorter ended in zeros. Queries come to the driver by
    chunks of about ``chunk`` rows; candidates never do. Each chunk's results are written to one table in the work folder
    before the next begins. Scores must fit 64 bits.
    """
    shape = vectors.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))).alias("most"),
    ).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    count = queries.count()
    if not count or shape["width"] is None:
        return vectors.sparkSession.createDataFrame([], schema)
    chunks = -(-count // chunk)
    path = f"{work_folder(vectors.sparkSession)}/lacuna-top-{uuid.uuid4().hex}"
    for i in range(chunks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i) if chunks > 1 else queries
        table = part.select("vec_id", "v").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids = np.asarray(table.column("vec_id").combine_chunks())
        rows = _matrix(table.column("v").combine_chunks(), shape["width"])
        bound = np.abs(rows.astype(np.float64)).sum(axis=1) * shape["most"]
        bound = np.minimum(bound, float(1 << 62)).astype(np.int64)
        _chunk_top(vectors, ids, rows, bound, k, bins, path)
    return vectors.sparkSession.read.schema(schema).parquet(path)
