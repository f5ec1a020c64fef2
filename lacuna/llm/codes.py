"""Compressing vectors to codes of their parts.

Vectors become whole numbers and are cut into consecutive parts; every part position has a codebook, fitted by rounds
of assigning all parts to their nearest entries and moving the entries to the means. Tasks build metric trees over the parts
of their own vectors once, block by block; a round then sends the codebooks to the trees and
adds up what whole balls, and the points of undivided ones, give to each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lacuna.llm.anchors import BallTree
from lacuna.operators.lineage import cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
#: Vectors whose trees are built, stored and searched together.
BLOCK = 4096

_EXACT = 2.0 ** 50


def whole_components(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component as long; null where the vector or a component is null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``lists``; those shorter than ``width`` end in zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def _split(rows: np.ndarray, parts: int) -> np.ndarray:
    """[part, row, component]."""
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _block_trees(batches: Iterator[pa.RecordBatch], parts: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per block: its kept columns and one tree for each part position."""
    kept: list[pa.Array] = []
    rows: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        of = pa.concat_arrays(kept)
        trees = [BallTree.build(part).to_bytes() for part in _split(np.concatenate(rows), parts)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of).cast(schema.field(0).type),
             pa.array([trees], pa.list_(pa.binary()))], schema=schema)

    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, min(BLOCK, batch.num_rows - at))
            while part.num_rows:
                now = part.slice(0, BLOCK - held)
                part = part.slice(now.num_rows)
                kept.append(now.column(0))
                rows.append(_matrix(now.column(1), width))
                held += now.num_rows
                if held == BLOCK:
                    yield emit()
                    kept, rows, held = [], [], 0
    if held:
        yield emit()


def _totals(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(part, entry, at, value): sums by component, and at -1 the number of parts, over the task's blocks."""
    books = shared.value
    counts = np.zeros(books.shape[:2], dtype=np.int64)
    sums = np.zeros(books.shape, dtype=np.int64)
    for batch in batches:
        for trees in batch.column(0):
            for part, tree in enumerate(trees):
                n, s = BallTree.from_bytes(tree.as_py()).totals(books[part])
                counts[part] += n
                sums[part] += s
    every = np.concatenate((counts[:, :, None], sums), axis=2)
    part, entry, at = np.nonzero(counts[:, :, None] * np.ones(every.shape, dtype=np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at - 1, pa.int32()),
         pa.array(every[part, entry, at], pa.int64())], names=["part", "entry", "at", "value"])


def _coded(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    books = shared.value
    for batch in batches:
        for i in range(batch.num_rows):
            found = [BallTree.from_bytes(tree.as_py()).owners(books[part]) for part, tree in enumerate(batch.column(1)[i])]
            codes = np.stack([owner for owner, _ in found], axis=1).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1).flatten(), pa.array([row.tobytes().hex() for row in codes], pa.string()),
                 pa.array(error, pa.int64())], schema=schema)


def fit_codebooks(trees: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, component] after ``rounds`` rounds from ``first``.

    A round is one pass over the trees; parts * entries * (components + 1) sums reach the driver.
    """
    books, spark = first, trees.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = (trees.select("trees").mapInArrow(lambda b: _totals(b, shared), "part int, entry int, at int, value bigint")
                .groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect())
        shared.destroy()
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
        for r in sums:
            total[r["part"], r["entry"], r["at"] + 1] = r["value"]
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable vector.

    A vector is left out when it is null or holds a null, NaN or infinite component. Its components become
    floor(scale * x) and are cut into ``parts`` equal consecutive parts; a vector shorter than the longest,
    or than a multiple of ``parts``, counts as if it ended in zeros. The codebooks start from the ``entries``
    smallest keys (null last; of equal keys by components), fewer where there are fewer vectors. A
    round assigns every part to its nearest entry, ties to the first, and replaces entries by the mean of their
    parts, floored; entries without parts stay. ``code`` is the final entries' numbers, two hex
    digits each, ``error`` the sum of the squared distances, ``label_error`` that sum over all vectors of a
    label (nulls are one). Repeated rows are coded singly, other columns ignored, and an empty table gives
    no rows. Squared distances of parts must stay below 2 ** 50; longer vectors raise ValueError. At most 256 entries.

    No vector is shuffled: the trees lie where a task has built them, in one written table. Errors
    are summed per label before they meet their rows again.
    """
    spark = vectors.sparkSession
    names = ["key", "label"]
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"),
                          whole_components(F.col(f"`{vector}`")).alias("v")).filter("v is not null")
    schema = f"{key} {rows.schema['key'].dataType.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(
        F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))).alias("most")).first()
    if shape["width"] is None:
        return spark.createDataFrame([], schema)
    each = -(-shape["width"] // parts)
    width = parts * each
    if each * (2 * (shape["most"] or 0.0)) ** 2 >= _EXACT:
        raise ValueError("components are too large for exact distances")
    seeds = rows.orderBy(F.asc_nulls_last("key"), "v").select("v").limit(entries).collect()
    first = _split(np.array([r["v"] + [0] * (width - len(r["v"])) for r in seeds], dtype=np.int64).reshape(len(seeds), width), parts)

    packed = rows.select(F.struct(*names).alias("kept"), "v")
    kind = packed.schema["kept"].dataType
    held = pa.schema([("kept", pa.list_(to_arrow_type(kind))), ("trees", pa.list_(pa.binary()))])
    trees = cut(packed.mapInArrow(lambda b: _block_trees(b, parts, width, held),
                                  f"kept array<{kind.simpleString()}>, trees array<binary>"))
    books = fit_codebooks(trees, first, rounds)
    shared = spark.sparkContext.broadcast(books)
    out = pa.schema([("kept", to_arrow_type(kind)), ("code", pa.string()), ("error", pa.int64())])
    coded = cut(trees.mapInArrow(lambda b: _coded(b, shared, out), f"kept {kind.simpleString()}, code string, error bigint")
                .select("kept.*", "code", "error"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
