"""Lempel-Ziv phrase fingerprints of documents.

A document is parsed into dictionary phrases: each phrase is the shortest piece that has
not occurred as a phrase before. Texts that would compress each other share many phrases. The
fingerprint holds the smallest hashes of the phrase set, and the likeness of two
fingerprints estimates the Jaccard similarity of the sets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Hashes kept; the standard error of a likeness is at most 0.5 / sqrt(HASHES).
HASHES = 64
#: Buckets of ids for each shuffle partition.
BUCKETS = 4

_NO_ID = -(1 << 63)


def parse(data: bytes, at: int, start: int, phrases: set[bytes]) -> int:
    """Go on parsing ``data`` from ``at``, where the open phrase began at ``start``.

    Adds to ``phrases`` and returns where the phrase that is open at the end began.
    """
    add = phrases.add
    for end in range(at + 1, len(data) + 1):
        phrase = data[start:end]
        if phrase not in phrases:
            add(phrase)
            start = end
    return start


def sketch(phrases: set[bytes], hashes: int = HASHES) -> np.ndarray:
    """The smallest distinct 32-bit hashes of a phrase set, rising."""
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), dtype=np.uint64, count=len(phrases))
    values = (values >> np.uint64(32)).astype(np.uint32)
    if len(values) > 2 * hashes:
        values = np.partition(values, 2 * hashes)[:2 * hashes]
    return np.unique(values)[:hashes]


def likeness(a: np.ndarray, b: np.ndarray, hashes: int = HASHES) -> float:
    """Share of the smallest hashes of both sets that lie in each; 1 for two empty sets."""
    union = np.union1d(a, b)[:hashes]
    return float(np.isin(union, np.intersect1d(a, b)).mean()) if len(union) else 1.0


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


class _Document(NamedTuple):
    doc_id: object
    text: str
    values: np.ndarray
    kept: bytes  # the first half, which the edited text shares
    open_at: int
    phrases: set[bytes]


def _read(doc_id, text: str | None, hashes: int) -> _Document:
    text = text or ""
    kept = text[:len(text) - len(text) // 2].encode()
    data = text.encode()
    phrases: set[bytes] = set()
    open_at = parse(kept, 0, 0, phrases)
    whole = set(phrases)
    parse(data, len(kept), open_at, whole)
    return _Document(doc_id, text, sketch(whole, hashes), kept, open_at, phrases)


def _compare(doc: _Document, nxt: _Document, hashes: int) -> tuple:
    half = len(doc.text) // 2
    edited = doc.kept + nxt.text[:half].encode()
    parse(edited, len(doc.kept), doc.open_at, doc.phrases)
    values = sketch(doc.phrases, hashes)
    return (doc.doc_id, len(doc.text), hashlib.sha256(edited).hexdigest(),
            to_text(doc.values), to_text(values),
            likeness(doc.values, values, hashes), likeness(doc.values, nxt.values, hashes))


def _pairs(batches: Iterator[pa.RecordBatch], hashes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each document with its successor; rows come by bucket, borrowed heads last."""
    bucket, open_, out = None, None, []
    for batch in batches:
        for row in range(batch.num_rows):
            at, borrowed, doc_id, text = (batch.column(c)[row].as_py() for c in range(4))
            if at == bucket and open_ is None:
                continue  # a further row with the id of the borrowed head
            doc = _read(doc_id, text, hashes)
            if at == bucket:
                out.append(_compare(open_, doc, hashes))
            bucket, open_ = at, None if borrowed else doc
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def fingerprint_edits(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Documents follow each other by falling doc_id (null ids last, equal ids by a
    hash of the text), the first after the last. Rows are dealt to buckets of ids, some for each shuffle
    partition, and the first row of each bucket is lent to the one before it, so no task
    sees more than one bucket and texts are shuffled once. An id with more rows than a bucket should have (such
    as null) is divided by the hash. Null texts are empty; two
    empty texts are alike (1.0); a single document follows itself; repeated rows are rows of
    their own; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("key"),
                       "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    count = BUCKETS * parts
    edges = rows.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 100 * count)
                     .alias("edges")).first()["edges"] if parts > 1 else []
    # an id that is several edges holds the rows of as many buckets
    edges, times = np.unique(np.array(edges or [], dtype=np.int64), return_counts=True)

    @F.pandas_udf("bigint")
    def bucket_of(key, hash_):
        import pandas as pd

        keys = key.to_numpy()
        coarse = np.searchsorted(edges, keys, "right")
        if not len(edges):
            return pd.Series(coarse.astype(np.int64))
        at = np.maximum(coarse - 1, 0)
        high = (hash_.to_numpy() >> 32) + (1 << 31)  # 0 to 2 ** 32, rising with the hash
        piece = np.where(keys == edges[at], high * times[at] >> 32, times[at])
        return pd.Series(coarse.astype(np.int64) * (count + 1) + piece)

    rows = rows.withColumn("bucket", bucket_of("key", "hash"))
    # one row per bucket: the largest id and hash, where the bucket above goes on
    heads = sorted((r["bucket"], r["head"]["key"], r["head"]["hash"]) for r in
                   rows.groupBy("bucket").agg(F.max(F.struct("key", "hash")).alias("head")).collect())
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ddl = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")
    if not heads:
        return spark.createDataFrame([], ddl)
    lent = F.create_map(*(x for (_, key, hash_), (above, _, _) in zip(heads, heads[1:] + heads[:1])
                          for x in (F.struct(F.lit(int(key)).cast("bigint").alias("key"), F.lit(int(hash_)).cast("bigint").alias("hash")),
                                    F.lit(int(above)).cast("bigint"))))
    lent_to = F.element_at(lent, F.struct("key", "hash"))
    targets = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("borrowed")),
                      F.struct(lent_to.alias("bucket"), F.lit(True).alias("borrowed")))
    dealt = (rows.withColumn("to", F.explode(F.filter(targets, lambda t: t["bucket"].isNotNull())))
             .select(F.col("to.bucket").alias("bucket"), F.col("to.borrowed").alias("borrowed"),
                     F.col("doc_id").cast("bigint").alias("doc_id"), "text", "key", "hash")
             .repartition(parts, "bucket")
             .sortWithinPartitions("bucket", "borrowed", F.desc("key"), F.desc("hash"), "text")
             .select("bucket", "borrowed", "doc_id", "text"))
    return dealt.mapInArrow(lambda batches: _pairs(batches, hashes, schema), ddl)
