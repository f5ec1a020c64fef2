"""Packing documents into fixed-length training sequences, in order.

The documents of a partition form one token stream. Cuts may fall at document ends,
at sentence ends and, where a sentence runs long, in between. A dynamic programme picks the
chain of cuts with the least padding plus truncation penalties:

    cost[j] = penalty[j] + min(cost[i] + limit - (at[j] - at[i]))   over at[j] - at[i] <= limit

``cost[i] + at[i]`` decides alone, so a monotone queue gives the minimum in constant time.
A window whose length is a power of two needs no padding and is a second transition.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lacuna.llm import words
from lacuna.operators.lineage import cut

SENTENCE_PENALTY = 8.0
BREAK_PENALTY = 64.0
WINDOW_COST = 8.0
#: Tokens planned at a time; the open window moves on to the next plan.
BLOCK = 1 << 18
#: Shortest window that may end at a power of two.
LEAST_WINDOW = 64
#: The merger's pattern tries every end of a run of white space and needs stack for each.
LONG_BLANK = 1 << 16
#: Rows that Python gets at a time.
BATCH = 1024

_BLANK = re.compile(r"\s++")


class Vocabulary(NamedTuple):
    """Files of one byte-level vocabulary, as they lie on every worker."""
    tokenizer: str  # for the tokenizers library
    ranks: str  # the same vocabulary as merge ranks
    pattern: str


@functools.lru_cache(maxsize=2)
def _merger(vocabulary: Vocabulary):
    import tiktoken

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks,
                             special_tokens={})


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: Vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.tokenizer)


@functools.lru_cache(maxsize=2)
def _special(vocabulary: Vocabulary) -> dict[str, int]:
    """Ids of the tokens that the tokenizer file adds to the vocabulary; read without building a tokenizer."""
    with open(vocabulary.tokenizer, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _blank_run(text: str) -> bool:
    """Has the text a run of white space that is too long for the merger's pattern?"""
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in _BLANK.finditer(text))


def encode(text: str | None, vocabulary: Vocabulary, special: Mapping[str, int] | None = None) -> np.ndarray:
    """Ids of the tokenizer file, then id 0.

    The merge ranks give the same ids several times faster; texts that spell a special token, or hold
    a run of LONG_BLANK characters of white space, go through the tokenizer itself.
    """
    text = text or ""
    special = _special(vocabulary) if special is None else special
    if any(token in text for token in special) or _blank_run(text):
        ids = _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = _merger(vocabulary).encode_ordinary(text)
    ids.append(0)
    return np.array(ids, dtype="<u4")


@functools.lru_cache(maxsize=2)
def _sentence_ends(vocabulary: Vocabulary, size: int) -> np.ndarray:
    """Per id below ``size``: does a sentence or a line end with it?"""
    merger = _merger(vocabulary)
    ends = np.zeros(max(size, merger.n_vocab), dtype=bool)
    for i in range(merger.n_vocab):
        token = merger.decode_single_token_bytes(i)
        ends[i] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in token
    return ends


def cut_points(size: int, document_ends: np.ndarray, sentence_ends: np.ndarray,
               limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where a stream of ``size`` tokens may be cut, ends included.

    Stretches without an end get cuts at every eighth of ``limit``.
    """
    natural = np.union1d(np.concatenate(([0], sentence_ends, document_ends)), [size])
    gaps = np.diff(natural)
    step = max(1, limit // 8)
    extra = [np.arange(natural[i] + step, natural[i + 1], step) for i in np.flatnonzero(gaps > step)]
    breaks = np.concatenate(extra) if extra else np.zeros(0, dtype=natural.dtype)
    at = np.union1d(natural, breaks)
    penalty = np.where(np.isin(at, breaks, assume_unique=True), BREAK_PENALTY, SENTENCE_PENALTY)
    penalty[np.isin(at, document_ends)] = 0.0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Indices into ``at`` of the cheapest chain from its first to its last position."""
    joins: list[tuple[int, int]] = []
    power = 1
    while power < limit:
        if power >= LEAST_WINDOW:
            i = np.searchsorted(at, at - power)
            j = np.flatnonzero(at[i] == at - power)
            joins += zip(j.tolist(), i[j].tolist())
        power *= 2
    joins.sort()
    joins.append((len(at), 0))
    place, fees = at.tolist(), (penalty + WINDOW_COST).tolist()
    cost, back = [0.0] * len(place), [0] * len(place)
    queue = deque([(float(place[0]), place[0], 0)])  # keys rise from left to right
    nxt = 0
    for j in range(1, len(place)):
        x = place[j]
        while queue[0][1] < x - limit:
            queue.popleft()
        least, origin = queue[0][0] - x + limit, queue[0][2]
        while joins[nxt][0] == j:
            i = joins[nxt][1]
            if cost[i] < least:
                least, origin = cost[i], i
            nxt += 1
        least += fees[j]
        cost[j], back[j] = least, origin
        key = least + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, x, j))
    chain, j = [len(place) - 1], len(place) - 1
    while j:
        j = back[j]
        chain.append(j)
    return chain[::-1]


class _Run(NamedTuple):
    """Tokens of one document from ``start`` on."""
    doc_id: object
    start: int
    ids: np.ndarray
    total: int


def _plan(runs: list[_Run], ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, starts of the runs, starts of the windows and the end of the stream)."""
    stream = np.concatenate([r.ids for r in runs])
    starts = np.cumsum([0] + [len(r.ids) for r in runs])
    sentences = np.flatnonzero(ends[stream]) + 1
    at, penalty = cut_points(len(stream), starts[1:], sentences, limit)
    return stream, starts, at[best_cuts(at, penalty, limit)]


def _pack_partition(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, special: Mapping[str, int],
                    limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    sentence_ends = _sentence_ends(vocabulary, 1 + max(special.values(), default=0))
    base, done = TaskContext.get().partitionId() << 33, 0
    runs: list[_Run] = []
    waiting = 0

    def emit(last: bool) -> pa.RecordBatch:
        nonlocal runs, waiting, done
        stream, starts, cuts = _plan(runs, sentence_ends, limit)
        stop = cuts[-1] if last else cuts[-2]
        raw = memoryview(stream.tobytes())
        edges = np.union1d(starts, cuts)
        edges = edges[edges <= stop]
        run = np.searchsorted(starts, edges[:-1], "right") - 1
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        sizes = np.diff(cuts)
        columns = [
            pa.array([runs[r].doc_id for r in run], schema.field(0).type),
            pa.array([runs[r].start + int(a - starts[r]) for r, a in zip(run, edges)], pa.int64()),
            pa.array(np.diff(edges), pa.int64()),
            pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist())], pa.int64()),
            pa.array([runs[r].total for r in run], pa.int64()),
            pa.array(base + done + window, pa.int64()),
            pa.array(edges[:-1] - cuts[window], pa.int64()),
            pa.array(sizes[window], pa.int64()),
            pa.array([raw[4 * a:4 * b].tobytes() for a, b in zip(edges.tolist(), edges[1:].tolist())], pa.binary())
            if len(schema) > 8 else None,
        ]
        done += len(cuts) - 1 if last else len(cuts) - 2
        rest = [r._replace(start=r.start + max(0, int(stop - a)), ids=r.ids[max(0, int(stop - a)):])
                for r, a, b in zip(runs, starts, starts[1:]) if b > stop]
        runs, waiting = rest, sum(len(r.ids) for r in rest)
        return pa.RecordBatch.from_arrays(columns[:len(schema)], schema=schema)

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            tokens = encode(texts[i].as_py(), vocabulary, special)
            runs.append(_Run(ids[i].as_py(), 0, tokens, len(tokens)))
            waiting += len(tokens)
            if waiting >= BLOCK:
                yield emit(last=False)
    if runs:
        yield emit(last=True)
    _tokenizer.cache_clear()  # rarely needed, and large


def pack(docs: DataFrame, vocabulary: Vocabulary, limit: int = 1024,
         with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``limit`` tokens.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens) and with ``with_ids`` the piece's ids as little-endian unsigned 32-bit
    numbers. A document is its ids and an end id 0; a null or empty text is that end
    alone, so each row, also a repeated one or one without id, gives at least one piece.
    The order is that of the input's partitions; no shuffle takes place, and a task
    that runs again packs its partition the same way; the pieces are written as a table. Only the last sequence of a
    partition is left unfilled. Memory holds one plan or one document, whichever is longer. Texts of any
    length are encoded whole, long runs of one character or of white space included.
    Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text")
    out = rows.select("doc_id").schema.simpleString()[len("struct<doc_id:"):-1]
    schema = (f"doc_id {out}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint, sequence_tokens bigint" + ", ids binary" * with_ids)
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(kind))] + [(name.split()[0], pa.int64()) for name in schema.split(", ")[1:8]]
    arrow = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    return cut(rows.mapInArrow(words.tidy(_pack_partition, vocabulary, _special(vocabulary), limit, arrow), schema), BATCH)
