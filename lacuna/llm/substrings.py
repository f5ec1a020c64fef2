"""Removing passages that an earlier document holds, found with FM-indexes.

A passage is a run of ``window`` words. Every window has an anchor: the least hash of the
word groups in it. Neighbouring windows with one anchor make a segment, and equal windows
have equal anchors wherever they occur, so segments can be dealt to shards by anchor. Only
segments whose anchor occurs in several documents are indexed, each different
segment once, for its earliest document. A shard is a compressed FM-index; its segments are searched
backwards through it, which gives matching statistics cut at ``window`` words, and for
every full match the earliest document in its interval.

An anchor that many different segments share, such as one in a footer with other words around it in
each document, would outgrow a shard. Its segments are cut again by a second family of anchors, and what is
still too much of one anchor into single windows, dealt by their own hashes. All go to shards of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import words
from lacuna.llm.fm_index import FMIndex
from lacuna.operators.lineage import cut

WINDOW = 50
#: Words in the groups that anchors are chosen from.
GROUP = 8
#: Words in a shard's index, about.
SHARD_WORDS = 1 << 18
#: Segments of an anchor with more than this part of a shard's words are cut again.
HOT_PART = 4
#: Rows that Python gets at a time.
BATCH = 1024

_U = np.uint64
_LAST = (1 << 63) - 1


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


#: Two odd bases and their inverses modulo 2 ** 64.
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the words of each run, from running sums."""
    out = []
    for base, inverse in _BASES:
        weighted = np.cumsum(words.mix(hashes + _U(base)) * _powers(len(hashes), base), dtype=_U)
        weighted = np.concatenate((np.zeros(1, dtype=_U), weighted))
        back = _powers(len(hashes) + 1, inverse)
        out.append(words.mix((weighted[ends] - weighted[starts]) * back[starts] + (ends - starts).astype(_U)))
    return out


def segments(hashes: np.ndarray, window: int, group: int,
             second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of each segment of a document, by either of two independent families."""
    grams = words.gram_hashes(hashes, group)
    anchors = _window_minima(words.mix(grams + _U(_BASES[1][0])) if second else grams, window - group + 1)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(anchors)) + 1))
    return starts, np.diff(np.append(starts, len(anchors))), anchors[starts]


def _segment_rows(batches: Iterator[pa.RecordBatch], window: int, group: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "text_hash", "start", "windows", "anchor", "seg_a", "seg_b"]
    types = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int64]
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in names]
        for key, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            hashes = words.word_hashes(words.split_words(text.as_py()))
            if len(hashes) < window:
                continue
            starts, counts, anchors = segments(hashes, window, group)
            a, b = _run_hashes(hashes, starts, starts + counts + window - 1)
            one = np.ones(len(starts), dtype=np.int64)
            for column, values in zip(out, (one * key, one * digest, starts, counts, anchors, a, b)):
                column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(t) if np.dtype(t).itemsize == 4 else np.concatenate(c).view(t))
                 for c, t in zip(out, types)], names=names)


def _segment_texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, anchor, seg_a, seg_b, hot, words) of the segments listed with each text."""
    names = ["key", "anchor", "seg_a", "seg_b", "hot", "words"]
    for batch in batches:
        rows: list[tuple] = []
        for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            split = words.split_words(text.as_py())
            for p in places:
                run = split[p["start"]:p["start"] + p["windows"] + window - 1]
                rows.append((key, p["anchor"], p["seg_a"], p["seg_b"], p["hot"], b" ".join(run)))
            if len(rows) >= 4096:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


_SMALLER = ("parent_a bigint, parent_b bigint, offset int, windows int, key bigint, anchor bigint, seg_a bigint, "
            "seg_b bigint, words binary")


def _smaller(batches: Iterator[pa.RecordBatch], window: int, group: int, single: bool) -> Iterator[pa.RecordBatch]:
    """Each segment (key, seg_a, seg_b, words) cut by second anchors, or into single windows."""
    names = [c.split()[0] for c in _SMALLER.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        for key, parent_a, parent_b, text in zip(*(c.to_pylist() for c in batch.columns)):
            run = text.split(b" ")
            hashes = words.word_hashes(run)
            if single:
                starts = np.arange(len(hashes) - window + 1)
                counts = np.ones(len(starts), dtype=np.int64)
            else:
                starts, counts, anchors = segments(hashes, window, group, second=True)
            seg_a, seg_b = (h.view(np.int64).tolist() for h in _run_hashes(hashes, starts, starts + counts + window - 1))
            named = seg_a if single else anchors.view(np.int64).tolist()
            rows += [(parent_a, parent_b, at, n, key, anchor, a, b, b" ".join(run[at:at + n + window - 1]))
                     for at, n, anchor, a, b in zip(starts.tolist(), counts.tolist(), named, seg_a, seg_b)]
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _hot_anchors(segments_: DataFrame, size: Column, shard_words: int) -> DataFrame:
    """(anchor, hot): anchors whose different segments are too much for a part of a shard."""
    return segments_.groupBy("anchor").agg(F.sum(size).alias("words")).filter(
        F.col("words") * HOT_PART > shard_words).select("anchor", F.lit(True).alias("hot"))


def _different(pieces: DataFrame) -> DataFrame:
    """Each different segment once, for its earliest document."""
    return pieces.groupBy("anchor", "seg_a", "seg_b").agg(F.min("key").alias("key"), F.first("words").alias("words"))


def _runs_of_parents(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """(seg_a, seg_b, runs) of the segments that ``pieces`` were cut from; a piece that was not searched is its own first."""
    shifted = F.transform("runs", lambda r: F.struct(
        (r["at"] + F.col("offset")).alias("at"), (r["end"] + F.col("offset")).alias("end"), r["least"].alias("least")))
    own = F.array(F.struct(F.col("offset").cast("bigint").alias("at"),
                           (F.col("offset") + F.col("windows")).cast("bigint").alias("end"), F.col("key").alias("least")))
    return (pieces.join(found, ["seg_a", "seg_b"], "left")
            .groupBy(F.col("parent_a").alias("seg_a"), F.col("parent_b").alias("seg_b"))
            .agg(F.flatten(F.collect_list(F.coalesce(shifted, own))).alias("runs")))


def _search(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Index the segments of one shard and look each of them up."""
    codes: dict[bytes, int] = {}
    parts: list[int] = []
    lengths = []
    for _, _, _, text in rows:
        run = text.split(b" ")
        parts += [codes.setdefault(w, len(codes) + 1) for w in run]
        parts.append(0)
        lengths.append(len(run))
    text = np.array(parts, dtype=np.int64)
    sizes = np.array(lengths, dtype=np.int64)
    owners = np.array([r[0] for r in rows], dtype=np.int64)
    index = FMIndex(text, np.repeat(owners, sizes + 1), window)
    firsts = index.least_owners(text, np.cumsum(sizes + 1) - sizes - 1, sizes)
    runs = []
    for owner in firsts:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
        ends = np.append(starts[1:], len(owner))
        runs.append([{"at": a, "end": b, "least": c} for a, b, c in zip(starts.tolist(), ends.tolist(), owner[starts].tolist())])
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("at", "end", "least")]))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(runs, kind)],
        names=["seg_a", "seg_b", "runs"])


def _search_shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard; one shard is held at a time."""
    shard, rows = None, []
    for batch in batches:
        for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if at != shard and rows:
                yield _search(rows, window)
                rows = []
            shard = at
            rows.append(tuple(row))
    if rows:
        yield _search(rows, window)


def _searched(pieces: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(seg_a, seg_b, runs): where the earliest document of a segment's windows changes, found in shards."""
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, int(size // (6 * shard_words)))
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
             .repartition(parts, "shard").sortWithinPartitions("shard", "seg_a", "seg_b")
             .select("shard", "key", "seg_a", "seg_b", "words"))
    return cut(dealt.mapInArrow(
        words.tidy(_search_shards, window),
        "seg_a bigint, seg_b bigint, runs array<struct<at: bigint, end: bigint, least: bigint>>"), BATCH)


def _cut_again(hot: DataFrame, pieces: DataFrame, window: int, group: int,
               shard_words: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """``pieces`` with what the hot segments become, and the two tables of smaller segments.

    Equal windows have equal second anchors, and a window by itself has its own hash, of which there is one
    different segment. A smaller segment whose second anchor lies in one hot segment alone needs no search.
    """
    columns = ["anchor", "seg_a", "seg_b", "key", "words"]
    cutting = ["key", "seg_a", "seg_b", "words"]
    second = cut(hot.select(*cutting).mapInArrow(words.tidy(_smaller, window, group, False), _SMALLER), BATCH)
    several = second.groupBy("anchor").agg(
        F.min(F.struct("parent_a", "parent_b")).alias("least"), F.max(F.struct("parent_a", "parent_b")).alias("most"))
    different = cut(_different(second.join(several.filter("least <> most").select("anchor"), "anchor")))
    heavy = _hot_anchors(different, F.octet_length("words") / 6, shard_words)
    marked = cut(different.join(heavy, "anchor", "left"))
    windows = cut(marked.filter("hot").select(*cutting).mapInArrow(
        words.tidy(_smaller, window, group, True), _SMALLER), BATCH)
    pieces = (pieces.unionByName(marked.filter("hot is null").select(*columns))
              .unionByName(_different(windows).select(*columns)))
    return cut(pieces), (second, windows)


def repeated_windows(docs: DataFrame, window: int = WINDOW, group: int = GROUP,
                     shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, text_hash, spans): per document the runs [from, to) of words to remove.

    ``docs`` holds (key, text_hash, text). Documents without such words have no row. A
    document's list is bounded by its length.
    """
    rows = cut(docs.mapInArrow(
        words.tidy(_segment_rows, window, group),
        "key bigint, text_hash bigint, start int, windows int, anchor bigint, seg_a bigint, seg_b bigint"), BATCH)
    several = cut(rows.groupBy("anchor").agg(F.min("key").alias("first"), F.max("key").alias("last"))
                  .filter("first < last").select("anchor"))
    shared = cut(rows.join(several, "anchor"))

    # one occurrence of each different segment, the earliest, goes into the index
    chosen = cut(shared.groupBy("anchor", "seg_a", "seg_b").agg(
        F.min(F.struct("key", "text_hash", "start", "windows")).alias("rep")))
    heavy = cut(_hot_anchors(chosen, F.col("rep.windows") + (window - 1), shard_words))
    marked = chosen.join(heavy, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_doc = marked.groupBy(F.col("rep.key").alias("key"), F.col("rep.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct(F.col("rep.start").alias("start"), F.col("rep.windows").alias("windows"),
                                "anchor", "seg_a", "seg_b", "hot")).alias("places"))
    texts = docs.join(per_doc, ["key", "text_hash"]).select("key", "text", "places", "text_hash")
    texts = texts.dropDuplicates(["key", "text_hash"]).select("key", "text", "places")
    indexed = cut(texts.mapInArrow(
        words.tidy(_segment_texts, window),
        "key bigint, anchor bigint, seg_a bigint, seg_b bigint, hot boolean, words binary"), BATCH)

    columns = ["anchor", "seg_a", "seg_b", "key", "words"]
    pieces, again = indexed.filter("not hot").select(*columns), []
    if not heavy.isEmpty():
        pieces, again = _cut_again(indexed.filter("hot"), pieces, window, group, shard_words)
    found = _searched(pieces, window, shard_words)
    if again:
        second, windows = again
        known = found.unionByName(cut(_runs_of_parents(windows, found)))
        found = cut(found.unionByName(_runs_of_parents(second, known)))

    # runs of windows whose earliest document lies before this one
    hit = shared.join(found, ["seg_a", "seg_b"])
    spans = F.transform(
        F.filter("runs", lambda r: r["least"] < F.col("key")),
        lambda r: F.struct((F.col("start") + r["at"]).cast("int").alias("from"),
                           (F.col("start") + r["end"] + (window - 1)).cast("int").alias("to")))
    return (hit.select("key", "text_hash", spans.alias("spans")).filter(F.size("spans") > 0)
            .groupBy("key", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _cut_texts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept, digests = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py()
            split = words.split_words(text)
            mask = np.zeros(len(split) + 1, dtype=np.int32)
            for span in spans or ():
                mask[span["from"]] += 1
                mask[span["to"]] -= 1
            gone = np.cumsum(mask)[:-1] > 0
            left = [w for w, out in zip(split, gone.tolist()) if not out] if gone.any() else split
            joined = b" ".join(left)
            counts.append(len(split))
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode() if removed[-1] else text)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(digests, pa.string()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns[:len(schema)], schema=schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False,
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_words, n_removed, kept_sha256 and, if asked, kept_text.

    A word goes when a window that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. kept_sha256 is the digest of the words that
    stay, joined by spaces; kept_text is that text where words went, else the text as it was.
    Null texts have no words, and texts shorter than a window lose none. Null ids count as
    greater than all others; rows that share an id are not before each other, and equal
    rows are treated alike. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), key.alias("key"),
                       F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_windows(rows.select("key", "text_hash", "text"), window)
    joined = rows.join(spans, ["key", "text_hash"], "left").select("kept", "text", "spans")
    from pyspark.sql.pandas.types import to_arrow_type

    kept = rows.schema["kept"].dataType
    fields = [("kept", to_arrow_type(kept)), ("n_words", pa.int64()), ("n_removed", pa.int64()),
              ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
    ddl = (f"kept {kept.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
           + ", kept_text string" * with_text)
    out = cut(joined.mapInArrow(words.tidy(_cut_texts, pa.schema(fields)), ddl), BATCH)
    return out.select("kept.*", "n_words", "n_removed", "kept_sha256", *(["kept_text"] * with_text))
