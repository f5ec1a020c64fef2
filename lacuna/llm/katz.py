"""Katz backoff scores of documents under an n-gram model trained on the corpus.

    P(w | h) = d(c) c(h w) / c(h)              if h w was seen c > 0 times in training
             = a(h) P(w | h')                  else; h' is h without its first word, and a(h) makes all sums one
    P(w)     = d(c) c(w) / N, and what the discounts leave for all unknown words together

Discounts are Good-Turing's, by order, up to LARGE; larger counts keep a constant share, so that every
history has something to give to unseen words. A history that was never seen backs off
with weight one.

Documents are read once, into batches with a dictionary of their words. All histories that end in one word
live in one bin, which therefore has whatever the recursion needs, but for the count of the
predicted word. So batches first ask for counts of their words, each once per batch, and then
deal their n-grams, with the documents they occur in, to the bins. A history with more
tokens than a bin should hold is treated as the empty one is: its continuations are counted
by asking, and its n-grams go by the next longer history, or by none.

Discounts follow from the counts of all bins. What was seen needs nothing else, so a bin adds it up by document
and class of count. For the rest it stores tables: the n-grams of histories that somebody
continues in an unseen way, and totals of one-word histories. Weights and probabilities are found
from them, table by table, by the recursion above.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import words
from lacuna.operators.lineage import arrow_rows, cut, work_folder

ORDER = 3
LARGE = 5
#: Tokens and documents of a batch, and tokens of a bin.
BATCH_TOKENS, BATCH_DOCS = 5 << 18, 1 << 15
BIN_TOKENS = 1 << 20
#: Least and most tasks among which bins are divided, and bins that a task takes before there are more tasks.
LEAST_TASKS, MOST_TASKS, TASK_BINS = 24, 8192, 16
#: Words with at least this share of training tokens travel as short numbers; at most 1 / FREQUENT are.
FREQUENT = 2.0 ** -20
#: Histories with a smaller share of all tokens are never spread; so 1 / SHARE of a length at most are.
SHARE = 2.0 ** -16
#: Wide rows that Python gets at a time, and bytes of sums that a task holds.
ROWS, HELD_BYTES = 16, 1 << 25

_U = np.uint64
_START, _END = _U(0x5354415254), _U(0x454E44)
_GOLD = _U(0x9E3779B97F4A7C15)


def discounts(classes: np.ndarray) -> np.ndarray:
    """Shares that counts 1, 2, .. LARGE and larger ones keep.

    ``classes`` has the number of types seen once, twice, .. LARGE + 1 times. Good-Turing
    estimates are used if all lie between 0 and 1; else half a count is taken.
    """
    r = np.arange(1, LARGE + 1)
    n = classes[:LARGE + 1].astype(float)
    small = (r - 0.5) / r
    if (n > 0).all() and (LARGE + 1) * n[LARGE] < n[0]:
        most = (LARGE + 1) * n[LARGE] / n[0]
        turing = ((r + 1) * n[1:] / (r * n[:-1]) - most) / (1 - most)
        if ((turing > 0) & (turing < 1)).all():
            small = turing
    return np.append(small, 1 - (1 - small[-1]) / 4)


class Unigrams:
    """Discounted word probabilities."""

    def __init__(self, tokens: int, types: int, classes: np.ndarray):
        self.tokens, self.types = tokens, types
        self.keep = discounts(classes)
        r = np.arange(1, LARGE + 1)
        small = classes[:LARGE] * r
        kept = float((small * self.keep[:-1]).sum() + (tokens - small.sum()) * self.keep[-1])
        self.unknown = 1 - kept / tokens if tokens else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        share = self.keep[np.clip(counts, 1, LARGE + 1) - 1]
        return np.where(counts > 0, counts * share / max(1, self.tokens), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def _pack(*columns: np.ndarray) -> bytes:
    sizes = np.array([c.nbytes for c in columns], dtype=np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)]), 3)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    sizes = np.frombuffer(data, dtype=np.int64, count=len(types))
    ends = np.cumsum(sizes) + sizes.nbytes
    return [np.frombuffer(data[end - size:end], dtype=t) for t, size, end in zip(types, sizes, ends)]


def _planes(values: np.ndarray) -> np.ndarray:
    """The low 48 bits, byte by byte; packs better than whole words."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].T.copy()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(planes) // 6, 8), dtype=np.uint8)
    out[:, :6] = planes.reshape(6, -1).T
    return out.view(_U).ravel()


def _tokens(text: str | None) -> np.ndarray:
    return np.append(words.word_hashes(words.split_words(text, lower=True)), _END)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of values that mostly rise, byte by byte."""
    return np.diff(values, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _from_steps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.reshape(8, -1).T.copy().view(_U).ravel(), dtype=_U)


def _bins(keys: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each key; rises with the key."""
    return (((keys >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    edges = np.append(np.flatnonzero(np.diff(values, prepend=values[0] - 1)), len(values)).tolist() if len(values) else []
    return list(zip(edges, edges[1:]))


def _classes(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, .. LARGE + 1 and more."""
    return np.bincount(np.minimum(counts, LARGE + 2), minlength=LARGE + 3)[1:]


def _before(values: np.ndarray, lengths: np.ndarray, k: int, start) -> np.ndarray:
    """The value ``k`` tokens earlier in the text, or ``start``."""
    out = np.roll(values, k)
    first = np.cumsum(lengths) - lengths
    for i in range(k):
        out[first[lengths > i] + i] = start
    return out


def _longer(history: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """History of ``k`` words from the shorter one and the word before it."""
    return words.mix(history * _GOLD + word + _U(k))


def _histories(word: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, .. order - 1 tokens before each token; texts begin with starts."""
    out, history = [], np.zeros(len(word), dtype=_U)
    for k in range(1, order):
        history = _longer(history, _before(word, lengths, k, _START), k)
        out.append(history)
    return out


def _grams(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return words.mix((history ^ _U(0x6772616D)) * _GOLD + word)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time; blobs do not leave the batch before they are asked for."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(column[row].as_py() for column in batch.columns)


# -- batches of documents ------------------------------------------------------

_BATCH = pa.schema([("batch", pa.int64()), ("tokens", pa.int64()), ("learnt", pa.int64()), ("docs", pa.binary()),
                    ("body", pa.binary()), ("often", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Batches of documents: ids, tokens by dictionary, and the histories that are frequent in the batch."""
    task, number = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    held: list[bool] = []
    texts: list[np.ndarray] = []
    size = 0

    def emit() -> pa.RecordBatch:
        nonlocal ids, held, texts, size, number
        lengths = np.array([len(t) for t in texts])
        word = np.concatenate(texts)
        names, codes = np.unique(word, return_inverse=True)
        often, of = [], np.arange(len(word))
        for history in _histories(word, lengths, order):
            # only what continues a frequent history can be frequent
            keys, at, n = np.unique(history[of], return_inverse=True, return_counts=True)
            enough = n >= size * SHARE
            often += [keys[enough], n[enough]]
            of = of[enough[at]]
        out = np.array(held)
        docs = _pack(np.array([x or 0 for x in ids], dtype=np.int64), np.array([x is None for x in ids]), out, lengths)
        row = ((task << 24) + number, size, int(lengths[~out].sum()), docs,
               _pack(_steps(names), codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), _pack(*often))
        ids, held, texts, size, number = [], [], [], 0, number + 1
        return _table([row], _BATCH)

    for batch in words.slices(batches):
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids.append(doc)
            held.append(out)
            texts.append(_tokens(text.as_py()))
            size += len(texts[-1])
            if size >= BATCH_TOKENS or len(ids) == BATCH_DOCS:
                yield emit()
    if ids:
        yield emit()


def _frequent(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(k, history, n): histories of length k that are frequent in some batch."""
    for (blob,) in _each(batches):
        columns = _unpack(blob, *[_U, np.int64] * (order - 1))
        for k in range(1, order):
            keys, n = columns[2 * k - 2:2 * k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, dtype=np.int32)), pa.array(keys.view(np.int64)),
                                              pa.array(n)], names=["k", "history", "n"])


class Frequent:
    """Words that travel as numbers, by falling count; number 0 stands for all others."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.lexsort((names, -counts))
        # the start of texts is no word to be predicted, so its count is never asked for
        self.names = np.concatenate((np.array([0, _START], dtype=_U), names[order]))
        self.counts = np.concatenate((np.zeros(2, dtype=np.int64), counts[order]))
        self.order = np.argsort(self.names[1:]) + 1
        self.sorted = self.names[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.sorted, hashes)
        found = self.order[np.minimum(at, len(self.order) - 1)]
        return np.where(self.names[found] == hashes, found, 0).astype(np.uint32)

    def pack(self, numbers: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        """Two columns: the numbers byte by byte, and 40 bits of the hashes of words without one."""
        return [np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 4)[:, :3].T.copy(), _planes(hashes[numbers == 0])[:5]]

    def unpack(self, planes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, hashes)"""
        wide = np.zeros((len(planes) // 3, 4), dtype=np.uint8)
        wide[:, :3] = planes.reshape(3, -1).T
        numbers = wide.view(np.uint32).ravel()
        hashes = self.names[numbers]
        hashes[numbers == 0] = _from_planes(np.append(rest, np.zeros(len(rest) // 5, dtype=np.uint8)))
        return numbers, hashes


class _Batch:
    """A batch with the place of each history among the spread ones."""

    def __init__(self, docs: bytes, body: bytes, spread: list[np.ndarray]):
        self.order = len(spread) + 1
        self.ids, self.missing, self.held, self.lengths = _unpack(docs, np.int64, np.bool_, np.bool_, np.int64)
        names, codes = _unpack(body, np.uint8, np.uint8)
        self.names = _from_steps(names)
        self.codes = codes.reshape(4, -1).T.copy().view(np.uint32).ravel()
        self.word = self.names[self.codes]
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.uint16), self.lengths)
        self.learnt = ~self.held[self.doc]
        self.histories = _histories(self.word, self.lengths, self.order)
        # depth: how many histories of a token, from the shortest on, are spread; chain: which ones
        self.depth = np.zeros(len(self.word), dtype=np.int8)
        self.chain = []
        for k, (keys, history) in enumerate(zip(spread, self.histories)):
            at = np.minimum(np.searchsorted(keys, history), max(0, len(keys) - 1))
            found = (keys[at] == history if len(keys) else np.zeros(len(history), dtype=bool)) & (self.depth == k)
            self.depth += found
            self.chain.append(np.where(found, at, 0).astype(np.uint32))

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """(keys, rising; their orders; learnt occurrences; per order the tokens that ask, the place of each one's
        key among the keys, and one of the askers, by number, for each key).

        Keys are all words, and the n-grams of spread histories.
        """
        keys, learnt, levels, askers, places, ones = [], [], [], [], [], []
        size = 0
        for k in range(self.order):
            of = np.flatnonzero(self.depth >= k) if k else np.arange(len(self.word))
            if k:
                names, one, at = np.unique(_grams(self.histories[k - 1][of], self.word[of]), return_index=True, return_inverse=True)
            else:
                names, one, at = self.names, np.zeros(0, dtype=np.int64), self.codes.astype(np.int64)
            keys.append(names)
            learnt.append(np.bincount(at, weights=self.learnt[of], minlength=len(names)))
            levels.append(np.full(len(names), k, dtype=np.uint8))
            askers.append(of)
            places.append(at + size)
            ones.append(one)
            size += len(names)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.arange(size)
        return (flat[order], np.concatenate(levels)[order], np.concatenate(learnt)[order].astype(np.uint32),
                askers, [rank[at] for at in places], ones)


# -- counting by asking --------------------------------------------------------

_ASK = pa.schema([("bin", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
_ASK_DDL = "bin bigint, batch bigint, blob binary"


def _ask(batches: Iterator[pa.RecordBatch], spread: list[np.ndarray], bins: int) -> Iterator[pa.RecordBatch]:
    for number, docs, body in _each(batches):
        keys, levels, learnt, *_ = _Batch(docs, body, spread).asked()
        bin_ = _bins(keys, bins)
        yield _table([(int(bin_[a]), number, _pack(_steps(keys[a:b]), levels[a:b], learnt[a:b])) for a, b in _runs(bin_)], _ASK)


def _answer(batches: Iterator[pa.RecordBatch], order: int, frequent: float) -> Iterator[pa.RecordBatch]:
    """Each batch's keys of a bin with their counts; one batch is told to report a key.

    Bin -2 has words seen at least ``frequent`` times, and bin -1, at last, classes of counts.
    """
    classes = np.zeros((order, LARGE + 2), dtype=np.int64)
    for bin_, rows in groupby(_each(batches), lambda row: row[0]):
        numbers, blobs = zip(*(row[1:] for row in rows))
        keys, levels, learnt = zip(*(_unpack(blob, np.uint8, np.uint8, np.uint32) for blob in blobs))
        keys = [_from_steps(k) for k in keys]
        ends = np.cumsum([len(k) for k in keys])
        names, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(learnt), minlength=len(first)).astype(np.int64)
        level = np.concatenate(levels)[first]
        often = (level == 0) & (count >= frequent)
        if often.any():
            yield _table([(-2, -1, _pack(names[often], count[often]))], _ASK)
        for k in range(order):
            classes[k] += _classes(count[level == k])
        report = np.zeros(len(at), dtype=bool)
        report[first] = count > 0
        count = count[at].view(_U)
        yield _table([(bin_, number, _pack(_planes(count[end - len(k):end]), report[end - len(k):end]))
                      for number, k, end in zip(numbers, keys, ends.tolist())], _ASK)
    yield _table([(-1, -1, _pack(classes))], _ASK)


# -- dealing n-grams to the bins of their histories ------------------------------

#: Kinds of rows below a number of spread histories are n-grams with so many of them.
_DOCS, _SUMS, _MORE, _CLASS_ROW, _REPORT = 100, 101, 102, 103, 200
_DEAL = pa.schema([("part", pa.int32()), ("bin", pa.int64()), ("kind", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])
_DEAL_DDL = "part int, bin bigint, kind int, batch bigint, blob binary"


def _lengths(flags: np.ndarray) -> np.ndarray:
    """Lengths of the runs that the flags begin."""
    return np.diff(np.append(np.flatnonzero(flags), len(flags))).astype(np.uint32)


def _deal(batches: Iterator[pa.RecordBatch], spread: list[np.ndarray], uni: Unigrams, frequent: Frequent, bins: int,
          per_part: int) -> Iterator[pa.RecordBatch]:
    """A batch's documents, n-grams by bin, and the continuations of spread histories that it reports."""
    for number, docs, body, answers in _each(batches):
        batch = _Batch(docs, body, spread)
        order, lengths = batch.order, batch.lengths
        counts, report = zip(*(_unpack(a["blob"], np.uint8, np.bool_) for a in sorted(answers, key=lambda a: a["bin"])))
        count = np.concatenate([_from_planes(c) for c in counts])
        if not (count >> _U(32)).any():
            count = count.astype(np.uint32)
        report = np.concatenate(report)
        _, _, _, askers, places, ones = batch.asked()
        known = [count[places[0]]]  # counts as far as they were asked for
        for of, at in zip(askers[1:], places[1:]):
            known.append(np.zeros(len(batch.word), dtype=count.dtype))
            known[-1][of] = count[at]

        spare = int(words.mix(np.array([number], dtype=_U))[0] % _U(bins))
        here = spare // per_part
        base = np.bincount(batch.doc, weights=uni.base(known[0].astype(np.int64)), minlength=len(batch.ids))
        out = [(here, spare, _DOCS, number, _pack(batch.ids, batch.missing, batch.held, lengths, base,
                                                  np.bincount(batch.doc[known[0] > 0], minlength=len(batch.ids))))]
        for k in range(1, order):
            told = askers[k][ones[k][report[places[k][ones[k]]]]]
            if len(told):
                out.append((here, spare, _REPORT + k, number, _pack(
                    *(batch.chain[i][told] for i in range(k)), *(known[i][told].astype(np.int64) for i in range(k + 1)))))
        yield _table(out, _DEAL)
        numbers = np.append(frequent.numbers(batch.names), np.uint32(1))  # the start is number 1
        named = np.append(batch.names, _START)
        del count, report, askers, places, ones, answers
        gram = _grams(batch.histories[-1], batch.word)
        mark = batch.doc | (batch.held[batch.doc].astype(np.uint16) << np.uint16(15))
        for depth in range(order):
            of = np.flatnonzero(batch.depth == depth)
            if not len(of):
                continue
            local = depth < order - 1
            route = batch.histories[depth][of] if local else np.zeros(len(of), dtype=_U)
            sort = np.argsort((route & ~_U(0xFFFFFFFF)) | (gram[of] >> _U(32)), kind="stable")
            of, route = of[sort], route[sort]
            new_gram = np.append(True, gram[of][1:] != gram[of][:-1])
            new_row = new_gram | np.append(True, mark[of][1:] != mark[of][:-1])
            at = np.flatnonzero(new_row)  # one row per n-gram and document
            times = _lengths(new_row)
            first = np.flatnonzero(new_gram[at])  # rows that begin an n-gram
            width = _lengths(new_gram[at])
            of, route = of[at], route[at][first]
            one, rows_of = of[first], np.append(first, len(at))
            # words of the n-gram: the farthest of the route, what is before it, and the last one
            said = [_before(batch.codes, lengths, k + 1, len(batch.names))[one] for k in range(depth, order - 1)] if local else []
            last = batch.codes[one]
            bin_ = _bins(route, bins) if local else np.full(len(one), spare)
            del sort, new_gram, new_row, at, first
            out = []
            for a, b in _runs(bin_):
                i, part = slice(rows_of[a], rows_of[b]), one[a:b]
                columns = [np.ascontiguousarray(mark[of[i]]).view(np.uint8).reshape(-1, 2).T, times[i], width[a:b]]
                heads = np.append(True, route[a:b][1:] != route[a:b][:-1]) if local else np.ones(b - a, dtype=bool)
                columns += [_lengths(heads), *(batch.chain[k][part[heads]] for k in range(depth))]
                columns += [_planes(known[k][part].astype(_U)) for k in range(1, depth + 1)]
                if local:
                    columns += frequent.pack(numbers[said[0][a:b][heads]], named[said[0][a:b][heads]])
                    for codes in said[1:]:
                        columns += frequent.pack(numbers[codes[a:b]], named[codes[a:b]])
                    columns += frequent.pack(numbers[last[a:b]], named[last[a:b]])
                columns.append(_planes((known[0][part][numbers[last[a:b]] == 0] if local else known[0][part]).astype(_U)))
                out.append((int(bin_[a]) // per_part, int(bin_[a]), depth, number, _pack(*columns)))
            yield _table(out, _DEAL)


def _dealt(blob: bytes, depth: int, order: int, frequent: Frequent) -> list[np.ndarray]:
    """(mark, times, width, chain.., route, words.., counts..) as dealt, one value per row for the first two and per n-gram for the others."""
    local = order - depth if depth < order - 1 else 0
    mark, times, width, heads, *rest = _unpack(
        blob, np.uint8, np.uint32, np.uint32, np.uint32, *[np.uint32] * depth, *[np.uint8] * (depth + 2 * local + 1))
    mark = mark.reshape(2, -1).T.copy().view(np.uint16).ravel()
    chain = [np.repeat(c, heads) for c in rest[:depth]]
    counts = [_from_planes(c) for c in rest[depth:2 * depth]]
    rest = rest[2 * depth:]
    said = []
    for i in range(local):
        numbers, hashes = frequent.unpack(rest[2 * i], rest[2 * i + 1])
        said.append(np.repeat(hashes, heads) if i == 0 else hashes)
    words_seen = _from_planes(rest[-1]).view(np.int64)
    if local:
        all_words = frequent.counts[numbers]
        all_words[numbers == 0] = words_seen
        words_seen = all_words
    return [mark, times, width, *chain, *said, words_seen, *(c.view(np.int64) for c in counts)]


def _gather(batches: Iterator[pa.RecordBatch], order: int, uni: Unigrams, frequent: Frequent, per_part: int) -> Iterator[pa.RecordBatch]:
    """What a bin knows of its n-grams.

    Sums of documents over n-grams that were seen: logarithms of c / c(h), and how many had a count of each class; and
    one row for each bin and depth with what the others need. Rows of other kinds pass; at last come classes of counts.
    """
    classes = np.zeros((order, LARGE + 2), dtype=np.int64)
    sums = _Sums(1 + LARGE + 1)

    def rows_of_sums() -> pa.RecordBatch:
        return _table([(-1, -1, _SUMS, number, blob) for number, blob in sums.flush()], _DEAL)

    for (bin_, depth), rows in groupby(_each(batches), lambda row: row[1:3]):
        if depth >= _DOCS:
            for row in rows:
                yield _table([row], _DEAL)
            continue
        numbers, columns = [], []
        for row in rows:
            numbers.append(row[3])
            columns.append(_dealt(row[4], depth, order, frequent))
        numbers = np.array(numbers, dtype=np.int64)
        owner = np.repeat(np.arange(len(numbers), dtype=np.uint32), [len(c[0]) for c in columns])
        mark, times, width, *rest = map(np.concatenate, zip(*columns))
        del columns
        of = np.repeat(np.arange(len(width)), width)
        chain, rest = rest[:depth], rest[depth:]
        if depth == order - 1:
            yield _table([(bin_ // per_part, bin_, depth, len(numbers), _pack(
                numbers, owner, mark, times, of.astype(np.uint32), *chain, *rest))], _DEAL)
            continue
        *said, word = rest[:order - depth]
        counts = rest[order - depth:]
        history = chain[-1].astype(_U) if chain else np.zeros(len(word), dtype=_U)
        histories = []
        for k, name in enumerate(said, depth + 1):
            history = _longer(history, name, k)
            histories.append(history)
        _, first, at = np.unique(_grams(history, word), return_index=True, return_inverse=True)
        of = at[of]  # the same n-gram of several batches becomes one
        chain, counts, histories, word = ([x[first] for x in chain], [x[first] for x in counts],
                                          [x[first] for x in histories], word[first])
        held = (mark >> 15).astype(bool)
        seen = np.bincount(of, weights=np.where(held, 0, times), minlength=len(first)).astype(np.int64)
        groups, firsts = [], []
        for k, history in enumerate(histories):
            is_first = np.ones(len(word), dtype=bool)
            count = seen
            if k < len(histories) - 1:
                _, one, at = np.unique(_grams(history, word), return_index=True, return_inverse=True)
                count = np.bincount(at, weights=seen, minlength=len(one)).astype(np.int64)[at]
                is_first = np.zeros(len(word), dtype=bool)
                is_first[one] = True
            classes[depth + 1 + k] += _classes(count[is_first])
            counts.append(count)
            firsts.append(is_first)
            groups.append(np.unique(history, return_inverse=True)[1])

        # documents' sums over what was seen
        total = np.bincount(groups[-1], weights=seen)[groups[-1]]
        sure = seen[of] > 0
        gram = of[sure]
        value = times[sure] * np.log10(seen[gram] / total[gram])
        sums.add(numbers, owner[sure], mark[sure] & 0x7FFF, [value], np.minimum(seen[gram], LARGE + 1), times[sure])
        if sums.nbytes > HELD_BYTES:
            yield rows_of_sums()

        # tables for what was not
        asked = ~sure
        if not asked.any():
            continue
        needs = np.zeros(len(word), dtype=bool)
        needs[of[asked]] = True
        if order > 2:  # all n-grams of the histories of two or more words, the shortest of them here
            shortest = groups[1 if depth == 0 else 0]
            wanted = np.zeros(int(shortest.max()) + 1, dtype=bool)
            wanted[shortest[needs]] = True
            needs = wanted[shortest]
        whole = []
        if depth == 0:  # one-word histories: occurrences by class, and what is given to the words seen
            c = np.where(firsts[0], counts[1], 0)
            names, at = np.unique(groups[0][needs], return_inverse=True)
            by_class = [np.bincount(groups[0], weights=c * (np.minimum(c, LARGE + 1) == r))[names] for r in range(1, LARGE + 2)]
            lower = np.bincount(groups[0], weights=(c > 0) * uni.probability(counts[0]))[names]
            whole = [at.astype(np.uint32), lower, *by_class]
        later = 1 if depth == 0 else 0
        place = np.cumsum(needs) - 1
        yield _table([(bin_ // per_part, bin_, depth, len(numbers), _pack(
            numbers, owner[asked], mark[asked], times[asked], place[of[asked]].astype(np.uint32),
            *(x[needs] for x in chain), *(x[needs] for x in counts),
            *(np.unique(g[needs], return_inverse=True)[1].astype(np.uint32) for g in groups[later:]),
            *(x[needs] for x in firsts[later:]), *whole))], _DEAL)
    if sums.tables:
        yield rows_of_sums()
    yield _table([(-1, -1, _CLASS_ROW, -1, _pack(classes))], _DEAL)


class _Sums:
    """Sums of documents by batch."""

    def __init__(self, width: int):
        self.width = width
        self.tables: dict[int, np.ndarray] = {}

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.tables.values())

    def add(self, numbers: np.ndarray, owner: np.ndarray, doc: np.ndarray, values: list[np.ndarray],
            column: np.ndarray | None = None, times: np.ndarray | None = None) -> None:
        """Add ``values`` to the first columns, and ``times`` to the one that ``column`` tells."""
        edges = np.searchsorted(owner, np.arange(len(numbers) + 1)).tolist()  # owners rise
        for number, a, b in zip(numbers.tolist(), edges, edges[1:]):
            if a == b:
                continue
            size = int(doc[a:b].max()) + 1
            table = self.tables.get(number, np.zeros((0, self.width)))
            if len(table) < size:
                table = np.concatenate((table, np.zeros((size - len(table), self.width))))
            for i, value in enumerate(values):
                table[:size, i] += np.bincount(doc[a:b], weights=value[a:b], minlength=size)
            if column is not None:
                flat = doc[a:b].astype(np.int64) * self.width + column[a:b]
                table[:size] += np.bincount(flat, weights=times[a:b], minlength=size * self.width).reshape(size, self.width)
            self.tables[number] = table

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """(batch, blob): documents with anything, the first column, and the others as whole numbers."""
        tables, self.tables = self.tables, {}
        for number, table in tables.items():
            at = np.flatnonzero(table.any(axis=1))
            yield number, _pack(at.astype(np.uint16), table[at, 0], table[at, 1:].T.astype(np.uint32))


# -- weights and scores --------------------------------------------------------

class Model:
    """Discounts of every order and what is known of spread histories."""

    def __init__(self, uni: Unigrams, classes: np.ndarray, spread: list[np.ndarray]):
        self.uni, self.order = uni, len(classes)
        self.keep = [discounts(c) for c in classes]
        # per length: occurrences, weight and probability of an unknown word
        self.total = [np.zeros(max(1, len(s))) for s in spread]
        self.weight = [np.ones(max(1, len(s))) for s in spread]
        self.unknown = [np.full(max(1, len(s)), uni.unknown) for s in spread]

    def share(self, k: int, counts: np.ndarray) -> np.ndarray:
        """What n-grams of k + 1 words keep of their counts."""
        return self.keep[k][np.clip(counts, 1, LARGE + 1) - 1]

    def climb(self, counts: list[np.ndarray], chain: list[np.ndarray], groups: list[np.ndarray] = (),
              firsts: list[np.ndarray] = (), whole: tuple | None = None) -> np.ndarray:
        """Probability of each n-gram's last word, from the empty history up to the longest.

        ``chain`` tells spread histories. The others are known by ``groups``, of which all n-grams are here;
        ``firsts`` marks one row for each n-gram of an order. Of one-word histories ``whole``
        tells (group, what goes to seen words without them, occurrences by class).
        """
        p = self.uni.probability(counts[0])
        unknown = np.full(len(p), self.uni.unknown)
        skipped = len(chain) + 1 + (whole is not None)
        for k in range(1, len(counts)):
            c = counts[k]
            if k <= len(chain):
                total, weight = self.total[k - 1][chain[k - 1]], self.weight[k - 1][chain[k - 1]]
            else:
                if k == 1 and whole is not None:
                    at, lower, by_class = whole
                    total, freed = by_class.sum(axis=0), (1 - self.keep[1]) @ by_class
                else:
                    at, seen = groups[k - skipped], firsts[k - skipped] & (c > 0)
                    total = np.bincount(at, weights=seen * c)
                    freed = np.bincount(at, weights=seen * c * (1 - self.share(k, c)))
                    lower = np.bincount(at, weights=seen * p)
                least = np.zeros(len(total))
                least[at] = unknown
                weight = self.weights(total, freed, lower, least)[at]
                total = total[at]
            p = np.where(c > 0, c * self.share(k, c) / np.maximum(total, 1), weight * p)
            unknown = weight * unknown
        return p

    @staticmethod
    def weights(total: np.ndarray, freed: np.ndarray, lower: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Freed share over what shorter histories give to unseen words, which is at least what they give to unknown ones."""
        return np.where(total > 0, freed / np.maximum(total, 1) / np.maximum(1 - lower, least), 1.0)

    def learn_spread(self, pieces: DataFrame) -> None:
        """Totals and weights of spread histories, length by length, from their reported continuations."""
        for k in range(1, self.order):
            shared = pieces.sparkSession.sparkContext.broadcast(self)

            def sums(batches, k=k):
                model = shared.value
                for (blob,) in _each(batches):
                    columns = _unpack(blob, *[np.uint32] * k, *[np.int64] * (k + 1))
                    chain, counts = columns[:k], columns[k:]
                    p = model.climb(counts[:k], chain[:k - 1])
                    names, at = np.unique(chain[-1], return_inverse=True)
                    parent = np.zeros(len(names), dtype=np.int64)
                    if k > 1:
                        parent[at] = chain[-2]
                    c = counts[-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.astype(np.int64)), pa.array(parent), *(pa.array(np.bincount(at, weights=x)) for x in (
                            c, c * (1 - model.share(k, c)), p))], names=["history", "parent", "total", "freed", "lower"])

            rows = (pieces.filter(F.col("kind") == _REPORT + k).select("blob").mapInArrow(
                sums, "history bigint, parent bigint, total double, freed double, lower double")
                .groupBy("history").agg(F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("total", "freed", "lower"))).toPandas())
            at = rows["history"].to_numpy(dtype=np.int64)
            least = self.unknown[k - 2][rows["parent"].to_numpy(dtype=np.int64)] if k > 1 else np.full(len(at), self.uni.unknown)
            total, freed, lower = (rows[c].to_numpy(dtype=float) for c in ("total", "freed", "lower"))
            self.total[k - 1][at] = total
            self.weight[k - 1][at] = self.weights(total, freed, lower, least)
            self.unknown[k - 1][at] = self.weight[k - 1][at] * least


_PART = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_PART_DDL = "batch bigint, kind int, blob binary"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Log probabilities of each batch's documents over stored n-grams, summed over the bins that a task has."""
    sums, order = _Sums(1), model.order

    def rows() -> pa.RecordBatch:
        return _table([(number, _MORE, blob) for number, blob in sums.flush()], _PART)

    for depth, blob in _each(batches):
        local = order - 1 - max(depth, 1)  # levels with groups
        whole = [np.uint32] + [np.float64] * (LARGE + 2) if depth == 0 else []
        numbers, owner, mark, times, of, *rest = _unpack(
            blob, np.int64, np.uint32, np.uint16, np.uint32, np.uint32, *[np.uint32] * depth, *[np.int64] * order,
            *[np.uint32] * local, *[np.bool_] * local, *whole)
        ends = np.cumsum([depth, order, local, local])
        chain, counts, groups, firsts, whole = (rest[a:b] for a, b in zip([0, *ends], [*ends, len(rest)]))
        p = model.climb(counts, chain, groups, firsts, (whole[0], whole[1], np.stack(whole[2:])) if whole else None)
        sums.add(numbers, owner, mark & 0x7FFF, [np.log10(p)[of] * times])
        if sums.nbytes > HELD_BYTES:
            yield rows()
    if sums.tables:
        yield rows()


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _own_documents(batches: Iterator[pa.RecordBatch], tokens: int, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of each batch; its row of documents comes first. ``keep`` are the longest n-grams' shares."""
    for _, rows in groupby(_each(batches), lambda row: row[0]):
        ids, missing, held, lengths, base, known = _unpack(
            next(rows)[2], np.int64, np.bool_, np.bool_, np.int64, np.float64, np.int64)
        score = np.zeros(len(ids))
        for _, kind, blob in rows:
            at, value, by_class = _unpack(blob, np.uint16, np.float64, np.uint32)
            score[at] += value
            if kind == _SUMS:
                score[at] += np.log10(keep) @ by_class.reshape(len(keep), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=missing), pa.array(held), pa.array(lengths), pa.array(known),
             pa.array(np.full(len(ids), tokens, dtype=np.int64)), pa.array(base), pa.array(score)], schema=_SCORES)


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model has n-grams of up to ``order`` (two or more) words and learns from documents whose ``held_out`` is not true. Tokens
    are the lower-cased words of the whole text and one end, so null and empty texts have one token. base_score sums
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability. Repeated rows count and are
    scored each; a null doc_id stays null; without training documents every word is
    unknown and certain, and both scores are 0. Words and histories compare by 64-bit hashes, rare words
    within a bin by 40 bits of them. Extra columns are ignored. Runs its jobs at once and returns the last step.
    """
    if order < 2:
        raise ValueError("the order must be two or more")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    # bucketed, so that answers come to the batches, and batches stay
    table = f"lacuna_{uuid.uuid4().hex}"
    with arrow_rows(spark, words.SLICE):
        (rows.mapInArrow(words.tidy(_read, order), "batch bigint, tokens bigint, learnt bigint, docs binary, body binary, often binary")
         .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch")
         .option("path", f"{work_folder(spark)}/{table}").saveAsTable(table))
    read = spark.table(table)
    size = read.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "learnt"))).first()
    bins = max(12, -(-size["tokens"] // BIN_TOKENS))
    parts = min(MOST_TASKS, max(min(bins, LEAST_TASKS), bins // TASK_BINS))
    per_part = -(-bins // parts)
    least = max(SHARE * size["tokens"], BIN_TOKENS / 2)
    often = (read.select("often").mapInArrow(lambda b: _frequent(b, order), "k int, history bigint, n bigint")
             .groupBy("k", "history").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas())
    spread = [np.sort(often.loc[often["k"] == k, "history"].to_numpy(dtype=np.int64).view(_U)) for k in range(1, order)]
    known = spark.sparkContext.broadcast(spread)

    asked = (read.select("batch", "docs", "body").mapInArrow(words.tidy(lambda b: _ask(b, known.value, bins)), _ASK_DDL)
             .withColumn("part", F.floor(F.col("bin") / per_part).cast("int"))
             .repartitionById(parts, F.col("part")).sortWithinPartitions("bin", "batch").select("bin", "batch", "blob"))
    answers = cut(asked.mapInArrow(words.tidy(_answer, order, max(1.0, FREQUENT * size["learnt"])), _ASK_DDL), ROWS)
    classes = np.zeros((order, LARGE + 2), dtype=np.int64)
    names, counts = [np.zeros(0, dtype=_U)], [np.zeros(0, dtype=np.int64)]
    for row in answers.filter(F.col("bin") < 0).toLocalIterator():
        if row["bin"] == -1:
            classes += _unpack(row["blob"], np.int64)[0].reshape(classes.shape)
        else:
            name, count = _unpack(row["blob"], _U, np.int64)
            names.append(name)
            counts.append(count)
    uni = Unigrams(size["learnt"], int(classes[0].sum()), classes[0])
    told_by = spark.sparkContext.broadcast((uni, Frequent(np.concatenate(names), np.concatenate(counts))))

    replies = answers.filter(F.col("bin") >= 0).groupBy("batch").agg(F.collect_list(F.struct("bin", "blob")).alias("answers"))
    told = read.select("batch", "docs", "body").join(replies, "batch").select("batch", "docs", "body", "answers")
    dealt = (told.mapInArrow(words.tidy(lambda b: _deal(b, known.value, *told_by.value, bins, per_part)), _DEAL_DDL)
             .repartitionById(parts, F.col("part")).sortWithinPartitions("bin", "kind", "batch"))
    pieces = cut(dealt.mapInArrow(words.tidy(lambda b: _gather(b, order, *told_by.value, per_part)), _DEAL_DDL), ROWS)
    spark.sql(f"DROP TABLE {table}")  # from the catalogue; its files are the work folder's
    for row in pieces.filter(F.col("kind") == _CLASS_ROW).toLocalIterator():
        classes += _unpack(row["blob"], np.int64)[0].reshape(classes.shape)

    model = Model(uni, classes, spread)
    model.learn_spread(pieces)
    shared = spark.sparkContext.broadcast(model)
    sums = cut(pieces.filter(F.col("kind") < _DOCS).select("kind", "blob").mapInArrow(
        words.tidy(lambda b: _score(b, shared.value)), _PART_DDL), ROWS)
    tokens = size["learnt"]
    keep = model.keep[-1]
    return (pieces.filter(F.col("kind").isin(_DOCS, _SUMS)).select("batch", "kind", "blob").unionByName(sums)
            .repartition(parts, "batch").sortWithinPartitions("batch", "kind")
            .mapInArrow(words.tidy(_own_documents, tokens, keep),
                        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                        "train_tokens bigint, base_score double, score double"))
