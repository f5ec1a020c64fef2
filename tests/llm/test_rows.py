"""Operators that work row by row or place and mix rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lacuna.llm import mixing, packing, phrases, sharding
from lacuna.llm.queries import VOCABULARY

from .data import documents, odd_rows, texts, words


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY.tokenizer)


def test_encoding_equals_the_tokenizer(tokenizer):
    for text in [*texts(), "a <|endoftext|> b", "  two  spaces \n\n ", "I'll don't 123 ...", "\x1c\x85\u3000x"]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert packing.encode(text, VOCABULARY).tolist() == want


@pytest.mark.parametrize("run", [" ", "\n", " \t", "x", "\u3000"], ids=["blank", "line", "mixed", "letter", "wide"])
def test_two_million_of_one_class(tokenizer, run):
    text = "start " + run * (2_000_000 // len(run)) + " end"
    assert packing.encode(text, VOCABULARY).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        at = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 40, 25)))))
        penalty = rng.integers(0, 9, len(at)).astype(float)
        limit = 128

        def fee(i, j):
            size = at[j] - at[i]
            full = size & (size - 1) == 0 and size >= packing.LEAST_WINDOW
            return penalty[j] + packing.WINDOW_COST + (0 if full else limit - size)

        best = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + fee(i, j) for i in range(j) if at[j] - at[i] <= limit)
        chain = packing.best_cuts(at, penalty, limit)
        assert chain[0] == 0 and chain[-1] == len(at) - 1
        assert sum(fee(i, j) for i, j in zip(chain, chain[1:])) == pytest.approx(best[-1])


@pytest.mark.parametrize("limit", [64, 1024])
def test_packing_is_a_partition_of_all_ids(spark, limit):
    docs = documents(spark, odd_rows()).coalesce(2)
    rows = packing.pack(docs, VOCABULARY, limit, with_ids=True).collect()
    by_sequence, texts_by_id = defaultdict(list), defaultdict(list)
    for i, text in odd_rows():
        texts_by_id[i].append(packing.encode(text, VOCABULARY).tobytes())
    for row in rows:
        by_sequence[row.sequence_id].append(row)
        assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
        assert any(len(ids) == 4 * row.doc_tokens and ids[4 * row.start:4 * (row.start + row.length)] == row.ids
                   for ids in texts_by_id[row.doc_id])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == pieces[0].sequence_tokens <= limit
    assert sum(r.length for r in rows) == sum(len(x) // 4 for v in texts_by_id.values() for x in v)


def test_packing_keeps_order_and_wastes_little(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(texts() * 20)]).coalesce(1)
    rows = packing.pack(docs, VOCABULARY, 256).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    sizes = {r.sequence_id: r.sequence_tokens for r in rows}.values()
    waste = sum(256 - s for s in sizes if s & (s - 1))
    assert waste < 0.05 * sum(sizes)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_phrases_follow_the_next_document(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in phrases.fingerprint_edits(documents(spark, rows)).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for i, text in rows:
        text, nxt = text or "", rows[i - 1][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def printed(t):
            found = set()
            phrases.parse(t.encode(), 0, 0, found)
            return phrases.sketch(found)

        a, b, c = printed(text), printed(edited), printed(nxt)
        assert got[i].fingerprint == phrases.to_text(a) and got[i].edited_fingerprint == phrases.to_text(b)
        assert got[i].near_edited == phrases.likeness(a, b) and got[i].near_next == phrases.likeness(a, c)


def test_phrases_against_a_parse_of_their_own(spark):
    """Phrase sets from a trie, hashes and likeness written out again."""
    import base64

    import xxhash

    def smallest(data):
        trie, node, phrase, found = {}, None, b"", set()
        for byte in data:
            node = trie if node is None else node
            phrase += bytes([byte])
            if byte in node:
                node = node[byte]
                continue
            node[byte] = {}
            found.add(phrase)
            node, phrase = None, b""
        return sorted({xxhash.xxh3_64_intdigest(x) >> 32 for x in found})[:phrases.HASHES]

    def like(a, b):
        union = sorted({*a, *b})[:phrases.HASHES]
        return sum(x in a and x in b for x in union) / len(union) if union else 1.0

    rows = dict(enumerate(texts()))
    for r in phrases.fingerprint_edits(documents(spark, list(rows.items()))).collect():
        text, nxt = rows[r.doc_id] or "", rows[(r.doc_id - 1) % len(rows)] or ""
        half = len(text) // 2
        a, b, c = (smallest(t.encode()) for t in (text, text[:len(text) - half] + nxt[:half], nxt))
        for values, printed in ((a, r.fingerprint), (b, r.edited_fingerprint)):
            assert np.frombuffer(base64.b64decode(printed), dtype="<u4").tolist() == values
        assert (r.near_edited, r.near_next) == pytest.approx((like(a, b), like(a, c)))


def test_rows_without_id_spread_over_buckets(spark):
    """Half of all rows have no id; each is followed by the next by hash, and no bucket has them all."""
    from pyspark.sql import functions as F
    rows = [(i, f"text {i}") for i in range(200)] + [(None, f"lost {i} " * 3) for i in range(200)] + [(7, "x"), (7, "y"), (None, None)] * 3
    df = phrases.fingerprint_edits(documents(spark, rows))
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(rows)
    hashes = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(((-(1 << 63) if i is None else i, hashes[t or ""], t or "") for i, t in rows), reverse=True)
    want = []
    for (i, _, t), (_, _, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(want) == sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.edited_sha256) for r in got)
    most = max(sum(r.doc_id is None and r.task == t for r in got) for t in range(4))
    assert most < 160 and len({r.task for r in got if r.doc_id is None}) > 1


def test_phrases_of_odd_tables(spark):
    rows = phrases.fingerprint_edits(documents(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alone = phrases.fingerprint_edits(documents(spark, [(4, "only this")])).first()
    assert alone.near_next == 1.0
    assert phrases.fingerprint_edits(documents(spark, [])).count() == 0


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(5)
    pool = [rng.bytes(8) for _ in range(3000)]
    a, b = set(pool[:2000]), set(pool[1000:])
    assert phrases.likeness(phrases.sketch(a, 1024), phrases.sketch(b, 1024), 1024) == pytest.approx(1 / 3, abs=0.06)


def test_sharding_laws(spark):
    docs = documents(spark, odd_rows() + [(i, "t") for i in range(1000, 3000)])
    tree = sharding.topology(40)
    rows = sharding.shard_documents(docs, tree, sharding.grow(tree)).collect()
    slots = defaultdict(list)
    by_id = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(v) == 1 for v in by_id.values())
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 0.4 * len(rows) / 41 < moved < 2 * len(rows) / 41
    assert len(slots) == 40 and max(map(len, slots.values())) < 2 * len(rows) / 40
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows
                 if r.doc_id is None or r.doc_id < 1000)
    assert got == want
    assert sharding.shard_documents(documents(spark, []), tree).count() == 0


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    ids = spark.range(4000)
    tree = sharding.topology(40)
    heavier = [s._replace(weight=2.0) if s.rack == 3 else s for s in tree]
    rows = sharding.place(sharding.place(ids, tree, F.col("id"), "a"), heavier, F.col("id"), "b").collect()
    changed = [r for r in rows if r.a != r.b]
    assert changed and all(r.b // 20 == 0 for r in changed)  # into region 0 alone
    assert all(r.b // 5 == 3 for r in changed if r.a // 20 == 0)  # and in it into rack 3 alone


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 90))) for i in range(1200)] + odd_rows()
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    share = {s: sum(sizes.values()) * weights[s] / sum(weights.values()) for s in names}
    for s in names:
        assert target[s] == pytest.approx(share[s]) and abs(taken[s] - target[s]) < 0.01 * target[s] + 5
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_hash, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_solve_the_dual(spark):
    """Rates of every source against a root found by bisection over its documents."""
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 90))) for i in range(900)] + [(i, "a " * 700) for i in range(900, 920)]
    by = defaultdict(list)
    for r in mixing.mix(documents(spark, rows), weights=(1, 5, 2), cap=3.0).collect():
        by[r.source].append(r)
    for group in by.values():
        size = np.array([r.size for r in group], dtype=float)
        target, x = group[0].target, size / size.mean()
        low, high = -1e3, 1e3
        for _ in range(200):
            middle = (low + high) / 2
            got = (size * np.exp(np.minimum(middle * x, np.log(3.0)))).sum()
            low, high = (low, middle) if got > target else (middle, high)
        want = np.exp(np.minimum(low * x, np.log(3.0)))
        np.testing.assert_allclose([r.rate for r in group], want, rtol=1e-6)
        assert (size * want).sum() == pytest.approx(target, rel=1e-6)


def test_mixing_caps_and_empty_tables(spark):
    rows = [(i, "a b c d" if i % 4 else "a " * 900) for i in range(400)]
    got = mixing.mix(documents(spark, rows), weights=(1, 9, 1), cap=3.0).collect()
    by = {r.source: r for r in got}
    limit = {s: 3 * by[s].source_size for s in by}
    assert all(by[s].target <= limit[s] for s in by)
    assert sum(r.target for r in by.values()) == pytest.approx(sum(r.size for r in got))
    for s in by:
        if by[s].target == limit[s]:
            assert all(r.copies == 3 for r in got if r.source == s)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, " ")])).agg({"taken": "sum"}).first()[0] == 0


def test_repeating_documents(spark):
    docs = documents(spark, odd_rows())
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert out.count() == want
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())
