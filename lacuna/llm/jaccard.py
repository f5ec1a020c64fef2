"""Exact Jaccard self-join of shingle sets by vertical partitioning.

All shingles have one global order, rare ones first. A pair that reaches the threshold shares
a shingle in the rare ends of both sets, so those ends alone give candidates. For verifying,
the order is cut into fragments: a set becomes one row per fragment, each fragment
counts its partial overlap of a candidate pair, and the counts are summed per pair.

Texts with equal sets form one class from the start. Large groups of near copies are first linked to
the most shared member of each posting list; only members that this leaves in different
components are then compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import words
from lacuna.llm.components import connected_components
from lacuna.operators.lineage import cut

WIDTH = 5
#: Similarity threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: log2 of the number of counters that estimate frequencies for the global order.
ORDER_BITS = 20
FRAGMENTS = 8
#: log2 of the number of bits in the filter on documents whose sets are needed.
FILTER_BITS = 23
#: Words of 64 bits in the bitmaps that bound what two sets share.
BITMAP = 4
#: Rows that Python gets at a time.
BATCH = 1024

_BLOCKS = 64
_SALTS = 32
_FLUSH = 1 << 18


def _bucket(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _class_of(shingles: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def _profiles(batches: Iterator[pa.RecordBatch], width: int, bits: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n_shingles, class) per document, then the task's counters in blocks."""
    counts, held, size = np.zeros(1 << bits, dtype=np.int64), [], 0
    schema = pa.schema([("doc_id", kind), ("text_hash", pa.int64()), ("n_shingles", pa.int64()),
                        ("class", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
    for batch in words.slices(batches):
        sizes, classes = [], []
        for text in batch.column(1):
            shingles = words.shingle_set(text.as_py(), width)
            sizes.append(len(shingles))
            classes.append(_class_of(shingles))
            held.append(shingles)
            size += len(shingles)
            if size >= _FLUSH:
                counts += np.bincount(_bucket(np.concatenate(held), bits), minlength=len(counts))
                held, size = [], 0
        none = [None] * len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
             pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
    if held:
        counts += np.bincount(_bucket(np.concatenate(held), bits), minlength=len(counts))
    blocks = [c.tobytes() for c in np.split(counts, _BLOCKS)] if counts.any() else []
    none = [None] * len(blocks)
    yield pa.RecordBatch.from_arrays(
        [pa.array(none, kind), *[pa.array(none, pa.int64())] * 3,
         pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], schema=schema)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(counts, dtype=np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())],
        names=["block", "counts"])


def _order(blocks: DataFrame, bits: int, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, fragment) of every counter: 2 ** bits numbers each, whatever the size of the corpus."""
    schema = "block int, counts binary"
    # every task has counted, so groups of tasks are summed before all of them
    salted = blocks.select("block", "counts", F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt"))
    some = salted.repartition("block", "salt").select("block", "counts").mapInArrow(_add_blocks, schema)
    summed = some.repartition("block").mapInArrow(_add_blocks, schema).collect()
    counts = np.zeros(1 << bits, dtype=np.int64)
    size = len(counts) // _BLOCKS
    for row in summed:
        counts[row["block"] * size:(row["block"] + 1) * size] = np.frombuffer(row["counts"], dtype=np.int64)
    by_count = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), dtype=np.uint32)
    rank[by_count] = np.arange(len(counts), dtype=np.uint32)
    mass = np.cumsum(counts[by_count])
    fragment = np.empty(len(counts), dtype=np.uint8)
    fragment[by_count] = np.minimum(fragments - 1, mass * fragments // max(1, mass[-1] + 1))
    return rank, fragment


def _prefixes(batches: Iterator[pa.RecordBatch], shared, width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Postings (shingle, class, n) of the rare end of every set, once per class and task."""
    rank, _ = shared.value
    seen: set[int] = set()
    for batch in words.slices(batches):
        rows: list[list[np.ndarray]] = [[], [], []]
        for text in batch.column(1):
            shingles = words.shingle_set(text.as_py(), width)
            size = len(shingles)
            name = _class_of(shingles)
            if not size or name in seen:
                continue
            seen.add(name)
            length = size - -(-size * NUMERATOR // DENOMINATOR) + 1
            ranks = rank[_bucket(shingles, bits)]
            # shingles rise, so those of one counter are in the order of their hashes
            near = np.argsort(ranks, kind="stable")[:length]
            rows[0].append(shingles[near].view(np.int64))
            rows[1].append(np.full(length, name, dtype=np.int64))
            rows[2].append(np.full(length, size, dtype=np.int32))
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows],
                                             names=["shingle", "class", "n"])


def _fragments(batches: Iterator[pa.RecordBatch], shared, width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, fragment, shingles) of the given texts."""
    _, fragment = shared.value
    for batch in words.slices(batches):
        classes, parts, lists = [], [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            shingles = words.shingle_set(text.as_py(), width)
            if _class_of(shingles) != name:
                continue
            of = fragment[_bucket(shingles, bits)]
            for part in np.unique(of).tolist():
                classes.append(name)
                parts.append(part)
                lists.append(shingles[of == part].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes, pa.int64()), pa.array(parts, pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
            names=["class", "fragment", "shingles"])


def _alike(a_n: Column, b_n: Column) -> Column:
    """Are two sets near enough in size to reach the threshold?"""
    return F.least(a_n, b_n) * DENOMINATOR >= F.greatest(a_n, b_n) * NUMERATOR


def _needed(a_n: Column, b_n: Column) -> Column:
    """Shingles that the rare ends of two sets of these sizes must share to reach the threshold.

    What is common and not in both rare ends lies beyond the rare end that stops first.
    """
    def up(x: Column, by: int) -> Column:
        return F.floor((x + (by - 1)) / by)

    total = up((a_n + b_n) * NUMERATOR, NUMERATOR + DENOMINATOR)
    return total + 1 - up(F.greatest(a_n, b_n) * NUMERATOR, DENOMINATOR)


def _bitmap(shingle: str) -> list[Column]:
    """Aggregates that give BITMAP words of 64 bits, with a bit set for each shingle."""
    at = F.shiftrightunsigned(F.col(shingle), 6).bitwiseAND(F.lit(BITMAP - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(shingle).bitwiseAND(F.lit(63)).cast("int"))
    return [F.bit_or(F.when(at == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"bits{i}") for i in range(BITMAP)]


def _most_shared(a: str, b: str) -> Column:
    """Upper bound of the shingles that two rows' lists share: where bitmaps differ, one set has what the other lacks."""
    differ = sum((F.bit_count(F.col(f"{a}.bits{i}").bitwiseXOR(F.col(f"{b}.bits{i}"))) for i in range(BITMAP)), F.lit(0))
    return (F.col(f"{a}.lists") + F.col(f"{b}.lists") - differ) / 2


def _verified(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """The pairs (u, v, u_n, v_n) at or above the threshold."""
    left = fragments.select(F.col("class").alias("u"), "fragment", F.col("shingles").alias("us"))
    right = fragments.select(F.col("class").alias("v"), "fragment", F.col("shingles").alias("vs"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"]).select(
        "u", "v", "u_n", "v_n", F.size(F.array_intersect("us", "vs")).alias("common"))
    common = partial.groupBy("u", "v", "u_n", "v_n").agg(F.sum("common").alias("common"))
    enough = F.col("common") * (NUMERATOR + DENOMINATOR) >= (F.col("u_n") + F.col("v_n")) * NUMERATOR
    return common.filter(enough).select("u", "v")


def _pairs(a: str, b: str) -> list[Column]:
    """Columns u, v, u_n, v_n of a pair, the smaller class first."""
    first = F.col(f"{a}.class") < F.col(f"{b}.class")
    return [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name)
            for name, x, y, c in (("u", a, b, "class"), ("v", b, a, "class"), ("u_n", a, b, "n"), ("v_n", b, a, "n"))]


def _place(doc_id: Column, text_hash: Column) -> Column:
    """Where a text is fetched by: a hash of its id, or of the text itself where there is none."""
    return F.when(doc_id.isNull(), text_hash).otherwise(F.xxhash64(doc_id))


def _listed(ids: DataFrame, spark) -> Column:
    """A filter on ``place`` that holds for all of ``ids`` and for few others.

    It reads 2 ** FILTER_BITS bits, so that most texts nobody asked for are not shuffled.
    """
    wide = 1 << 15  # bits in one bitmap of Spark's bitmap functions
    bit = F.pmod("place", F.lit(1 << FILTER_BITS))
    maps = (ids.select(F.floor(bit / wide).alias("page"), (bit % wide).alias("bit"))
            .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    table = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in maps:
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        table[row["page"] * len(bits):(row["page"] + 1) * len(bits)] = bits
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def listed(at):
        import pandas as pd

        at = at.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7)) & 1).astype(bool)

    return listed(F.pmod("place", F.lit(1 << FILTER_BITS)))


def _sets(pairs: DataFrame, classes: DataFrame, rows: DataFrame, shared, width: int, bits: int) -> DataFrame:
    """The fragments of all sets in ``pairs``, each read from its first document."""
    names = pairs.select(F.col("u").alias("class")).unionByName(pairs.select(F.col("v").alias("class"))).distinct()
    wanted = cut(names.join(classes, "class"))
    placed = rows.select(_place(F.col("doc_id"), F.xxhash64("text")).alias("place"), "text")
    texts = placed.filter(_listed(wanted, rows.sparkSession)).join(
        wanted.select("class", "place"), "place").select("class", "text")
    # of rows that share a place, the one whose set is of the class
    return texts.mapInArrow(words.tidy(_fragments, shared, width, bits),
                            "class bigint, fragment int, shingles array<bigint>").dropDuplicates(["class", "fragment"])


def near_duplicates(docs: DataFrame, width: int = WIDTH, bits: int = ORDER_BITS,
                    fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) of every document.

    Two documents are linked when their sets of lower-cased ``width``-word shingles have a Jaccard
    similarity of 0.8 or more; component_id is the smallest doc_id that links reach. Null
    texts and texts without words have no shingles and are linked with nothing. Rows with
    equal sets are one class (known by a 64-bit hash of the set), so repeated rows and copies
    cost one set; a null doc_id is greater than any other, so component_id is null where links reach no id. Sets compare by 64-bit hashes of
    shingles. Any extra columns are ignored; an empty table gives no rows.

    The global order comes from 2 ** ``bits`` counters over all documents. Counters only decide
    how rare a shingle seems: any order gives the same links.
    """
    return _grouped(docs, width, bits, fragments).drop("first_hash")


def _grouped(docs: DataFrame, width: int, bits: int, fragments: int) -> DataFrame:
    """The rows of near_duplicates, and the least text_hash of components without id as first_hash."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)
    profile = cut(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        words.tidy(_profiles, width, bits, kind),
        f"doc_id {id_type.simpleString()}, text_hash bigint, n_shingles bigint, class bigint, block int, counts binary"), BATCH)
    shared = spark.sparkContext.broadcast(_order(profile.filter("block is not null"), bits, fragments))
    members = profile.filter("block is null").select("doc_id", "text_hash", "n_shingles", "class")
    classes = members.filter("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("first"), F.min("text_hash").alias("first_hash"))
    classes = cut(classes.withColumn("place", _place(F.col("first"), F.col("first_hash"))))

    postings = rows.mapInArrow(words.tidy(_prefixes, shared, width, bits),
                               "shingle bigint, class bigint, n int")
    same = Window.partitionBy("shingle")
    lists = cut(postings.withColumn("least", F.min("class").over(same))
                .withColumn("most", F.max("class").over(same))
                .withColumn("size", F.count(F.lit(1)).over(same))
                # a class comes once from each task that holds a copy
                .withColumn("again", F.lag("class").over(same.orderBy("class")).eqNullSafe(F.col("class")))
                .filter("least < most and not again").drop("least", "most", "again"), BATCH)

    # link each list to its most shared member
    degree = lists.groupBy("class").agg(F.sum("size").alias("degree"))
    ranked = cut(lists.drop("size").join(degree, "class"))
    pivots = ranked.groupBy("shingle").agg(F.max(F.struct("degree", "class", "n")).alias("top")).select(
        "shingle", F.col("top.class").alias("class"), F.col("top.n").alias("n"))
    a, p = ranked.alias("a"), pivots.alias("p")
    star = a.join(p, "shingle").filter((F.col("a.class") != F.col("p.class")) & _alike(F.col("a.n"), F.col("p.n")))
    star = cut(star.select(*_pairs("a", "p")).groupBy("u", "v", "u_n", "v_n").agg(F.count(F.lit(1)).alias("common"))
               .filter(F.col("common") * 2 >= _needed(F.col("u_n"), F.col("v_n"))).drop("common"))
    links = cut(_verified(star, cut(_sets(star, classes, rows, shared, width, bits), BATCH)))
    found = cut(connected_components(links))

    # what the stars left apart is compared across components
    placed = ranked.join(found, F.col("class") == F.col("node"), "left").select(
        "shingle", "class", "n", F.coalesce("component", "class").alias("component"))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = mixed.filter("least < most").select("shingle")
    apart = cut(placed.join(mixed, "shingle"))
    # what a class has in such lists, and a bitmap of it, bound what it can share with any other there
    apart = cut(apart.join(apart.groupBy("class").agg(F.count(F.lit(1)).alias("lists"), *_bitmap("shingle")), "class"))
    a, b = apart.alias("a"), apart.alias("b")
    across = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") < F.col("b.component"))
                    & _alike(F.col("a.n"), F.col("b.n"))
                    & (_most_shared("a", "b") >= _needed(F.col("a.n"), F.col("b.n"))))
    across = across.select(*_pairs("a", "b")).groupBy("u", "v", "u_n", "v_n").agg(F.count(F.lit(1)).alias("common"))
    rest = cut(across.filter(F.col("common") >= _needed(F.col("u_n"), F.col("v_n"))).drop("common")
               .join(star.select("u", "v"), ["u", "v"], "left_anti"))
    more = _verified(rest, cut(_sets(rest, classes, rows, shared, width, bits), BATCH))
    component = cut(connected_components(links.unionByName(more)))

    named = component.join(classes, F.col("node") == F.col("class"))
    smallest = named.groupBy("component").agg(
        F.min("first").alias("component_id"), F.min("first_hash").alias("least_hash"))
    named = named.join(smallest, "component").select("class", "component_id", "least_hash")
    known = classes.join(named, "class", "left").select(
        "class", F.coalesce("component_id", "first").alias("component_id"),
        F.coalesce("least_hash", "first_hash").alias("first_hash"))
    empty = members.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash",
        F.col("text_hash").alias("first_hash"))
    return members.filter("n_shingles > 0").join(known, "class").select(
        "doc_id", "n_shingles", "component_id", "text_hash", "first_hash").unionByName(empty)


def first_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with the smallest doc_id of each group of near duplicates, all columns kept.

    Rows of one id and text are one document. Documents without words stay. Of a group in which none
    has an id, the text with the least hash stays.
    """
    last = (1 << 63) - 1
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(last)).alias("row_key")
    near = _grouped(docs, width, ORDER_BITS, FRAGMENTS)
    nameless = F.col("component_id").isNull() & (F.col("text_hash") != F.col("first_hash"))
    later = near.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) | nameless).select(
        key, F.col("text_hash").alias("row_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key, F.xxhash64("text").alias("row_hash"))
    return (rows.dropDuplicates(["row_key", "row_hash"])
            .join(later, ["row_key", "row_hash"], "left_anti").select("row.*"))
