"""Mixing sources to target weights by entropy balancing.

Document rates r = exp(l * size / mean size), at most ``cap``, are the least change from
r = 1 (in entropy) under which every source yields its target of words; l is the
dual variable of the source. The dual is convex and solved by safeguarded Newton steps,
each one distributed sum over all size classes. Rates are then rounded to copies: from
large documents to small, each class passes on what rounding left over, so a source
misses its target by little more than its shortest documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Sizes up to this have a class each; larger ones share OCTAVE classes per doubling.
EXACT_SIZES = 4096
OCTAVE = 64
TOLERANCE = 1e-9
MAX_STEPS = 100


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Number of a document's size class; bounded for any size."""
    octaves = F.log2(F.greatest(size, F.lit(1)) / F.lit(float(EXACT_SIZES)))
    return F.when(size <= EXACT_SIZES, size).otherwise(
        F.lit(EXACT_SIZES + 1) + F.floor(octaves * OCTAVE)).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, docs, weight, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share all words by
    them; no target exceeds ``cap`` times its source, and the excess is shared again. The
    only unpartitioned window numbers the sources, one row each.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sources = cut(sizes.groupBy("source").agg(
        F.sum("size").cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("docs"),
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)))
    limit = F.col("source_size") * cap
    level = math.inf  # words per unit of weight, which rises as sources reach their limit
    capped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, limit)).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("free"),
            F.count(F.when(capped, 1)).alias("n")).first()
        if not row["free"]:
            break
        level = (row["all"] - (row["full"] or 0.0)) / row["free"]
        now = F.col("weight") * level > limit
        if sources.filter(now).count() == row["n"]:
            break
        capped = now
    share = F.col("weight") * level if math.isfinite(level) else limit
    return sources.withColumn("target", F.least(share, limit).cast("double"))


def solve_tilt(classes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(source, tilt): the dual variable of every source with words and a target.

    ``classes`` holds (source, class, docs, words). A step joins the classes with the tilts
    and sums words and their slope per source; it is a Newton step on the logarithm of the
    words, or halves the bracket where that would leave it.
    """
    mean = F.col("source_size") / F.col("docs")
    wanted = sources.filter((F.col("source_size") > 0) & (F.col("target") > 0)).select(
        "source", "target", mean.alias("mean"), "source_size")
    ratio = F.col("target") / F.col("source_size")
    state = cut(wanted.select(
        "source", "target", "mean",
        F.least(F.ln(ratio) * F.greatest("mean", F.lit(1.0)), F.lit(0.0)).alias("low"),
        (F.lit(math.log(cap)) * F.greatest("mean", F.lit(1.0))).alias("high"),
        F.lit(0.0).alias("tilt"), F.lit(False).alias("done")))
    for _ in range(MAX_STEPS):
        x = (F.col("words") / F.col("c.docs")) / F.col("mean")
        open_ = F.exp(F.least(F.col("tilt") * x, F.lit(math.log(cap))))
        slope = F.when(F.col("tilt") * x < math.log(cap), F.col("words") * x * open_).otherwise(0.0)
        c, s = classes.alias("c"), state.alias("s")
        sums = (c.filter(F.col("words") > 0)
                .join(s, F.col("c.source").eqNullSafe(F.col("s.source")))
                .groupBy(F.col("s.source").alias("source"), "target", "mean", "low", "high", "tilt")
                .agg(F.sum(F.col("words") * open_).alias("got"), F.sum(slope).alias("slope")))
        over = F.col("got") > F.col("target")
        sums = (sums.withColumn("done", F.abs(F.col("got") - F.col("target")) <= F.col("target") * TOLERANCE)
                .withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
                .withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))))
        newton = F.col("tilt") - F.ln(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(
            (F.col("low") + F.col("high")) / 2)
        state = cut(sums.withColumn("tilt", step).select(*state.columns))
        # a bracket that has shrunk to nothing is as near as doubles come
        if not state.filter(~F.col("done") & (F.col("high") - F.col("low") > 1e-12 * F.greatest(F.abs("high"), F.abs("low")))).take(1):
            break
    return state.select("source", "tilt")


def _round_classes(frame):
    """Copies of each size class of one source, large sizes first; leftovers move on."""
    import numpy as np
    import pandas as pd

    frame = frame.sort_values("class", ascending=False)
    left, rows = 0.0, []
    for number, docs, words, rate in frame[["class", "docs", "words", "rate"]].itertuples(index=False):
        size = words / docs
        least, most = docs * math.floor(rate), docs * math.ceil(rate)
        want = docs * rate * size + left
        copies = min(most, max(least, math.floor(want / size + 0.5))) if size else least
        left = want - copies * size
        rows.append((number, math.floor(rate), copies - least))
    out = pd.DataFrame(rows, columns=["class", "base", "extra"])
    out.insert(0, "source", frame["source"].iloc[0] if len(frame) else None)
    return out.astype({"class": np.int32, "base": np.int64, "extra": np.int64})


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, text_hash) of every document.

    ``size`` counts words (null text: 0) and ``taken`` = copies * size. Copies are the
    rate rounded down or up, at most ``cap``. Which documents of a class round up is
    decided by a hash of their id and text, so reruns agree; a class is ranked in 16 pieces that are
    counted first, so no task ranks a whole class. Documents without words, and sources
    without words, keep one copy and take nothing. Rows with one id are documents of
    their own; equal rows are interchangeable. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.xxhash64("text").alias("text_hash"))
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text_hash").cast("string")))
    rows = cut(rows.withColumn("class", size_class(F.col("size"))).withColumn("digest", digest))
    sources = cut(source_targets(rows, weights, cap))
    classes = cut(rows.groupBy("source", "class").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")))
    tilts = solve_tilt(classes, sources, cap)
    known = sources.select(F.col("source").alias("name"), "source_size", "target",
                           (F.col("source_size") / F.col("docs")).alias("mean"))
    tilted = tilts.select(F.col("source").alias("name_"), "tilt")
    rated = (classes.join(known, F.col("source").eqNullSafe(F.col("name")))
             .join(tilted, F.col("source").eqNullSafe(F.col("name_")), "left")
             .withColumn("rate", F.when(F.col("tilt").isNull() | (F.col("words") == 0), 1.0).otherwise(
                 F.exp(F.least(F.col("tilt") * F.col("words") / F.col("docs") / F.col("mean"),
                               F.lit(math.log(cap))))))
             # rates that differ from whole copies by rounding of doubles alone
             .withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate"))
                         .otherwise(F.col("rate")))
             .drop("name", "name_"))
    kind = docs.schema["source"].dataType.simpleString()
    rounded = rated.groupBy("source").applyInPandas(
        _round_classes, f"source {kind}, class int, base bigint, extra bigint")
    plan = cut(rated.alias("r").join(
        rounded.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.class") == F.col("o.class")),
    ).select(F.col("r.source").alias("of_source"), F.col("r.class").alias("of_class"),
             "source_size", "target", "rate", "base", "extra"))

    piece = F.substring("digest", 1, 1)
    before = (Window.partitionBy("source", "class").orderBy("piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy("source", "class", piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source").alias("in_source"), F.col("class").alias("in_class"), F.col("piece").alias("in_piece"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("source", "class", "piece").orderBy("digest", "doc_id", "text_hash")
    ranked = rows.withColumn("piece", piece).withColumn("at", F.row_number().over(order))
    ranked = ranked.join(first, F.col("source").eqNullSafe(F.col("in_source"))
                         & (F.col("class") == F.col("in_class")) & (F.col("piece") == F.col("in_piece")))
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("class") == F.col("of_class")))
    copies = F.col("base") + (F.col("first") + F.col("at") <= F.col("extra")).cast("bigint")
    return out.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns.

    Copies come back to texts by id and text hash. Rows that agree in both are one text:
    their copies are added up and one of them is repeated.
    """
    last = (1 << 63) - 1
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(last)).alias("row_key")
    copies = mix(docs, weights, cap).groupBy(key, F.col("text_hash").alias("row_hash")).agg(
        F.sum("copies").cast("int").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), key, F.xxhash64("text").alias("row_hash"))
    joined = rows.dropDuplicates(["row_key", "row_hash"]).join(copies, ["row_key", "row_hash"])
    times = F.explode(F.sequence(F.lit(1), F.col("times")))
    return joined.filter("times > 0").select("row", times).select("row.*")
