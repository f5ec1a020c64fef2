"""Quality rules whose failures are judged host by host.

Every document is tried by a few rules on its whole text. Failures are counted per host and rule. How
much hosts differ tells how far a host's own share can be trusted: a beta prior is fitted to all
hosts, and each host's share of failures is the mean of its posterior. A host whose share passes one
limit loses all its documents, one past a lower limit those that fail the rule in question. All
steps are column expressions, sums and joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.lineage import cut

#: Words in the windows that tell repetition.
WINDOW = 8
#: Shrunk shares of failing documents above which a host is blocked, or watched.
BLOCKED, WATCHED = 0.5, 0.2
#: Bounds on alpha + beta of the prior: hosts that could not differ more, and hosts that don't.
LEAST_WEIGHT, MOST_WEIGHT = 1e-3, 1e6

_BLANK = " \t\n\x0b\x0c\r"
_BLANKS = r"[\x20\x09-\x0D]+"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What a document fails by, as SQL on the features; the first two are the base rules.
BASE_RULES = {
    "short": "n_words < 20",
    "repeats": "n_repeat_words * 100 > n_words * 30",
}
HOST_RULES = BASE_RULES | {
    "symbols": "n_symbols * 10 > n_words",
    "dup_lines": "n_dup_lines * 10 > n_lines * 3",
    "word_length": "word_chars < n_words * 3 OR word_chars > n_words * 10",
}


class Prior(NamedTuple):
    """Beta prior of a share."""
    alpha: float
    beta: float


def _repeated_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more; ``grams`` holds a hash per window."""
    ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(m: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            before, after = F.get(m, j - 1), F.get(m, j + 1)
            return (F.coalesce(before["g"] == x["g"], F.lit(False))
                    | F.coalesce(after["g"] == x["g"], F.lit(False)))

        starts = F.sort_array(F.transform(F.filter(m, twice), lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, at: F.struct((s["n"] + at + WINDOW - F.greatest(s["end"], at)).alias("n"),
                                   (at + WINDOW).alias("end")),
            lambda s: s["n"])

    # bound as a lambda's variable, so that the sorted windows are made once
    found = F.get(F.transform(F.array(ranked), covered), 0)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(found)


def text_features(docs: DataFrame, keep: Mapping[str, Column]) -> DataFrame:
    """Columns ``keep`` with what the rules need, from the whole of ``text`` (null: empty).

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines
    (of these, equal to an earlier one) and n_repeat_words. Windows compare by 64-bit hashes within
    their text.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(_BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANK)) != "")
    rows = docs.select(
        F.struct(*(c.alias(name) for name, c in keep.items())).alias("kept"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        # generators hold what is used more than once
        F.explode(F.array(F.struct(words.alias("words"), lines.alias("lines")))).alias("parts"))
    starts = F.sequence(F.lit(1), F.size("parts.words") - (WINDOW - 1))
    grams = F.when(F.size("parts.words") >= WINDOW, F.transform(
        starts, lambda i: F.xxhash64(F.slice("parts.words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", F.explode(F.array(grams)).alias("grams"))

    def long(c: Column) -> Column:
        return c.cast("bigint")

    return rows.select(
        "kept.*", long(F.size("parts.words")).alias("n_words"),
        long(F.char_length(F.array_join("parts.words", ""))).alias("word_chars"), "n_symbols",
        long(F.size("parts.lines")).alias("n_lines"),
        long(F.size("parts.lines") - F.size(F.array_distinct("parts.lines"))).alias("n_dup_lines"),
        long(_repeated_words(F.col("grams"))).alias("n_repeat_words"))


def fit_priors(hosts: DataFrame, names: Sequence[str], total: str = "n") -> dict[str, Prior]:
    """Beta prior of the hosts' shares ``name`` / ``total`` for each column in ``names``, by moments.

    The spread of shares beyond what chance gives to hosts of these sizes is the prior's variance.
    One row of sums reaches the driver. Without hosts a prior says that nothing fails.
    """
    n = F.col(total).cast("double")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for i, name in enumerate(names):
        x = F.col(name).cast("double")
        sums += [F.sum(x).alias(f"x{i}"), F.sum(x * x / n).alias(f"xx{i}")]
    s = hosts.agg(*sums).first()
    if not s["k"]:
        return {name: Prior(0.0, 1.0) for name in names}
    free = s["n"] - s["nn"] / s["n"] - (s["k"] - 1)
    out = {}
    for i, name in enumerate(names):
        mean = s[f"x{i}"] / s["n"]
        noise = mean * (1 - mean)
        weight = MOST_WEIGHT
        if noise > 0 and free > 0:
            # correlation of two documents of one host
            within = ((s[f"xx{i}"] - s[f"x{i}"] * mean) / noise - (s["k"] - 1)) / free
            if within > 0:
                weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / within - 1))
        out[name] = Prior(mean * weight, (1 - mean) * weight)
    return out


def judge_documents(docs: DataFrame, host: str = "source", rules: Mapping[str, str] = HOST_RULES,
                    base: Mapping[str, str] = BASE_RULES, blocked: float = BLOCKED,
                    watched: float = WATCHED) -> DataFrame:
    """(doc_id, host, the FEATURES, n_lines, base_failed, host_verdict, kept) of every document.

    ``rules`` and ``base`` are conditions on the features. host_verdict is 'block' where the host's shrunk share
    of documents that fail some rule exceeds ``blocked``, 'watch' where one exceeds ``watched``,
    else 'pass'. A document is kept unless it fails a base rule, its host is blocked, or its
    host is watched for a rule that it fails. A null host is a host of its own; so is ''. Null and
    blank texts have no words and fail as short. Repeated rows count and are judged singly, ids
    may be null, other columns are ignored, and an empty table gives no rows.

    The text is read once and its features written. A host's documents are counted before the
    shuffle; the join back has one row per host on its other side.
    """
    rows = cut(text_features(docs, {"doc_id": F.col("doc_id"), "host": F.col(host)}))
    counts = [F.count_if(F.expr(rule)).alias(f"failed_{name}") for name, rule in rules.items()]
    hosts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *counts))
    priors = fit_priors(hosts, [f"failed_{name}" for name in rules])
    shares = []
    for name in rules:
        alpha, beta = priors[f"failed_{name}"]
        # rounded, as sums of doubles depend on their order
        shares.append(F.round((F.col(f"failed_{name}") + alpha) / (F.col("n") + (alpha + beta)), 9).alias(name))
    judged = hosts.select(F.col("host").alias("of"), *shares)
    most = F.greatest(*rules, F.lit(0.0))
    watch = [(F.col(name) > watched).alias(f"watch_{name}") for name in rules]
    judged = judged.select("of", *watch, F.when(most > blocked, "block").when(most > watched, "watch")
                           .otherwise("pass").alias("host_verdict"))
    base_failed, doubtful = F.lit(False), F.lit(False)
    for rule in base.values():
        base_failed = base_failed | F.expr(rule)
    for name, rule in rules.items():
        doubtful = doubtful | (F.col(f"watch_{name}") & F.expr(rule))
    return rows.join(judged, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "host", *FEATURES, "n_lines", base_failed.alias("base_failed"), "host_verdict",
        (~base_failed & (F.col("host_verdict") != "block") & ~doubtful).alias("kept"))
