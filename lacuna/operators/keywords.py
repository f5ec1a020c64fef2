"""Per-page keywords: most frequent one- and two-word terms.

The whole computation is one column expression on one page, so extracting
keywords never shuffles text, however long or numerous the pages are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import let

# Letters a token may hold, its least length, how often the title
# counts, how many terms are kept as features and how many become keywords.
TOKEN_LETTERS = "a-zA-ZąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
MIN_TOKEN_CHARS = 3
TITLE_WEIGHT = 3
MAX_FEATURES = 200
N_KEYWORDS = 8

_RUN = r"[\p{L}\p{N}_]+"
_TOKEN = rf"^[{TOKEN_LETTERS}]{{{MIN_TOKEN_CHARS},}}$"


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case tokens in text order, stop words left out.

    A token is a whole run of word characters made only of allowed letters, so
    a word that touches a digit, an underscore or a foreign letter gives none. The stop
    words become part of the query; ``with_keywords`` takes a long list as a table.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(_RUN), F.lit(0))
    stop = sorted(set(stopwords))

    def keep(token: Column) -> Column:
        ok = token.rlike(_TOKEN)
        return ok & ~token.isin(*stop) if stop else ok

    return F.filter(runs, keep)


def terms(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.when(
        F.size(words) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def top_terms(all_terms: Column, n: int) -> Column:
    """First ``n`` distinct terms, most frequent first, ties by term.

    Equal terms are neighbours after one sort, so a count is the distance
    between the starts of two runs. The n-th largest count is found on plain
    integers; only terms that reach it are ordered as (count, term) pairs.
    """
    def of_sorted(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(b: Column) -> Column:
            sizes = F.transform(b, lambda p, j: F.coalesce(F.get(b, j + 1), F.size(s)) - p)

            def chosen(c: Column) -> Column:
                cut = F.get(F.sort_array(c), F.greatest(F.size(c) - n, F.lit(0)))
                frequent = let(cut, lambda least: F.filter(
                    F.sequence(F.lit(0), F.size(c) - 1), lambda j: F.get(c, j) >= least))
                pairs = F.transform(frequent, lambda j: F.struct(
                    (-F.get(c, j)).alias("neg"), F.get(s, F.get(b, j)).alias("term")))
                return F.transform(F.slice(F.sort_array(pairs), 1, n), lambda r: r["term"])

            return let(sizes, chosen)

        return let(starts, runs)

    return let(F.sort_array(all_terms), lambda s: F.when(F.size(s) > 0, of_sorted(s))
               .otherwise(F.array().cast("array<string>")))


def _weighted_text(title: Column, content: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(" ", *([F.coalesce(title, blank)] * TITLE_WEIGHT), F.coalesce(content, blank))


def keyword_list(title: Column, content: Column, n: int = N_KEYWORDS,
                 max_features: int = MAX_FEATURES, stopwords: Sequence[str] = ()) -> Column:
    return let(tokens(_weighted_text(title, content), stopwords),
               lambda w: top_terms(terms(w), min(n, max_features)))


def without_stopwords(listed: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(page_id, words) without the words in the first column of ``stopwords``, order kept.

    Numbered words meet the table in an anti-join, which Spark broadcasts where the table
    is small and shuffles where it is not. A page whose words all go has no row.
    """
    words = stopwords.select(F.col(stopwords.columns[0]).alias("word")).distinct()
    return (listed.select("page_id", F.posexplode("words").alias("pos", "word"))
            .join(words, "word", "left_anti")
            .groupBy("page_id").agg(F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda e: e["word"]).alias("words")))


def with_keywords(pages: DataFrame, n: int = N_KEYWORDS, max_features: int = MAX_FEATURES,
                  stopwords: Sequence[str] | DataFrame = ()) -> DataFrame:
    """Add ``keywords``; stop words are a short list, or a table of any length.

    With a table, pages need a ``page_id`` without repeats.
    """
    if not isinstance(stopwords, DataFrame):
        return pages.withColumn("keywords", keyword_list(
            F.col("title"), F.col("content"), n, max_features, stopwords))
    listed = pages.select("page_id", tokens(_weighted_text(F.col("title"), F.col("content"))).alias("words"))
    found = without_stopwords(listed, stopwords).select(
        "page_id", top_terms(terms(F.col("words")), min(n, max_features)).alias("keywords"))
    joined = pages.drop("keywords").join(found, "page_id", "left")
    return joined.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
