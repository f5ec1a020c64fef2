"""Raw html or text pages -> page records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import text as tx
from lacuna.operators.keywords import keyword_list
from lacuna.schemas import COMPETITOR, PAGE_SCHEMA, Settings

METADATA_MODES = ("tfidf", "llm")


def html_pages(raw: DataFrame, source: str = COMPETITOR, query: Column | str = "") -> DataFrame:
    """(url, html) -> (url, title, content, domain, source, query), blank pages included.

    The text comes out of a generator, so that filters and later columns on it use
    the finished text and do not repeat the extraction.
    """
    kept = [c for c in raw.columns if c not in ("url", "html")]
    texts = raw.select("url", "html", *kept, F.explode_outer(
        F.array(tx.html_text(F.col("html")))).alias("content"))
    return texts.select(
        "url",
        tx.html_title(F.col("html")).alias("title"),
        "content",
        tx.domain_of(F.col("url")).alias("domain"),
        F.lit(source).alias("source"),
        (F.lit(query) if isinstance(query, str) else query).alias("query"))


def has_text(pages: DataFrame, min_chars: int = 1) -> DataFrame:
    return pages.filter(F.length(F.trim("content")) >= min_chars)


def without_text(pages: DataFrame, min_chars: int = 1) -> DataFrame:
    return pages.filter(F.coalesce(F.length(F.trim("content")), F.lit(0)) < min_chars)


def validate_vectors(pages: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(pages with a vector of ``size`` numbers, the other pages)."""
    good = F.coalesce(F.size("vector") == size, F.lit(False))
    return pages.filter(good), pages.filter(~good)


Embedder = Callable[[Column], Column]


def embed(pages: DataFrame, embedder: Embedder | None = None, size: int = 1536,
          chars: int | None = None) -> DataFrame:
    """Add ``vector``.

    ``embedder`` maps the text column to an ``array<float>`` column, normally a
    scalar-iterator ``pandas_udf`` that loads a model once per task; ``chars`` cuts the
    text for models with an input limit. The default reads whole texts and hashes words into ``size`` buckets: stable and fast, but not semantic.
    """
    text = tx.embed_text(F.col("title"), F.col("content"))
    if embedder is not None:
        return pages.withColumn("vector", embedder(F.substring(text, 1, chars) if chars else text))
    work = pages.withColumn("_text", text)
    work = Tokenizer(inputCol="_text", outputCol="_words").transform(work)
    work = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size).transform(work)
    work = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(work)
    return work.withColumn("vector", vector_to_array("_unit", "float32")).drop(
        "_text", "_words", "_tf", "_unit")


def join_vectors(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add precomputed vectors by page id; pages without one are left out."""
    return pages.join(vectors.select("page_id", "vector"), "page_id")


Enricher = Callable[[Column, Column], Column]


def with_metadata(pages: DataFrame, mode: Column | str, enricher: Enricher | None = None,
                  default_mode: str = "tfidf", stopwords: Sequence[str] = (),
                  chars: int | None = None) -> DataFrame:
    """Add metadata_mode, summary and keywords.

    Unknown modes fall back to ``default_mode``. The ``llm`` arm takes a user
    column function (title, content) -> struct<summary, keywords>; NULL or no
    function gives empty metadata. ``chars`` cuts the content for functions with an
    input limit.
    """
    if default_mode not in METADATA_MODES:
        raise ValueError(f"unknown metadata mode: {default_mode}")
    wanted = F.lit(mode) if isinstance(mode, str) else mode
    chosen = F.when(wanted.isin(*METADATA_MODES), wanted).otherwise(F.lit(default_mode))
    no_words = F.array().cast("array<string>")
    out = pages.withColumn("metadata_mode", chosen)
    is_chat = F.col("metadata_mode") == "llm"
    words = keyword_list(F.col("title"), F.col("content"), stopwords=stopwords)
    if enricher is None:
        return out.withColumns({
            "summary": F.lit(""),
            "keywords": F.when(is_chat, no_words).otherwise(words)})
    # only rows of the chat mode carry text into the user's function
    title = F.when(is_chat, F.col("title"))
    content = F.when(is_chat, F.substring("content", 1, chars) if chars else F.col("content"))
    out = out.withColumn("_meta", enricher(title, content))
    out = out.withColumns({
        "summary": F.when(is_chat, F.coalesce("_meta.summary", F.lit(""))).otherwise(""),
        "keywords": F.when(is_chat, F.coalesce("_meta.keywords", no_words)).otherwise(words)})
    return out.drop("_meta")


def page_records(pages: DataFrame, embedder: Embedder | None = None,
                 enricher: Enricher | None = None, mode: Column | str = "tfidf",
                 stopwords: Sequence[str] = (), settings: Settings = Settings(),
                 at: Column | None = None) -> DataFrame:
    """(url, title, content, domain, source, query) -> rows of the page table.

    Freshly written pages belong to no topic, so both cluster columns are NULL.
    """
    rows = with_metadata(has_text(pages), mode, enricher,
                         settings.default_metadata_mode, stopwords)
    rows = embed(rows, embedder, settings.vector_size)
    rows = rows.withColumns({
        "page_id": tx.page_id(F.col("url")),
        "content_snippet": tx.snippet(F.col("content")),
        "timestamp": tx.ingest_ts() if at is None else at,
        "cluster_id": F.lit(None).cast("int"),
        "cluster_label": F.lit(None).cast("string")})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in PAGE_SCHEMA])
