"""Views that map the TPC-style test tables onto this package's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text as tx
from lacuna.schemas import COMPETITOR, OWN

#: Buckets by which documents without a vector are told apart; as many numbers are broadcast at most.
ID_BUCKETS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page with a planted topic id, and its doc_id; vectors are not joined yet."""
    docs = table(spark, sf_dir, "documents")
    own = F.col("doc_id") % 10 == 0
    noise = F.col("doc_id") % 13 == 0
    host = F.concat(F.col("source"), F.lit(".example"))
    url = F.concat(F.lit("https://"), host, F.lit("/"), F.col("doc_id").cast("string"))
    topic = F.floor(F.col("doc_id") / 10) % 10
    return docs.select(
        "doc_id",
        tx.page_id(url).alias("page_id"),
        url.alias("url"),
        F.substring("text", 1, 60).alias("title"),
        host.alias("domain"),
        F.when(own, OWN).otherwise(COMPETITOR).alias("source"),
        F.when(own, "").otherwise(
            F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string"))).alias("query"),
        F.lit("").alias("summary"),
        F.lit("tfidf").alias("metadata_mode"),
        tx.snippet(F.col("text")).alias("content_snippet"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("timestamp"),
        F.when(own | noise, -1).otherwise(topic).cast("int").alias("cluster_id"),
        F.when(own, "").when(noise, "noise").otherwise(
            F.concat(F.lit("topic "), topic.cast("string"))).alias("cluster_label"),
        F.col("text").alias("content"),
    )


def with_vectors(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Pages of ``page_texts`` with their vector in place of doc_id; NULL where none is known."""
    names = [c for c in pages.columns if c != "doc_id"]
    after = names.index("timestamp") + 1
    known = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return pages.join(known, F.col("doc_id") == F.col("vec_id"), "left").select(*names[:after], "vector", *names[after:])


def near_vectors(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Pages of ``page_texts`` without most of those that have no vector; the others fall out where vectors are needed.

    Ids are compared by bucket, so what is broadcast is bounded and texts stay where they are.
    """
    def bucket(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(ID_BUCKETS)).cast("int").alias("bucket")

    known = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull()).select(bucket("vec_id")).distinct()
    return pages.select("*", bucket("doc_id")).join(F.broadcast(known), "bucket", "left_semi").drop("bucket")


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page with a planted topic id; vector is NULL where none is known.

    What comes of the text is made before the vectors are joined, so whole texts move only for queries that read them.
    """
    return with_vectors(spark, sf_dir, page_texts(spark, sf_dir))


def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a page (id and vector only)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("page_id"),
        F.col("embedding").alias("vector"))


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked results per query; some are sponsored."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.concat(F.lit("q"), (F.col("page_id") % 20).cast("string")).alias("query"),
        (F.floor(F.col("page_id") / 20) + 1).cast("bigint").alias("rank"),
        (F.col("page_id") % 7 == 0).alias("sponsored"),
        F.col("url"))


def jobs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per user, its status taken from the user's latest event."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = ev.groupBy("user_id").agg(
        F.min("ts").alias("created_at"),
        F.max_by(F.struct("ts", "event_type", "props"), F.struct("ts", "event_id")).alias("e"))
    kind = F.col("e.event_type")
    status = (F.when(kind == "error", "failed").when(kind == "purchase", "done")
              .when(kind == "click", "in_progress").otherwise("pending"))
    return last.select(
        F.col("user_id").alias("seq"),
        F.concat(F.lit("query "), F.col("user_id").cast("string")).alias("query"),
        status.alias("status"),
        "created_at",
        F.when(kind.isin("error", "purchase", "click"), F.col("e.ts")).alias("started_at"),
        F.when(kind.isin("error", "purchase"), F.col("e.ts")).alias("finished_at"),
        F.when(kind == "error", F.col("e.props")).alias("error"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return usage_from_events(ev)


def usage_from_events(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type").isin("view", "click")).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "view", "embedding").otherwise("llm").alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as agent log lines, some JSON and some plain text.

    Every seventh plain line carries a limit message with a reset time in one of
    several shapes; every 11th system turn becomes a denied limit event and
    every 13th an error result.
    """
    return log_from_conversations(table(spark, sf_dir, "conversations"))


def log_from_conversations(conv: DataFrame) -> DataFrame:
    key = F.col("conv_id") + F.col("turn")
    hour12 = (F.col("conv_id") % 12 + 1).cast("string")
    clock = (F.when(F.col("conv_id") % 5 == 0, F.concat(hour12, F.lit("PM UTC")))
             .when(F.col("conv_id") % 5 == 1, F.concat(hour12, F.lit(" PM UTC")))
             .when(F.col("conv_id") % 5 == 2, F.concat(hour12, F.lit(":45 AM UTC")))
             .when(F.col("conv_id") % 5 == 3, F.concat(hour12, F.lit(":45AM (UTC)")))
             .otherwise(F.concat((F.col("conv_id") % 24).cast("string"), F.lit(":05 (UTC)"))))
    plain = F.when(
        key % 7 == 0,
        F.concat(F.col("text"), F.lit(" Usage limit reached, resets at "), clock),
    ).otherwise(F.col("text"))
    assistant = F.to_json(F.struct(
        F.lit("assistant").alias("type"),
        F.struct(F.array(F.struct(
            F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
        ).alias("message")))
    tool = F.to_json(F.struct(
        F.lit("tool_use").alias("type"),
        F.concat(F.lit("tool"), (F.col("turn") % 5 + F.col("conv_id") % 3).cast("string")).alias("name")))
    denied = F.to_json(F.struct(
        F.lit("rate_limit_event").alias("type"),
        F.struct(F.lit("denied").alias("status"),
                 (F.lit(1704067200) + F.col("conv_id") * 3600).alias("resetsAt"),
                 ).alias("rate_limit_info")))
    failed = F.to_json(F.struct(
        F.lit("result").alias("type"), F.lit("error").alias("subtype"),
        F.col("text").alias("error")))
    line = (F.when(F.col("role") == "assistant", assistant)
            .when((F.col("role") == "system") & (F.col("conv_id") % 11 == 0), denied)
            .when((F.col("role") == "system") & (F.col("conv_id") % 13 == 0), failed)
            .when(F.col("role") == "system", tool)
            .otherwise(plain))
    return conv.select(
        F.col("conv_id").cast("string").alias("worker"),
        F.col("turn").alias("line_no"),
        F.timestamp_seconds(
            F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        line.alias("line"))
