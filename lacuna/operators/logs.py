"""Agent-log queries: text, tools, limit messages, reset times, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.schemas import LOG_EVENT_SCHEMA

# Phrases that mark a usage limit, in any letter case, anywhere in a line.
LIMIT_PHRASES = (
    "usage limit",
    "rate limit",
    "too many requests",
    "hit your limit",
    "claude ai usage",
    "exceeded your",
    "quota exceeded",
    "please slow down",
    "api error: terminated",
)

# Shape of a reset announcement, and the safety margin added to it.
RESET_PATTERN = (
    r"(?i)resets?\s*(?:at\s*)?(\d{1,2}(?::\d{2})?\s*[AP]M|\d{1,2}:\d{2})\s*\(?UTC\)?")
RESET_MARGIN_SECONDS = 60


# Spark reads more than JSON unless told otherwise.
_STRICT = {"allowSingleQuotes": "false"}


def parse_log(lines: DataFrame) -> DataFrame:
    """Non-blank lines with the parsed event, or the text in ``raw`` when no JSON object.

    A line is parsed once, as the only element of an array, so text after the object makes
    it unreadable. Of a key that occurs twice the last value counts.
    """
    trimmed = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter(F.col("line") != "")
    only = F.when(F.col("line").startswith("{"), F.from_json(
        F.concat(F.lit("["), F.col("line"), F.lit("]")), T.ArrayType(LOG_EVENT_SCHEMA), _STRICT))
    parsed = trimmed.withColumn("event", only)
    is_json = F.coalesce(F.size("event") == 1, F.lit(False)) & F.col("event")[0].isNotNull()
    return parsed.withColumns({
        "event": F.when(is_json, F.col("event")[0]),
        "raw": F.when(~is_json, F.col("line"))})


def text_blocks(parsed: DataFrame) -> DataFrame:
    """Text blocks of assistant messages, one row each."""
    assistant = parsed.filter(F.col("event.type") == "assistant")
    content = F.from_json(F.from_json("event.message", "content string", _STRICT)["content"],
                          "array<struct<type string, text string>>", _STRICT)
    blocks = assistant.select("worker", "line_no", F.posexplode_outer(content).alias("block_no", "block"))
    return blocks.filter(F.col("block.type") == "text").select(
        "worker", "line_no", "block_no", F.col("block.text").alias("text"))


def tool_counts(parsed: DataFrame) -> DataFrame:
    tools = parsed.filter(F.col("event.type") == "tool_use")
    return tools.groupBy(
        F.coalesce("event.name", F.lit("unknown")).alias("tool")
    ).agg(F.count(F.lit(1)).alias("calls"))


def denied_limits(parsed: DataFrame) -> DataFrame:
    """Denied limit events with the second from which work may go on (NULL when not told).

    Fractions of a second are dropped.
    """
    rows = parsed.filter(F.col("event.type") == "rate_limit_event").withColumn(
        "info", F.from_json("event.rate_limit_info", "status string, resetsAt string", _STRICT))
    resets = F.floor(F.nullif(F.expr("try_cast(info.resetsAt AS double)"), F.lit(0.0)))
    return rows.filter(F.col("info.status") == "denied").select(
        "worker", "line_no",
        F.timestamp_seconds(resets + RESET_MARGIN_SECONDS).alias("resume_at"))


def error_results(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(
        (F.col("event.type") == "result") & (F.col("event.subtype") == "error"))
    return rows.select(
        "worker", "line_no",
        F.coalesce("event.error", F.lit("unknown error")).alias("error"))


def is_limit_line(line: Column) -> Column:
    lower = F.lower(line)
    hit = F.lit(False)
    for phrase in LIMIT_PHRASES:
        hit = hit | F.contains(lower, F.lit(phrase))
    return hit


def reset_time(line: Column, at: Column) -> Column:
    """Announced reset time plus a margin, the next one after ``at``.

    Readable shapes are ``5PM``, ``3:45 PM`` and ``15:45``; others give NULL.
    """
    text = F.upper(F.trim(F.regexp_extract(line, RESET_PATTERN, 1)))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    whole = r"^(1[0-2]|0?[1-9])([AP])M$"
    half = r"^(1[0-2]|0?[1-9]):([0-5]?[0-9])\s+([AP])M$"
    full = r"^(2[0-3]|[01]?[0-9]):([0-5]?[0-9])$"

    def minutes(hour: Column, minute: Column, half_day: Column) -> Column:
        return ((hour.cast("int") % 12 + F.when(half_day == "P", 12).otherwise(0)) * 60
                + minute.cast("int"))

    of_day = (
        F.when(text.rlike(whole), minutes(part(whole, 1), F.lit("0"), part(whole, 2)))
        .when(text.rlike(half), minutes(part(half, 1), part(half, 2), part(half, 3)))
        .when(text.rlike(full), part(full, 1).cast("int") * 60 + part(full, 2).cast("int")))
    # epoch arithmetic keeps the clock in UTC whatever the session time zone is
    now = F.unix_micros(at.cast("timestamp"))
    day = 86_400 * 1_000_000
    today = now - F.pmod(now, F.lit(day)) + of_day.cast("bigint") * 60_000_000
    chosen = F.when(today < now, today + day).otherwise(today)
    return F.timestamp_micros(chosen + RESET_MARGIN_SECONDS * 1_000_000)


def limit_hits(lines: DataFrame, wait_hours: int = 5) -> DataFrame:
    """Lines that announce a limit, JSON or not, with the time to resume.

    Without a readable reset time the wait ends ``wait_hours`` after the line.
    """
    hits = lines.filter(is_limit_line(F.col("line")))
    exact = reset_time(F.col("line"), F.col("ts"))
    return hits.select(
        "worker", "line_no", "ts", exact.isNotNull().alias("exact"),
        F.coalesce(exact, F.col("ts").cast("timestamp")
                   + F.make_dt_interval(hours=F.lit(wait_hours))).alias("resume_at"))


def silences(events: DataFrame, minutes: int = 15, bucket: str = "hour") -> DataFrame:
    """Gaps of at least ``minutes`` between two events of one worker.

    Rows are ordered inside (worker, time bucket) only; gaps across buckets come
    from one first/last row per bucket. A worker that writes a large part of
    all events is thus spread over its buckets.
    """
    events = events.select("worker", F.col("ts").cast("timestamp").alias("ts")).withColumn(
        "bucket", F.date_trunc(bucket, "ts"))
    inside = events.withColumn("previous", F.lag("ts").over(
        Window.partitionBy("worker", "bucket").orderBy("ts")))
    edges = events.groupBy("worker", "bucket").agg(
        F.min("ts").alias("ts"), F.max("ts").alias("last"))
    across = edges.withColumn("previous", F.lag("last").over(
        Window.partitionBy("worker").orderBy("bucket")))
    gaps = inside.select("worker", "previous", "ts").unionByName(
        across.select("worker", "previous", "ts"))
    idle = F.unix_micros("ts") - F.unix_micros("previous")
    return gaps.filter(idle >= minutes * 60 * 1_000_000).select(
        "worker", F.col("previous").alias("last_output"), F.col("ts").alias("next_output"),
        F.greatest(F.lit(1), F.floor(idle / 60_000_000)).cast("bigint").alias("idle_minutes"))
