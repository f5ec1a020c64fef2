"""Streams and the page table: restarts, replays, snapshots."""

from pyspark.sql import functions as F

from lacuna.operators import ingest, usage
from lacuna.plans import analyze as pl
from lacuna.plans import views
from lacuna.sources import reports
from lacuna.sources.page_table import PageTable
from lacuna.streaming import streams

from .conftest import SF

PAGES = "page_id bigint, url string, html string, day int"


def test_upsert_stream_replay_and_late_pages(spark, tmp_path):
    folder, table = str(tmp_path / "in"), PageTable(spark, str(tmp_path / "table"))

    def write(day, title):
        spark.createDataFrame(
            [(1, "https://a.example/1", f"<title>{title}</title><p>x y</p>", day)], PAGES
        ).coalesce(1).write.mode("append").parquet(folder)

    def to_records(batch):
        pages = ingest.html_pages(batch, query=F.col("day").cast("string"))
        return ingest.page_records(
            pages, settings=pl.Settings(vector_size=8),
            at=F.timestamp_seconds(F.col("query").cast("bigint") * 86400))

    def run():
        raw = streams.read_stream(spark, folder, PAGES)
        streams.upsert_stream(raw, table, to_records, str(tmp_path / "cp")).awaitTermination()

    write(5, "five")
    run()
    assert table.read().first()["title"] == "five"
    table.patch(spark.createDataFrame(
        [(table.read().first()["page_id"], 3, "topic")],
        "page_id string, cluster_id int, cluster_label string"))
    assert table.read().first()["cluster_id"] == 3
    write(2, "two")
    run()
    assert table.read().first()["title"] == "five" and table.read().first()["cluster_id"] == 3
    write(9, "nine")
    run()
    row = table.read().first()
    assert row["title"] == "nine" and row["cluster_id"] is None and table.read().count() == 1
    before = table.read().collect()
    table.compact()
    assert table.read().collect() == before
    assert table.next_batch() == 3
    # a replayed delivery that is already merged changes nothing
    table.deliver(table.read(), 2)
    assert table.read().collect() == before


def test_patches_hold_until_a_page_is_written_again(spark, tmp_path):
    """Patches between deliveries, against the same steps one after the other; a patch stores no vector."""
    from lacuna.schemas import PAGE_SCHEMA
    from lacuna.sources.pages import patch_pages, upsert_pages

    table = PageTable(spark, str(tmp_path / "table"))
    plain = spark.createDataFrame([], PAGE_SCHEMA)
    steps = [("deliver", 3, "pqr"), ("patch", 1, "pq"), ("deliver", 2, "p"), ("deliver", 5, "q"), ("patch", 2, "qrx"),
             ("deliver", 5, "r"), ("patch", 3, "q"), ("compact", 0, ""), ("patch", 4, "p"), ("deliver", 9, "p"), ("deliver", 4, "r")]
    for number, (step, value, ids) in enumerate(steps):
        if step == "deliver":
            rows = spark.createDataFrame([(i, f"{i}{number}", value) for i in ids], "page_id string, title string, day int").select(
                *(F.col(f.name) if f.name in ("page_id", "title") else F.timestamp_seconds(F.col("day") * 86400).alias("timestamp")
                  if f.name == "timestamp" else F.array(F.lit(0.5)).cast("array<float>").alias("vector")
                  if f.name == "vector" else F.lit(None).cast(f.dataType).alias(f.name) for f in PAGE_SCHEMA))
            table.deliver(rows, table.next_batch())
            plain = upsert_pages(plain, rows)
        elif step == "patch":
            news = spark.createDataFrame([(i, value, f"t{value}") for i in ids], "page_id string, cluster_id int, cluster_label string")
            table.patch(news)
            plain = patch_pages(plain, news)
        else:
            table.compact()
        plain = spark.createDataFrame(plain.collect(), PAGE_SCHEMA)
        assert sorted(map(str, table.read().collect())) == sorted(map(str, plain.collect())), (number, step)
    topics = spark.read.parquet(str(tmp_path / "table" / "topics"))
    assert set(topics.columns) == {"page_id", "cluster_id", "cluster_label", "after", "version", "patch"}


def test_usage_stream_continues_after_restart(spark, tmp_path):
    events = views.usage_events(spark, SF)
    folder = str(tmp_path / "in")
    for part in (0, 1):
        events.filter(F.pmod(F.hash("ts"), F.lit(2)) == part).coalesce(1).write.mode(
            "append").parquet(folder)
        stream = streams.read_stream(spark, folder, events.schema)
        streams.usage_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    got = streams.read_usage(spark, str(tmp_path / "t")).first()
    assert got == usage.usage_totals(events).first()


def test_log_stream_reads_text(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "agent1.log").write_text("hello\nusage limit\n")
    rows = streams.read_log_stream(spark, str(folder))
    streams.append_stream(rows, str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).orderBy("line").collect()
    assert [(r["worker"], r["line"]) for r in got] == [
        ("agent1", "hello"), ("agent1", "usage limit")]


def test_sessions_close_by_timer_and_open_ones_are_told(spark, tmp_path):
    """Events in three batches, one late: sessions as over all events; silence is told without another line."""
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "worker string, ts timestamp"

    def run(rows):
        spark.createDataFrame(rows, "worker string, m double").select(
            "worker", F.timestamp_micros(((F.col("m") + 1440) * 60_000_000).cast("bigint")).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        streams.silence_watch(streams.read_stream(spark, folder, schema), out, cp).awaitTermination()
        return {(r.worker, r.first_output.minute + 60 * r.first_output.hour, r.last_output.minute + 60 * r.last_output.hour,
                 r.lines, r.silent) for r in streams.read_sessions(spark, out).collect()}

    assert run([("a", 0.0), ("a", 5.0), ("b", 1.0), ("b", 16.0), ("a", None), (None, 2.0)]) == {
        ("a", 0, 5, 2, False), ("b", 1, 1, 1, False), ("b", 16, 16, 1, False), (None, 2, 2, 1, False)}
    # 14 comes late and joins a's lines to the new one; c moves the watermark past b's first session
    assert run([("a", 28.0), ("a", 14.0), ("c", 60.0)]) == {
        ("a", 0, 28, 4, True), ("b", 1, 1, 1, True), ("b", 16, 16, 1, True), (None, 2, 2, 1, True), ("c", 60, 60, 1, False)}
    # too late for the watermark: dropped; the open session goes on
    assert run([("a", 30.0), ("c", 61.0), ("c", 200.0)]) == {
        ("a", 0, 28, 4, True), ("b", 1, 1, 1, True), ("b", 16, 16, 1, True), (None, 2, 2, 1, True), ("c", 60, 61, 2, True),
        ("c", 200, 200, 1, False)}
    assert streams.read_sessions(spark, str(tmp_path / "none")).count() == 0


def test_whole_analysis(spark, tmp_path):
    """Planted topics go from a page table through the analysis into reports."""
    import numpy as np
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6))
    rows = []
    for i in range(36):
        v = centres[i % 3] + 0.05 * rng.normal(size=6)
        rows.append((f"https://c.example/{i}", "competitor", [float(x) for x in v],
                     [f"slowo{'abc'[i % 3]}", "inne"]))
    rows.append(("https://own.example/1", "own", [float(x) for x in centres[0]], []))
    pages = spark.createDataFrame(
        rows, "url string, source string, vector array<float>, keywords array<string>").select(
        F.md5("url").alias("page_id"), "url", F.lit("t").alias("title"),
        F.lit("c.example").alias("domain"), "source", F.lit("").alias("query"),
        F.lit("").alias("summary"), "keywords", F.lit("tfidf").alias("metadata_mode"),
        F.lit("").alias("content_snippet"),
        F.timestamp_seconds(F.lit(1704067200)).alias("timestamp"), "vector",
        F.lit(None).cast("int").alias("cluster_id"),
        F.lit(None).cast("string").alias("cluster_label"))
    table = PageTable(spark, str(tmp_path / "table"))
    table.deliver(pages, 0)
    out = str(tmp_path / "out")
    result = pl.analyze_table(table, out, pl.Settings(min_cluster_size=5), method=pl.AXES)
    summary = reports.read_gap_summary(spark, f"{out}/gap").first()
    assert (summary["total_clusters"], summary["covered_clusters"]) == (3, 1)
    report = reports.read_gap_report(spark, f"{out}/gap").collect()
    assert {len(r["example_pages"]) for r in report} == {5}
    assert {r["page_count"] for r in report} == {12}
    assert reports.read_projection(spark, f"{out}/projection").count() == 37
    assert table.read().filter("cluster_id >= 0").count() == 36
    assert result.assignments.count() == 36
