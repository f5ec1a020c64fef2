"""Hand-made cases for rules that the SQL twins cannot show."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as tx
from lacuna.operators import explore, frontier, gap, ingest, jobs, labels, logs, usage
from lacuna.operators.keywords import keyword_list, with_keywords
from lacuna.plans import analyze as pl
from lacuna.plans import queries, views
from lacuna.schemas import PAGE_SCHEMA
from lacuna.sources.pages import upsert_pages, with_defaults
from lacuna.sources.query_list import read_queries


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# -- text ---------------------------------------------------------------------

@pytest.mark.parametrize("url,want", [
    ("https://user:pw@Example.COM:8080/a?b#c", "user:pw@Example.COM:8080"),
    ("//cdn.example/x", "cdn.example"),
    ("example.com/x", ""),
    ("http://a b.example/x", "a b.example"),
    ("", ""),
])
def test_domain_of(spark, url, want):
    assert value(spark, tx.domain_of(F.lit(url))) == want


def test_html_title_falls_back_to_heading(spark):
    html = F.lit("<html><title> </title><body><h1>A &amp;lt; <b>b</b></h1></body>")
    assert value(spark, tx.html_title(html)) == "A &lt; b"


def test_html_text(spark):
    html = F.lit("<head><title>t</title></head><script>if (a<b) {}</script><!-- x -->"
                 "<p>Caf&#233;&nbsp;&#x41;<br>b &lt;c&gt; &#xD800;</p><header>h</header>")
    assert value(spark, tx.html_text(html)) == "Café A b <c> � h"


@pytest.mark.parametrize("text,want", [
    ("&oacute;&#243;&#xF3;", "óóó"), ("&#99999999; &#0; &#xD800;", "\ufffd \ufffd \ufffd"), ("&amp;lt; &amp;amp;", "&lt; &amp;"),
    ("&copy 2020 &copyright; &notin; &notit;", "© 2020 ©right; ∉ ¬it;"), ("&#146;s &#0065;&#x041;", "’s AA"),
    ("a & b &; &# &unknown; &am &", "a & b &; &# &unknown; &am &"), ("", ""), ("&NotEqualTilde;", "≂̸"), ("&#233", "é"),
])
def test_character_references(spark, text, want):
    assert value(spark, tx.decode_entities(F.lit(text))) == want


def test_links_with_and_without_quotes(spark):
    html = """<a href="/a">x</a><a class=b href=/c?x=1&copy=2>y</a><A HREF='d"e'>z</A><link href="/no"><a data-href="/no">"""
    assert value(spark, tx.hrefs(F.lit(html))) == ["/a", "/c?x=1&copy=2", 'd"e']
    base = F.lit("https://a.example/d/")
    assert value(spark, tx.resolve_link(base, F.lit("/c?x=1&copy=2&amp;b"))) == "https://a.example/c?x=1&copy=2&b"


@pytest.mark.parametrize("href,want", [
    ("../up", "https://a.example/up"), ("../../../up/", "https://a.example/up/"), ("x/../y/./z", "https://a.example/d/y/z"),
    ("/a/b/..", "https://a.example/a/"), ("https://c.example/a/../b?q=/../x", "https://c.example/b?q=/../x"),
    (".", "https://a.example/d/"), ("..", "https://a.example/"), (".hidden/..x", "https://a.example/d/.hidden/..x"),
    ("/x", "https://a.example/x"), ("y.html#top", "https://a.example/d/y.html"),
    ("./z", "https://a.example/d/z"), ("//b.example/q", "https://b.example/q"),
    ("http://c.example/", "http://c.example/"), ("?p=2", "https://a.example/d/e?p=2"),
    ("#top", None), ("mailto:x@y.example", None), ("", None),
])
def test_resolve_link(spark, href, want):
    assert value(spark, tx.resolve_link(F.lit("https://a.example/d/e?p=1"), F.lit(href))) == want


def test_keywords_tokens(spark):
    words = keyword_list(
        F.lit(""), F.lit("żółw abc1 éclair ząb_x the żółw kot the pies Ąę ąęć"), n=20,
        stopwords=["the"])
    got = value(spark, words)
    assert got[0] == "żółw"
    # a pair may span a dropped stop word
    assert {"kot pies", "żółw kot", "ąęć", "pies ąęć", "żółw żółw"} <= set(got)
    assert not any("abc" in t or "clair" in t or "ząb" in t for t in got)


def test_long_stopword_table_equals_the_short_list(spark):
    short = ["the", "pies", "żółw"]
    table = spark.createDataFrame([(w,) for w in [*short, "the", None, *(f"zz{i}x" for i in range(20_000))]], "w string")
    pages = spark.createDataFrame([
        ("a", "żółw", "the kot the pies kot ząb"), ("b", "the", "pies"), ("c", None, None), ("d", "", "kot the kot pies kot"),
    ], "page_id string, title string, content string").withColumn("keywords", F.array(F.lit("old")))
    want = {r["page_id"]: r["keywords"] for r in with_keywords(pages, stopwords=short).collect()}
    got = {r["page_id"]: r["keywords"] for r in with_keywords(pages, stopwords=table).collect()}
    assert got == want and got["b"] == got["c"] == [] and got["d"] == ["kot", "kot kot"]
    long = {r["page_id"]: r["keywords"] for r in with_keywords(
        pages, stopwords=[*short, *(f"zz{i}x" for i in range(12_000))]).collect()}
    assert long == want


def test_keywords_title_weight_and_empty(spark):
    assert value(spark, keyword_list(F.lit("alfa"), F.lit("beta beta"), n=1)) == ["alfa"]
    assert value(spark, keyword_list(F.lit(""), F.lit("a b 12"))) == []
    assert value(spark, keyword_list(F.lit(None).cast("string"), F.lit(None).cast("string"))) == []


# -- ingestion ----------------------------------------------------------------

def test_metadata_modes(spark):
    pages = spark.createDataFrame(
        [("tfidf",), ("llm",), ("other",), (None,)], "mode string").select(
        "mode", F.lit("tytul strony").alias("title"), F.lit("tekst").alias("content"))

    def enricher(title, content):
        return F.struct(F.lit(None).cast("string").alias("summary"),
                        F.lit(None).cast("array<string>").alias("keywords"))

    rows = {r["mode"]: r for r in ingest.with_metadata(pages, F.col("mode"), enricher).collect()}
    assert rows["llm"]["summary"] == "" and rows["llm"]["keywords"] == []
    assert rows["other"]["metadata_mode"] == rows[None]["metadata_mode"] == "tfidf"
    assert rows["other"]["keywords"] == rows["tfidf"]["keywords"] != []


def test_vector_guard_and_blank_pages(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "page_id string, vector array<float>")
    good, bad = ingest.validate_vectors(rows, 2)
    assert [r["page_id"] for r in good.collect()] == ["a"]
    known = spark.createDataFrame([("x", 1), ("y", 2)], "page_id string, n int")
    vectors = spark.createDataFrame([("x", [1.0]), ("z", [2.0])], "page_id string, vector array<float>")
    assert [tuple(r) for r in ingest.join_vectors(known, vectors).collect()] == [("x", 1, [1.0])]
    assert sorted(r["page_id"] for r in bad.collect()) == ["b", "c"]
    pages = spark.createDataFrame([("x",), ("  ",), (None,)], "content string")
    assert ingest.has_text(pages).count() == 1 and ingest.without_text(pages).count() == 2


def murmur3(data: bytes, seed: int = 42) -> int:
    """32-bit MurmurHash3, whole words as published, as the default embedder's buckets need it."""
    mask, h = 0xFFFFFFFF, seed
    rotl = lambda x, r: (x << r | x >> (32 - r)) & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i:i + 4], "little")
        h = (rotl(h ^ rotl(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= rotl(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def test_default_embedding_is_hashed_word_counts(spark):
    pages = spark.createDataFrame([("Tytuł", "kot pies kot żółw"), ("a", None), (None, "x " * 300)],
                                  "title string, content string")
    for row in ingest.embed(pages.withColumn("text", tx.embed_text(F.col("title"), F.col("content"))), size=16).collect():
        counts = [0.0] * 16
        for word in re.split(r"\s", row["text"].lower().rstrip()):  # blanks at the end give no word, others empty ones
            counts[(murmur3(word.encode()) ^ 1 << 31) - (1 << 31) & 15] += 1
        size = sum(c * c for c in counts) ** 0.5
        assert row["vector"] == pytest.approx([c / size for c in counts], abs=1e-6)


def test_page_records(spark):
    raw = spark.createDataFrame(
        [("https://a.example/1", "<head><title>T</title></head><p>tekst strony</p>"),
         ("https://a.example/2", "<head><title>T</title></head><br>")], "url string, html string")
    rows = ingest.page_records(
        ingest.html_pages(raw), settings=pl.Settings(vector_size=16)).collect()
    assert len(rows) == 1 and rows[0].asDict().keys() == set(PAGE_SCHEMA.names)
    assert len(rows[0]["vector"]) == 16 and rows[0]["cluster_id"] is None
    assert abs((datetime.now() - rows[0]["timestamp"]).total_seconds()) < 3600


# -- store --------------------------------------------------------------------

def page(spark, *rows):
    full = [{**{f: None for f in PAGE_SCHEMA.names}, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f] for f in PAGE_SCHEMA.names) for r in full],
                                 PAGE_SCHEMA)


def at(day):
    return datetime(2024, 1, day)


def test_upsert_replaces_the_whole_row(spark):
    store = page(spark, dict(page_id="p", title="a", timestamp=at(2), cluster_id=4,
                             cluster_label="x"),
                 dict(page_id="q", title="keep", timestamp=at(9), cluster_id=1))
    batch = page(spark, dict(page_id="p", title="old", timestamp=at(1)),
                 dict(page_id="p", title="new", timestamp=at(5)),
                 dict(page_id="q", title="late", timestamp=at(3)))
    once = upsert_pages(store, batch)
    rows = {r["page_id"]: r for r in once.collect()}
    assert rows["p"]["title"] == "new" and rows["p"]["cluster_id"] is None
    assert rows["q"]["title"] == "keep" and rows["q"]["cluster_id"] == 1
    again = upsert_pages(once, batch)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    defaults = {r["page_id"]: r for r in with_defaults(once).collect()}
    assert defaults["p"]["cluster_id"] == -1 and defaults["p"]["keywords"] == []


def test_query_list(spark, tmp_path):
    path = tmp_path / "list.yaml"
    path.write_text('# head\nqueries:\n\n  # part\n  - "żółw #1"\n  - \'b c\'\n  - plain text # note\n',
                    encoding="utf-8")
    rows = read_queries(spark, str(path)).orderBy("seq").collect()
    assert [r["query"] for r in rows] == ["żółw #1", "b c", "plain text"]
    assert read_queries(spark, str(path), 2).count() == 2


# -- labels -------------------------------------------------------------------

def labelled(spark, rows):
    df = spark.createDataFrame(
        rows, "cluster_id int, page_id string, title string, keywords array<string>")
    return {r["cluster_id"]: r["cluster_label"] for r in labels.topic_labels(df).collect()}


def test_label_rules(spark):
    got = labelled(spark, [
        (0, "a", "t", ["Beta ", "alfa"]), (0, "b", "t", ["alfa", "beta", "  "]),
        (1, "c", "Dobre słowa tutaj", ["  ", ""]),
        (2, "d", "Słowa nowe ale to", []), (2, "e", "nowe", None),
        (3, "f", "a bc def", []),
        (4, "g", None, None),
        (-1, "h", "x", ["word"]),
    ])
    assert got == {0: "beta · alfa", 1: "unlabelled", 2: "nowe · słowa", 3: "unlabelled",
                   4: "unlabelled", -1: "noise"}


def test_noise_label_reaches_spread_pages(spark):
    placed = spark.createDataFrame([(f"p{i}", -1 if i % 3 else i % 2) for i in range(60)], "page_id string, cluster_id int")
    names = spark.createDataFrame([(-1, "noise"), (-1, "noise"), (0, "a")], "cluster_id int, cluster_label string")
    got = labels.assign_labels(placed, names).collect()
    assert len(got) == 50 and all(r["cluster_label"] == {-1: "noise", 0: "a"}[r["cluster_id"]] for r in got)


# -- coverage -----------------------------------------------------------------

def gap_pages(spark, own, competitor):
    rows = [(f"o{i}", f"u{i}", "", "own", -1, "", v) for i, v in enumerate(own)]
    rows += [(f"c{i}", f"cu{i}", "", "competitor", c, f"t{c}", v)
             for i, (c, v) in enumerate(competitor)]
    return spark.createDataFrame(rows, "page_id string, url string, title string, source string, "
                                       "cluster_id int, cluster_label string, vector array<float>"
                                 ).withColumns({"domain": F.lit("d"), "summary": F.lit("")})


def test_gap_edges(spark):
    pages = gap_pages(spark, [[0.0, 0.0], [4.0, 3.0], [4.0, 3.0]],
                      [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (-1, [0.0, 1.0]), (1, [0.0, -1.0])])
    rows = {r["cluster_id"]: r for r in gap.gap_report(pages, 0.2).collect()}
    # distance 0.2 lies on the threshold; the first of two equal own pages is named
    assert rows[0]["covered"] and rows[0]["coverage_score"] == 0.0
    assert rows[0]["best_own_page"]["url"] == "u1" and rows[0]["page_count"] == 2
    # the zero vector is at distance 1 of everything and wins against farther pages
    assert rows[1]["best_own_page"]["url"] == "u0" and not rows[1]["covered"]
    assert len(rows[0]["example_pages"]) == 2


def test_gap_slabs_agree(spark):
    pages = gap_pages(spark, [[1.0, 0.0], [0.0, 1.0]],
                      [(c, [1.0, c / 10]) for c in range(12)])
    topics = gap.centroids(pages)
    one = gap.nearest_own(pages, topics).orderBy("cluster_id").collect()
    for options in (dict(slab_topics=2), dict(slab_topics=2, slabs_at_once=2), dict(slab_topics=1, slabs_at_once=1, topic_count=12)):
        many = gap.nearest_own(pages, topics, **options).orderBy("cluster_id").collect()
        assert one == many and len(one) == 12


def test_gap_own_vectors_stay_in_place(spark, tmp_path):
    """Three slabs in one pass: the own pages meet them in a broadcast join, and only winners are shuffled."""
    gap_pages(spark, [[1.0, 0.0], [0.0, 1.0]], [(c, [1.0, c / 10]) for c in range(6)]).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    topics = spark.createDataFrame([(c, [1.0, 0.0]) for c in range(6)], "cluster_id int, centroid array<double>")
    found = gap.nearest_own(pages, topics, slab_topics=2, topic_count=6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("BroadcastExchange" in line for line in exchanges) == 1 and "BroadcastNestedLoopJoin" in plan
    assert not any("own_flat" in line or "vector" in line for line in exchanges)
    # one shuffle for the winners, one for the slabs
    assert sum("hashpartitioning" in line for line in exchanges) == 2


def test_centroids_of_many_topics(spark):
    """Sums by task and their merge: no sort, equal to numpy; flushing early changes nothing."""
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(int(c), v) for c, v in zip(rng.integers(0, 1000, 4000), rng.normal(size=(4000, 3)).round(2).tolist())]
    rows += [(0, [0.0, 0.0, 0.0])]
    pages = gap_pages(spark, [[1.0, 0.0, 0.0]], rows).repartition(6)
    df = gap.centroids(pages)
    assert "Sort" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["cluster_id"]: r for r in df.collect()}
    for c in {c for c, _ in rows}:
        mine = [(f"c{i}", np.float32(v).astype(float)) for i, (t, v) in enumerate(rows) if t == c]
        total = sum(v / (np.linalg.norm(v) or 1) for _, v in mine)
        np.testing.assert_allclose(got[c]["centroid"], total / (np.linalg.norm(total) or 1), atol=1e-9)
        assert (got[c]["page_count"], got[c]["first_page_id"], got[c]["cluster_label"]) == (
            len(mine), min(p for p, _ in mine), f"t{c}")
    sums = gap._TopicSums()
    sums.add(np.array([2, 1, 2]), np.eye(3), np.array([1, 1, 1]), np.array(["b", "a", "b"], dtype=object),
             np.array([None, "x", "y"], dtype=object))
    out = sums.flush().set_index("cluster_id")
    assert out.loc[2, "cluster_label"] == "y" and out.loc[2, "page_count"] == 2 and not sums.sums


def test_report_order(spark):
    """Least covered topic first, equal scores by first page."""
    pages = gap_pages(spark, [[1.0, 0.0]], [(3, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (0, [0.9, 0.1])])
    assert [r["cluster_id"] for r in gap.gap_report(pages, 0.5).collect()] == [3, 2, 0, 1]
    assert [r["cluster_id"] for r in gap.gap_clusters(pages, 0.5).collect()] == [3, 2, 0, 1]


def test_score_has_no_upper_limit_and_needs_a_threshold(spark):
    assert value(spark, gap.coverage_score(F.lit(-0.3), 0.3)) == 2.0
    with pytest.raises(ValueError):
        gap.coverage_score(F.lit(0.1), 0.0)


def test_coverage_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 40), (3, 40), (0, 0)],
                               "covered_clusters bigint, total_clusters bigint")
    assert [r["coverage_pct"] for r in gap.coverage_percent(df).collect()] == [2, 8, 0]


def test_analysis_refuses_empty_parts(spark):
    pages = gap_pages(spark, [], [(0, [1.0, 0.0])])
    pages = pages.withColumn("keywords", F.array().cast("array<string>"))
    with pytest.raises(ValueError, match="own"):
        pl.coverage(pages)
    with pytest.raises(ValueError, match="competitor"):
        pl.find_topics(gap_pages(spark, [[1.0, 0.0]], []).withColumn(
            "keywords", F.array().cast("array<string>")))
    with pytest.raises(ValueError, match="topic"):
        pl.coverage(gap_pages(spark, [[1.0, 0.0]], [(-1, [1.0, 0.0])]))


# -- exploring ----------------------------------------------------------------

def test_own_pages_survive_map_filters(spark):
    pages = gap_pages(spark, [[1.0, 0.0]], [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (-1, [1.0, 0.0])])
    ids = {r["page_id"] for r in explore.map_view(pages, labels=["t1"]).collect()}
    assert ids == {"o0", "c1"}
    ids = {r["page_id"] for r in explore.map_view(pages, domains=["none"]).collect()}
    assert ids == {"o0"}
    assert explore.map_view(pages, show_noise=True).count() == 4


def test_search_is_a_regular_expression(spark):
    rows = spark.createDataFrame(
        [("abc", "u"), (None, "xaBcx"), ("a.c", None), (None, None), ("ac", "u")],
        "title string, url string")
    assert explore.explore(rows, search="a.c").count() == 3
    assert explore.explore(rows, search=r"a\.c").count() == 1


# -- frontier, jobs, usage ----------------------------------------------------

def test_frontier_threshold(spark):
    stored = spark.createDataFrame(
        [("a", "competitor")] * 5 + [("b", "competitor")] * 4 + [("c", "own")] * 9,
        "domain string, source string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "domain string")
    got = {r["domain"]: r["action"] for r in frontier.frontier_actions(wanted, stored).collect()}
    assert got == {"a": "skip", "b": "recrawl", "c": "crawl"}


def test_job_rules(spark):
    now = F.lit(datetime(2024, 1, 2, 12)).cast("timestamp")
    table = jobs.new_jobs(spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")],
                                                "seq bigint, query string"), now)
    assert table.count() == 2
    started = jobs.start_jobs(table, jobs.next_batch(table, 1), now)
    assert {r["query"]: r["status"] for r in started.collect()} == {
        "x": "in_progress", "y": "pending"}
    # exactly 120 minutes is not stale yet
    on_time = F.lit(datetime(2024, 1, 2, 14)).cast("timestamp")
    late = F.lit(datetime(2024, 1, 2, 14, 0, 1)).cast("timestamp")
    assert jobs.reset_stale(started, on_time).filter("status = 'in_progress'").count() == 1
    assert jobs.reset_stale(started, late).filter("status = 'in_progress'").count() == 0
    outcomes = spark.createDataFrame(
        [("x", "failed", datetime(2024, 1, 3), "e" * 3000), ("x", "done", datetime(2024, 1, 2), None)],
        "query string, outcome string, at timestamp, error string")
    done = {r["query"]: r for r in jobs.apply_outcomes(started, outcomes).collect()}
    assert done["x"]["status"] == "failed" and len(done["x"]["error"]) == 2000
    assert done["x"]["started_at"] is not None and done["y"]["status"] == "pending"
    reset = jobs.seed_jobs(started, spark.createDataFrame([(5, "x")], "seq bigint, query string"),
                           now, reset=True)
    assert [r["status"] for r in reset.collect()] == ["pending"]


def test_projection_without_pages(spark):
    totals = usage.usage_totals(spark.createDataFrame(
        [(None, "llm", 10, 5)], "ts timestamp, kind string, input_tokens bigint, output_tokens bigint"))
    row = usage.usage_projection(totals, 100).first()
    assert row["pages_processed"] == 0 and row["projected_cost_usd"] is None
    assert usage.usage_projection(totals, 0).first()["projected_cost_usd"] is None


# -- logs ---------------------------------------------------------------------

@pytest.mark.parametrize("text,want", [
    ("resets 5PM UTC", "2024-01-01 17:01:00"),
    ("limit resets at 5 PM UTC", None),
    ("resets at 3:45 PM (UTC)", "2024-01-01 15:46:00"),
    ("resets at 3:45PM UTC", None),
    ("Reset 15:45 (UTC)", "2024-01-01 15:46:00"),
    ("resets at 9:30 UTC", "2024-01-02 09:31:00"),
    ("resets at 12:10 AM UTC", "2024-01-02 00:11:00"),
    ("resets at 12PM UTC", "2024-01-01 12:01:00"),
    ("resets at 13PM UTC", None),
    ("resets at 25:10 UTC", None),
    ("resets soon", None),
])
def test_reset_times(spark, text, want):
    at_ten = F.timestamp_seconds(F.lit(1704103200))
    got = value(spark, F.date_format(logs.reset_time(F.lit(text), at_ten), "yyyy-MM-dd HH:mm:ss"))
    assert got == want


def test_limit_phrases(spark):
    for phrase in logs.LIMIT_PHRASES:
        assert value(spark, logs.is_limit_line(F.lit(f"x {phrase.upper()} y")))
    assert not value(spark, logs.is_limit_line(F.lit("all is well")))


def test_log_lines(spark):
    lines = spark.createDataFrame([
        ("w", 1, '{"type":"assistant","message":{"content":[{"type":"text","text":"a"},'
                 '{"type":"tool","text":"b"},{"type":"text","text":"c"}]}}'),
        ("w", 2, "plain {not json"), ("w", 3, "   "), ("w", 4, '{"type":"tool_use"}'),
        ("w", 5, '{"type":"rate_limit_event","rate_limit_info":{"status":"allowed"}}'),
        ("w", 6, '{"type":"rate_limit_event","rate_limit_info":{"status":"denied"}}'),
        ("w", 7, '{"type":"result","subtype":"error"}'),
        ("w", 8, "{not json"),
    ], "worker string, line_no int, line string")
    parsed = logs.parse_log(lines)
    assert parsed.count() == 7
    assert [r["text"] for r in logs.text_blocks(parsed).orderBy("block_no").collect()] == ["a", "c"]
    assert sorted(r["raw"] for r in parsed.filter("raw is not null").collect()) == [
        "plain {not json", "{not json"]
    assert [tuple(r) for r in logs.tool_counts(parsed).collect()] == [("unknown", 1)]
    assert [r["resume_at"] for r in logs.denied_limits(parsed).collect()] == [None]
    assert [r["error"] for r in logs.error_results(parsed).collect()] == ["unknown error"]


@pytest.mark.parametrize("line,event", [
    ('{"type":"a","type":"tool_use","name":"n"}', True), ('{"type":"tool_use"} x', False), ("{'type':'tool_use'}", False),
    ('{"type":"tool_use"},{"type":"tool_use"}', False), ('[{"type":"tool_use"}]', False), ("{}", True), ("{", False),
    ('{"type":"tool_use","message":"text","rate_limit_info":7,"other":{"a":[1]}}', True), ('"x"', False),
])
def test_log_line_shapes(spark, line, event):
    row = logs.parse_log(spark.createDataFrame([("w", 1, line)], "worker string, line_no int, line string")).first()
    assert (row["event"] is not None, row["raw"]) == (event, None if event else line)
    if event and "tool_use" in line:
        assert row["event"]["type"] == "tool_use"


@pytest.mark.parametrize("told,want", [("1704067200", "2024-01-01 00:01:00"), ("1704067200.9", "2024-01-01 00:01:00"),
                                       ("0", None), ("null", None), ('"soon"', None), ("1.7040672e9", "2024-01-01 00:01:00")])
def test_denied_limit_times(spark, told, want):
    line = '{"type":"rate_limit_event","rate_limit_info":{"status":"allowed","status":"denied","resetsAt":%s}}' % told
    parsed = logs.parse_log(spark.createDataFrame([("w", 1, line)], "worker string, line_no int, line string"))
    rows = logs.denied_limits(parsed).select(F.date_format("resume_at", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert [r["t"] for r in rows] == [want]


def test_silence_across_buckets(spark):
    times = [datetime(2024, 1, 1, 23, 50), datetime(2024, 1, 2, 0, 5), datetime(2024, 1, 2, 0, 10),
             datetime(2024, 1, 4, 0, 10)]
    rows = spark.createDataFrame([("w", t) for t in times], "worker string, ts timestamp")
    got = logs.silences(rows).orderBy("last_output").collect()
    assert [r["idle_minutes"] for r in got] == [15, 2880]


def test_page_store_does_not_move_texts_that_nobody_reads(spark, tmp_path):
    spark.createDataFrame([(i, f"some text {i}", "en", "web", 11) for i in range(30)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 30, 3)], "vec_id bigint, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = views.page_store(spark, str(tmp_path)).drop("content")
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
            pages._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) Exchange\n(Input[^\n]*)", plan)
        assert moved and not any("text#" in line for line in moved)
        assert pages.count() == 30 and pages.filter("vector is not null").count() == 10
        assert pages.columns.index("vector") == pages.columns.index("timestamp") + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keywords_are_made_before_vectors_are_joined(spark, tmp_path):
    """With the joins of large tables, no text moves, and pages without a vector are told apart before."""
    spark.createDataFrame([(i, f"some words about subject {i}", "en", "web", 22) for i in range(40)] + [(None, "lost", "en", "web", 4)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    # a vector twice, one that is null and one of no document
    known = [(i, [float(i), 1.0]) for i in range(0, 30, 3)] + [(3, [9.0, 1.0]), (4, None), (99, [1.0, 1.0])]
    spark.createDataFrame(known, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = views.page_texts(spark, str(tmp_path))
        near = views.near_vectors(spark, str(tmp_path), texts)
        assert near.count() < 15  # 10 and perhaps some that share a bucket
        for part in (texts, near):
            pages = queries._keyword_pages(spark, str(tmp_path), part).filter("vector is not null").select(
                "page_id", "title", "vector", "keywords")
            plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
                pages._jdf.queryExecution(), "formatted")
            moved = re.findall(r"\) Exchange\n(Input[^\n]*)", plan)
            assert any("keywords#" in line for line in moved) and not any(re.search("(text|content)#", line) for line in moved)
            assert pages.count() == 11
        store = views.page_store(spark, str(tmp_path))
        assert queries._keyword_pages(spark, str(tmp_path)).columns == [*store.columns, "keywords"]
        assert queries._keyword_pages(spark, str(tmp_path)).count() == 42
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
