"""The registered queries as SQL over the same tables, written independently."""

from __future__ import annotations

from lacuna.operators.logs import LIMIT_PHRASES
from lacuna.plans.queries import STOPWORDS

PAGE_STORE = """
page_store AS (
  SELECT md5(url) AS page_id, * FROM (
    SELECT 'https://' || d.source || '.example/' || d.doc_id AS url,
           substr(d.text, 1, 60) AS title,
           d.source || '.example' AS domain,
           CASE WHEN d.doc_id % 10 = 0 THEN 'own' ELSE 'competitor' END AS source,
           CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE 'q' || (d.doc_id % 20) END AS query,
           '' AS summary,
           substr(d.text, 1, 500) AS content_snippet,
           d.text AS content,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS ts,
           e.embedding AS vector,
           CAST(CASE WHEN d.doc_id % 10 = 0 OR d.doc_id % 13 = 0 THEN -1 ELSE d.doc_id // 10 % 10 END AS INTEGER) AS cluster_id,
           CASE WHEN d.doc_id % 10 = 0 THEN '' WHEN d.doc_id % 13 = 0 THEN 'noise'
                ELSE 'topic ' || (d.doc_id // 10 % 10) END AS cluster_label
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id))
"""


def _gap(threshold: float) -> str:
    return f"""{PAGE_STORE},
dims AS (
  SELECT page_id, source, cluster_id, unnest(vector)::DOUBLE AS x,
         generate_subscripts(vector, 1) AS i
  FROM page_store WHERE vector IS NOT NULL AND (source = 'own' OR cluster_id <> -1)),
norms AS (SELECT page_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY page_id),
unit AS (
  SELECT d.page_id, source, cluster_id, i, x / n AS x
  FROM dims d JOIN norms USING (page_id)),
means AS (
  SELECT cluster_id, i, avg(x) AS m FROM unit WHERE source = 'competitor'
  GROUP BY cluster_id, i),
sizes AS (SELECT cluster_id, sqrt(sum(m * m)) AS n FROM means GROUP BY cluster_id),
cent AS (SELECT cluster_id, i, m / n AS c FROM means JOIN sizes USING (cluster_id)),
dist AS (
  SELECT c.cluster_id, u.page_id, round(1 - sum(u.x * c.c), 10) AS d
  FROM unit u JOIN cent c USING (i) WHERE u.source = 'own'
  GROUP BY c.cluster_id, u.page_id),
best AS (
  SELECT * FROM dist
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY d, page_id) = 1),
topics AS (
  SELECT cluster_id, count(*) AS page_count, arg_min(cluster_label, page_id) AS cluster_label,
         min(page_id) AS first_page_id
  FROM page_store WHERE source = 'competitor' AND cluster_id <> -1 AND vector IS NOT NULL
  GROUP BY cluster_id),
report AS (
  SELECT t.cluster_id, t.cluster_label, t.page_count, b.d <= {threshold} AS covered,
         round(greatest(0.0, 1 - b.d / {threshold}), 4) AS coverage_score,
         round(b.d, 4) AS min_distance_to_own, p.url AS best_url, p.title AS best_title,
         round(b.d, 4) AS best_distance, first_page_id
  FROM topics t JOIN best b USING (cluster_id) JOIN page_store p ON p.page_id = b.page_id)
"""


def _unescape(expr: str) -> str:
    # the references that the test pages hold
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        expr = f"replace({expr}, '{name}', '{char}')"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


def _visible(expr: str) -> str:
    plain = _unescape(f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({plain}, '[\\s ]+', ' ', 'g'))"


def _text(html: str) -> str:
    for tag in ("head", "script", "style", "noscript", "template"):
        html = f"regexp_replace({html}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return _visible(f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')")


TITLE = (f"coalesce(nullif({_visible('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, ''), "
         f"{_visible('''regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)''')})")
DOMAIN = "regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
HTML = f"""html_pages AS (
  SELECT url, {TITLE} AS title, {_text('html')} AS content, {DOMAIN} AS domain FROM pages)"""

RESULTS = f"""
results AS (
  SELECT 'q' || (page_id % 20) AS query, page_id // 20 + 1 AS rank,
         page_id % 7 = 0 AS sponsored, url FROM pages),
organic AS (
  SELECT *, {DOMAIN} AS domain,
         row_number() OVER (PARTITION BY query ORDER BY rank, url) AS position
  FROM results WHERE NOT sponsored QUALIFY position <= 5),
stored AS (SELECT url, {DOMAIN} AS domain FROM results WHERE rank > 5),
counts AS (SELECT domain, count(*) AS page_count FROM stored GROUP BY domain),
actions AS (
  SELECT domain, coalesce(page_count, 0) > 0 AS known, coalesce(page_count, 0) AS page_count,
         CASE WHEN coalesce(page_count, 0) = 0 THEN 'crawl' WHEN page_count >= 5 THEN 'skip'
              ELSE 'recrawl' END AS action
  FROM (SELECT DISTINCT domain FROM organic) LEFT JOIN counts USING (domain))
"""

LINKS = f"""
links AS (
  SELECT DISTINCT url, domain, site || href AS link, domain AS link_domain FROM (
    SELECT url, {DOMAIN} AS domain,
           regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS site,
           unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href
    FROM pages) WHERE href LIKE '/%' AND href NOT LIKE '//%')
"""

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
KEYWORDS = f"""{PAGE_STORE},
runs AS (
  SELECT page_id, unnest(r) AS tok, generate_subscripts(r, 1) AS pos FROM (
    SELECT page_id, regexp_extract_all(
      lower(title || ' ' || title || ' ' || title || ' ' || content), '[\\p{{L}}\\p{{N}}_]+') AS r
    FROM page_store)),
words AS (
  SELECT page_id, tok, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM runs
  WHERE regexp_full_match(tok, '[a-zA-ZąćęłńóśźżĄĆĘŁŃÓŚŹŻ]{{3,}}') AND tok NOT IN ({STOP})),
terms AS (
  SELECT page_id, tok AS term FROM words UNION ALL
  SELECT a.page_id, a.tok || ' ' || b.tok FROM words a JOIN words b
    ON a.page_id = b.page_id AND b.k = a.k + 1),
ranked AS (
  SELECT page_id, term, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, term) AS r
  FROM terms GROUP BY page_id, term QUALIFY r <= 8)
"""

JOBS = """
jobs AS (
  SELECT user_id AS seq, 'query ' || user_id AS query,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done'
              WHEN 'click' THEN 'in_progress' ELSE 'pending' END AS status,
         created AS created_at,
         CASE WHEN event_type IN ('error', 'purchase', 'click') THEN ts END AS started_at,
         CASE WHEN event_type IN ('error', 'purchase') THEN ts END AS finished_at,
         CASE WHEN event_type = 'error' THEN props END AS error
  FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS created,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1)
"""


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


JOB_COLUMNS = (f"query, status, {stamp('created_at')} AS created_at, "
               f"{stamp('started_at')} AS started_at, {stamp('finished_at')} AS finished_at, error")

USAGE = """
usage AS (
  SELECT CASE event_type WHEN 'view' THEN 'embedding' ELSE 'llm' END AS kind,
         CAST(json_extract(props, '$.k') AS BIGINT) AS i, CAST(floor(value) AS BIGINT) AS o
  FROM events WHERE event_type IN ('view', 'click')),
totals AS (
  SELECT count(*) FILTER (kind = 'embedding') AS pages_processed,
         CAST(coalesce(sum(i) FILTER (kind = 'embedding'), 0) AS BIGINT) AS embedding_tokens,
         CAST(coalesce(sum(i) FILTER (kind = 'llm'), 0) AS BIGINT) AS llm_input_tokens,
         CAST(coalesce(sum(o) FILTER (kind = 'llm'), 0) AS BIGINT) AS llm_output_tokens
  FROM usage),
cost AS (
  SELECT *, embedding_tokens / 1000000 * 0.020::DOUBLE + llm_input_tokens / 1000000 * 0.150::DOUBLE
            + llm_output_tokens / 1000000 * 0.600::DOUBLE AS usd FROM totals)
"""

LOG = """
logged AS (
  SELECT CAST(conv_id AS VARCHAR) AS worker, turn AS line_no, conv_id, role, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS INTEGER)) AS ts,
         (conv_id + turn) % 7 = 0 AND role = 'user' AS limited,
         role = 'system' AND conv_id % 11 = 0 AS denied,
         role = 'system' AND conv_id % 11 <> 0 AND conv_id % 13 = 0 AS failed,
         CASE conv_id % 5
           WHEN 0 THEN (conv_id % 12 + 1) || 'PM UTC'
           WHEN 1 THEN (conv_id % 12 + 1) || ' PM UTC'
           WHEN 2 THEN (conv_id % 12 + 1) || ':45 AM UTC'
           WHEN 3 THEN (conv_id % 12 + 1) || ':45AM (UTC)'
           ELSE (conv_id % 24) || ':05 (UTC)' END AS clock,
         CASE conv_id % 5
           WHEN 0 THEN (conv_id % 12 + 1) % 12 * 60 + 720
           WHEN 2 THEN (conv_id % 12 + 1) % 12 * 60 + 45
           WHEN 4 THEN conv_id % 24 * 60 + 5 END AS minutes
  FROM conversations),
timed AS (
  SELECT *, CASE WHEN limited AND minutes IS NOT NULL THEN
           date_trunc('day', ts) + to_minutes(CAST(minutes AS INTEGER)) END AS today
  FROM logged),
resets AS (
  SELECT *, CASE WHEN today < ts THEN today + INTERVAL 1 DAY ELSE today END
            + INTERVAL 60 SECOND AS resume FROM timed)
"""

VECTORS = """
unit AS (
  SELECT CAST(vec_id AS VARCHAR) AS page_id, list_transform(embedding, lambda x: x::DOUBLE
         / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v
  FROM embeddings),
pairs AS (
  SELECT a.page_id, b.page_id AS neighbour_id, list_dot_product(a.v, b.v) AS dot
  FROM unit a JOIN unit b ON a.page_id <> b.page_id)
"""

HAS_LIMIT = " OR ".join(f"contains(lower(text), '{p}')" for p in LIMIT_PHRASES)

ORACLE = {
    "gap_report": f"WITH {_gap(0.3)} SELECT * EXCLUDE (first_page_id) FROM report",
    "gap_report_077": f"WITH {_gap(0.77)} SELECT * EXCLUDE (first_page_id) FROM report",
    "gap_summary": f"""WITH {_gap(0.77)}
SELECT count(*) AS total_clusters, count(*) FILTER (covered) AS covered_clusters,
       count(*) FILTER (NOT covered) AS missing_clusters, 0.77::DOUBLE AS coverage_threshold,
       (SELECT count(*) FROM page_store WHERE source = 'own') AS own_pages_count,
       (SELECT count(*) FROM page_store WHERE source = 'competitor') AS competitor_pages_count
FROM report""",
    "gap_coverage_pct": f"""WITH {_gap(0.77)}
SELECT count(*) AS total_clusters, count(*) FILTER (covered) AS covered_clusters,
       CAST(round_even(count(*) FILTER (covered) / greatest(count(*), 1) * 100, 0) AS BIGINT)
         AS coverage_pct
FROM report""",
    "gap_examples": f"""WITH {PAGE_STORE}
SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY page_id) AS rn,
       url, title, domain
FROM page_store WHERE source = 'competitor' AND cluster_id <> -1 QUALIFY rn <= 5""",
    "gap_cards": f"""WITH {_gap(0.77)},
shown AS (
  SELECT cluster_id, string_agg(coalesce(nullif(substr(title, 1, 70), ''), substr(url, 1, 70))
                                || ' — ' || domain, chr(10) ORDER BY page_id) AS examples
  FROM (SELECT * FROM page_store WHERE source = 'competitor' AND cluster_id <> -1
        QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY page_id) <= 3)
  GROUP BY cluster_id)
SELECT cluster_id, cluster_label, page_count, covered,
       CAST(trunc(coverage_score * 100) AS BIGINT) AS score_pct, examples,
       coalesce(nullif(substr(best_title, 1, 70), ''), substr(best_url, 1, 60)) AS closest_page
FROM report JOIN shown USING (cluster_id)""",
    "gap_filter_missing": f"""WITH {_gap(0.77)}
SELECT cluster_id, page_count, coverage_score FROM report WHERE NOT covered""",
    "gap_filter_covered": f"""WITH {_gap(0.77)}
SELECT cluster_id, page_count, coverage_score FROM report WHERE covered""",
    "gap_filter_min_pages": f"""WITH {_gap(0.77)}
SELECT cluster_id, page_count, covered FROM report WHERE page_count >= 41""",
    "top_clusters": f"""WITH {_gap(0.77)}
SELECT substr(cluster_label, 1, 30) AS label, page_count AS pages, covered FROM report
ORDER BY page_count DESC, coverage_score, first_page_id LIMIT 12""",

    "own_pages": f"WITH {PAGE_STORE} SELECT url, title FROM page_store WHERE source = 'own'",
    "option_lists": f"""WITH {PAGE_STORE}
SELECT DISTINCT 'label' AS kind, cluster_label AS value FROM page_store WHERE cluster_id >= 0
UNION ALL SELECT DISTINCT 'competitor', domain FROM page_store WHERE source = 'competitor'
UNION ALL SELECT DISTINCT 'domain', domain FROM page_store""",
    "assigned_pages": f"""WITH {PAGE_STORE}
SELECT page_id, cluster_id, cluster_label FROM page_store
WHERE source = 'competitor' AND cluster_id >= 0""",
    "domain_filter": f"""WITH {PAGE_STORE}
SELECT page_id, url FROM page_store WHERE domain = 'src3.example' AND source = 'competitor'""",
    "store_stats": f"""WITH {PAGE_STORE}
SELECT count(*) AS total, count(*) FILTER (source = 'own') AS own_pages,
       count(*) FILTER (source = 'competitor') AS competitor_pages FROM page_store""",
    "competitor_domains": f"""WITH {PAGE_STORE}
SELECT DISTINCT domain FROM page_store WHERE source = 'competitor'""",
    "distinct_counts": f"""WITH {PAGE_STORE}
SELECT count(DISTINCT domain) FILTER (source = 'competitor') AS domains,
       count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters FROM page_store""",
    "dashboard": f"""WITH {PAGE_STORE}
SELECT count(*) FILTER (source = 'own') AS own_pages,
       count(*) FILTER (source = 'competitor') AS competitor_pages,
       count(DISTINCT domain) FILTER (source = 'competitor') AS domains,
       count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters FROM page_store""",
    "top_domains": f"""WITH {PAGE_STORE}
SELECT domain, count(*) AS pages FROM page_store WHERE source = 'competitor'
GROUP BY domain ORDER BY pages DESC, domain LIMIT 15""",
    "map_view_filtered": f"""WITH {PAGE_STORE}
SELECT page_id, source, cluster_id, domain FROM page_store
WHERE source = 'own' OR (cluster_label IN ('topic 1', 'topic 4') AND cluster_id >= 0
  AND domain IN ('src1.example', 'src2.example', 'src5.example'))""",
    "map_layers": f"""WITH {PAGE_STORE}
SELECT layer, count(*) AS points,
       CASE WHEN layer IN ('own', 'unclassified') THEN layer
            ELSE substr(arg_min(cluster_label, page_id), 1, 35) END AS label
FROM (SELECT *, CASE WHEN source = 'own' THEN 'own' WHEN cluster_id = -1 THEN 'unclassified'
                     ELSE CAST(cluster_id AS VARCHAR) END AS layer FROM page_store)
GROUP BY layer""",
    "map_counts": f"""WITH {PAGE_STORE}
SELECT count(*) AS points, count(DISTINCT cluster_id) FILTER (source = 'competitor') AS clusters
FROM page_store""",
    "explorer_search": f"""WITH {PAGE_STORE}
SELECT source, domain, cluster_label, title, url, summary FROM page_store
WHERE regexp_matches(title, '(?i)en.t|/1[0-9]$') OR regexp_matches(url, '(?i)en.t|/1[0-9]$')""",
    "explorer_filter": f"""WITH {PAGE_STORE}
SELECT source, domain, cluster_label, title, url, summary FROM page_store
WHERE source = 'competitor' AND domain = 'src7.example' AND cluster_label = 'topic 2'""",
    "detail_rows": f"""WITH {PAGE_STORE}
SELECT page_id, coalesce(nullif(substr(title, 1, 80), ''), url) AS heading, url, source, domain,
       cluster_label, content_snippet
FROM page_store WHERE source = 'competitor' ORDER BY page_id LIMIT 50""",
    "page_defaults": f"""WITH {PAGE_STORE}
SELECT page_id, CASE WHEN source = 'own' THEN '' ELSE query END AS query,
       CASE WHEN source = 'own' THEN '' ELSE cluster_label END AS cluster_label,
       CAST(CASE WHEN source = 'own' THEN -1 ELSE cluster_id END AS INTEGER) AS cluster_id,
       CASE WHEN source = 'own' THEN '' ELSE replace(query, 'q', ',') END AS keywords
FROM page_store""",

    "page_keywords": f"""WITH {KEYWORDS}
SELECT page_id, coalesce(keywords, '') AS keywords FROM page_store LEFT JOIN (
  SELECT page_id, string_agg(term, ', ' ORDER BY r) AS keywords FROM ranked GROUP BY page_id)
USING (page_id)""",
    "topic_labels": f"""WITH {KEYWORDS},
found AS (
  SELECT p.cluster_id, k.term, count(*) AS n, min((k.page_id, k.r)) AS first_seen
  FROM ranked k JOIN page_store p USING (page_id)
  WHERE p.source = 'competitor' GROUP BY p.cluster_id, k.term),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first_seen) AS r
        FROM found QUALIFY r <= 5)
SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'noise'
                        ELSE string_agg(term, ' · ' ORDER BY r) END AS cluster_label
FROM top GROUP BY cluster_id""",
    "topic_labels_title_fallback": f"""WITH {PAGE_STORE},
words AS (
  SELECT cluster_id, page_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
    SELECT cluster_id, page_id, regexp_split_to_array(lower(title), '\\s+') AS w
    FROM page_store WHERE source = 'competitor')),
found AS (
  SELECT cluster_id, term, count(*) AS n, min((page_id, pos)) AS first_seen FROM words
  WHERE length(term) > 3 GROUP BY cluster_id, term),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first_seen) AS r
        FROM found QUALIFY r <= 5)
SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'noise'
                        ELSE string_agg(term, ' · ' ORDER BY r) END AS cluster_label
FROM top GROUP BY cluster_id""",

    "ingest_titles": f"SELECT page_id, {TITLE} AS title FROM pages",
    "ingest_text": f"""WITH {HTML}
SELECT url, content, length(content) AS n_chars FROM html_pages WHERE length(trim(content)) >= 1""",
    "ingest_records": f"""WITH {HTML}
SELECT md5(url) AS page_id, url, domain, substr(content, 1, 500) AS content_snippet,
       md5(title || chr(10) || chr(10) || content) AS embed_md5
FROM html_pages WHERE length(trim(content)) >= 1""",
    "url_domains": f"SELECT url, {DOMAIN} AS domain FROM pages",
    "discover_links": f"WITH {LINKS} SELECT url, domain, link, link_domain FROM links",
    "site_map": f"""WITH {LINKS}
SELECT domain, link AS url, row_number() OVER (PARTITION BY domain ORDER BY link) AS position
FROM (SELECT DISTINCT domain, link FROM links WHERE link_domain = domain)
QUALIFY position <= 20""",

    "upsert_lww": f"""WITH {PAGE_STORE}
SELECT page_id, CASE WHEN source = 'own' THEN title ELSE 'new ' || title END AS title, source,
       CASE WHEN source = 'own' THEN CAST(-1 AS INTEGER) END AS cluster_id,
       CASE WHEN source = 'own' THEN cluster_label END AS cluster_label,
       {stamp("CASE WHEN source = 'own' THEN ts ELSE ts + INTERVAL 1 DAY END")} AS written_at
FROM page_store""",
    "upsert_ties": f"""WITH {PAGE_STORE}
SELECT page_id, 'copy 3' AS title, source, {stamp("ts + INTERVAL 1 DAY")} AS written_at FROM page_store""",
    "patch_clusters": f"""WITH {PAGE_STORE}
SELECT page_id, url,
       CAST(CASE WHEN cluster_id >= 5 THEN cluster_id + 100 ELSE cluster_id END AS INTEGER)
         AS cluster_id,
       CASE WHEN cluster_id >= 5 THEN 'patched' ELSE cluster_label END AS cluster_label
FROM page_store""",

    "top_k_results": f"WITH {RESULTS} SELECT query, url, position FROM organic",
    "frontier_actions": f"WITH {RESULTS} SELECT domain, known, page_count, action FROM actions",
    "unknown_domains": f"WITH {RESULTS} SELECT domain FROM actions WHERE NOT known",
    "page_cap": f"""
SELECT {DOMAIN} AS domain, url, row_number() OVER (PARTITION BY {DOMAIN} ORDER BY url) AS position
FROM pages QUALIFY position <= 3""",
    "incomplete_domains": f"""WITH {RESULTS}
SELECT domain, page_count, page_count < 3 AS incomplete FROM counts""",
    "crawl_report": f"""WITH {RESULTS}, {HTML},
outcome AS (
  SELECT domain, count(*) FILTER (length(trim(content)) >= 300) AS saved,
         count(*) FILTER (length(trim(content)) < 300) AS failed FROM html_pages GROUP BY domain)
SELECT domain, action, known, coalesce(saved, 0) AS saved, coalesce(failed, 0) AS failed
FROM actions LEFT JOIN outcome USING (domain)""",

    "query_list": """
SELECT conv_id AS seq, text AS query FROM conversations
WHERE turn = 0 AND role = 'user' ORDER BY conv_id, text LIMIT 50""",
    "jobs_seed": f"""WITH {JOBS}
SELECT {JOB_COLUMNS} FROM jobs
UNION ALL
SELECT 'query ' || c_custkey, 'pending', '2024-01-30 12:00:00', NULL, NULL, NULL FROM customer
WHERE 'query ' || c_custkey NOT IN (SELECT query FROM jobs)""",
    "jobs_seed_order": f"""WITH {JOBS}, fresh AS (
  SELECT -c_custkey AS seq, 'query ' || c_custkey AS query FROM customer
  WHERE 'query ' || c_custkey NOT IN (SELECT query FROM jobs))
SELECT seq, query, status FROM jobs
UNION ALL
SELECT seq + 1 + (SELECT max(seq) FROM jobs) - (SELECT min(seq) FROM fresh), query, 'pending' FROM fresh""",
    "jobs_seed_reset": """
SELECT 'query ' || c_custkey AS query, 'pending' AS status, '2024-01-30 12:00:00' AS created_at,
       CAST(NULL AS VARCHAR) AS started_at, CAST(NULL AS VARCHAR) AS finished_at,
       CAST(NULL AS VARCHAR) AS error FROM customer""",
    "jobs_stale": f"""WITH {JOBS}, fresh AS (
  SELECT * REPLACE (CASE WHEN stale THEN 'pending' ELSE status END AS status,
                    CASE WHEN stale THEN NULL ELSE started_at END AS started_at)
  FROM (SELECT *, coalesce(status = 'in_progress'
                    AND started_at < TIMESTAMP '2024-01-30 10:00:00', false) AS stale FROM jobs))
SELECT {JOB_COLUMNS} FROM fresh""",
    "jobs_retry": f"""WITH {JOBS}, fresh AS (
  SELECT * REPLACE (CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
                    CASE WHEN status = 'failed' THEN NULL ELSE started_at END AS started_at,
                    CASE WHEN status = 'failed' THEN NULL ELSE finished_at END AS finished_at,
                    CASE WHEN status = 'failed' THEN NULL ELSE error END AS error) FROM jobs)
SELECT {JOB_COLUMNS} FROM fresh""",
    "jobs_retry_count": f"""WITH {JOBS}
SELECT count(*) AS reset_jobs FROM jobs WHERE status = 'failed'""",
    "jobs_outcomes": f"""WITH {JOBS}, last AS (
  SELECT 'query ' || user_id AS query, ts AS at, props,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done'
              ELSE 'pending' END AS outcome
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, outcome DESC) = 1),
fresh AS (
  SELECT j.query, coalesce(l.outcome, j.status) AS status, j.created_at,
         CASE WHEN l.outcome = 'pending' THEN NULL ELSE j.started_at END AS started_at,
         CASE WHEN l.outcome IN ('done', 'failed') THEN l.at ELSE j.finished_at END AS finished_at,
         CASE WHEN l.outcome = 'failed' THEN substr(repeat(l.props, 300), 1, 2000)
              ELSE j.error END AS error
  FROM jobs j LEFT JOIN last l USING (query))
SELECT {JOB_COLUMNS}, length(error) AS error_chars FROM fresh""",
    "jobs_next_batch": f"""WITH {JOBS}
SELECT seq, query, status FROM jobs WHERE status = 'pending' ORDER BY seq LIMIT 10""",
    "jobs_started": f"""WITH {JOBS}, batch AS (
  SELECT query FROM jobs WHERE status = 'pending' ORDER BY seq LIMIT 10),
fresh AS (
  SELECT * REPLACE (CASE WHEN claimed THEN 'in_progress' ELSE status END AS status,
                    CASE WHEN claimed THEN TIMESTAMP '2024-01-30 12:00:00'
                         ELSE started_at END AS started_at)
  FROM (SELECT *, query IN (SELECT query FROM batch) AS claimed FROM jobs))
SELECT {JOB_COLUMNS} FROM fresh""",
    "jobs_stats": f"""WITH {JOBS}
SELECT count(*) FILTER (status = 'pending') AS pending,
       count(*) FILTER (status = 'in_progress') AS in_progress,
       count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
       count(*) AS total FROM jobs""",
    "jobs_failed": f"""WITH {JOBS}
SELECT query, substr(error, 1, 120) AS error FROM jobs WHERE status = 'failed'""",
    "usage_totals": f"WITH {USAGE} SELECT * FROM totals",
    "usage_cost": f"WITH {USAGE} SELECT round(usd, 6) AS estimated_cost_usd FROM cost",
    "usage_projection": f"""WITH {USAGE}
SELECT pages_processed, round(usd, 6) AS estimated_cost_usd,
       CASE WHEN pages_processed > 0 THEN round(usd * 1000000 / pages_processed, 4) END
         AS projected_cost_usd FROM cost""",

    "log_text_blocks": f"""WITH {LOG}
SELECT worker, line_no, CAST(0 AS BIGINT) AS block_no, text FROM logged WHERE role = 'assistant'""",
    "log_raw_lines": f"""WITH {LOG}
SELECT worker, line_no, trim(CASE WHEN limited THEN text || ' Usage limit reached, resets at '
       || clock ELSE text END) AS raw FROM logged WHERE role = 'user'""",
    "log_tool_counts": f"""WITH {LOG}
SELECT 'tool' || (line_no % 5 + conv_id % 3) AS tool, count(*) AS calls FROM logged
WHERE role = 'system' AND NOT denied AND NOT failed GROUP BY tool""",
    "log_denied": f"""WITH {LOG}
SELECT worker, line_no, {stamp("TIMESTAMP '2024-01-01 00:01:00' + to_hours(CAST(conv_id AS INTEGER))")}
         AS resume_at FROM logged WHERE denied""",
    "log_errors": f"WITH {LOG} SELECT worker, line_no, text AS error FROM logged WHERE failed",
    "log_limit_hits": f"""WITH {LOG}
SELECT worker, line_no, resume IS NOT NULL AS exact,
       {stamp("coalesce(resume, ts + INTERVAL 5 HOUR)")} AS resume_at
FROM resets WHERE limited OR ((role <> 'system' OR failed) AND ({HAS_LIMIT}))""",
    "log_reset_times": f"""WITH {LOG}
SELECT worker, line_no, {stamp("resume")} AS resume_at FROM resets""",
    "log_silence": f"""
SELECT worker, {stamp("previous")} AS last_output, {stamp("ts")} AS next_output,
       CAST(greatest(1, floor(idle / 60000000)) AS BIGINT) AS idle_minutes FROM (
  SELECT CAST(user_id AS VARCHAR) AS worker, ts, lag(ts) OVER w AS previous,
         epoch_us(ts) - epoch_us(lag(ts) OVER w) AS idle
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE idle >= 900000000""",

    "knn_exact": f"""WITH {VECTORS}
SELECT page_id, neighbour_id, round(1 - dot, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(1 - dot, 10), neighbour_id)
            AS rank FROM pairs) WHERE rank <= 5""",
    "core_distances": f"""WITH {VECTORS}
SELECT page_id, round(d, 6) AS core FROM (
  SELECT page_id, sqrt(greatest(2 - 2 * dot, 0)) AS d,
         row_number() OVER (PARTITION BY page_id ORDER BY dot DESC) AS rank FROM pairs)
WHERE rank = 5""",
    "clustering_quality": f"""WITH {PAGE_STORE}
SELECT count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS topics,
       avg(CASE WHEN cluster_id = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS noise_ratio
FROM page_store WHERE source = 'competitor'""",
    "sinks_roundtrip": f"""WITH {KEYWORDS}
SELECT page_id AS id, url, title, coalesce(keywords, '') AS keywords, cluster_id, cluster_label,
       CASE WHEN cluster_id = -1 THEN '' ELSE cluster_label END AS topic,
       {stamp("ts")} AS written_at, cluster_id::DOUBLE AS x, length(title)::DOUBLE AS y
FROM page_store LEFT JOIN (
  SELECT page_id, string_agg(term, ', ' ORDER BY r) AS keywords FROM ranked GROUP BY page_id)
USING (page_id)""",
    "gap_roundtrip": f"""WITH {_gap(0.77)}
SELECT cluster_id, cluster_label, page_count, covered, coverage_score, min_distance_to_own,
       best_url, least(page_count, 5) AS examples, (SELECT count(*) FROM report) AS total_clusters
FROM report""",
    "embed_hashing": f"""WITH {PAGE_STORE}
SELECT page_id, true AS valid, CAST(256 AS BIGINT) AS dim, 1.0::DOUBLE AS norm
FROM page_store""",
    "ingest_metadata": f"""WITH {KEYWORDS}
SELECT page_id, CASE WHEN m = 1 THEN 'llm' ELSE 'tfidf' END AS metadata_mode,
       CASE WHEN m = 1 THEN title ELSE '' END AS summary,
       CASE WHEN m = 1 THEN substr(title, 1, 5) || ', ' || length(content)
            ELSE coalesce(keywords, '') END AS keywords
FROM (SELECT *, CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 3 AS m FROM page_store)
LEFT JOIN (
  SELECT page_id, string_agg(term, ', ' ORDER BY r) AS keywords FROM ranked GROUP BY page_id)
USING (page_id)""",
    "stream_upsert": f"""WITH {HTML}
SELECT md5(url) AS page_id, url, title, domain, 'competitor' AS source,
       substr(content, 1, 500) AS content_snippet, CAST(NULL AS INTEGER) AS cluster_id,
       CAST(64 AS BIGINT) AS dim
FROM html_pages WHERE length(trim(content)) >= 1""",
    "stream_silence": f"""WITH marked AS (
  SELECT CAST(user_id AS VARCHAR) AS worker, ts,
         coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 900000000, true) AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (
  SELECT *, sum(opens::INTEGER) OVER (PARTITION BY worker ORDER BY ts
            ROWS UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (
  SELECT worker, min(ts) AS first_output, max(ts) AS last_output, count(*) AS lines
  FROM numbered GROUP BY worker, session)
SELECT worker, {stamp("first_output")} AS first_output, {stamp("last_output")} AS last_output,
       lines
FROM sessions
WHERE last_output + INTERVAL 15 MINUTE
      <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE""",
}
# the same sessions, whether they have ended or not
ORACLE["stream_sessions"] = ORACLE["stream_silence"].split("WHERE last_output")[0]
ORACLE["stream_usage"] = ORACLE["usage_totals"]
ORACLE["stream_limit_hits"] = ORACLE["log_limit_hits"]
ORACLE["stream_text_blocks"] = ORACLE["log_text_blocks"]
ORACLE["knn_exact_blocks"] = ORACLE["knn_exact"]
ORACLE["core_distances_blocks"] = ORACLE["core_distances"]
# Prim's rounds: every point outside keeps its lightest edge into the tree; distinct vectors are assumed
ORACLE["mst_edges"] = f"""WITH RECURSIVE {VECTORS},
dists AS (SELECT page_id AS a, neighbour_id AS b, sqrt(greatest(2 - 2 * dot, 0)) AS d FROM pairs),
core AS (SELECT a, d AS core FROM (
  SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM dists) WHERE r = 3),
reach AS MATERIALIZED (SELECT dists.a, dists.b, greatest(d, c.core, o.core) AS w
  FROM dists JOIN core c ON c.a = dists.a JOIN core o ON o.a = dists.b),
outside(step, node, best, chosen) AS (
  SELECT 0, b, w, row_number() OVER (ORDER BY w, b) = 1
  FROM reach WHERE a = (SELECT min(a) FROM core)
  UNION ALL
  SELECT step + 1, node, best, row_number() OVER (ORDER BY best, node) = 1 FROM (
    SELECT o.step, o.node, least(o.best, r.w) AS best
    FROM outside o JOIN outside c ON c.chosen AND NOT o.chosen JOIN reach r ON r.a = c.node AND r.b = o.node))
SELECT count(*) AS edges, round(sum(best), 4) AS total, round(max(best), 6) AS heaviest FROM outside WHERE chosen"""
ORACLE["mst_edges_blocks"] = ORACLE["mst_edges"]
ORACLE["layout_quality"] = """
SELECT count(DISTINCT embedding) AS points, true AS trustworthy FROM embeddings WHERE embedding IS NOT NULL"""
ORACLE["crawl_totals"] = f"""SELECT count(*) FILTER (NOT known) AS new_domains, count(*) FILTER (known) AS known_domains,
       sum(saved)::BIGINT AS saved, sum(failed)::BIGINT AS failed FROM ({ORACLE["crawl_report"]})"""
