"""SQL twins of the registered queries, where SQL can say what they compute."""

from __future__ import annotations

_HOST = r"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_LINK = r"(?i)\shref\s*=\s*[\"'']?\s*(?:https?:)?//([^/?#\"''\s<>]+)"


def _url_filter(rounds: int = 220) -> str:
    """Rules spelled out, then what seeds pass on, round after round, until less than 1e-15 of it is left."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, html, {_HOST} AS host, {_PATH} AS path FROM pages),
    j AS MATERIALIZED (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
    edges AS (SELECT host AS src, dst, count(*) AS n FROM (
        SELECT host, unnest(list_distinct([translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            for x in regexp_extract_all(html, '{_LINK}', 1)])) AS dst FROM p)
        WHERE host <> dst AND host <> '' GROUP BY ALL),
    own AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
    links AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, share FROM own
        UNION ALL SELECT 'distrust', dst, src, share FROM own),
    seeds AS MATERIALIZED (SELECT * FROM (
        SELECT 'trust' AS kind, host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0::DOUBLE ELSE 0 END) AS rank FROM j GROUP BY host
        UNION ALL SELECT 'distrust', host, avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0::DOUBLE ELSE 0 END) FROM j GROUP BY host)
        WHERE rank > 0),
    passed(step, kind, host, rank) AS (SELECT 0, kind, host, 0.15 * rank FROM seeds UNION ALL
        SELECT p.step + 1, p.kind, l.dst, sum(0.85 * p.rank * l.share)
        FROM passed p JOIN links l ON p.kind = l.kind AND p.host = l.src
        WHERE p.step < {rounds} GROUP BY p.step, p.kind, l.dst),
    blocked AS (SELECT host FROM passed GROUP BY host
        HAVING round(sum(CASE kind WHEN 'distrust' THEN rank ELSE -rank END), 12) > 0.5 * 0.15)
    SELECT page_id, j.host, path, rule, CASE
        WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
    FROM j LEFT JOIN blocked b ON j.host = b.host"""


def _draw(level: str, node: str, weight: str) -> str:
    digest = f"('0x' || substr(md5(doc_id::VARCHAR || '|{level}|' || {node}), 1, 13))::BIGINT"
    return f"{{'d': -ln(({digest}::DOUBLE + 1) / 4503599627370496.0) / {weight}, 'n': {node}}}"


def _least(level: str, nodes: str, weight: str = "1.0") -> str:
    return f"list_min([{_draw(level, 'x', weight)} for x in {nodes}]).n"


_SHARDS = f"""WITH table_ AS (SELECT list(list_reduce([c, 1, 2, 3, 4, 5, 6, 7, 8],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY c) AS t
        FROM (SELECT unnest(range(256)) AS c)),
    bytes AS MATERIALIZED (SELECT doc_id, [('0x' || h)::BIGINT for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
    crc AS MATERIALIZED (SELECT doc_id, len(b) + 16 AS size, xor(list_reduce(list_prepend(4294967295, b),
        lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS text_crc32 FROM bytes, table_),
    regions AS MATERIALIZED (SELECT *, {_least('region', '[0, 1]', '20.0')} AS g,
        {_least('region', '[0, 1, 2]', '(CASE x WHEN 2 THEN 1.0 ELSE 20.0 END)')} AS gg FROM crc),
    racks AS MATERIALIZED (SELECT *, {_least('rack', 'range(4 * g, 4 * g + 4)', '5.0')} AS k,
        CASE WHEN gg = 2 THEN 8 ELSE {_least('rack', 'range(4 * gg, 4 * gg + 4)', '5.0')} END AS gk FROM regions),
    shards AS (SELECT *, {_least('shard', 'range(5 * k, 5 * k + 5)')} AS s,
        CASE WHEN gk = 8 THEN 40 ELSE {_least('shard', 'range(5 * gk, 5 * gk + 5)')} END AS gs FROM racks)
    SELECT doc_id, size, text_crc32, 'key' AS law, s::INTEGER AS shard,
        row_number() OVER (PARTITION BY s ORDER BY substr(md5(doc_id::VARCHAR || '|slot'), 1, 2), doc_id, size, text_crc32) - 1 AS slot,
        gs::INTEGER AS grown_shard FROM shards"""

_TOP_K = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_COMPONENTS = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_transform({_WORDS}, lambda x:
        translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
        FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE 100 * common >= 80 * (x.n + y.n - common)),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
    FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_REPEATS = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
        FROM w, unnest(range(1, len(w) - 48)) AS t(i)),
    f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (g), unnest(range(50)) AS t(k) WHERE first < doc_id),
    lost AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
    kept AS (SELECT w.doc_id, w, coalesce(len(p), 0) AS removed,
        CASE WHEN p IS NULL THEN w ELSE [x for x, i in w if NOT list_contains(p, i)] END AS k
        FROM w LEFT JOIN lost USING (doc_id))
    SELECT doc_id, len(w) AS n_words, removed AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""



def _codes(rounds: int = 6) -> str:
    """One assignment and one table of entries per round; entries without parts stay."""
    def nearest(k: int) -> str:
        distance = "list_sum([(p.v[j] - e.v[j]) ** 2 for j in range(1, len(p.v) + 1)])::BIGINT"
        return f"""a{k} AS MATERIALIZED (SELECT n, part, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry FROM (
            SELECT n, p.part, entry, {distance} AS d FROM parts p JOIN e{k} e ON p.part = e.part) GROUP BY n, part)"""

    steps = []
    for k in range(rounds):
        steps.append(nearest(k))
        steps.append(f"""e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m.v, e.v) AS v FROM e{k} e LEFT JOIN (
            SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY j) AS v FROM (
                SELECT a.part, a.entry, j, sum(p.v[j])::DOUBLE AS s, count(*) AS n
                FROM a{k} a JOIN parts p ON a.n = p.n AND a.part = p.part, unnest(range(1, len(p.v) + 1)) AS t(j)
                GROUP BY ALL) GROUP BY part, entry) m ON m.part = e.part AND m.entry = e.entry)""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
            [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    parts AS MATERIALIZED (SELECT n, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS v
        FROM v, unnest(range(8)) AS t(part)),
    e0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v FROM parts WHERE n <= 16),
    {", ".join(steps)}, {nearest(rounds)},
    coded AS MATERIALIZED (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM a{rounds} GROUP BY n),
    books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM v JOIN coded USING (n), books"""


_TERMS = r"""list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda x:
        translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""

_RANKED = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS t FROM documents),
    q AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
    c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM t WHERE len(t) > 0),
    tf AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM t)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM tf, c GROUP BY term),
    s AS (SELECT q, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf
            + 8 * (100 - 90 + (90 * len(t) * n_docs) // n_terms))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN t USING (d), c GROUP BY q, item_id, d, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def _host_rules() -> str:
    """Features, failures by host, the prior's two moments for each rule, and verdicts."""
    rules = {"short": "n_words < 20", "repeats": "n_repeat_words * 100 > n_words * 30", "symbols": "n_symbols * 10 > n_words",
             "dup_lines": "n_dup_lines * 10 > n_lines * 3",
             "word_length": "word_chars < n_words * 3 OR word_chars > n_words * 10"}
    blank = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    host = ", ".join(f"sum(({rule})::INT)::DOUBLE AS {r}" for r, rule in rules.items())
    mean = ", ".join(f"sum({r}) / sum(n) AS m_{r}, sum({r} * {r} / n) - sum({r}) * sum({r}) / sum(n) AS s_{r}" for r in rules)
    within = ", ".join(f"CASE WHEN m_{r} * (1 - m_{r}) > 0 AND free > 0 THEN (s_{r} / (m_{r} * (1 - m_{r})) - (k - 1)) / free END AS w_{r}"
                       for r in rules)
    weight = ", ".join(f"CASE WHEN w_{r} > 0 THEN least(1e6, greatest(1e-3, 1 / w_{r} - 1)) ELSE 1e6 END::DOUBLE AS a_{r}" for r in rules)
    share = ", ".join(f"round((h.{r} + m_{r} * a_{r}) / (h.n + a_{r}), 9) AS p_{r}" for r in rules)
    doubtful = " OR ".join(f"(p_{r} > 0.2 AND ({rule}))" for r, rule in rules.items())
    return rf"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    g AS (SELECT d, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) AS t(i)),
    twice AS (SELECT d, unnest(list(i)) AS i FROM g GROUP BY d, g HAVING count(*) > 1),
    inside AS (SELECT d, count(DISTINCT i + j) AS n FROM twice, unnest(range(8)) AS t(j) GROUP BY d),
    f AS MATERIALIZED (SELECT d, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words
        FROM (SELECT *, [x for x in string_split(text, chr(10)) if trim(x, {blank}) <> ''] AS l FROM w) LEFT JOIN inside USING (d)),
    h AS MATERIALIZED (SELECT source, count(*)::DOUBLE AS n, {host} FROM f GROUP BY source),
    m AS (SELECT count(*) AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free, {mean} FROM h),
    x AS (SELECT *, {within} FROM m), y AS (SELECT *, {weight} FROM x),
    z AS MATERIALIZED (SELECT source AS host, {share} FROM h, y)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
            AND greatest({", ".join(f"p_{r}" for r in rules)}) <= 0.5 AND NOT ({doubtful}) AS kept
    FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.host"""


ORACLE = {
    "op2_url_filter": _url_filter(),
    "op3_jaccard_join": _COMPONENTS,
    "op6_sharding": _SHARDS,
    "op8_substring_dedup": _REPEATS,
    "op10_top_k": _TOP_K,
    "op11_anchor_codes": _codes(),
    "op12_sketch_search": _RANKED,
    "op13_host_rules": _host_rules(),
}
