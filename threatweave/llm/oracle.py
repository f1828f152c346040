"""SQL twins (DuckDB) of the queries of this subpackage."""

QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (
    SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
           generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
windows AS (
    SELECT doc_id, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3
    FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (
    SELECT doc_id, i FROM windows WHERE w3 IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY doc_id),
lines AS (
    SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line,
           generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
keyed AS (
    SELECT doc_id, source, i,
           regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
    FROM full_lines),
often AS (SELECT source, key FROM keyed GROUP BY source, key HAVING count(DISTINCT doc_id) > 10),
removed AS (
    SELECT doc_id, sum(n)::BIGINT AS n FROM (
        SELECT k.doc_id, k.i, any_value(length(k.key)) AS n FROM keyed k JOIN often o
        ON k.source IS NOT DISTINCT FROM o.source AND k.key = o.key GROUP BY k.doc_id, k.i)
    GROUP BY doc_id),
base AS (
    SELECT d.doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
           coalesce(removed.n, 0) AS n_removed_chars, length(t) AS chars
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT * EXCLUDE (chars), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
           AND 100 * n_removed_chars <= 50 * chars AS kept
FROM base
"""

LINES = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
    SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM lines),
often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.i, k.line, o.keeper IS NOT NULL AND o.keeper <> k.doc_id AS gone
    FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

NEAR = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT x, y FROM common c JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, to_id) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.to_id = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.to_id) AS component_id, d.doc_id = min(r.to_id) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id, s.n
"""

URLS = r"""
WITH RECURSIVE parts AS (
    SELECT page_id, url, html,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
           CASE WHEN contains(url, '://') THEN concat(
               translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1)) END AS node
    FROM pages),
tags AS (
    SELECT url, host, path, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
    FROM parts WHERE node IS NOT NULL),
targets AS (
    SELECT url, host, path, node, CASE
        WHEN regexp_matches(tag, '(?is)^<link\b') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
            THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
        WHEN regexp_matches(tag, '(?is)^<meta\b') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
            THEN regexp_extract(tag, '(?is)\burl\s*=\s*([^"''\s>]+)', 1) END AS target
    FROM tags),
seen AS (
    SELECT node, CASE
        WHEN contains(target, '://') THEN target
        WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || target
        WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://)', 1) || host || target
        ELSE regexp_extract(url, '(?s)^(.*?://)', 1) || host
            || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || target
        END AS target FROM targets WHERE target <> ''),
links AS (
    SELECT DISTINCT node AS u, concat(
        translate(regexp_extract(target, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1)) AS v FROM seen),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(node, other) AS (
    SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
rules(verdict, host, path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
    SELECT DISTINCT r.node, u.verdict FROM (SELECT DISTINCT other AS node FROM reach) r, rules u
    WHERE starts_with(regexp_extract(r.node, '(?s)^.*?://[^/?#]*([^?#]*)', 1), u.path)
      AND ends_with('.' || regexp_extract(r.node, '://([^/?#]*)', 1), '.' || u.host)
    QUALIFY row_number() OVER (PARTITION BY r.node ORDER BY length(u.host || u.path) DESC) = 1),
alias AS (
    SELECT r.node, CASE WHEN bool_or(u.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
    FROM reach r JOIN ruled u ON u.node = r.other GROUP BY r.node),
hits AS (
    SELECT p.page_id, p.url, u.host || u.path AS rule, u.verdict FROM parts p, rules u
    WHERE starts_with(p.path, u.path) AND ends_with('.' || p.host, '.' || u.host)
    QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(u.host || u.path) DESC) = 1)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, a.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h USING (page_id) LEFT JOIN alias a USING (node)
"""

# CRC-32 from its polynomial; bytes of letters up to U+00FF in UTF-8.
SPELLING = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, range(8)), lambda a, b: if(a % 2 = 1, xor(3988292384, a // 2), a // 2))) AS tab),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
        string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: if(ord(c) < 128, [ord(c)::BIGINT], [195::BIGINT, ord(c)::BIGINT - 64])))),
        lambda a, b: xor(tab[xor(a, b) % 256 + 1], a // 256)), 4294967295) AS h
    FROM pairs, crc),
words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END
            AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (
    SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
    FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
    SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b
    WHERE x.word != y.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.a || h.b = w.word
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.a || h.b = w.word),
best AS (
    SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
           CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)),
roots(word, root, form) AS (
    SELECT word, word, form FROM forms
    UNION ALL SELECT r.word, f.word, f.form FROM roots r JOIN forms f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word AND r.form IS NULL
"""

CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
sized AS (
    SELECT *, length('### ') + length(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role
            ELSE '\r' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') END)
        + 2 + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) + length('</turn>') + 1 AS n
    FROM turns),
joined AS (
    SELECT conv_id, count(*) AS n_turns, sum(n)::BIGINT AS formatted_chars,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
           string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text) AS loss
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM joined
"""


def _cluster_sql(rounds: int = 5, clusters: int = 40) -> str:
    """The rounds of k-means one after another, each from the centroids of the one before."""
    steps = [f"""
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
vectors AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept
    QUALIFY c < {clusters}),
centroids0 AS MATERIALIZED (SELECT c, i, x FROM seeds JOIN vectors USING (rid))"""]
    for r in range(rounds + 1):
        steps.append(f"""
nearest{r} AS MATERIALIZED (
    SELECT rid, c, d FROM (
        SELECT v.rid, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d
        FROM vectors v JOIN centroids{r} k USING (i) GROUP BY v.rid, k.c)
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
centroids{r + 1} AS MATERIALIZED (
    SELECT k.c, k.i, coalesce((s - ((s % n) + n) % n) // n, k.x)::BIGINT AS x FROM centroids{r} k LEFT JOIN (
        SELECT c, i, sum(x) AS s, count(*) AS n FROM nearest{r} JOIN vectors USING (rid) GROUP BY c, i) m
    ON m.c = k.c AND m.i = k.i)""")
    return ",".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM nearest{rounds} JOIN kept USING (rid) JOIN (
    SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM centroids{rounds} GROUP BY c) USING (c)
"""


CLUSTERS = _cluster_sql()


ORACLE = {
    "op1_quality_rules": QUALITY,
    "op2_line_dedup": LINES,
    "op4_url_filter": URLS,
    "op5_near_dedup": NEAR,
    "op6_exact_dedup": EXACT,
    "op11_spelling_variants": SPELLING,
    "op12_chat_format": CHATS,
    "op13_centroid_clusters": CLUSTERS,
}
