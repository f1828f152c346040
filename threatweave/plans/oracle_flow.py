"""SQL twins of the dataset, evaluation, URL and text queries."""

from __future__ import annotations

from threatweave.functions import fixed as K


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _array(words) -> str:
    return "[" + _list(words)[1:-1] + "]"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# --- orders as labelled flows ---------------------------------------------------
ORDERS = """
o AS (
  SELECT o_orderkey, o_orderdate, o_totalprice,
         CASE WHEN left(o_orderpriority, 1) = '1' THEN 'DDoS' WHEN left(o_orderpriority, 1) = '2' THEN 'DoS'
              WHEN left(o_orderpriority, 1) = '3' AND o_orderstatus = 'P' THEN 'Odd'
              WHEN left(o_orderpriority, 1) = '4' THEN 'PortScan' ELSE 'BENIGN' END AS label,
         left(o_orderpriority, 1) = '1' AS friday_file,
         ('0x' || left(md5('42:' || o_orderkey), 8))::BIGINT AS h
  FROM orders)"""

# --- dataset profile ---------------------------------------------------------
DATASET = """
ds AS (
  SELECT 'part-' || l_linestatus || '.parquet' AS file, l_linenumber AS no, l_returnflag AS flag, l_quantity AS quantity,
         CASE WHEN l_tax = 0.08 THEN 'NaN'::DOUBLE WHEN l_tax > 0 THEN l_tax END AS tax,
         CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity / l_discount END AS rate,
         l_extendedprice AS price, 7 AS protocol, l_partkey AS port
  FROM lineitem),
named(no, flag, validator, indexed, strict, permissive) AS (
  SELECT n, f,
    CASE WHEN n = 1 THEN 'BENIGN' WHEN n = 2 AND f = 'A' THEN 'None' WHEN n = 2 THEN 'BENIGN'
         WHEN n = 3 AND f = 'R' THEN 'DoS other' WHEN n = 3 THEN 'DoS Hulk' WHEN n = 4 THEN 'FTP-Patator'
         WHEN n = 5 AND f = 'N' THEN 'Web Attack - Sql Injection' WHEN n = 5 THEN 'Web Attack - XSS'
         WHEN n = 6 AND f = 'R' THEN 'Botnet' WHEN n = 6 THEN 'Bot' WHEN f = 'A' THEN 'Unknown thing'
         ELSE 'Web Attack - Brute Force' END,
    CASE WHEN n = 1 THEN 'BENIGN' WHEN n = 2 AND f = 'A' THEN 'None' WHEN n = 2 THEN 'BENIGN'
         WHEN n = 3 AND f = 'R' THEN 'DoS other' WHEN n = 3 THEN 'DoS Hulk' WHEN n = 4 THEN 'FTP - Patator'
         WHEN n = 5 AND f = 'N' THEN 'Web Attack - Sql Injection' WHEN n = 5 THEN 'Web Attack - XSS'
         WHEN n = 6 AND f = 'R' THEN 'Botnet' WHEN n = 6 THEN 'Bot' WHEN f = 'A' THEN 'Unknown thing'
         ELSE 'Web Attack - Brute Force' END,
    CASE WHEN n = 1 THEN 'BENIGN' WHEN n = 2 AND f = 'A' THEN NULL WHEN n = 2 THEN 'BENIGN'
         WHEN n = 3 AND f = 'R' THEN NULL WHEN n = 3 THEN 'DoS' WHEN n = 4 THEN 'BruteForce' WHEN n = 5 THEN 'WebAttack'
         WHEN n = 6 AND f = 'R' THEN NULL WHEN n = 6 THEN 'Botnet' WHEN f = 'A' THEN NULL ELSE 'WebAttack' END,
    CASE WHEN n = 1 THEN 'BENIGN' WHEN n = 2 AND f = 'A' THEN 'None' WHEN n = 2 THEN 'BENIGN' WHEN n = 3 THEN 'DoS'
         WHEN n = 4 THEN 'BruteForce' WHEN n = 5 THEN 'WebAttack' WHEN n = 6 THEN 'Botnet' WHEN f = 'A' THEN 'Unknown thing'
         ELSE 'WebAttack' END
  FROM range(1, 8) AS a(n), (VALUES ('A'), ('N'), ('R')) AS b(f)),
lab AS (SELECT ds.*, validator, indexed, strict, permissive FROM ds JOIN named USING (no, flag)),
classes(class_no, label) AS (SELECT i - 1, names[i] FROM (SELECT """ + _array(K.CANONICAL_CLASSES) + """ AS names), range(1, 10) AS r(i))"""


def _stat(name: str, expr: str, number: bool = True, inf: bool = False) -> str:
    low = f"coalesce(round(min({expr}) FILTER (NOT isnan({expr}::DOUBLE)), 6), -1.0)" if number else "-1.0"
    high = low.replace("min(", "max(", 1)
    infinite = f"count(*) FILTER (isinf({expr}::DOUBLE))" if inf else "0"
    gone = f"{expr} IS NULL" + (f" OR isnan({expr}::DOUBLE)" if number else "")
    return f"""SELECT file, '{name}' AS "column", count(*) AS rows, count(*) FILTER ({gone}) AS missing,
       {infinite} AS infinite, {low}::DOUBLE AS min, {high}::DOUBLE AS max FROM ds GROUP BY file"""


def _per_column(*names: str) -> str:
    """One row per file and number column: its least and greatest value."""
    return "\nUNION ALL ".join(
        f"SELECT file, '{n}' AS name, min(x) FILTER (NOT isnan(x)) AS lo, max(x) FILTER (NOT isnan(x)) AS hi FROM (SELECT file, {c}::DOUBLE AS x FROM ds) GROUP BY file"
        for n, c in (n.split(":") for n in names))


REPORTS = DATASET + ", ranges AS (" + _per_column("quantity:quantity", "tax:tax", "rate:rate", "price:price", "protocol:protocol", "attack port:port") + f"""),
names AS (SELECT unnest(['Label', 'quantity', 'tax', 'rate', 'price', 'protocol', 'attack port', 'class name']) AS name),
leaking AS (SELECT string_agg(name, ',' ORDER BY name) AS leakage FROM names WHERE regexp_matches(name, '(?i)\\b({'|'.join(K.LEAKAGE_WORDS)})\\b') AND lower(name) <> 'label'),
cells AS (
  SELECT file, count(*) AS rows, count(*) FILTER (tax IS NULL OR isnan(tax)) + count(*) FILTER (no = 2 AND flag = 'A') AS missing,
         count(*) FILTER (isinf(rate)) AS infinite FROM ds GROUP BY file),
cls AS (SELECT file, strict AS label, count(*) AS n FROM lab WHERE strict IS NOT NULL GROUP BY ALL),
unm AS (SELECT file, coalesce(validator, '?') AS label, count(*) AS n FROM lab WHERE strict IS NULL GROUP BY ALL)"""

PROFILE = {
    "file_report": _with(REPORTS, """
SELECT file, rows, 8 AS columns, TRUE AS label_found,
       (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM cls WHERE cls.file = cells.file) AS classes,
       (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM unm WHERE unm.file = cells.file) AS unmapped, missing, infinite,
       (SELECT count(*) FROM ranges r WHERE r.file = cells.file) AS ranges,
       (SELECT round(sum(lo) + sum(hi) FILTER (NOT isinf(hi)), 4) FROM ranges r WHERE r.file = cells.file) AS low_high, leakage
FROM cells, leaking"""),
    "dataset_summary": _with(REPORTS + """,
one AS (SELECT label, sum(n) AS n FROM unm GROUP BY 1), two AS (SELECT label, sum(n) AS n FROM cls GROUP BY 1),
total AS (SELECT count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(infinite) AS BIGINT) AS infinite FROM cells),
bad AS (SELECT count(*) AS unmapped_labels, CAST(sum(n) AS BIGINT) AS unmapped_rows, string_agg(label || '=' || n, ',' ORDER BY label) AS unmapped FROM one),
verdict AS (SELECT concat_ws(',', CASE WHEN rows = 0 THEN 'no_rows' END, CASE WHEN unmapped_rows > 0 THEN 'unmapped_labels' END,
                   CASE WHEN missing > 0 THEN 'missing_values' END, CASE WHEN infinite > 0 THEN 'infinite_values' END) AS failures FROM total, bad)""", """
SELECT files, rows, (SELECT count(*) FROM names) AS columns, 0 AS mismatches, 0 AS files_without_label, unmapped_labels, unmapped_rows, unmapped,
       (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM two) AS classes, missing, infinite, leakage,
       (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM ranges GROUP BY 1 HAVING min(lo) = max(hi) AND NOT isinf(min(lo)))) AS constant,
       failures, failures = '' AS passed
FROM total, bad, leaking, verdict"""),
    "drifting_exports": _with(DATASET, """
SELECT flag AS class_name, CASE WHEN flag = 'R' THEN 'same' ELSE raw_label END AS label, count(*) AS n, CAST(sum(protocol) AS BIGINT) AS protocols,
       CAST(count(tax) FILTER (flag <> 'A') AS BIGINT) AS taxed, CAST(sum(port) AS BIGINT) AS ports, round(sum(price::DECIMAL(18,2))::DOUBLE, 2) AS price
FROM (SELECT *, CASE WHEN no = 1 THEN '  Benign ' WHEN no = 2 AND flag = 'A' THEN NULL WHEN no = 2 THEN 'BENIGN' WHEN no = 3 THEN 'DoS Hulk'
                     WHEN no = 4 THEN 'FTP-Patator' WHEN no = 5 AND flag = 'N' THEN 'Web Attack ' || chr(65533) || ' Sql Injection'
                     WHEN no = 5 THEN 'Web  Attack ' || chr(8211) || ' XSS' WHEN no = 6 THEN 'Bot' WHEN flag = 'A' THEN 'Unknown thing'
                     ELSE 'WebAttack- Brute Force' END AS raw_label FROM ds) GROUP BY ALL"""),
    "csv_encodings": _with(ORDERS, "SELECT label || ' caf' || chr(233) AS note, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o GROUP BY 1"),
    "label_canonical": _with(DATASET, """
SELECT validator, indexed, coalesce(strict, '-') AS strict, permissive, count(*) AS n FROM lab GROUP BY ALL"""),
    "label_keep_canonical": _with(DATASET, """
SELECT permissive AS label, count(*) AS n FROM lab WHERE permissive IN ('None', 'Unknown thing') GROUP BY 1
UNION ALL SELECT '(kept)', count(*) FROM lab WHERE permissive NOT IN ('None', 'Unknown thing')"""),
    "label_distribution": _with(DATASET, """
SELECT f.file, c.class_no, c.label, count(lab.no) AS n
FROM (SELECT DISTINCT file FROM ds) f CROSS JOIN classes c LEFT JOIN lab ON lab.file = f.file AND lab.strict = c.label GROUP BY ALL
UNION ALL SELECT '(all)', c.class_no, c.label, count(lab.no) FROM classes c LEFT JOIN lab ON lab.strict = c.label GROUP BY ALL"""),
    "unmapped_labels": _with(DATASET, "SELECT validator AS label, count(*) AS n FROM lab WHERE strict IS NULL GROUP BY 1"),
    "column_stats": _with(DATASET, "\nUNION ALL ".join([
        _stat("quantity", "quantity"), _stat("tax", "tax"), _stat("rate", "rate", inf=True), _stat("price", "price"),
        _stat("protocol", "protocol"), _stat("attack port", "port"), _stat("class name", "flag", number=False),
        _stat("Label", "CASE WHEN NOT (no = 2 AND flag = 'A') THEN 1 END", number=False)])),
    "constant_columns": _with(DATASET, """SELECT 'protocol' AS "column" FROM (SELECT count(DISTINCT protocol) AS k FROM ds) WHERE k = 1"""),
    "leakage_in_files": f"""
SELECT table_name || '.parquet' AS file, column_name AS "column" FROM information_schema.columns
WHERE regexp_matches(column_name, '(?i)\\b({'|'.join(K.LEAKAGE_WORDS)})\\b') AND lower(column_name) <> 'toxic'""",
    "leakage_columns": _with(DATASET, """SELECT unnest(['attack port', 'class name']) AS "column" WHERE (SELECT count(*) FROM ds) >= 0"""),
    "quality_gate": _with(DATASET, """
SELECT (SELECT count(DISTINCT file) FROM ds) AS files, (SELECT count(*) FROM ds) AS rows_total,
       (SELECT count(*) FILTER (tax IS NULL OR isnan(tax)) + count(*) FILTER (no = 2 AND flag = 'A') FROM ds) AS missing_total,
       (SELECT count(*) FILTER (isinf(rate)) FROM ds) AS inf_total,
       (SELECT count(DISTINCT validator) FROM lab WHERE strict IS NULL) AS unmapped_labels,
       (SELECT count(*) FROM lab WHERE strict IS NULL) AS unmapped_rows, 1 AS constant_columns,
       'unmapped_labels,missing_values,infinite_values' AS failures, false AS passed"""),
    "file_label_index": _with(DATASET, f"""
SELECT file, count(*) AS rows, count(*) FILTER (permissive IN {_list(K.CANONICAL_CLASSES)}) AS canonical_rows,
       string_agg(DISTINCT permissive, ',' ORDER BY permissive) FILTER (permissive IN {_list(K.CANONICAL_CLASSES)}) AS canonical_present
FROM lab GROUP BY file"""),
    "dataset_labels": _with(DATASET, "SELECT permissive AS label, count(*) AS n FROM lab GROUP BY 1"),
}

# --- splits ------------------------------------------------------------------
WEEKDAY = ORDERS + """,
sp AS (SELECT *, CASE WHEN dayofweek(o_orderdate) = 5 THEN 'test' WHEN h < 644245094 THEN 'val' ELSE 'train' END AS split FROM o)"""

QUOTA = ORDERS + """,
cnt AS (SELECT label, count(*) AS n FROM o WHERE label <> 'Odd' GROUP BY label),
least_of AS (
  SELECT label, n, CASE WHEN w > n THEN greatest(1, n // 2) ELSE w END AS min_train,
         CAST(round_even(n * 0.20, 0) AS BIGINT) AS t0, CAST(round_even(n * 0.15, 0) AS BIGINT) AS v0
  FROM (SELECT label, n, CASE label WHEN 'DDoS' THEN 2500 WHEN 'DoS' THEN 500 WHEN 'PortScan' THEN 100000 ELSE 1000 END AS w FROM cnt)),
plan AS (
  SELECT label, n, t0 - least(short, t0) AS n_test, v0 - least(short - least(short, t0), v0) AS n_val, min_train
  FROM (SELECT *, greatest(0, min_train - (n - t0 - v0)) AS short FROM least_of)),
sp AS (
  SELECT o.*, CASE WHEN p.label IS NULL THEN 'train' WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + n_val THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rk FROM o) o LEFT JOIN plan p USING (label))"""

SPLITS = {
    "split_weekday": _with(WEEKDAY, "SELECT o_orderkey, split FROM sp"),
    "split_counts": _with(WEEKDAY, "SELECT split, label, count(*) AS n FROM sp GROUP BY ALL"),
    "split_filename": _with(ORDERS, """
SELECT CASE WHEN friday_file THEN 'test' WHEN h < 644245094 THEN 'val' ELSE 'train' END AS split, label, count(*) AS n FROM o GROUP BY ALL"""),
    "quota_plan": _with(QUOTA, "SELECT label, n, n_test, n_val, n - n_test - n_val AS n_train, min_train FROM plan"),
    "quota_split": _with(QUOTA, "SELECT o_orderkey, split FROM sp"),
    "quota_split_manifest": _with(QUOTA, """
SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM sp GROUP BY label"""),
    "split_coverage": _with(QUOTA, "SELECT DISTINCT 'test_label_not_in_train' AS problem, 't:' || label AS label FROM sp WHERE split = 'test'"),
    "sample_rows": _with(ORDERS, """
SELECT o_orderkey, label, CASE WHEN o_totalprice < 100000 THEN 'BENIGN' WHEN o_totalprice < 200000 THEN 'DDoS' WHEN o_totalprice < 300000 THEN 'DoS'
       WHEN o_totalprice < 350000 THEN 'PortScan' ELSE label END AS prediction
FROM o ORDER BY h, o_orderkey LIMIT 5000"""),
}

# --- features and evaluation -------------------------------------------------
SCORED = ORDERS + """,
s AS (
  SELECT *, CASE WHEN o_totalprice < 100000 THEN 'BENIGN' WHEN o_totalprice < 200000 THEN 'DDoS' WHEN o_totalprice < 300000 THEN 'DoS'
                 WHEN o_totalprice < 350000 THEN 'PortScan' ELSE label END AS prediction, ((o_orderkey * 37) % 101) / 100 AS score
  FROM o),
names AS (SELECT label FROM s UNION SELECT prediction FROM s),
cm AS (
  SELECT a.label AS truth, b.label AS predicted, count(s.o_orderkey) AS n
  FROM names a CROSS JOIN names b LEFT JOIN s ON s.label = a.label AND s.prediction = b.label GROUP BY ALL)"""


def _metrics(names: str) -> str:
    return f"""
counted AS (
  SELECT c.label, count(*) FILTER (s.label = c.label AND s.prediction = c.label) AS tp,
         count(*) FILTER (s.label = c.label) AS support, count(*) FILTER (s.prediction = c.label) AS called
  FROM ({names}) c CROSS JOIN s GROUP BY c.label),
met AS (
  SELECT label, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
         CASE WHEN called + support > 0 THEN 2 * tp / (called + support) ELSE 0 END AS f1, support FROM counted)"""


FIXED_NAMES = "SELECT unnest(" + _array(K.CANONICAL_CLASSES) + ") AS label"
MET = "SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM met"
SUMMARY = "SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows FROM met"


def _search(start: int, stop: int, macro: bool) -> str:
    f1 = "CASE WHEN called + pos > 0 THEN 2 * tp / (called + pos) ELSE 0 END"
    if macro:
        f1 = f"({f1} + CASE WHEN 2 * total - called - pos > 0 THEN 2 * (total - called - pos + tp) / (2 * total - called - pos) ELSE 0 END) / 2"
    return _with(SCORED + f""",
g AS (SELECT i * 5 / 100 AS threshold FROM range({start}, {stop}) AS r(i)),
swept AS (
  SELECT s.prediction AS class, g.threshold, count(*) FILTER (score >= threshold) AS called,
         count(*) FILTER (score >= threshold AND s.label = s.prediction) AS tp, count(*) FILTER (s.label = s.prediction) AS pos, count(*) AS total
  FROM s CROSS JOIN g GROUP BY ALL)""", f"""
SELECT class, round(threshold, 9) AS threshold, round({f1}, 9) AS f1 FROM swept
QUALIFY row_number() OVER (PARTITION BY class ORDER BY {f1} DESC, threshold) = 1""")


def _fit(name: str, expr: str) -> str:
    good = f"CASE WHEN isfinite({expr}::DOUBLE) THEN {expr}::DOUBLE END"
    return f"""SELECT '{name}' AS feature, round(any_value(md), 6) AS median, round(avg(coalesce(v, md)), 7) AS mean,
       round(CASE WHEN stddev_pop(coalesce(v, md)) = 0 THEN 1 ELSE stddev_pop(coalesce(v, md)) END, 7) AS std
  FROM (SELECT {good} AS v, median({good}) OVER () AS md FROM ds)"""


EVALUATE = {
    "feature_fit": _with(DATASET, "\nUNION ALL ".join(_fit(n, e) for n, e in (
        ("quantity", "quantity"), ("tax", "tax"), ("rate", "rate"), ("price", "price"), ("protocol", "protocol"), ("attack port", "port")))),
    "feature_standardize": """
WITH x AS (SELECT vec_id, i AS name, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) AS r(i)),
st AS (SELECT name, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY name),
ranked AS (SELECT i, row_number() OVER (ORDER BY 'e' || i) - 1 AS pos FROM range(0, 64) AS r(i))
SELECT vec_id, pos, round(((v - mu) / sd)::FLOAT::DOUBLE, 3) AS x FROM x JOIN st USING (name) JOIN ranked ON i = name""",
    "feature_contract": """
WITH h AS (SELECT vec_id, label, embedding[1]::DOUBLE AS v, ('0x' || left(md5('42:' || vec_id), 8))::BIGINT / 4294967296.0 AS share FROM embeddings),
s AS (SELECT *, CASE WHEN share < 0.2 THEN 'test' WHEN share < 0.35 THEN 'val' ELSE 'train' END AS split FROM h),
fit AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM s WHERE split = 'train')
SELECT split, label::VARCHAR AS label, count(*) AS rows, 64 AS features, count(*) AS same, round(avg(((v - mu) / sd) * ((v - mu) / sd)), 4) AS mean_square
FROM s, fit GROUP BY ALL""",
    "class_weights": _with(ORDERS, """
SELECT label, n, round(total / (k * n), 9) AS weight
FROM (SELECT label, count(*) AS n FROM o GROUP BY label), (SELECT count(*) AS total, count(DISTINCT label) AS k FROM o)"""),
    "confusion": _with(SCORED, "SELECT truth, predicted, n FROM cm"),
    "confusion_normalized": _with(SCORED, "SELECT truth, predicted, n, round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 9) AS share FROM cm"),
    "per_class_metrics": _with(SCORED + "," + _metrics(FIXED_NAMES), MET),
    "macro_weighted_f1": _with(SCORED + "," + _metrics("SELECT label FROM names"), SUMMARY),
    "macro_f1_fixed_labels": _with(SCORED + "," + _metrics(FIXED_NAMES), SUMMARY),
    "binary_report": _with(SCORED.replace("s AS (", "s0 AS (", 1).replace("names AS", """s AS (
  SELECT o_orderkey, CASE WHEN label = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS label,
         CASE WHEN prediction = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS prediction FROM s0),
names AS""") + "," + _metrics("SELECT unnest(['ATTACK', 'BENIGN']) AS label"), MET),
    "threshold_search": _search(1, 20, False),
    "gate_threshold_search": _search(2, 20, True),
    "predict_thresholds": """WITH s AS (
  SELECT vec_id, unnest(range(1, 10)) AS c, unnest([0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.0, 0.0]) AS least,
         round(CAST(unnest(embedding[1:9]) AS DOUBLE), 2) + CAST(0 AS DOUBLE) AS score FROM embeddings)
SELECT vec_id, (""" + _array(K.CANONICAL_CLASSES) + """)[c] AS prediction, round(score, 2) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score >= least DESC, score DESC, c) = 1""",
    "alert_levels": _with(SCORED, """
SELECT prediction, CASE WHEN prediction <> 'BENIGN' AND score >= 0.65 THEN 'CONFIRMED' WHEN prediction <> 'BENIGN' AND score >= 0.35 THEN 'SUSPECT'
       WHEN prediction = 'BENIGN' AND score >= 0.65 THEN 'SUSPECT' ELSE 'NONE' END AS alert_level, count(*) AS n FROM s GROUP BY ALL"""),
}

# --- URLs --------------------------------------------------------------------
KEYWORDS = _array(K.PHISHING_KEYWORDS)
URLS = f"""
base AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages),
u AS (
  SELECT page_id, kind, url, ((length(url) * 13) % 101) / 100 AS p FROM (
    SELECT page_id, 0 AS kind, url FROM base
    UNION ALL SELECT page_id, 1, replace(url, '.example.', '.secure-login.') FROM base
    UNION ALL SELECT page_id, 2, 'http://10.1.2.' || (page_id % 256) || ':8080//verify?account=1&b=&c=2&c=3' FROM base
    UNION ALL SELECT page_id, 3, h || '/free-gift/paypal;p=1?x=%41@y' FROM base
    UNION ALL SELECT page_id, 4, 'https://bit.ly.shop.co.uk/a/b/c/' || h || '#confirm' FROM base
    UNION ALL SELECT page_id, 5, 'https://user:pw@a.b.c.d.update-bank.xyz/' || repeat(url, 4) FROM base)),
cut1 AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS nofrag FROM u),
cut2 AS (
  SELECT *, split_part(nofrag, '?', 1) AS before_q, CASE WHEN contains(nofrag, '?') THEN substr(nofrag, strpos(nofrag, '?') + 1) ELSE '' END AS query FROM cut1),
cut3 AS (
  SELECT *, contains(before_q, '://') AND regexp_matches(before_q, '^https?://') AS full_url,
         CASE WHEN regexp_matches(before_q, '^https?://') THEN split_part(before_q, '/', 3) ELSE split_part(before_q, '/', 1) END AS authority,
         regexp_replace(CASE WHEN regexp_matches(before_q, '^https?://') THEN regexp_replace(before_q, '^https?://[^/]*', '') ELSE before_q END, ';[^/]*$', '') AS path
  FROM cut2),
hosts AS (SELECT *, split_part(regexp_extract(authority, '[^@]*$'), ':', 1) AS host FROM cut3),
lab AS (SELECT *, string_split(host, '.') AS l, kind = 2 AS address FROM hosts),
parted AS (
  SELECT *, CASE WHEN address THEN '' WHEN l[-2] || '.' || l[-1] = 'co.uk' THEN 'co.uk'
                 WHEN l[-1] IN ('com', 'org', 'net', 'xyz') OR length(l[-1]) = 2 THEN l[-1] ELSE '' END AS suffix FROM lab),
parted2 AS (
  SELECT *, CASE WHEN suffix = '' THEN 0 ELSE length(string_split(suffix, '.')) END AS w FROM parted),
feat AS (
  SELECT *, CASE WHEN address THEN host ELSE l[len(l) - w] END AS domain, lower(suffix) AS tld,
         CASE WHEN address THEN 0 ELSE greatest(len(l) - w - 1, 0) END AS num_subdomains,
         length(regexp_replace(url, '[^\\p{{Nd}}]', '', 'g')) AS num_digits, length(regexp_replace(url, '[^\\p{{L}}]', '', 'g')) AS num_letters,
         length(regexp_replace(url, '[\\p{{L}}\\p{{N}}]', '', 'g')) AS num_special_chars,
         len(list_filter({KEYWORDS}, lambda k: contains(lower(url), k))) AS phishing_keyword_count,
         len(string_split_regex(lower(url), '\\s+')) AS n_tokens
  FROM parted2),
rd AS (SELECT *, domain || CASE WHEN suffix <> '' THEN '.' || suffix ELSE '' END AS registered_domain FROM feat),
ent AS (
  SELECT page_id, kind, entropy(c) AS entropy FROM (SELECT page_id, kind, unnest(string_split(registered_domain, '')) AS c FROM rd) GROUP BY ALL),
full_f AS (
  SELECT rd.*, round(entropy, 9) AS entropy, length(url) AS url_length, num_special_chars / length(url) AS special,
         CASE WHEN regexp_matches(url, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') THEN 1 ELSE 0 END AS uses_ip_address,
         CASE WHEN tld IN {_list(K.HIGH_RISK_TLDS)} THEN 1 ELSE 0 END AS is_high_risk_tld
  FROM rd JOIN ent USING (page_id, kind)),
risk AS (
  SELECT *, least(100, floor(p * 60) + 10 * is_high_risk_tld + least(3 * phishing_keyword_count, 15)
                 + CASE WHEN uses_ip_address = 1 THEN 10 WHEN url_length > 150 THEN 5 WHEN num_subdomains > 3 THEN 3 ELSE 0 END
                 + CASE WHEN special > 0.3 THEN 5 ELSE 0 END)::INTEGER AS risk_score FROM full_f),
leveled AS (
  SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM'
                 WHEN risk_score >= 20 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level FROM risk)"""



def _suffix_sql(more: str = "") -> str:
    """Suffix, domain and subdomain by listed rules: an exception wins, then the most labels."""
    rules = ("com", "org", "example.com", "pills.example.com", "*.example.net", "!ththan.example.net", "m.ththth.example.net")
    return _with(URLS + f""",
listed AS (SELECT unnest({_array(rules)}) AS rule{more}),
names AS (SELECT DISTINCT host, l, address FROM lab),
ends AS (SELECT host, k, array_to_string(l[len(l) - k + 1:], '.') AS whole, '*.' || array_to_string(l[len(l) - k + 2:], '.') AS wild
         FROM names, range(1, 12) AS r(k) WHERE k <= len(l)),
fits AS (
  SELECT host, k AS score FROM ends JOIN listed ON rule = whole UNION ALL SELECT host, k FROM ends JOIN listed ON rule = wild
  UNION ALL SELECT host, 1000 + k - 1 FROM ends JOIN listed ON rule = '!' || whole),
best AS (SELECT host, max(score) % 1000 AS b FROM fits GROUP BY host),
wide AS (SELECT host, l, address, CASE WHEN address THEN 0 WHEN b IS NOT NULL THEN b WHEN length(l[-1]) = 2 THEN 1 ELSE 0 END AS w
         FROM names LEFT JOIN best USING (host))""", """
SELECT page_id, kind, lab.host, array_to_string(wide.l[len(wide.l) - w + 1:], '.') AS suffix,
       CASE WHEN wide.address THEN lab.host WHEN len(wide.l) > w THEN wide.l[len(wide.l) - w] ELSE '' END AS domain,
       CASE WHEN wide.address OR len(wide.l) - w - 1 <= 0 THEN '' ELSE array_to_string(wide.l[:len(wide.l) - w - 1], '.') END AS subdomain
FROM lab JOIN wide ON lab.host = wide.host""")


ADVICE = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.RISK_ADVICE.items()) + " END"

URL = {
    "url_features": _with(URLS, f"""
SELECT page_id, kind, registered_domain, tld, url_length, length(registered_domain) AS domain_length, length(path) AS path_length, num_subdomains,
       num_digits, num_letters, num_special_chars, round(num_digits / url_length, 9) AS digit_ratio, round(num_letters / url_length, 9) AS letter_ratio,
       round(special, 9) AS special_char_ratio, phishing_keyword_count, round(phishing_keyword_count / n_tokens, 9) AS phishing_keyword_ratio,
       starts_with(url, 'https://')::INTEGER AS is_https, starts_with(url, 'http://')::INTEGER AS is_http, (path NOT IN ('', '/'))::INTEGER AS has_path,
       (query <> '')::INTEGER AS has_query, CASE WHEN query = '' THEN 0 ELSE len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.')), lambda x: split_part(x, '=', 1)))) END AS num_params,
       (num_subdomains > 0)::INTEGER AS has_subdomain, is_high_risk_tld, (tld IN {_list(K.LEGITIMATE_TLDS)})::INTEGER AS is_legitimate_tld, uses_ip_address,
       regexp_matches(url, '[@%&*]')::INTEGER AS has_suspicious_symbols, contains(path, '//')::INTEGER AS has_double_slash,
       starts_with(url, 'https://')::INTEGER AS has_ssl, length(path) - length(replace(path, '/', '')) AS url_depth,
       (contains(url, 'bit.ly') OR contains(url, 'tinyurl') OR contains(url, 'goo.gl'))::INTEGER AS is_shortened, entropy FROM full_f"""),
    "url_suffix_rules": _suffix_sql(),
    "url_suffix_table": _suffix_sql(" UNION SELECT DISTINCT h FROM base WHERE h LIKE '%.example.org'"),
    "url_tld_codes": _with(URLS, """
SELECT tld, CASE WHEN tld = '' THEN 0 ELSE (('0x' || left(md5('0:' || tld), 8))::BIGINT % 1000)::INTEGER END AS tld_encoded, count(*) AS n
FROM full_f GROUP BY ALL"""),
    "url_risk": _with(URLS, f"""
SELECT page_id, kind, risk_score, CASE WHEN p >= 0.35 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS prediction,
       CASE WHEN p > 0.8 THEN 'HIGH' WHEN p > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, risk_level, {ADVICE} AS recommendation,
       coalesce(nullif(concat_ws('|', CASE WHEN is_high_risk_tld = 1 THEN 'High-risk TLD detected: ' || tld END,
         CASE WHEN phishing_keyword_count > 0 THEN 'Contains ' || phishing_keyword_count || ' phishing keywords' END,
         CASE WHEN url_length > 150 THEN 'Suspiciously long URL' END, CASE WHEN special > 0.3 THEN 'High special character ratio' END,
         CASE WHEN uses_ip_address = 1 THEN 'Uses IP address instead of domain' END,
         CASE WHEN p > 0.9 THEN 'Very high phishing probability (>90%)' END), ''), 'No specific indicators detected') AS reasons FROM leveled"""),
    "url_quick_risk": _with(URLS, f"""
SELECT page_id, kind, least(100, floor(p * 60) + 10 * hr + least(3 * phishing_keyword_count, 15)
         + CASE WHEN uses_ip_address = 1 THEN 10 WHEN url_length > 150 THEN 5 WHEN subs > 3 THEN 3 ELSE 0 END
         + CASE WHEN special > 0.3 THEN 5 ELSE 0 END)::INTEGER AS risk_score, subs AS num_subdomains, hr AS is_high_risk_tld
FROM (SELECT *, CASE WHEN full_url THEN greatest(0, len(string_split(authority, '.')) - 2) ELSE 0 END AS subs,
             (split_part(string_split(lower(url), '.')[-1], '/', 1) IN {_list(K.HIGH_RISK_TLDS)})::INTEGER AS hr FROM full_f)"""),
    "url_batch_stats": _with(URLS, """
SELECT count(*) AS total_urls, count(*) FILTER (p >= 0.35) AS phishing_count, count(*) FILTER (p < 0.35) AS safe_count,
       round(count(*) FILTER (p >= 0.35) / count(*) * 100, 2) AS phishing_rate FROM u"""),
    "url_host_rollup": _with(URLS, """
SELECT registered_domain, count(*) AS urls, count(*) FILTER (p >= 0.35) AS phishing, max(risk_score) AS max_risk,
       CAST(sum(phishing_keyword_count) AS BIGINT) AS keywords FROM leveled GROUP BY 1"""),
    "url_patterns": _with(URLS, """
SELECT page_id, kind, concat_ws(',', CASE WHEN regexp_matches(url, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}') THEN 'ip_address' END,
       CASE WHEN contains(url, '@') THEN 'user_part' END, CASE WHEN regexp_matches(url, '%\\w{2}') THEN 'encoded_char' END,
       CASE WHEN regexp_matches(url, '\\.(exe|bat|cmd|msi|jar)$') THEN 'executable' END) AS patterns FROM u"""),
}

# --- text --------------------------------------------------------------------
WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
MESSAGES = rf"""
m AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' Dear Customer, click here within 24 hours: HTTPS://evil-' || turn
           || '.example/x?y=1 or mail a.b@c.example, call +1 (555) 010-' || (conv_id % 9000 + 1000)
           || '. Verify your account_id 42 now, I am not joking!' ELSE text END AS text
  FROM conversations),
clean AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
    'https?://[^{WS}]+|www\.[^{WS}]+', '', 'g'), '[^{WS}]+@[^{WS}]+', '', 'g'),
    '\+?\p{{Nd}}[\p{{Nd}}{WS}\-()]{{7,}}\p{{Nd}}', '', 'g'), '[^\p{{L}}\p{{N}}_{WS}.!?]', ' ', 'g'), '[{WS}]+', ' ', 'g')) AS scrubbed
  FROM m)"""


def _groups(col: str) -> str:
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + f" THEN '{name}' END"
        for name, words in K.TEXT_PATTERNS.items()
    )
    return f"[x for x in [{cases}] if x IS NOT NULL]"


TEXT = {
    "text_scrub": _with(MESSAGES, "SELECT conv_id, turn, scrubbed AS out FROM clean"),
    "text_tokens": _with(MESSAGES, rf"""
SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(scrubbed, '[ .!?]+'),
         lambda w: w <> '' AND NOT list_contains({_array(K.STOP_WORDS)}, w) AND (length(w) > 1 OR w IN ('a', 'i')) AND NOT regexp_full_match(w, '\p{{Nd}}+')), ' ') AS out
FROM clean"""),
    "text_patterns": _with(MESSAGES, f"SELECT conv_id, turn, array_to_string({_groups('text')}, ',') AS out FROM m"),
    "text_keywords": _with(MESSAGES, f"SELECT conv_id, turn, array_to_string(list_filter({KEYWORDS}, lambda k: contains(lower(text), k)), ',') AS out FROM m"),
    "text_phrases": _with(MESSAGES, r"""
SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(text, 'Dear (?:Customer|User|Member|Valued)') THEN 'greeting_mismatch' END,
  CASE WHEN regexp_matches(text, 'Hello\s*(?:there|!|,)') THEN 'generic_greeting' END,
  CASE WHEN regexp_matches(text, 'within \d+ hours?|immediate(?:ly)?|ASAP') THEN 'urgency_indicators' END,
  CASE WHEN regexp_matches(text, 'account (?:will be|has been) (?:suspended|locked|closed)') THEN 'threat_indicators' END,
  CASE WHEN regexp_matches(text, 'click (?:here|below|the link)|verify (?:your|my) account') THEN 'action_required' END) AS out FROM m"""),
    "text_pattern_totals": f"SELECT lang, pattern, count(*) AS n FROM (SELECT lang, unnest({_groups('text')}) AS pattern FROM documents) GROUP BY ALL",
    "text_verdict": _with(MESSAGES, """
SELECT conv_id, turn, CASE WHEN p >= 0.35 THEN 'PHISHING' ELSE 'SAFE' END AS prediction, floor(p * 100)::INTEGER AS risk_score
FROM (SELECT *, (length(text) % 1001) / 1000 AS p FROM m)"""),
}

FLOW_ORACLE = {**PROFILE, **SPLITS, **EVALUATE, **URL, **TEXT}
