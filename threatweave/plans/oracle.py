"""The same results as the named queries, written independently in plain SQL."""

from __future__ import annotations

from threatweave.functions import fixed as K
from threatweave.plans.oracle_flow import FLOW_ORACLE

EVENTS = """
ev AS (
  SELECT event_id AS ord, epoch_us(ts) AS at, event_type,
         least(1.0, greatest(0.0, value / 500)) AS confidence,
         CAST(least(10, greatest(1, 1 + floor(value / 50))) AS INTEGER) AS severity,
         CASE WHEN value >= 100 THEN 'high' WHEN value >= 20 THEN 'mid' ELSE 'low' END AS tag,
         '10.0.0.' || json_extract_string(props, '$.k') AS dst_ip,
         CAST(user_id AS VARCHAR) AS usr
  FROM events)"""



def _lint_sql(more_rules: str = "", more_steps: str = "") -> str:
    """Rule-set issues worked out from the rules as rows (times in seconds)."""
    comma = ", " if more_rules else ""
    return f"""WITH {EVENTS},
rules(n, rule_id, conf, span) AS (VALUES
  (0, 'W001', 0.85, 7200), (1, 'W002', 0.60, 43200), (2, 'W003', 0.90, NULL), (3, 'W004', 0.40, 300), (4, 'W005', 0.70, NULL)
  {comma}{more_rules}),
steps(n, step_no, kind, min_sev, min_conf, tags, win) AS (VALUES
  (0, 0, 'error', 0, 0, '', NULL), (0, 1, 'purchase', 0, 0, '', 3600),
  (1, 0, 'view', 0, 0, '', NULL), (1, 1, 'click', 0, 0, '', 14400), (1, 2, 'purchase', 0, 0, '', 14400),
  (2, 0, 'error', 3, 0, '', NULL), (2, 1, 'error', 0, 0.01, '', 1800),
  (3, 0, 'signup', 0, 0, '', 60), (3, 1, 'view', 0, 0, 'high,mid', 600),
  (4, 0, 'click', 0, 0, '', NULL), (4, 1, 'no_such_type', 0, 0, '', 3600)
  {comma}{more_steps}),
spans AS (SELECT n, max(step_no) + 1 AS steps, sum(win) FILTER (step_no > 0) AS total FROM steps GROUP BY n)
SELECT rule_id, -1 AS step_no, 'error' AS level, 'duplicate_id' AS issue FROM rules
QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY n) > 1
UNION ALL SELECT rule_id, 0, 'warning', 'within_on_first_step' FROM rules JOIN steps USING (n) JOIN spans USING (n)
WHERE step_no = 0 AND win IS NOT NULL AND spans.steps >= 2
UNION ALL SELECT rule_id, -1, 'warning', 'within_exceeds_max_span' FROM rules JOIN spans USING (n) WHERE total > span
UNION ALL SELECT rule_id, -1, 'warning', 'low_confidence' FROM rules WHERE conf < 0.5
UNION ALL SELECT rule_id, step_no, 'warning', 'step_never_met' FROM rules JOIN steps s USING (n)
WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_type = s.kind AND ev.severity >= s.min_sev
  AND ev.confidence >= s.min_conf AND (s.tags = '' OR contains(s.tags, ev.tag)))"""


CHAINS = EVENTS + """,
w1 AS (
  SELECT 'W001' AS rule_id, s.ord AS o0, s.at AS t0, c.ord AS o1, c.at AS t1,
         CAST(NULL AS BIGINT) AS o2, CAST(NULL AS BIGINT) AS t2
  FROM ev s JOIN ev c ON c.usr = s.usr AND c.at BETWEEN s.at AND s.at + 3600000000
  WHERE s.event_type = 'error' AND c.event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY s.ord ORDER BY c.at, c.ord) = 1),
w2a AS (
  SELECT s.ord AS o0, s.at AS t0, c.ord AS o1, c.at AS t1, c.usr, c.dst_ip
  FROM ev s JOIN ev c ON c.usr = s.usr AND c.at BETWEEN s.at AND s.at + 4 * 3600000000
  WHERE s.event_type = 'view' AND c.event_type = 'click'
  QUALIFY row_number() OVER (PARTITION BY s.ord ORDER BY c.at, c.ord) = 1),
w2 AS (
  SELECT 'W002' AS rule_id, s.o0, s.t0, s.o1, s.t1, c.ord AS o2, c.at AS t2
  FROM w2a s JOIN ev c ON (c.usr = s.usr OR c.dst_ip = s.dst_ip)
    AND c.at BETWEEN s.t1 AND least(s.t1 + 4 * 3600000000, s.t0 + 6 * 3600000000)
  WHERE c.event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY s.o0 ORDER BY c.at, c.ord) = 1),
w3 AS (
  SELECT 'W003' AS rule_id, s.ord AS o0, s.at AS t0, c.ord AS o1, c.at AS t1,
         CAST(NULL AS BIGINT) AS o2, CAST(NULL AS BIGINT) AS t2
  FROM ev s JOIN ev c ON (c.usr = s.usr OR c.dst_ip = s.dst_ip) AND c.at BETWEEN s.at AND s.at + 1800000000
  WHERE s.event_type = 'error' AND s.severity >= 3 AND c.event_type = 'error' AND c.confidence >= 0.01
  QUALIFY row_number() OVER (PARTITION BY s.ord ORDER BY c.at, c.ord) = 1),
w4 AS (
  SELECT 'W004' AS rule_id, s.ord AS o0, s.at AS t0, c.ord AS o1, c.at AS t1,
         CAST(NULL AS BIGINT) AS o2, CAST(NULL AS BIGINT) AS t2
  FROM ev s JOIN ev c ON c.at BETWEEN s.at AND s.at + 300000000
  WHERE s.event_type = 'signup' AND c.event_type = 'view' AND c.tag IN ('high', 'mid')
  QUALIFY row_number() OVER (PARTITION BY s.ord ORDER BY c.at, c.ord) = 1),
chains AS (
  SELECT *, CAST(o0 AS VARCHAR) || '>' || CAST(o1 AS VARCHAR) || coalesce('>' || CAST(o2 AS VARCHAR), '') AS chain,
         coalesce(t2, t1) AS t_end
  FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4))"""

RULE_META = """
meta(rule_id, severity, confidence, base) AS (VALUES
  ('W001', 'high', 0.85, 7), ('W002', 'medium', 0.60, 5), ('W003', 'critical', 0.90, 9), ('W004', 'low', 0.40, 3))"""

ALERTS = CHAINS + "," + RULE_META + """,
full_chain AS (
  SELECT c.*, m.severity, m.confidence AS rule_confidence, m.base,
         e0.dst_ip AS dst_ip, CAST(floor(c.t0 / 600000000) AS BIGINT) AS bucket,
         e0.usr AS usr, e1.usr AS usr1, e2.usr AS usr2, e0.dst_ip AS d0, e1.dst_ip AS d1, e2.dst_ip AS d2,
         e0.event_type AS y0, e1.event_type AS y1, e2.event_type AS y2,
         (CASE WHEN e0.confidence > 0 THEN 1.0 / e0.confidence ELSE 0 END
          + CASE WHEN e1.confidence > 0 THEN 1.0 / e1.confidence ELSE 0 END
          + CASE WHEN coalesce(e2.confidence, 0) > 0 THEN 1.0 / e2.confidence ELSE 0 END) AS inv,
         (CASE WHEN e0.confidence > 0 THEN 1 ELSE 0 END + CASE WHEN e1.confidence > 0 THEN 1 ELSE 0 END
          + CASE WHEN coalesce(e2.confidence, 0) > 0 THEN 1 ELSE 0 END) AS n_pos,
         CASE WHEN c.o2 IS NULL THEN (e0.severity + e1.severity) / 2.0
              ELSE (e0.severity + e1.severity + e2.severity) / 3.0 END AS mean_sev,
         greatest(CASE WHEN c.t0 = c.t_end THEN c.o0 ELSE -1 END, CASE WHEN c.t1 = c.t_end THEN c.o1 ELSE -1 END,
                  coalesce(c.o2, -1)) AS completion_ord
  FROM chains c JOIN meta m USING (rule_id)
  JOIN ev e0 ON e0.ord = c.o0 JOIN ev e1 ON e1.ord = c.o1 LEFT JOIN ev e2 ON e2.ord = c.o2),
alerts AS (
  SELECT *, 'entities.dst_ip=' || dst_ip AS key_entity,
         CASE WHEN n_pos > 0 THEN n_pos / inv ELSE 0 END AS hm,
         0.60 * rule_confidence + 0.40 * (CASE WHEN n_pos > 0 THEN n_pos / inv ELSE 0 END) AS score,
         CASE WHEN mean_sev >= 8 AND base < 9 THEN base + 1 ELSE base END AS severity_score
  FROM full_chain),
kept AS (
  SELECT * FROM alerts
  QUALIFY row_number() OVER (PARTITION BY rule_id, key_entity, bucket
                             ORDER BY t_end, completion_ord, t0, o0) = 1)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


CORRELATION = {
    "seq_two_step_alerts": _with(ALERTS, """
SELECT rule_id, chain, severity, severity_score, round(score, 6) AS confidence, key_entity, bucket
FROM kept WHERE rule_id = 'W001'"""),
    "seq_three_step": _with(CHAINS, "SELECT rule_id, chain, t0 AS start_at, t_end AS end_at FROM chains WHERE rule_id = 'W002'"),
    "seq_multi_rule": _with(CHAINS, "SELECT rule_id, chain, t0 AS start_at, t_end AS end_at FROM chains"),
    "alert_dedupe": _with(ALERTS, "SELECT rule_id, chain, key_entity, bucket, completion_ord FROM kept"),
    "alert_key_entity": _with(ALERTS, "SELECT rule_id, chain, key_entity, bucket, completion_ord FROM alerts"),
    "alert_scores": _with(ALERTS, """
SELECT rule_id, chain, severity_score, round(score, 6) AS confidence, 1.0 AS entity_strength,
       concat_ws('|', CASE WHEN hm < 0.5 THEN 'Evidence confidence is low (harmonic mean < 0.5).' END,
                 CASE WHEN mean_sev >= 8 AND base < 9 THEN 'Severity bumped due to high average event severity.' END) AS notes
FROM alerts"""),
    "alert_explain": _with(ALERTS, """
SELECT rule_id, o0 AS start_ord, 0 AS step_index, y0 AS event_type, CAST(o0 AS VARCHAR) AS event_id,
       -1 AS seconds_from_prev, '' AS path, '' AS value FROM alerts
UNION ALL
SELECT rule_id, o0, 1, y1, CAST(o1 AS VARCHAR), (t1 - t0) // 1000000,
       CASE WHEN rule_id = 'W004' THEN '' WHEN usr = usr1 THEN 'entities.user' ELSE 'entities.dst_ip' END,
       CASE WHEN rule_id = 'W004' THEN '' WHEN usr = usr1 THEN usr1 ELSE d1 END FROM alerts
UNION ALL
SELECT rule_id, o0, 2, y2, CAST(o2 AS VARCHAR), (t2 - t1) // 1000000,
       CASE WHEN usr1 = usr2 THEN 'entities.user' ELSE 'entities.dst_ip' END,
       CASE WHEN usr1 = usr2 THEN usr2 ELSE d2 END FROM alerts WHERE o2 IS NOT NULL"""),
    "alert_entities": _with(ALERTS, "SELECT rule_id, o0 AS start_ord, 'dst_ip=' || d0 || ';user=' || usr AS entities FROM alerts"),
    "alert_rule_report": _with(ALERTS, """
SELECT rule_id, count(*) AS alerts, round(avg(score), 6) AS mean_confidence, max(severity_score) AS max_severity_score
FROM kept GROUP BY rule_id"""),
    "rule_lint": _lint_sql(),
    "rule_lint_repeated": _lint_sql(
        "(5, 'W001', 0.85, 7200), (6, 'W001', 0.30, 600), (7, 'W004', 0.40, 300)",
        "(5, 0, 'error', 0, 0, '', NULL), (5, 1, 'purchase', 0, 0, '', 3600), (6, 0, 'click', 0, 0, '', 60), "
        "(6, 1, 'nowhere', 0, 0, '', 1200), (7, 0, 'signup', 0, 0, '', 60)"),
    "rule_step_coverage": _with(EVENTS, """
SELECT rule_id, step_no, count(ev.ord) AS n_events
FROM (VALUES ('W001', 0, 'error', 0, 0, ''), ('W001', 1, 'purchase', 0, 0, ''),
             ('W002', 0, 'view', 0, 0, ''), ('W002', 1, 'click', 0, 0, ''), ('W002', 2, 'purchase', 0, 0, ''),
             ('W003', 0, 'error', 3, 0, ''), ('W003', 1, 'error', 0, 0.01, ''),
             ('W004', 0, 'signup', 0, 0, ''), ('W004', 1, 'view', 0, 0, 'high,mid'),
             ('W005', 0, 'click', 0, 0, ''), ('W005', 1, 'no_such_type', 0, 0, ''))
     AS s(rule_id, step_no, kind, min_sev, min_conf, tags)
LEFT JOIN ev ON ev.event_type = s.kind AND ev.severity >= s.min_sev AND ev.confidence >= s.min_conf
  AND (s.tags = '' OR contains(s.tags, ev.tag))
GROUP BY rule_id, step_no"""),
}

TRAP = """
tr AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS ord, epoch_us(ts) AS tm,
         CASE event_type WHEN 'signup' THEN 'service_connect' WHEN 'error' THEN 'canary_triggered'
              WHEN 'click' THEN 'file_read' WHEN 'view' THEN 'file_copy' ELSE 'file_delete' END AS action,
         CASE WHEN event_type NOT IN ('purchase', 'view') THEN '10.1.0.' || CAST(user_id AS VARCHAR)
              WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 'local'
              ELSE '/srv/share/' || json_extract_string(props, '$.k') END AS source
  FROM events)"""

SESSIONS = """,
opened AS (
  SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY source ORDER BY tm, ord) <= 7200000000 THEN 0 ELSE 1 END AS opens
  FROM base),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY tm, ord ROWS UNBOUNDED PRECEDING) AS no FROM opened),
named AS (SELECT *, first_value(event_id) OVER (PARTITION BY source, no ORDER BY tm, ord) AS session_id FROM numbered),
sess AS (
  SELECT session_id, source, count(*) AS event_count, string_agg(DISTINCT action, ',' ORDER BY action) AS actions,
         min(tm) AS start_at, max(tm) AS end_at,
         bool_or(action IN ('file_read', 'canary_triggered')) AS p1, bool_or(action IN ('service_connect', 'file_copy')) AS p2,
         bool_or(action IN ('file_copy', 'canary_triggered')) AS p3, bool_or(action = 'service_connect') AS p4
  FROM named GROUP BY session_id, source)"""

ALL_TRAPS = TRAP + ", base AS (SELECT * FROM tr)" + SESSIONS
WAITING = TRAP + ", base AS (SELECT * FROM tr WHERE action <> 'file_read')" + SESSIONS

TRAPS = {
    "trap_sessions": _with(ALL_TRAPS, "SELECT session_id, source, event_count, actions, 'HIGH' AS confidence, start_at, end_at FROM sess"),
    "session_members": _with(ALL_TRAPS, "SELECT event_id, session_id FROM named"),
    "session_patterns": _with(ALL_TRAPS, """
SELECT pattern, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM (
  SELECT 'credential_harvesting' AS pattern, event_count FROM sess WHERE p1
  UNION ALL SELECT 'lateral_movement', event_count FROM sess WHERE p2
  UNION ALL SELECT 'data_exfiltration', event_count FROM sess WHERE p3
  UNION ALL SELECT 'reconnaissance', event_count FROM sess WHERE p4) GROUP BY pattern"""),
    "event_store_dedupe": _with(TRAP, "SELECT action, count(*) AS n, min(ord) AS first_ord FROM tr GROUP BY action"),
    "event_store_insert": _with(TRAP, "SELECT action, count(*) AS n FROM tr WHERE action NOT IN ('file_read', 'file_copy') GROUP BY action"),
    "export_unacked": _with(TRAP, "SELECT event_id, action, tm AS ts_us FROM tr WHERE action <> 'file_read'"),
    "export_acks": _with(WAITING, """
SELECT event_id, session_id FROM named WHERE session_id IN (SELECT session_id FROM sess WHERE event_count > 1)"""),
    "export_counts": _with(WAITING, """
SELECT CAST(coalesce(sum(event_count) FILTER (event_count > 1), 0) AS BIGINT) AS exported, count(*) AS sessions FROM sess"""),
}

FLOWS = """
fl AS (
  SELECT event_id AS ord, epoch_us(ts) AS tm, '10.1.0.' || CAST(user_id % 10 AS VARCHAR) || '->10.0.0.1' AS key,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS port,
         CASE event_type WHEN 'signup' THEN 'BENIGN' WHEN 'error' THEN 'PortScan' WHEN 'click' THEN 'DoS'
              WHEN 'view' THEN 'WebAttack' ELSE 'BruteForce' END AS label,
         least(1.0, value / 100) AS p, value / 50 AS m
  FROM events),
leveled AS (
  SELECT *, CASE WHEN label <> 'BENIGN' AND p >= 0.65 THEN 'CONFIRMED' WHEN label <> 'BENIGN' AND p >= 0.35 THEN 'SUSPECT'
                 WHEN label = 'BENIGN' AND p >= 0.65 THEN 'SUSPECT' ELSE 'NONE' END AS alert_level
  FROM fl),
trig AS (SELECT *, CASE WHEN alert_level = 'CONFIRMED' THEN 1 ELSE 0 END AS conf FROM leveled WHERE alert_level <> 'NONE')"""

GRADED = """,
per_label AS (
  SELECT key, id, label, count(*) AS n, min(tm) AS first_at, arg_min(ord, (tm, ord)) AS first_ord FROM win GROUP BY key, id, label),
tops AS (
  SELECT key, id, string_agg(label || '=' || n, ',' ORDER BY n DESC, first_at, first_ord) FILTER (rn <= 3) AS top_labels,
         string_agg(label || '=' || n, ',' ORDER BY label) AS counts
  FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY n DESC, first_at, first_ord) AS rn FROM per_label)
  GROUP BY key, id),
totals AS (
  SELECT key, id, min(tm) AS start_at, max(tm) AS end_at, count(*) AS n, CAST(sum(conf) AS BIGINT) AS confirmed,
         count(DISTINCT port) AS unique_ports, avg(p) AS avg_p, avg(m) AS avg_m,
         bool_or(label IN ('Infiltration', 'Botnet', 'WebAttack')) AS rare, bool_or(label = 'PortScan') AS scan
  FROM win GROUP BY key, id),
ranked AS (
  SELECT *, n - confirmed AS suspect,
         CASE WHEN confirmed >= 20 THEN 3 WHEN confirmed >= 5 THEN 2 WHEN n - confirmed >= 40 THEN 2
              WHEN n - confirmed >= 15 THEN 1 ELSE 0 END AS r0
  FROM totals),
boosted AS (SELECT *, CASE WHEN rare THEN least(r0 + 1, 3) ELSE r0 END AS r1 FROM ranked),
graded AS (
  SELECT *, CASE WHEN scan AND unique_ports >= 50 THEN greatest(r1, 2) WHEN scan AND unique_ports >= 20 THEN greatest(r1, 1) ELSE r1 END AS r2
  FROM boosted WHERE NOT (scan AND unique_ports < 20 AND r1 <= 1 AND confirmed < 5)),
incident AS (
  SELECT g.*, t.top_labels, t.counts, ['LOW', 'MED', 'HIGH', 'CRITICAL'][r2 + 1] AS severity,
         least(1.0, avg_p + CASE WHEN avg_m > 1.0 THEN 0.15 ELSE 0 END) AS confidence
  FROM graded g JOIN tops t USING (key, id))"""

INCIDENT_COLUMNS = "key, start_at, end_at, severity, top_labels, counts, confirmed, suspect, unique_ports, round(confidence, 10) AS confidence, CASE severity " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in K.INCIDENT_ADVICE.items()) + " END AS recommendation"
TUMBLING = FLOWS + ", win AS (SELECT *, CAST(floor(tm / 21600000000) AS BIGINT) AS id FROM trig)" + GRADED
TRAILING = FLOWS + """, win AS (
  SELECT o.*, t.ord AS id FROM leveled t JOIN trig o ON o.key = t.key AND o.tm BETWEEN t.tm - 21600000000 AND t.tm)""" + GRADED

# Replay alert by alert: ``cleared`` is the last alert a serious incident swept away.
_FIGURES = """count(o.ord) AS n, coalesce(sum(o.conf), 0) AS confirmed, count(DISTINCT o.port) AS ports,
           coalesce(bool_or(o.label IN ('Infiltration', 'Botnet', 'WebAttack')), false) AS rare,
           coalesce(bool_or(o.label = 'PortScan'), false) AS scan"""
_SERIOUS = """n > 0 AND NOT (scan AND ports < 20 AND raised <= 1 AND confirmed < 5)
           AND (raised >= 2 OR (scan AND ports >= 50))"""
STATEFUL = FLOWS + f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY tm, ord) AS rn, alert_level <> 'NONE' AS live,
         CASE WHEN alert_level = 'CONFIRMED' THEN 1 ELSE 0 END AS conf FROM leveled),
replay(key, rn, cleared) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT FROM numbered
  UNION ALL
  SELECT key, rn, CASE WHEN {_SERIOUS} THEN rn ELSE cleared END FROM (
    SELECT *, CASE WHEN rare THEN least(base + 1, 3) ELSE base END AS raised FROM (
      SELECT *, CASE WHEN confirmed >= 20 THEN 3 WHEN confirmed >= 5 THEN 2 WHEN n - confirmed >= 40 THEN 2
                     WHEN n - confirmed >= 15 THEN 1 ELSE 0 END AS base FROM (
        SELECT t.key, t.rn, r.cleared, {_FIGURES}
        FROM replay r JOIN numbered t ON t.key = r.key AND t.rn = r.rn + 1
        LEFT JOIN numbered o ON o.key = t.key AND o.live AND o.rn > r.cleared AND o.rn <= t.rn AND o.tm >= t.tm - 21600000000
        GROUP BY t.key, t.rn, r.cleared)))),
win AS (
  SELECT o.*, t.ord AS id FROM numbered t JOIN replay r ON r.key = t.key AND r.rn = t.rn - 1
  JOIN numbered o ON o.key = t.key AND o.live AND o.rn > r.cleared AND o.rn <= t.rn AND o.tm >= t.tm - 21600000000)""" + GRADED

INCIDENTS = {
    "incidents_stateful": _with("RECURSIVE " + STATEFUL.lstrip(), f"SELECT id AS alert_ord, {INCIDENT_COLUMNS} FROM incident"),
    "incidents_tumbling": _with(TUMBLING, f"SELECT id AS bucket, {INCIDENT_COLUMNS} FROM incident"),
    "incidents_trailing": _with(TRAILING, f"SELECT id AS alert_ord, {INCIDENT_COLUMNS} FROM incident"),
    "incident_top_labels": _with(TUMBLING, """
SELECT severity, label, count(*) AS incidents, CAST(sum(n) AS BIGINT) AS alerts FROM (
  SELECT i.severity, p.label, p.n FROM incident i JOIN per_label p USING (key, id)
  QUALIFY row_number() OVER (PARTITION BY key, id ORDER BY p.n DESC, p.first_at, p.first_ord) <= 3)
GROUP BY severity, label"""),
    "alert_level_histogram": _with(FLOWS, "SELECT alert_level, label, count(*) AS n FROM leveled GROUP BY alert_level, label"),
}

# What each producer's payload must turn into, worked out case by case.
NORMAL = """
src AS (
  SELECT event_id AS ord, event_type AS e, value, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) AS us, (epoch_us(ts) // 1000000) * 1000000 AS whole,
         CAST(least(10, 1 + floor(value / 50)) AS INTEGER) AS sev
  FROM events),
cases AS (
  SELECT ord, e, k,
    CASE e WHEN 'error' THEN 'port_scan' WHEN 'click' THEN 'phishing_detected' WHEN 'view' THEN 'domain_flagged' ELSE e END AS event_type,
    CASE e WHEN 'error' THEN 'network_analysis' WHEN 'click' THEN 'phishing_detector' WHEN 'view' THEN 'url_intel' ELSE 'raw' END AS source,
    CASE e WHEN 'signup' THEN us WHEN 'error' THEN us WHEN 'click' THEN whole - 19800000000
           WHEN 'view' THEN CASE WHEN k % 10 <> 0 THEN whole END ELSE CASE WHEN k >= 10 THEN whole END END AS ts_us,
    CASE e WHEN 'click' THEN 3 WHEN 'view' THEN 3 WHEN 'purchase' THEN k ELSE sev END AS severity,
    CASE e WHEN 'signup' THEN value / 500 WHEN 'error' THEN value / 200 WHEN 'click' THEN CAST('0.' || k AS DOUBLE)
           WHEN 'view' THEN 0.7 ELSE k / 50 END AS confidence,
    CASE WHEN e = 'click' THEN 'delivery' ELSE '' END AS stage,
    CASE e WHEN 'signup' THEN 'a|b|c' WHEN 'click' THEN 'x|y' ELSE '' END AS tags,
    CASE WHEN e = 'error' THEN '10.0.0.' || k ELSE '' END AS src_ip,
    CASE WHEN e = 'error' THEN '10.0.' || (k * 3) || '.1' ELSE '' END AS dst_ip,
    CASE WHEN e = 'view' AND k < 30 THEN '10.9.8.' || k ELSE '' END AS ip,
    CASE e WHEN 'signup' THEN 'host' || k || '.example.com' WHEN 'click' THEN 'evil' || k || '.example.net'
           WHEN 'view' THEN CASE WHEN k < 30 THEN '' WHEN k < 60 THEN 'bad' || k || '.example.org' ELSE 'bad.example.org' END
           WHEN 'purchase' THEN 'web' || k || '.corp.example' ELSE '' END AS domain,
    CASE e WHEN 'signup' THEN 'HTTPS://Host' || k || '.Example.com:8080/p' WHEN 'click' THEN 'http://evil' || k || '.example.net/login'
           WHEN 'view' THEN CASE WHEN k >= 60 THEN 'https://bad.example.org/' || k ELSE '' END ELSE '' END AS url,
    CASE WHEN e IN ('signup', 'purchase') THEN CAST(user_id AS VARCHAR) ELSE '' END AS "user",
    CASE WHEN e = 'purchase' THEN 'web' || k || '.corp.example' ELSE '' END AS host,
    CASE WHEN e = 'click' THEN 'a' || user_id || '@x.org' ELSE '' END AS email_from,
    CASE WHEN e = 'click' THEN 'b@y.org' ELSE '' END AS email_to
  FROM src),
judged AS (
  SELECT *, CASE WHEN e = 'purchase' AND k >= 90 THEN 'unknown kind: mystery'
                 WHEN e = 'view' AND ts_us IS NULL THEN 'missing timestamp'
                 WHEN ts_us IS NULL THEN 'invalid timestamp'
                 WHEN confidence > 1 THEN 'confidence out of range'
                 WHEN severity NOT BETWEEN 1 AND 10 THEN 'severity out of range'
                 WHEN e = 'error' AND k * 3 > 255 THEN 'malformed ip' END AS error
  FROM cases),
strict_ok AS (SELECT * FROM judged WHERE error IS NULL),
lenient_ok AS (
  SELECT * REPLACE (coalesce(ts_us, 1706745600000000) AS ts_us, least(10, greatest(1, severity)) AS severity, least(1.0, confidence) AS confidence,
                    CASE WHEN e = 'error' AND k * 3 > 255 THEN '' ELSE src_ip END AS src_ip,
                    CASE WHEN e = 'error' AND k * 3 > 255 THEN '' ELSE dst_ip END AS dst_ip)
  FROM judged WHERE error IS NULL OR error NOT IN ('unknown kind: mystery', 'invalid timestamp'))"""

EVENT_COLUMNS = """ord, event_type, source, severity, round(confidence, 9) AS confidence, ts_us, stage, tags,
  src_ip, dst_ip, ip, domain, url, "user", host, email_from, email_to"""

REPLAYED = NORMAL + """,
pair AS (
  SELECT s.ord AS o0, s.ts_us AS t0, c.ord AS o1, c.ts_us AS t1, s.confidence AS c0, c.confidence AS c1, c.dst_ip
  FROM strict_ok s JOIN strict_ok c ON c.ts_us BETWEEN s.ts_us AND s.ts_us + 3600000000
  WHERE s.event_type = 'phishing_detected' AND s.confidence >= 0.5 AND c.event_type = 'port_scan'
  QUALIFY row_number() OVER (PARTITION BY s.ord ORDER BY c.ts_us, c.ord) = 1),
kept AS (
  SELECT *, CASE WHEN t0 = t1 THEN greatest(o0, o1) ELSE o1 END AS completion_ord FROM pair
  QUALIFY row_number() OVER (PARTITION BY dst_ip, floor(t0 / 600000000)
                             ORDER BY t1, CASE WHEN t0 = t1 THEN greatest(o0, o1) ELSE o1 END, t0, o0) = 1)"""

NORMALIZE = {
    "normalize_strict": _with(NORMAL, f"SELECT {EVENT_COLUMNS} FROM strict_ok"),
    "normalize_lenient": _with(NORMAL, f"SELECT {EVENT_COLUMNS} FROM lenient_ok"),
    "normalize_rejects": _with(NORMAL, "SELECT ord, error FROM judged WHERE error IS NOT NULL"),
    "normalize_rejects_lenient": _with(NORMAL, "SELECT ord, error FROM judged WHERE error IN ('unknown kind: mystery', 'invalid timestamp')"),
    "adapt_kinds": _with(NORMAL, """
SELECT source, event_type, count(*) AS n, count(*) FILTER (ip <> '') AS ips, count(*) FILTER (url <> '') AS urls,
       count(*) FILTER (domain <> '') AS domains, count(*) FILTER (email_from <> '') AS senders
FROM lenient_ok GROUP BY source, event_type"""),
    "event_contract": _with(NORMAL, "SELECT count(*) AS events, 0 AS violating FROM strict_ok"),
    "replay_counters": _with(REPLAYED, """
SELECT (SELECT count(*) FROM judged) AS total_input, (SELECT count(*) FROM strict_ok) AS normalized_ok,
       (SELECT count(*) FROM judged WHERE error IS NOT NULL) AS normalized_failed, (SELECT count(*) FROM kept) AS alerts_emitted"""),
    "replay_alerts": _with(REPLAYED, """
SELECT 'N001' AS rule_id, o0 AS start_ord, completion_ord, 'entities.dst_ip=' || dst_ip AS key_entity,
       round(0.6 * 0.8 + 0.4 * CASE WHEN c1 > 0 THEN 2 / (1 / c0 + 1 / c1) ELSE c0 END, 9) AS confidence FROM kept"""),
}

# A stream, closed at its end, gives the batch results.
STREAMS = {
    # Windows that end by the watermark: a minute behind the newest alert, in milliseconds.
    "stream_sliding_counts": _with(FLOWS, """
SELECT key, start AS start_us, count(*) AS n, CAST(sum(conf) AS BIGINT) AS confirmed
FROM (SELECT *, (tm // 7200000000 - unnest(range(3))) * 7200000000 AS start FROM trig)
WHERE (start + 21600000000) // 1000 <= (SELECT max(tm) // 1000 - 60000 FROM trig) GROUP BY key, start"""),
    "stream_export_acks": _with(ALL_TRAPS, """
SELECT event_id, session_id FROM named WHERE session_id IN (SELECT session_id FROM sess WHERE event_count > 1)"""),
    "stream_trap_sessions": TRAPS["trap_sessions"],
    "stream_incidents_stateful": INCIDENTS["incidents_stateful"],
    "stream_event_dedupe": _with(TRAP, "SELECT action, count(*) AS n FROM tr GROUP BY action"),
    "stream_sequence_alerts": CORRELATION["alert_dedupe"],
}

ORACLE: dict[str, str] = {**CORRELATION, **TRAPS, **INCIDENTS, **NORMALIZE, **FLOW_ORACLE, **STREAMS}
