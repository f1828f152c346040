"""Normalisation cases, adapters and a replay of the golden events from a file."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from threatweave.functions.raw import with_fields
from threatweave.operators.adapt import adapt_events
from threatweave.operators.normalize import contract_violations, normalize_events, split_rejects
from threatweave.plans.correlate import correlate
from threatweave.sources.events import read_events, write_alerts

# Golden records and the two rules whose alerts the results have to equal.
GOLDEN = [
    {"event_type": "phishing_detected", "timestamp": "2026-02-08T09:00:00Z", "user": "alice", "domain": "evil.com", "severity": 6, "confidence": 0.90},
    {"event_type": "malware_download", "timestamp": "2026-02-08T09:20:00Z", "user": "alice", "domain": "evil.com", "severity": 7, "confidence": 0.80},
    {"event_type": "port_scan", "timestamp": "2026-02-08T10:00:00Z", "src_ip": "192.168.1.50", "dst_ip": "10.0.0.5", "severity": 4, "confidence": 0.75},
    {"event_type": "exploit_attempt", "timestamp": "2026-02-08T10:10:00Z", "src_ip": "192.168.1.50", "dst_ip": "10.0.0.5", "severity": 9, "confidence": 0.90},
    {"event_type": "phishing_detected", "timestamp": "2026-02-08T11:00:00Z", "user": "bob", "domain": "maybe-benign.com", "severity": 2, "confidence": 0.40},
    {"event_type": "malware_download", "timestamp": "2026-02-08T13:30:00Z", "user": "bob", "domain": "maybe-benign.com", "severity": 3, "confidence": 0.60},
]
RULES = {
    "rules": [
        {"id": "R001", "name": "phishing_then_download", "severity": "high", "confidence": 0.85, "max_span": "2h",
         "sequence": [{"event_type": "phishing_detected", "where": {"min_confidence": 0.60}},
                      {"event_type": "malware_download", "within": "1h", "same": ["entities.user", "entities.domain"]}]},
        {"id": "R002", "name": "scan_then_exploit", "severity": "critical", "confidence": 0.90, "max_span": "1h",
         "sequence": [{"event_type": "port_scan", "where": {"min_severity": 3}},
                      {"event_type": "exploit_attempt", "within": "30m", "same": ["entities.dst_ip"]}]},
    ]
}


def rows(spark, records, kind=None, **kw):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r), kind) for i, r in enumerate(records)], "ord bigint, raw string, kind string")
    if kind:
        df = adapt_events(with_fields(df))
    return normalize_events(df, **kw).orderBy("ord").collect()


def test_aliases_and_types(spark):
    base = {"type": "x", "time": 1760000000}
    got = rows(spark, [
        {**base, "source_ip": " 10.0.0.1 ", "dest_ip": "10.0.0.2", "score": 0.7},
        {"name": "y", "ts": "2026-02-08T08:00:00+05:30", "indicator_ip": "1.2.3.4", "tags": "osint, blocklist"},
        {"type": "z", "time": "2026-02-08", "from": "a@b.c", "to": "d@e.f", "url": "https://Evil.com:81/x", "severity": 6.9, "tags": ["a", " ", 5]},
        {"is_phishing": True, "timestamp": "2026-02-08 08:00:00", "severity": "7", "confidence": "0.5"},
    ])
    assert all(r.error is None for r in got)
    assert (got[0].entities.src_ip, got[0].entities.dst_ip, got[0].confidence, got[0].severity, got[0].source) == ("10.0.0.1", "10.0.0.2", 0.7, 3, "replay")
    assert got[1].entities.ip == "1.2.3.4" and got[1].tags == ["osint", "blocklist"] and got[1].ts == dt.datetime(2026, 2, 8, 2, 30)
    assert got[2].entities.domain == "evil.com" and got[2].severity == 6 and got[2].tags == ["a", "5"] and got[2].entities.email_to == "d@e.f"
    assert got[3].event_type == "phishing_detected" and got[3].severity == 7 and got[3].confidence == 0.5
    assert len(got[0].event_id) >= 8 and len({r.event_id for r in got}) == 4


OK = {"event_type": "x", "timestamp": "2026-02-08T08:00:00Z"}


@pytest.mark.parametrize("record,error", [
    ({"event_type": "x"}, "missing timestamp"), ({**OK, "src_ip": "999.1.1.1"}, "malformed ip"), ({**OK, "confidence": 1.5}, "confidence out of range"),
    ({**OK, "severity": 11}, "severity out of range"), ({**OK, "severity": "3.7"}, "invalid severity"), ({**OK, "confidence": "high"}, "invalid confidence"),
    ({"timestamp": "2026-02-08"}, "missing event_type"), ({**OK, "timestamp": "soon"}, "invalid timestamp"), ({**OK, "timestamp": "1760000000"}, "invalid timestamp"),
    ({**OK, "event_type": "  "}, "blank event_type"), ("[1]", "not a JSON object"), ("{oops", "not a JSON object"),
])
def test_strict_errors(spark, record, error):
    assert rows(spark, [record])[0].error == error


def test_repeated_keys_and_basic_dates(spark):
    got = rows(spark, ['{"event_type": "a", "event_type": "b", "time": "20260208T080000Z"}', {"type": "c", "ts": "20260208"},
                       {"type": "d", "ts": "20260208T080000+0530", "event_type": None, "category": ""}])
    assert [(r.error, r.event_type) for r in got] == [(None, "b"), (None, "c"), (None, "d")]
    assert [r.ts for r in got] == [dt.datetime(2026, 2, 8, 8), dt.datetime(2026, 2, 8), dt.datetime(2026, 2, 8, 2, 30)]


def test_event_ids_by_named_columns(spark):
    df = spark.createDataFrame([(1, json.dumps(OK), "f1"), (2, json.dumps(OK), "f1"), (3, json.dumps(OK), "f2")], "ord bigint, raw string, file string")
    ids = [r.event_id for r in normalize_events(df, id_columns=("file",)).orderBy("ord").collect()]
    assert ids[0] == ids[1] != ids[2]


def test_lenient_repairs(spark):
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    r = rows(spark, [{"event_type": "x", "src_ip": "bad", "dst_ip": "10.0.0.1", "confidence": 99, "severity": 99, "url": "http://a.com/x"}], strict=False, now=now)[0]
    assert r.error is None and r.confidence == 1.0 and r.severity == 10 and r.ts.year == 2023
    # One bad address empties all three and the domain is not taken from the URL.
    assert (r.entities.src_ip, r.entities.dst_ip, r.entities.domain, r.entities.url) == (None, None, None, "http://a.com/x")
    assert rows(spark, [{"event_type": "x", "timestamp": "soon"}], strict=False)[0].error == "invalid timestamp"


def test_normalised_rows_pass_through(spark):
    done = {"event_id": "id", "timestamp": "2026-02-08T08:00:00Z", "event_type": "x", "source": "s", "entities": {"user": "u"}, "severity": 42, "confidence": 3.5, "raw": {}}
    r = rows(spark, [done])[0]
    assert (r.error, r.event_id, r.severity, r.confidence, r.entities.user) == (None, "id", 42, 3.5, "u")
    df = normalize_events(spark.createDataFrame([(0, json.dumps(done))], "ord bigint, raw string"))
    assert contract_violations(df).first().violations == ["event_id", "severity", "confidence"]


def test_adapters(spark):
    n = rows(spark, [{"alert_type": "", "type": "ddos", "ts": 5, "score": 0.2}], "network", source=None)[0]
    assert (n.event_type, n.source, n.confidence) == ("ddos", "network_analysis", 0.2)
    p = rows(spark, [{"is_phishing": "true", "time": "2026-01-01", "sender": "a@b.c", "link": "http://x.org/"}], "phishing", source=None)[0]
    assert (p.event_type, p.entities.email_from, p.entities.domain) == ("phishing_alert", "a@b.c", "x.org")
    u = rows(spark, [{"indicator": i, "time": "2026-01-01"} for i in ("https://q.org/1", "bad.org", "10.0.0.9")], "url_intel", source=None)
    assert [r.event_type for r in u] == ["intel_indicator"] * 3
    assert (u[0].entities.url, u[1].entities.domain, u[2].entities.ip) == ("https://q.org/1", "bad.org", "10.0.0.9")
    assert rows(spark, [OK], "other", source=None)[0].error == "unknown kind: other"
    assert rows(spark, [OK], "raw", source=None)[0].source == "raw"


def test_golden_replay_from_file(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(json.dumps(e) for e in GOLDEN) + "\n\n  \n{broken\n")
    good, rejects = read_events(spark, str(path))
    assert rejects.count() == 1
    events, bad = split_rejects(normalize_events(good))
    assert bad.count() == 0
    alerts = correlate(events, RULES)
    write_alerts(alerts, str(tmp_path / "out"))
    write_alerts(alerts, str(tmp_path / "out"), "append")
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 4
    found = {r.rule_id: r for r in back.collect()}
    assert set(found) == {"R001", "R002"}
    assert found["R001"].confidence == pytest.approx(0.848824, abs=1e-6) and found["R001"].severity_score == 7
    assert found["R002"].confidence == pytest.approx(0.867273, abs=1e-6) and found["R002"].severity_score == 9
    assert found["R001"].key_entity == "entities.domain=evil.com" and found["R002"].key_entity == "entities.dst_ip=10.0.0.5"


def test_repeated_key_in_a_plain_session(spark, tmp_path):
    """The last value counts, in sessions that were made without the library's settings too."""
    (tmp_path / "e.jsonl").write_text('{"event_type": "a", "event_type": "b", "timestamp": 1760000000}\n[1]\n')
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    good, rejects = read_events(spark, str(tmp_path))
    assert [r.event_type for r in normalize_events(good).collect()] == ["b"] and rejects.count() == 1
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "true"


def test_replay_normalises_once(spark):
    from threatweave.plans import tables as T
    from threatweave.plans.catalog import NORMALIZE
    for name in ("replay_alerts", "replay_counters"):
        plan = NORMALIZE[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "parse_json" not in plan.lower()
    assert NORMALIZE["replay_counters"](spark, "/root/testdata/sf0.001").first().total_input == T.raw_events(spark, "/root/testdata/sf0.001").count()
