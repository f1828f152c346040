"""Sequence matching and alerts against a sequential model and known cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threatweave.functions.fixed import ENTITY_FIELDS, KEY_ENTITY_PREFERENCE
from threatweave.operators import sequence
from threatweave.operators.alerts import build_alerts
from threatweave.operators.rules import lint_rules, rule_tables
from threatweave.operators.sequence import match_sequences
from threatweave.plans.correlate import correlate

ENT = ", ".join(f"{f}: string" for f in ENTITY_FIELDS)
SCHEMA = (
    "event_id string, ord bigint, ts timestamp, event_type string, source string, severity int, "
    f"confidence double, tags array<string>, entities struct<{ENT}>"
)
T0 = dt.datetime(2026, 2, 8, 10, tzinfo=dt.timezone.utc)


def event(ord_, kind, seconds, conf=0.9, sev=5, tags=(), **entities):
    return (
        f"E{ord_}", ord_, T0 + dt.timedelta(seconds=seconds), kind, "t", sev, conf, list(tags),
        {f: entities.get(f) for f in ENTITY_FIELDS},
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rule(steps, rid="R01", **kw):
    return {"id": rid, "name": rid, "severity": "high", "confidence": 0.8, "sequence": steps, **kw}


def seconds(text):
    return None if text is None else int(text[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[text[-1]]


def model(rows, rules, retention=6 * 3600, bucket=600):
    """One event after the other, as plain loops: (all chains, alerts after dedupe)."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))

    def fits(e, s):
        w = s.get("where", {})
        if e[3] != s["event_type"] or e[6] < w.get("min_confidence", -1) or e[5] < w.get("min_severity", -1):
            return False
        return not w.get("tag_any") or bool(set(w["tag_any"]) & set(e[7]))

    def shares(a, b, same):
        pairs = [(a[8][p.split(".")[1]], b[8][p.split(".")[1]]) for p in same]
        return not same or any(x and x.strip() and x == y for x, y in pairs)

    chains = set()
    for r in rules:
        if not r.get("enabled", True) or len(r["sequence"]) < 2:
            continue
        for start in rows:
            if not fits(start, r["sequence"][0]):
                continue
            chain = [start]
            for s in r["sequence"][1:]:
                prev = chain[-1]
                end = start[2] + dt.timedelta(seconds=min(retention, seconds(r.get("max_span")) or retention))
                if s.get("within"):
                    end = min(end, prev[2] + dt.timedelta(seconds=seconds(s["within"])))
                hit = next((e for e in rows if prev[2] <= e[2] <= end and fits(e, s) and shares(prev, e, s.get("same", []))), None)
                if hit is None:
                    break
                chain.append(hit)
            else:
                chains.add((r["id"], tuple(e[1] for e in chain)))
    by_ord = {r[1]: r for r in rows}

    def key(chain):
        for f in KEY_ENTITY_PREFERENCE:
            for o in chain:
                v = by_ord[o][8][f]
                if v and v.strip():
                    return f"entities.{f}={v}"
        return "no_key_entity"

    def order(c):
        last = by_ord[c[1][-1]][2]
        return last, max(o for o in c[1] if by_ord[o][2] == last), by_ord[c[1][0]][2], c[1][0]

    seen, alerts = set(), set()
    for c in sorted(chains, key=order):
        sig = (c[0], key(c[1]), int(by_ord[c[1][0]][2].timestamp()) // bucket)
        if sig not in seen:
            seen.add(sig)
            alerts.add(c)
    return chains, alerts


RULES = [
    rule([{"event_type": "a"}, {"event_type": "b", "within": "60s", "same": ["entities.user"]}], "AB"),
    rule([{"event_type": "a"}, {"event_type": "a", "within": "30s", "same": ["entities.user", "entities.ip"]}], "AA"),
    rule(
        [{"event_type": "a"}, {"event_type": "b", "within": "90s", "same": ["entities.user", "entities.ip"]},
         {"event_type": "c", "within": "5m", "same": ["entities.ip"], "where": {"min_severity": 4}}],
        "ABC", max_span="3m",
    ),
    rule([{"event_type": "c", "where": {"tag_any": ["x", "y"]}}, {"event_type": "b", "where": {"min_confidence": 0.5}}], "CB", max_span="20s"),
    rule([{"event_type": "b"}, {"event_type": "c", "same": ["entities.host"]}], "BC"),
]


@pytest.mark.parametrize("seed,slice_s", [(1, 60), (2, 7), (3, 1)])
def test_random_events_match_model(spark, monkeypatch, seed, slice_s):
    monkeypatch.setattr(sequence, "SLICE_US", slice_s * 1_000_000)
    rnd = random.Random(seed)
    rows = []
    for i in range(260):
        # Few instants, so there are ties, exact gaps and self matches.
        at = rnd.randrange(0, 1500) if i % 20 else rnd.randrange(0, 60_000)
        rows.append(event(
            i, rnd.choice("abc"), at, conf=rnd.choice([0.0, 0.3, 0.5, 0.9]), sev=rnd.randrange(1, 9), tags=rnd.sample(["x", "z"], rnd.randrange(0, 2)),
            user=rnd.choice(["u1", "u2", "", " ", None]), ip=rnd.choice(["1.1.1.1", "2.2.2.2", None]), host=rnd.choice(["h", None]),
        ))
    events = frame(spark, rows)
    rules, steps = rule_tables(spark, {"rules": RULES})
    chains = match_sequences(events, rules, steps)
    want, alerts = model(rows, RULES)
    assert {(r.rule_id, tuple(r.ords)) for r in chains.collect()} == want
    found = build_alerts(chains, events, rules, steps).select("rule_id", "event_ids").collect()
    assert {(r.rule_id, tuple(int(e[1:]) for e in r.event_ids)) for r in found} == alerts


def test_hot_entity_matches_model(spark):
    """One value holds nearly all events, many at the same instant."""
    rows = [event(i, "ab"[i % 3 == 0], (i // 40) * 13, user="hot") for i in range(600)]
    rows += [event(1000 + i, "ab"[i % 2], i * 11, user=f"u{i % 5}") for i in range(50)]
    rules, steps = rule_tables(spark, {"rules": RULES[:2]})
    got = match_sequences(frame(spark, rows), rules, steps).collect()
    assert {(r.rule_id, tuple(r.ords)) for r in got} == model(rows, RULES[:2])[0]


def alerts_of(spark, rows, *rules):
    return correlate(frame(spark, rows), {"rules": list(rules)}).collect()


SCAN = rule([{"event_type": "a"}, {"event_type": "b", "within": "30m", "same": ["entities.dst_ip"]}], max_span="1h")


def test_window_edges(spark):
    assert len(alerts_of(spark, [event(1, "a", 0, dst_ip="x"), event(2, "b", 1800, dst_ip="x")], SCAN)) == 1
    assert alerts_of(spark, [event(1, "a", 0, dst_ip="x"), event(2, "b", 1801, dst_ip="x")], SCAN) == []


def test_retention_edge(spark):
    free = rule([{"event_type": "a"}, {"event_type": "b"}])
    assert len(alerts_of(spark, [event(1, "a", 0), event(2, "b", 21600)], free)) == 1
    assert alerts_of(spark, [event(1, "a", 0), event(2, "b", 21601)], free) == []


def test_later_repeat_raises_no_second_alert(spark):
    rows = [event(1, "a", 0, dst_ip="x"), event(2, "b", 300, dst_ip="x"), event(3, "b", 360, dst_ip="x")]
    found = alerts_of(spark, rows, SCAN)
    assert [a.event_ids for a in found] == [["E1", "E2"]]
    assert len(found[0].explanation.steps) == 2 and found[0].explanation.steps[1].seconds_from_prev == 300


def test_disabled_and_single_step_rules_are_silent(spark):
    rows = [event(1, "a", 0, dst_ip="x"), event(2, "b", 1, dst_ip="x")]
    assert alerts_of(spark, rows, {**SCAN, "enabled": False}) == []
    assert alerts_of(spark, rows, rule([{"event_type": "a"}])) == []


def test_score_bump_and_notes(spark):
    rows = [event(1, "a", 0, conf=0.2, sev=9, dst_ip="x"), event(2, "b", 1, conf=0.0, sev=8, dst_ip="x")]
    a = alerts_of(spark, rows, SCAN)[0]
    assert a.severity == "high" and a.severity_score == 8
    assert a.confidence == pytest.approx(0.6 * 0.8 + 0.4 * 0.2)
    assert [n.split()[0] for n in a.scoring_notes] == ["Evidence", "Severity"]
    assert a.matched_entities == {"dst_ip": "x"} and a.key_entity == "entities.dst_ip=x"


def test_lint(spark):
    bad = {**SCAN, "confidence": 0.3, "max_span": "10m"}
    rules, steps = rule_tables(spark, {"rules": [bad, {**SCAN, "sequence": [{"event_type": "a", "within": "1m"}, {"event_type": "q"}]}]})
    issues = {(r.level, r.issue) for r in lint_rules(frame(spark, [event(1, "a", 0), event(2, "b", 0)]), rules, steps).collect()}
    assert ("error", "duplicate_id") in issues
    assert {"within_on_first_step", "within_exceeds_max_span", "low_confidence"} <= {i for _, i in issues}


def test_lint_tells_every_repeat(spark):
    once = {**SCAN, "sequence": [{"event_type": "zz", "within": "1m"}]}
    rules, steps = rule_tables(spark, {"rules": [SCAN, SCAN, once]})
    issues = sorted((r.rule_id, r.step_no, r.issue) for r in lint_rules(frame(spark, [event(1, "a", 0), event(2, "b", 0)]), rules, steps).collect())
    # A window on the only step of a rule is no issue; its step that nothing meets is its own.
    assert issues == [("R01", -1, "duplicate_id")] * 2 + [("R01", 0, "step_never_met")]
