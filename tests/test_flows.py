"""Incidents, sessions, the event store, labels, features and model helpers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threatweave.operators import features, incidents as I
from threatweave.operators import labels as L
from threatweave.operators import sessions as S
from threatweave.operators import splits as G
from threatweave.operators import store
from threatweave.operators.gates import predict_with_thresholds
from threatweave.plans import traps

FLOW = "ts double, ord bigint, src_ip string, dst_ip string, dst_port int, label string, alert_level string, p_attack double, margin double"


def flow(i, at, label="DoS", level="CONFIRMED", port=80, p=0.5, m=0.5, src="s"):
    return (float(at), i, src, "d", port, label, level, p, m)


def one(spark, rows, mode="tumbling"):
    return I.incidents(spark.createDataFrame(rows, FLOW), "30s", mode).collect()


@pytest.mark.parametrize("n,level,severity", [
    (4, "CONFIRMED", "LOW"), (5, "CONFIRMED", "HIGH"), (19, "CONFIRMED", "HIGH"), (20, "CONFIRMED", "CRITICAL"),
    (14, "SUSPECT", "LOW"), (15, "SUSPECT", "MED"), (39, "SUSPECT", "MED"), (40, "SUSPECT", "HIGH"),
])
def test_severity_ladder(spark, n, level, severity):
    assert one(spark, [flow(i, 1, level=level) for i in range(n)])[0].severity == severity


@pytest.mark.parametrize("ports,severity", [(19, None), (20, "MED"), (39, "MED"), (50, "HIGH")])
def test_port_scan(spark, ports, severity):
    # 15 to 39 suspects are MED, too weak below 20 ports.
    got = one(spark, [flow(i, 1, "PortScan", "SUSPECT", port=i) for i in range(ports)])
    assert [r.severity for r in got] == ([severity] if severity else [])


def test_rare_label_raises_one_level_up_to_critical(spark):
    assert one(spark, [flow(1, 1, "Botnet", "SUSPECT")])[0].severity == "MED"
    assert one(spark, [flow(i, 1, "Botnet") for i in range(20)])[0].severity == "CRITICAL"


def sequential(rows, clear):
    """Plain replay: window by key, optionally emptied by a serious incident."""
    out, held = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        # An alert of level NONE expires and reads the window, but does not join it.
        buf = [x for x in held.get(r[2], []) if x[0] >= r[0] - 30] + [r] * (r[6] != "NONE")
        held[r[2]] = buf
        if not buf:
            continue
        conf = sum(x[6] == "CONFIRMED" for x in buf)
        susp = len(buf) - conf
        sev = 3 if conf >= 20 else 2 if conf >= 5 or susp >= 40 else 1 if susp >= 15 else 0
        names, ports = [x[5] for x in buf], len({x[4] for x in buf})
        if {"Infiltration", "Botnet", "WebAttack"} & set(names):
            sev = min(sev + 1, 3)
        weak = "PortScan" in names and ports < 20 and sev <= 1 and conf < 5
        if "PortScan" in names:
            sev = max(sev, 2 if ports >= 50 else 1 if ports >= 20 else 0)
        held[r[2]] = buf
        if weak:
            continue
        first = {}
        for i, n in enumerate(names):
            first.setdefault(n, i)
        top = sorted(first, key=lambda n: (-names.count(n), first[n]))[:3]
        p, m = sum(x[7] for x in buf) / len(buf), sum(x[8] for x in buf) / len(buf)
        out[r[1]] = (I.INCIDENT_LEVELS[sev], tuple((n, names.count(n)) for n in top), conf, susp, ports, round(min(1, p + 0.15 * (m > 1)), 6))
        if clear and sev >= 2:
            held[r[2]] = []
    return out


def random_flows(seed, n=500):
    rnd = random.Random(seed)
    kinds = ["DoS", "PortScan", "DDoS", "BruteForce", "Botnet"]
    # Distinct instants: rows of one instant share a trailing window.
    times = rnd.sample(range(0, 40_000), n)
    return [
        flow(i, t / 10, rnd.choice(kinds[: 4 + (t % 7 == 0)]), rnd.choice(["NONE", "SUSPECT", "SUSPECT", "CONFIRMED"]), rnd.randrange(40), rnd.random(), rnd.random() * 2, rnd.choice(["hot"] * 6 + ["s1", "s2"]))
        for i, t in enumerate(times)
    ]


@pytest.mark.parametrize("mode", ["trailing", "stateful"])
def test_windows_match_sequential_replay(spark, mode):
    rows = random_flows(5)
    got = {
        r.alert_ord: (r.severity, tuple((t.label, t.n) for t in r.top_labels), r.confirmed, r.suspect, r.unique_ports, round(r.confidence, 6))
        for r in one(spark, rows, mode)
    }
    assert got == sequential(rows, mode == "stateful")


def test_arrival_without_level_reads_the_window(spark):
    rows = [flow(1, 0, "PortScan", "SUSPECT"), flow(2, 20, "DoS", "SUSPECT"), flow(3, 35, "DoS", "NONE"), flow(4, 90, "DoS", "NONE")]
    for mode in ("trailing", "stateful"):
        got = [(r.alert_ord, r.severity, r.start_at, r.end_at) for r in one(spark, rows, mode)]
        assert got == [(3, "LOW", 20_000_000, 20_000_000)]


def test_window_edge_is_inclusive(spark):
    rows = [flow(1, 0.0), flow(2, 30.0), flow(3, 60.000001)]
    assert {r.alert_ord: r.confirmed for r in one(spark, rows, "trailing")} == {1: 1, 2: 2, 3: 1}


TRAP = "event_id string, ord bigint, action string, source struct<remote_ip: string, file_path: string>, ts timestamp"
T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def trap(i, at, action="file_read", ip="1.1.1.1", path=None):
    return (f"e{i}", i, action, (ip, path), T0 + dt.timedelta(seconds=at))


def sessions(spark, rows, gap="300s"):
    return S.trap_sessions(spark.createDataFrame(rows, TRAP), gap).orderBy("start_time").collect()


def test_sessions(spark):
    assert [r.event_count for r in sessions(spark, [trap(1, 0)])] == [1]
    assert [r.event_count for r in sessions(spark, [trap(1, 0), trap(2, 120)])] == [2]
    assert len(sessions(spark, [trap(1, 0), trap(2, 300)], "60s")) == 2
    assert len(sessions(spark, [trap(1, 299), trap(2, 599)])) == 1
    assert len(sessions(spark, [trap(1, 299), trap(2, 599.000001)])) == 2
    assert len(sessions(spark, [trap(1, 0), trap(2, 1, ip="2.2.2.2")])) == 2
    s = sessions(spark, [trap(1, 0), trap(2, 1, "canary_triggered")])[0]
    assert s.attack_patterns == ["credential_harvesting", "data_exfiltration"] and s.confidence == "HIGH" and s.session_id == "e1"
    s = sessions(spark, [trap(1, 0, "service_connect"), trap(2, 1, "file_copy")])[0]
    assert "lateral_movement" in s.attack_patterns and "reconnaissance" in s.attack_patterns
    assert {r.source for r in sessions(spark, [trap(1, 0, ip="", path="/f"), trap(2, 0, ip=None)])} == {"/f", "local"}


def test_store_and_export(spark):
    ev = spark.createDataFrame([trap(1, 0), trap(2, 10), trap(3, 9000), (*trap(1, 5)[:1], 9, "late", ("9.9.9.9", None), T0)], TRAP)
    kept = store.dedupe_events(ev)
    assert {(r.event_id, r.ord) for r in kept.collect()} == {("e1", 1), ("e2", 2), ("e3", 3)}
    acks = spark.createDataFrame([], "event_id string, session_id string")
    done, counts = traps.export_cycle(ev, acks, traps.accept_some)
    assert {r.event_id for r in done.collect()} == {"e1", "e2"}
    assert counts.first().asDict() == {"exported": 2, "sessions": 2}
    again, counts = traps.export_cycle(ev, done, traps.accept_some)
    assert counts.first().asDict() == {"exported": 0, "sessions": 1}


def test_labels(spark):
    raw = ["Benign", " BENIGN ", "DoS Hulk", "DoS other", "FTP-Patator", "Bot", "Botnet", "Web Attack – XSS", "Web Attack � Sql Injection", "WebAttack- Brute Force", "Web Attack - other", "Unknown", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "i int, s string")
    rows = df.select(L.canonical_label("s", "strict").alias("a"), L.canonical_label("s").alias("b"), "i").orderBy("i").collect()
    assert [r.a for r in rows] == ["BENIGN", "BENIGN", "DoS", None, "BruteForce", "Botnet", None, "WebAttack", "WebAttack", "WebAttack", "WebAttack", None, None]
    assert [r.b for r in rows] == ["BENIGN", "BENIGN", "DoS", "DoS", "BruteForce", "Botnet", "Botnet", "WebAttack", "WebAttack", "WebAttack", "WebAttack", "Unknown", "None"]


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_exact_median(spark, monkeypatch, small):
    monkeypatch.setattr(features, "SMALL", small)
    rnd = random.Random(3)
    rows = [(rnd.random() * 100, float(rnd.choice([1, 1, 1, 2, 9])), rnd.choice([None, float("nan"), float("inf"), float(i)])) for i in range(1001)]
    got = features.exact_medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 50)
    import statistics
    for n, k in enumerate("abc"):
        vals = [r[n] for r in rows if r[n] is not None and abs(r[n]) != float("inf") and r[n] == r[n]]
        assert got[k] == pytest.approx(statistics.median(vals))


def test_quota_split_is_exact(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "DoS").otherwise("BENIGN").alias("label"))
    out = G.quota_split(df, "label", "id", min_train={"DoS": 90}).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in out} == {
        ("BENIGN", "test"): 980, ("BENIGN", "val"): 735, ("BENIGN", "train"): 3185, ("DoS", "val"): 10, ("DoS", "train"): 90,
    }


def test_thresholded_prediction(spark):
    df = spark.createDataFrame([([0.4, 0.3, 0.35],), ([0.1, 0.2, 0.2],), ([0.6, 0.9, 0.3],)], "s array<double>")
    assert [r[0] for r in df.select(predict_with_thresholds(F.col("s"), [0.5, 0.3, 0.3])).collect()] == [2, 1, 1]
