"""Emit and clear by composed steps against a replay alert by alert."""

import random

import pytest

from threatweave.operators import clearing
from threatweave.operators import incidents as I

ALERTS = "key string, at bigint, ord bigint, label string, port int, conf bigint, p double, m double, live boolean"
WIDTH = 3_000


def alerts(seed, n, suspects=0.5, rare=0.1, pace=40, keys=("hot", "hot", "hot", "a", "b")):
    """Bursts and pauses, ties, exact edges, readers; one key has more than half of all."""
    rng = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 0, 1, pace, pace, pace, WIDTH if rng.random() < 0.1 else 2, 9 * WIDTH if rng.random() < 0.02 else 3])
        live = rng.random() < 0.85
        label = rng.choice(["Botnet", "Infiltration"]) if rng.random() < rare else rng.choice(["DoS", "DDoS", "PortScan"])
        port = None if rng.random() < 0.1 else rng.randrange(400)
        conf = int(live and rng.random() > suspects)
        out.append((rng.choice(keys), at, i, label, port, conf, round(rng.random(), 3), round(2 * rng.random(), 3), live))
    return out


def replay(rows):
    held, out = {}, {}
    for key, at, ord_, *rest in sorted(rows, key=lambda r: (r[1], r[2])):
        made = held.setdefault(key, I.WindowState(WIDTH)).push(at, *rest)
        if made:
            out[ord_] = (key, made["start_at"], made["end_at"], made["severity"], tuple((t["label"], t["n"]) for t in made["top_labels"]),
                         tuple(sorted(made["counts"].items())), made["confirmed"], made["suspect"], made["unique_ports"],
                         round(made["confidence"], 6), made["recommendation"])
    return out


def windows(spark, rows):
    made = I.to_incidents(clearing.cleared_windows(spark.createDataFrame(rows, ALERTS).repartition(3), WIDTH), "alert_ord").collect()
    got = {r.alert_ord: (r.key, r.start_at, r.end_at, r.severity, tuple((t.label, t.n) for t in r.top_labels), tuple(sorted(r.counts.items())),
                         r.confirmed, r.suspect, r.unique_ports, round(r.confidence, 6), r.recommendation) for r in made}
    assert len(got) == len(made)
    return got


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
@pytest.mark.parametrize("kind", [dict(), dict(suspects=1.0, rare=0.0), dict(suspects=0.97, rare=0.04), dict(pace=1, suspects=0.9)])
def test_equals_the_replay(spark, monkeypatch, block, kind):
    monkeypatch.setattr(clearing, "BLOCK", block)
    rows = alerts(block + len(kind), 700, **kind)
    want = replay(rows)
    assert sum(v[3] in ("HIGH", "CRITICAL") for v in want.values()) > 1
    assert windows(spark, rows) == want


def test_many_clears_in_one_instant(spark, monkeypatch):
    monkeypatch.setattr(clearing, "BLOCK", 16)
    rows = [("k", 5 + (i > 180), i, "DoS", i % 70, 1, 0.5, 0.5, True) for i in range(200)]
    got = windows(spark, rows)
    assert got == replay(rows) and sum(v[3] == "HIGH" for v in got.values()) == 40


def test_scan_of_fifty_ports_clears_by_number_first(spark):
    rows = [("k", 10 * i, i, "PortScan", i, 0, 0.5, 0.5, True) for i in range(120)]
    got = windows(spark, rows)
    assert got == replay(rows) and {v[8] for v in got.values() if v[3] == "HIGH"} == {40}


def test_awkward_rows(spark):
    assert windows(spark, []) == {}
    rows = [("k", 0, 1, "DoS", None, 0, 0.1, 0.1, False), (None, 0, 2, "DoS", 1, 1, 0.1, 0.1, True), ("k", None, 3, "DoS", 1, 1, 0.1, 0.1, True)]
    assert windows(spark, rows) == {}
    rows += [("k", -WIDTH, 4, "DoS", None, 1, 0.1, 0.1, True), ("k", -WIDTH - 1, 5, "DoS", None, 1, 0.1, 0.1, True)]
    assert {k: (v[1], v[2], v[6]) for k, v in windows(spark, rows).items()} == {
        5: (-WIDTH - 1, -WIDTH - 1, 1), 4: (-WIDTH - 1, -WIDTH, 2), 1: (-WIDTH, -WIDTH, 1)}
