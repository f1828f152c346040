"""Streams forget: what a batch reads stays the same however old the stream is."""

import datetime as dt

from pyspark.sql import functions as F

from threatweave.functions.fixed import ENTITY_FIELDS
from threatweave.plans import correlate as C
from threatweave.session import local_table
from threatweave.streaming import correlate as SC
from threatweave.streaming.batches import batch_ids
from threatweave.streaming.retention import RetentionLog

HOUR = 3_600_000_000


def test_fifty_batches_read_no_more_than_ten(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = RetentionLog(spark, folder, "v bigint, at bigint", "at", 3 * HOUR)

    def step(i, rows):
        held = log.before(i)
        seen = sorted(map(tuple, log.read(held).collect()))
        _, lo, hi = log.append(local_table(spark, rows, "v bigint, at bigint"), i)
        log.commit(held, i, lo, hi)
        return seen, len(held.kept)

    reads = []
    for i in range(50):
        # Every batch has an hour; each tenth one is empty, each seventh has one row that comes late.
        rows = [] if i % 10 == 9 else [(i, i * HOUR), (i, i * HOUR + HOUR // 2)] + [(-i, (i - 2) * HOUR)] * (i % 7 == 0)
        seen, kept = step(i, rows)
        reads.append(kept)
        assert kept == len({v for v, _ in seen if v >= 0} | {-v for v, _ in seen if v < 0})
    assert max(reads[10:]) <= 5 and len(batch_ids(spark, folder)) <= 7 and len(batch_ids(spark, f"{folder}/_marks")) <= 3
    # A batch that runs again sees what it saw, and leaves what it left.
    again = [(48, 48 * HOUR), (48, 48 * HOUR + HOUR // 2)]
    first, before = step(50, again), batch_ids(spark, folder)
    assert step(50, again) == first and batch_ids(spark, folder) == before
    assert [v for v, _ in log.read(log.before(51), 48 * HOUR).orderBy("at", "v").collect()] == [48, 48, 48, 48]


def test_old_batches_do_not_move_the_mark_back(spark, tmp_path):
    log = RetentionLog(spark, str(tmp_path / "log"), "at bigint", "at", 10)
    for i, at in enumerate([100, 50, 95, 60]):
        held = log.before(i)
        _, lo, hi = log.append(local_table(spark, [(at,)], "at bigint"), i)
        assert log.commit(held, i, lo, hi) == 100
    assert [k[0] for k in log.before(4).kept] == [0, 2] and log.before(0).high is None


EVENT = ("event_id string, ord bigint, ts timestamp, event_type string, source string, severity int, confidence double, tags array<string>, "
         "entities struct<" + ", ".join(f"{f}: string" for f in ENTITY_FIELDS) + ">")
RULES = {"rules": [{"id": "R", "name": "r", "severity": "high", "confidence": 0.8, "sequence": [
    {"event_type": "a"}, {"event_type": "b", "within": "3h", "same": ["entities.user"]}]}]}


def events(spark):
    """Thirty hours; users' events come in pairs that lie in one batch, in the next, or too far apart."""
    t0 = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(90):
        at = t0 + dt.timedelta(minutes=20 * i)
        user = f"u{i % 7}"
        rows.append((f"e{i}", i, at, "a" if i % 3 else "b", "s", 5, 0.5, ["t"], tuple(user if f == "user" else None for f in ENTITY_FIELDS)))
    return spark.createDataFrame(rows, EVENT)


def test_alerts_with_forgotten_events_are_those_of_the_batch(spark, tmp_path):
    ev, folder = events(spark), str(tmp_path / "s")
    sizes = []
    for i in range(9):
        SC.process_batch(ev.filter(F.floor(F.col("ord") / 10) == i), i, folder, RULES, retention="4h", bucket="30m")
        sizes.append((len(batch_ids(spark, f"{folder}/events")), len(batch_ids(spark, f"{folder}/signatures"))))
    want = C.alert_keys(C.correlate(ev, RULES, "4h", bucket="30m")).collect()
    got = C.alert_keys(SC.read_alerts(spark, folder)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10
    assert sizes[-1] == sizes[-2] == sizes[-3] and sizes[-1][0] <= 5
    # From the state on disk alone: the last batch again, as after a restart.
    SC.process_batch(ev.filter("ord >= 80"), 8, folder, RULES, retention="4h", bucket="30m")
    assert sorted(map(tuple, C.alert_keys(SC.read_alerts(spark, folder)).collect())) == sorted(map(tuple, want))
