"""Streams in several micro-batches give the batch results; a repeated batch changes nothing."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatweave.operators import incidents as I
from threatweave.plans import correlate as C
from threatweave.plans import tables as T
from threatweave.plans import traps
from threatweave.operators import sessions as S
from threatweave.streaming import correlate as SC
from threatweave.streaming import incidents as SI
from threatweave.streaming import traps as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events table as four files in time order, one per micro-batch."""
    root = tmp_path_factory.mktemp("parts")
    ev = T.table(spark, SF, "events")
    edges = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0)
    bounds = [-1, *edges, 10**12]
    for i in range(4):
        ev.filter((F.col("event_id") > bounds[i]) & (F.col("event_id") <= bounds[i + 1])).coalesce(1).write.mode("append").parquet(str(root / "in"))
    return root, ev.schema


def stream(spark, parts):
    root, schema = parts
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root / "in"))


def drain(spark, df, folder):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}-c").trigger(availableNow=True).start(str(folder))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(folder))


def rows(df):
    return sorted(map(str, df.collect()))


def test_alerts(spark, parts, tmp_path):
    q = SC.correlate_stream(T.events_in(stream(spark, parts)), str(tmp_path / "a"), T.EVENT_RULES, str(tmp_path / "c"))
    q.awaitTermination()
    batch = C.correlate(T.security_events(spark, SF), T.EVENT_RULES)
    got = SC.read_alerts(spark, str(tmp_path / "a"))
    assert rows(C.alert_keys(got)) == rows(C.alert_keys(batch))
    # Running the last batch again replaces its own files.
    last = spark.read.parquet(str(tmp_path / "a/events/batch-3")).select(*T.security_events(spark, SF).columns)
    copy = spark.createDataFrame(last.collect(), last.schema)
    SC.process_batch(copy, 3, str(tmp_path / "a"), T.EVENT_RULES)
    assert rows(C.alert_keys(SC.read_alerts(spark, str(tmp_path / "a")))) == rows(C.alert_keys(batch))


def test_incidents(spark, parts, tmp_path):
    got = drain(spark, SI.incident_stream(T.flow_alerts_in(stream(spark, parts)), "2d"), tmp_path / "i")
    want = I.incidents(T.flow_alerts(spark, SF), "2d", "stateful")
    pick = ["alert_ord", "key", "severity", "confirmed", "suspect", "unique_ports", "start_at", "end_at"]
    assert rows(got.select(*pick)) == rows(want.select(*pick))


def test_sessions_and_dedupe(spark, parts, tmp_path):
    ev = T.trap_events_in(stream(spark, parts))
    got = traps.session_rows(drain(spark, ST.session_stream(ev.withWatermark("ts", "10 minutes"), "1d"), tmp_path / "s"))
    whole = traps.session_rows(S.trap_sessions(T.trap_events(spark, SF), "1d"))
    done = set(rows(got))
    assert done and done < set(rows(whole))
    twice = ev.unionByName(ev).select("event_id", "ts")
    once = drain(spark, ST.dedupe_stream(twice, delay="30 days"), tmp_path / "o")
    assert once.count() == once.select("event_id").distinct().count() == T.table(spark, SF, "events").count()


def test_sessions_to_the_end_of_the_stream(spark, parts, tmp_path):
    end = str(tmp_path / "end")
    sessions = ST.session_stream(ST.with_end(T.trap_events_in(stream(spark, parts)), end).withWatermark("ts", "10 minutes"), "1d")
    open_ = traps.session_rows(drain(spark, sessions, tmp_path / "s")).count()
    ST.end_stream(spark, end)
    got = traps.session_rows(drain(spark, sessions, tmp_path / "s"))
    assert rows(got) == rows(traps.session_rows(S.trap_sessions(T.trap_events(spark, SF), "1d"))) and got.count() > open_


def test_export_stream(spark, parts, tmp_path):
    ST.export_stream(T.trap_events_in(stream(spark, parts)), str(tmp_path / "x"), traps.accept_some, str(tmp_path / "c"), "1d").awaitTermination()
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "x/events"))
    acks = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "x/acks"))
    assert stored.count() == stored.select("event_id").distinct().count() == T.table(spark, SF, "events").count()
    assert acks.count() == acks.select("event_id").distinct().count() > 0
    # What waits is what no delivery took; only the last two batches' backlogs are kept.
    waiting = spark.read.parquet(str(tmp_path / "x/waiting/batch-3"))
    assert rows(waiting.select("event_id")) == rows(stored.select("event_id").join(acks.select("event_id"), "event_id", "left_anti"))
    assert sorted(p.name for p in (tmp_path / "x/waiting").iterdir()) == ["batch-2", "batch-3"]


def test_sliding_counts(spark, parts, tmp_path):
    assert drain(spark, SI.sliding_counts(T.flow_alerts_in(stream(spark, parts))), tmp_path / "w").count() > 0


def test_rows_of_a_key_are_held_packed():
    rng, n, batch = np.random.default_rng(1), 200_000, 10_000

    def batches():
        for a in range(0, n, batch):
            label = pd.Series(np.array(["".join(["Do", "S"]), "BENIGN", None], object)[rng.integers(0, 3, batch)])
            yield pd.DataFrame({
                "key": ["a->b" + str(i) for i in range(batch)], "at": rng.integers(0, n // 4, batch), "ord": np.arange(a, a + batch)[::-1], "label": label,
                "port": np.where(rng.random(batch) < 0.1, np.nan, 80.0), "conf": rng.integers(0, 2, batch), "p": rng.random(batch),
                "m": rng.random(batch), "live": rng.random(batch) < 0.5})

    tracemalloc.start()
    before, seen = None, 0
    for ord_, at, label, port, conf, p, m, live in SI.in_order(batches()):
        assert before is None or before < (at, ord_)
        assert label in ("DoS", "BENIGN", None) and isinstance(live, bool)
        before, seen = (at, ord_), seen + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 150 * n
