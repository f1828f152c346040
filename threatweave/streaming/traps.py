"""Trap events as a stream: insert once, sessionise, deliver with acknowledgement."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatweave.functions.columns import parse_window
from threatweave.functions.fixed import ATTACK_PATTERNS
from threatweave.operators.sessions import attack_patterns, session_members, source_key, trap_sessions
from threatweave.operators.store import Deliver, acks_of, deliver_sessions, insert_new, unacked
from threatweave.session import local_table
from threatweave.streaming.batches import batch_ids, drop_folder, write_batch
from threatweave.streaming.retention import RetentionLog


ACKS = "event_id string, session_id string"


def dedupe_stream(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """First write per id wins, remembered for as long as the watermark allows."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def session_stream(events: DataFrame, gap: str = "300s", patterns: dict = ATTACK_PATTERNS) -> DataFrame:
    """Sessions, each emitted once the watermark has passed its end.

    ``events`` carries a watermark on ``ts``. A session that spans micro-batches
    stays one session.
    """
    window = F.session_window("ts", f"{parse_window(gap)} seconds")
    return (
        events.withColumn("source_key", source_key())
        .groupBy("source_key", window)
        .agg(
            F.min(F.struct("ts", "ord", "event_id")).alias("opening"),
            F.count("*").alias("event_count"),
            F.max("ts").alias("end_time"),
            F.array_sort(F.collect_set("action")).alias("actions"),
        )
        .select(
            F.col("opening.event_id").alias("session_id"), F.col("source_key").alias("source"), "event_count", "actions",
            attack_patterns("actions", patterns).alias("attack_patterns"), F.lit("HIGH").alias("confidence"),
            F.col("opening.ts").alias("start_time"), "end_time",
        )
    )


# Later than any event: what has no end of its own ends here.
END_OF_TIME = dt.datetime(2900, 1, 1, tzinfo=dt.timezone.utc)


def with_end(events: DataFrame, end_folder: str) -> DataFrame:
    """A stream of events that :func:`end_stream` can end; without that it goes on as it is.

    Put the watermark on what this returns.
    """
    spark = events.sparkSession
    local_table(spark, [], events.schema).write.mode("ignore").parquet(end_folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(end_folder))


def end_stream(spark: SparkSession, end_folder: str) -> None:
    """Tell a stream made by :func:`with_end`, and drained, that no more events come.

    Started again from its checkpoint it reads one row beyond all time: the watermark
    passes every open session and the stream emits it. That row's own session never ends.
    """
    spark.createDataFrame([(END_OF_TIME,)], "ts timestamp").write.mode("append").parquet(end_folder)


def export_stream(
    events: DataFrame, folder: str, deliver: Deliver, checkpoint: str, gap: str = "300s", remember: str = "30d",
) -> StreamingQuery:
    """Store each batch, then export every session that waits.

    Below ``folder``: ``events`` stored once per id, ``acks`` of delivered sessions, both
    per batch id, so a batch that is run again replaces its own files; ``waiting``, the
    events not acknowledged yet, handed on from batch to batch; ``ids``, those stored in the
    last ``remember`` of event time. A batch reads the last two only. Sessions that are not
    acknowledged come up again with the next batch. A copy of an event that arrives more
    than ``remember`` behind the newest event is stored again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored, acked, waits = (f"{folder}/{name}" for name in ("events", "acks", "waiting"))
        ids = RetentionLog(spark, f"{folder}/ids", "event_id string, ts timestamp", "unix_micros(ts)", parse_window(remember) * 1_000_000)
        held = ids.before(batch_id)
        write_batch(insert_new(batch, ids.read(held)), stored, batch_id)
        fresh = spark.read.schema(batch.schema).parquet(f"{stored}/batch-{batch_id}")
        earlier = [i for i in batch_ids(spark, waits) if i < batch_id]
        waiting = fresh
        if earlier:
            waiting = spark.read.schema(batch.schema).parquet(f"{waits}/batch-{earlier[-1]}").unionByName(fresh)
        delivered = deliver_sessions(trap_sessions(waiting, gap), deliver)
        write_batch(acks_of(session_members(waiting, gap), delivered), acked, batch_id)
        acks = spark.read.schema(ACKS).parquet(f"{acked}/batch-{batch_id}")
        write_batch(unacked(waiting, acks), waits, batch_id)
        _, lo, hi = ids.append(fresh.select("event_id", "ts"), batch_id)
        ids.commit(held, batch_id, lo, hi)
        for i in earlier[:-1]:
            drop_folder(spark, f"{waits}/batch-{i}")

    return (
        events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
