"""Rule matching as a stream.

State is a table, not a keyed store: the events of the last retention period in
the shared folder. Each micro-batch matches over what is still in reach with the
batch operator, so a hot entity is spread over tasks in a stream as well, and
both forms give the same alerts. Events and signatures that no later batch can
reach are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatweave.functions.columns import parse_window
from threatweave.operators.alerts import build_alerts
from threatweave.operators.rules import rule_tables
from threatweave.operators.sequence import match_sequences
from threatweave.streaming.batches import write_batch
from threatweave.streaming.retention import RetentionLog

SIGNATURE = ["rule_id", "key_entity", "bucket"]


def process_batch(batch: DataFrame, batch_id: int, folder: str, ruleset: dict, retention: str = "6h", bucket: str = "10m") -> None:
    """Add a batch of normalised events and write the alerts it completes.

    Everything is written under the batch id and earlier batches are only read,
    so a repeated batch replaces its own files and nothing else. ``folder`` keeps the
    alerts; events are forgotten the retention period behind the newest one, signatures
    of alerts a bucket later (an alert starts within reach, its bucket at most a bucket
    before). A batch without dated events writes none.
    """
    spark = batch.sparkSession
    keep, extra = (parse_window(w) * 1_000_000 for w in (retention, bucket))
    events = RetentionLog(spark, f"{folder}/events", batch.schema, "unix_micros(ts)", keep)
    held = events.before(batch_id)
    mine, lo, hi = events.append(batch, batch_id)
    if hi is None:
        return
    reach = mine
    if held.high is not None:
        # What earlier batches have left within reach; older arrivals are pruned at once.
        since = F.timestamp_micros(F.lit(held.high - keep))
        mine = mine.filter(F.col("ts") >= since)
        reach = events.read(held, max(held.high, lo) - keep).unionByName(mine)
    rules, steps = rule_tables(spark, ruleset)
    chains = match_sequences(reach, rules, steps, retention)
    slots = chains.select("rule_id", "start_ord", F.explode("ords").alias("ord"))
    fresh = slots.join(mine.select("ord"), "ord", "left_semi").select("rule_id", "start_ord").distinct()
    found = build_alerts(chains.join(fresh, ["rule_id", "start_ord"], "left_semi"), reach, rules, steps, True, bucket)
    signed = found.select(*SIGNATURE, "start_at")
    signatures = RetentionLog(spark, f"{folder}/signatures", signed.schema, "start_at", keep + extra)
    known = signatures.before(batch_id)
    write_batch(found.join(signatures.read(known).select(*SIGNATURE), SIGNATURE, "left_anti"), f"{folder}/alerts", batch_id)
    written = spark.read.schema(found.schema).parquet(f"{folder}/alerts/batch-{batch_id}")
    _, first, last = signatures.append(written.select(*SIGNATURE, "start_at"), batch_id)
    high = events.commit(held, batch_id, lo, hi)
    signatures.commit(known, batch_id, first, last, high)


def correlate_stream(events: DataFrame, folder: str, ruleset: dict, checkpoint: str, retention: str = "6h", bucket: str = "10m") -> StreamingQuery:
    """Alerts of a stream of normalised events, under ``folder``/alerts."""

    def run(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, folder, ruleset, retention, bucket)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_alerts(spark, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/alerts")
