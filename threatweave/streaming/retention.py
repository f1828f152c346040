"""A stream's memory as tables that forget: what a batch reads does not grow with the stream's age."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatweave.session import local_table
from threatweave.streaming.batches import batch_ids, drop_folder, write_batch

_MARK = "id bigint, lo bigint, hi bigint, kept boolean, high bigint"


@dataclass
class Held:
    """What the log held before a batch: its high-water mark and, per kept batch, the times it spans."""

    mark: int = -1
    high: int | None = None
    kept: list[tuple[int, int, int]] = field(default_factory=list)
    gone: list[int] = field(default_factory=list)


class RetentionLog:
    """Rows by batch in ``folder``, forgotten ``keep_us`` microseconds behind the newest row.

    ``time`` is a SQL expression over the rows: their time in microseconds. Each batch
    leaves a mark, one row per batch still kept, so that the next finds what to read from
    one small table. A batch whose rows have all fallen behind leaves the mark at once and
    the folder when the following batch commits; by then no batch that could run again
    reads it. Running a batch again replaces its own rows and mark and nothing else.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, time: str, keep_us: int):
        self.spark, self.folder, self.schema, self.time, self.keep_us = spark, folder, schema, time, keep_us

    def before(self, batch_id: int) -> Held:
        marks = [i for i in batch_ids(self.spark, f"{self.folder}/_marks") if i < batch_id]
        if not marks:
            return Held()
        # As many rows as batches within the retention period.
        rows = self.spark.read.schema(_MARK).parquet(f"{self.folder}/_marks/batch-{max(marks)}").collect()
        return Held(max(marks), max((r["high"] for r in rows), default=None),
                    sorted((r["id"], r["lo"], r["hi"]) for r in rows if r["kept"]), [r["id"] for r in rows if not r["kept"]])

    def read(self, held: Held, since: int | None = None) -> DataFrame:
        """Kept rows of earlier batches, not older than ``since``; files of older batches are not opened."""
        ids = [i for i, _, hi in held.kept if since is None or hi >= since]
        if not ids:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/batch-{i}" for i in ids])
        return rows if since is None else rows.filter(F.expr(self.time) >= since)

    def append(self, rows: DataFrame, batch_id: int) -> tuple[DataFrame, int | None, int | None]:
        """Write a batch's rows; returns them as written, and the times they span (null: none)."""
        write_batch(rows, self.folder, batch_id)
        mine = self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch-{batch_id}")
        span = mine.agg(F.min(F.expr(self.time)).alias("lo"), F.max(F.expr(self.time)).alias("hi")).first()
        return mine, span["lo"], span["hi"]

    def commit(self, held: Held, batch_id: int, lo: int | None, hi: int | None, high: int | None = None) -> int | None:
        """Mark the batch as read and forget what lies behind; returns the new high-water mark.

        ``high`` moves the mark by another log's time.
        """
        moved = max((x for x in (held.high, hi if high is None else high) if x is not None), default=None)
        # A batch without rows is behind at once.
        rows = [(i, a, z, z is not None and z >= moved - self.keep_us, moved) for i, a, z in [*held.kept, (batch_id, lo, hi)]]
        local_table(self.spark, rows, _MARK).write.mode("overwrite").parquet(f"{self.folder}/_marks/batch-{batch_id}")
        for i in held.gone:
            drop_folder(self.spark, f"{self.folder}/batch-{i}")
        for i in batch_ids(self.spark, f"{self.folder}/_marks"):
            if i < held.mark:
                drop_folder(self.spark, f"{self.folder}/_marks/batch-{i}")
        return moved
