"""Roll scored flow alerts up into incidents per source -> destination.

Modes: ``tumbling`` (one row per key and window), ``trailing`` (one row per
alert over the window that ends at it) and ``stateful`` (as trailing, alert by alert
in order, but a HIGH or CRITICAL incident empties the window).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatweave.functions.columns import parse_window
from threatweave.functions.fixed import INCIDENT_ADVICE, INCIDENT_LEVELS, RARE_LABELS
from threatweave.operators.clearing import cleared_windows


def flow_key() -> Column:
    return F.concat("src_ip", F.lit("->"), "dst_ip")


def triggers(alerts: DataFrame) -> DataFrame:
    """Alerts in the narrow form the modes work on; ``live`` ones count.

    ``alerts``: ts (epoch seconds), ord, src_ip, dst_ip, dst_port, label,
    alert_level, p_attack, margin. Alerts of other levels add nothing to a window,
    but their arrival expires it and reads it like any other. A missing port is no
    port; a missing probability or margin is 0.
    """
    return alerts.select(
        flow_key().alias("key"),
        F.round(F.col("ts") * 1_000_000).cast("bigint").alias("at"),
        "ord", "label", F.col("dst_port").alias("port"),
        F.coalesce(F.col("alert_level") == "CONFIRMED", F.lit(False)).cast("bigint").alias("conf"),
        F.coalesce("p_attack", F.lit(0.0)).alias("p"), F.coalesce("margin", F.lit(0.0)).alias("m"),
        F.coalesce(F.col("alert_level").isin("SUSPECT", "CONFIRMED"), F.lit(False)).alias("live"),
    )


def _has(labels: Column, names) -> Column:
    return F.exists(labels, lambda x: x["label"].isin(*names))


def to_incidents(stats: DataFrame, *extra: str) -> DataFrame:
    """Severity, confidence and advice from the figures of a window.

    ``stats``: key, start_at, end_at, n, confirmed, sum_p, sum_m, unique_ports,
    labels ARRAY<STRUCT<label, n, first_at, first_ord>>.
    """
    suspect = F.col("n") - F.col("confirmed")
    rank = (
        F.when(F.col("confirmed") >= 20, 3).when(F.col("confirmed") >= 5, 2)
        .when(suspect >= 40, 2).when(suspect >= 15, 1).otherwise(0)
    )
    rank = F.when(_has(F.col("labels"), RARE_LABELS), F.least(rank + 1, F.lit(3))).otherwise(rank)
    scan = _has(F.col("labels"), ["PortScan"])
    wide, some = F.col("unique_ports") >= 50, F.col("unique_ports") >= 20
    ranked = stats.withColumns({"suspect": suspect, "_rank": rank, "_scan": scan})
    raised = (
        F.when(F.col("_scan") & wide, F.greatest("_rank", F.lit(2)))
        .when(F.col("_scan") & some, F.greatest("_rank", F.lit(1)))
        .otherwise(F.col("_rank"))
    )
    weak = F.col("_scan") & ~some & (F.col("_rank") <= 1) & (F.col("confirmed") < 5)
    level = F.get(F.array(*map(F.lit, INCIDENT_LEVELS)), raised)
    advice = F.create_map(*[F.lit(x) for kv in INCIDENT_ADVICE.items() for x in kv])
    ordered = F.array_sort(
        F.transform("labels", lambda x: F.struct((-x["n"]).alias("minus_n"), x["first_at"], x["first_ord"], x["label"]))
    )
    top = F.transform(F.slice(ordered, 1, 3), lambda x: F.struct(x["label"].alias("label"), (-x["minus_n"]).alias("n")))
    boost = F.when(F.col("sum_m") / F.col("n") > 1.0, 0.15).otherwise(0.0)
    return ranked.filter(~weak).withColumn("severity", level).select(
        *extra, "key", "start_at", "end_at", "severity",
        top.alias("top_labels"),
        F.map_from_entries(F.transform("labels", lambda x: F.struct(x["label"], x["n"]))).alias("counts"),
        "confirmed", "suspect", "unique_ports",
        F.least(F.lit(1.0), F.col("sum_p") / F.col("n") + boost).alias("confidence"),
        F.try_element_at(advice, F.col("severity")).alias("recommendation"),
    )


def _tumbling(trig: DataFrame, width: int) -> DataFrame:
    trig = trig.withColumn("bucket", F.floor(F.col("at") / width))
    # Two levels: the label list of a window is as long as the label set.
    per_label = trig.groupBy("key", "bucket", "label").agg(
        F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("p").alias("p"), F.sum("m").alias("m"),
        F.max("at").alias("end_at"), F.min(F.struct("at", "ord")).alias("first"),
    )
    rolled = per_label.groupBy("key", "bucket").agg(
        F.min("first.at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n"),
        F.sum("conf").alias("confirmed"), F.sum("p").alias("sum_p"), F.sum("m").alias("sum_m"),
        F.collect_list(
            F.struct("label", "n", F.col("first.at").alias("first_at"), F.col("first.ord").alias("first_ord"))
        ).alias("labels"),
    )
    ports = trig.groupBy("key", "bucket").agg(F.count_distinct("port").alias("unique_ports"))
    return to_incidents(rolled.join(ports, ["key", "bucket"]), "bucket")


def _trailing(trig: DataFrame, width: int) -> DataFrame:
    """Sliding figures in linear time.

    A sliding frame would rescan its window for every alert. Instead an alert
    adds its figures when it arrives and takes them back when it expires, and a
    running sum reads the window off. Time is cut into pieces of one window; a
    piece also holds the alerts of the piece before, all its windows can reach,
    so a key of any size spreads over tasks.
    """
    win = F.floor(F.col("at") / width)
    spread = trig.filter("live").withColumn("win", F.explode(F.array(win, win + 1)))
    # One row per instant before anything is ordered.
    atoms = spread.groupBy("key", "win", "label", "at").agg(
        F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("p").alias("p"), F.sum("m").alias("m"),
        F.min("ord").alias("ord"),
    )
    points = trig.select("key", win.alias("win"), "at").distinct()
    labels = atoms.select("key", "win", "label").distinct()
    # Every window reads every label of its piece: as many rows as the label set.
    reads = points.join(labels, ["key", "win"])

    figures = ["n", "conf", "p", "m"]
    zero = [F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("conf"), F.lit(0.0).alias("p"), F.lit(0.0).alias("m")]
    part = ["key", "win", "label"]
    moves = (
        atoms.select(*part, "at", F.lit(0).alias("read"), *figures)
        .unionByName(atoms.select(*part, (F.col("at") + width + 1).alias("at"), F.lit(0).alias("read"), *[(-F.col(c)).alias(c) for c in figures]))
        .unionByName(reads.select(*part, "at", F.lit(1).alias("read"), *zero))
    )
    running = Window.partitionBy(*part).orderBy("at", "read").rowsBetween(Window.unboundedPreceding, 0)
    sums = moves.select(*part, "at", "read", *[F.sum(c).over(running).alias(c) for c in figures],
                        F.max(F.when(F.col("n") > 0, F.col("at"))).over(running).alias("last_at")).filter("read = 1 AND n > 0").drop("read")

    # Oldest alert of the label still inside the window.
    marks = atoms.select(*part, F.col("at").alias("pos"), F.lit(0).alias("read"), "at", "ord").unionByName(
        reads.select(*part, (F.col("at") - width).alias("pos"), F.lit(1).alias("read"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("ord"))
    )
    back = Window.partitionBy(*part).orderBy(F.col("pos").desc(), F.col("read").asc()).rowsBetween(Window.unboundedPreceding, 0)
    oldest = marks.select(
        *part, "read", (F.col("pos") + width).alias("at"),
        F.last("at", ignorenulls=True).over(back).alias("first_at"),
        F.last("ord", ignorenulls=True).over(back).alias("first_ord"),
    ).filter("read = 1").drop("read")

    by_label = sums.join(oldest, [*part, "at"])
    rolled = by_label.groupBy("key", "win", "at").agg(
        F.min("first_at").alias("start_at"), F.max("last_at").alias("end_at"), F.sum("n").alias("n"),
        F.sum("conf").alias("confirmed"), F.sum("p").alias("sum_p"), F.sum("m").alias("sum_m"),
        F.collect_list(F.struct("label", "n", "first_at", "first_ord")).alias("labels"),
    )

    # A port counts from each of its alerts until the next one or the window's length.
    seen = spread.filter("port IS NOT NULL").select("key", "win", "port", "at").distinct()
    after = Window.partitionBy("key", "win", "port").orderBy("at")
    held = seen.withColumn("upto", F.least(F.col("at") + width + 1, F.lead("at").over(after)))
    steps = (
        held.select("key", "win", "at", F.lit(1).alias("d"))
        .unionByName(held.select("key", "win", F.col("upto").alias("at"), F.lit(-1).alias("d")))
        .groupBy("key", "win", "at").agg(F.sum("d").alias("d"))
        .withColumn("read", F.lit(0))
        .unionByName(points.select("key", "win", "at", F.lit(0).cast("bigint").alias("d"), F.lit(1).alias("read")))
    )
    level = Window.partitionBy("key", "win").orderBy("at", "read").rowsBetween(Window.unboundedPreceding, 0)
    ports = steps.select("key", "win", "at", "read", F.sum("d").over(level).alias("unique_ports")).filter("read = 1").drop("read")

    windows = to_incidents(rolled.join(ports, ["key", "win", "at"]), "at")
    return windows.join(trig.select("key", "at", F.col("ord").alias("alert_ord")), ["key", "at"]).drop("at")


class WindowState:
    """Figures of one key's trailing window, kept up as alerts come and expire."""

    def __init__(self, width: int, rows=()):
        self.width = width
        self.clear()
        for row in rows:
            self._add(tuple(row))

    def clear(self):
        self.rows: deque = deque()
        self.by_label: dict[str, deque] = {}
        self.ports: dict[int, int] = {}
        self.confirmed, self.sum_p, self.sum_m, self.seq = 0, 0.0, 0.0, 0

    def _add(self, row):
        at, label, port, conf, p, m = row
        self.rows.append(row)
        self.by_label.setdefault(label, deque()).append(self.seq)
        if port is not None:
            self.ports[port] = self.ports.get(port, 0) + 1
        self.confirmed, self.sum_p, self.sum_m, self.seq = self.confirmed + conf, self.sum_p + p, self.sum_m + m, self.seq + 1

    def expire(self, before: int):
        while self.rows and self.rows[0][0] < before:
            _, label, port, conf, p, m = self.rows.popleft()
            self.by_label[label].popleft()
            if not self.by_label[label]:
                del self.by_label[label]
            if port is not None:
                self.ports[port] -= 1
                if not self.ports[port]:
                    del self.ports[port]
            self.confirmed, self.sum_p, self.sum_m = self.confirmed - conf, self.sum_p - p, self.sum_m - m
        if not self.rows:
            self.clear()

    def push(self, at, label, port, conf, p, m, live=True) -> dict | None:
        """Let an alert arrive and, if it is live, add it; the incident the window then is, or None."""
        self.expire(at - self.width)
        if live:
            self._add((at, label, None if port is None or port != port else int(port), conf, p, m))
        if not self.rows:
            return None
        incident = self._incident()
        if incident and incident["severity"] in ("HIGH", "CRITICAL"):
            self.clear()
        return incident

    def _incident(self) -> dict | None:
        n, confirmed, ports = len(self.rows), self.confirmed, len(self.ports)
        suspect = n - confirmed
        rank = 3 if confirmed >= 20 else 2 if confirmed >= 5 or suspect >= 40 else 1 if suspect >= 15 else 0
        if any(label in self.by_label for label in RARE_LABELS):
            rank = min(rank + 1, 3)
        if "PortScan" in self.by_label:
            if ports < 20 and rank <= 1 and confirmed < 5:
                return None
            rank = max(rank, 2 if ports >= 50 else 1 if ports >= 20 else 0)
        level = INCIDENT_LEVELS[rank]
        # Most frequent first; among equals the one seen first in the window.
        ranked = sorted(self.by_label.items(), key=lambda kv: (-len(kv[1]), kv[1][0]))
        return {
            "start_at": self.rows[0][0], "end_at": self.rows[-1][0], "severity": level,
            "top_labels": [{"label": k, "n": len(v)} for k, v in ranked[:3]],
            "counts": {k: len(v) for k, v in ranked},
            "confirmed": confirmed, "suspect": suspect, "unique_ports": ports,
            "confidence": min(1.0, self.sum_p / n + (0.15 if self.sum_m / n > 1.0 else 0.0)),
            "recommendation": INCIDENT_ADVICE[level],
        }


STATEFUL_SCHEMA = (
    "alert_ord bigint, key string, start_at bigint, end_at bigint, severity string, "
    "top_labels array<struct<label: string, n: bigint>>, counts map<string, bigint>, "
    "confirmed bigint, suspect bigint, unique_ports bigint, confidence double, recommendation string"
)


INCIDENT_COLUMNS = [
    "alert_ord", "key", "start_at", "end_at", "severity", "top_labels", "counts",
    "confirmed", "suspect", "unique_ports", "confidence", "recommendation",
]


def incidents(alerts: DataFrame, window: str = "30s", mode: str = "trailing") -> DataFrame:
    width = parse_window(window) * 1_000_000
    trig = triggers(alerts)
    if mode == "tumbling":
        return _tumbling(trig.filter("live"), width)
    if mode == "trailing":
        return _trailing(trig, width)
    if mode == "stateful":
        return to_incidents(cleared_windows(trig, width), "alert_ord")
    raise ValueError(f"unknown mode: {mode!r}")
