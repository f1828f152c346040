"""Emit-and-clear windows without a loop over alerts.

A window is emptied by the alert that makes its incident HIGH or worse: with 5
confirmed alerts, or 40 suspects, or 15 suspects and a rare label. (50 ports of a scan
need 50 alerts, of which 5 are confirmed or 40 are suspects.) More alerts never undo
that. So each alert has one last start from which on its window still clears, and where
the next clear lies follows from where the last one was:

- an alert clears a window begun after alert i if its last start lies behind i;
- the clear after a clear at i is the first such alert.

These steps are followed by pointer doubling, inside blocks of positions first and then
from block to block. Between two clears windows are plain trailing ones, of 44 alerts
at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatweave.functions.fixed import RARE_LABELS
from threatweave.session import cut

# Fixed values of the incident rules.
CONFIRMED, SUSPECTS, RARE_SUSPECTS = 5, 40, 15
# Positions of a key that one task looks at together.
BLOCK = 1 << 16


def placed(trig: DataFrame, width: int) -> DataFrame:
    """Alerts with their piece of time ``win`` (one window long) and their place ``pos`` in the key's order, from 1.

    Pieces are numbered by themselves and shifted by the counts of the pieces before.
    """
    pieces = trig.filter("key IS NOT NULL AND at IS NOT NULL").withColumn("win", F.floor(F.col("at") / width))
    before = Window.partitionBy("key").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.groupBy("key", "win").agg(F.count("*").alias("_n")).select(
        "key", "win", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    nth = F.row_number().over(Window.partitionBy("key", "win").orderBy("at", "ord"))
    return pieces.withColumn("_nth", nth).join(shift, ["key", "win"]).withColumn(
        "pos", F.col("_nth") + F.col("_shift")).drop("_nth", "_shift")


def _block(pos: str) -> Column:
    return F.floor(F.col(pos) / BLOCK)


def _with_context(rows: DataFrame) -> DataFrame:
    """Rows in their own piece and, for the windows that reach back, in the next (``own`` tells them apart)."""
    return rows.withColumn("_go", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *[c for c in rows.columns if c != "win"], (F.col("win") + F.col("_go")).alias("win"), (F.col("_go") == 0).alias("own"))


def last_starts(alerts: DataFrame, width: int) -> DataFrame:
    """``key, pos, start``: live alerts whose trailing window would clear, and the last place it may begin at for that."""
    me = F.struct("pos", "at")
    by_kind = Window.partitionBy("key", "win", "conf").orderBy("pos")
    so_far = Window.partitionBy("key", "win").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def back(conf: int, k: int) -> Column:
        """The k-th last alert of a kind, this one included."""
        return F.when(F.col("conf") == conf, F.lag(me, k - 1).over(by_kind))

    marks = {
        "_confirmed": back(1, CONFIRMED), "_many": back(0, SUSPECTS), "_some": back(0, RARE_SUSPECTS),
        "_rare": F.when(F.col("label").isin(*RARE_LABELS), me),
    }
    seen = _with_context(alerts.filter("live").select("key", "win", "pos", "at", "label", "conf")).withColumns(marks).withColumns(
        {name: F.last(name, ignorenulls=True).over(so_far) for name in marks})
    both = F.when(F.col("_rare").isNotNull() & F.col("_some").isNotNull(), F.least("_rare", "_some"))
    start = F.greatest("_confirmed", "_many", both)
    return seen.filter("own").withColumn("_start", start).filter(F.col("_start.at") >= F.col("at") - width).select(
        "key", "pos", F.col("_start.pos").alias("start"))


def next_clears(starts: DataFrame) -> DataFrame:
    """``key, pos, next, block``: for each alert that may clear, the next one to clear once it has (null: none).

    Later alerts have later last starts, so that is the first one whose start lies behind ``pos``.
    """
    none = F.lit(None).cast("bigint")
    rows = starts.select("key", F.col("pos").alias("p"), F.lit(1).alias("ask"), none.alias("offer")).unionByName(
        starts.select("key", F.col("start").alias("p"), F.lit(0).alias("ask"), F.col("pos").cast("bigint").alias("offer"))
    ).withColumn("block", _block("p"))
    behind = Window.partitionBy("key", "block").orderBy(F.col("p").desc(), F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("key").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("key", "block").agg(F.min("offer").alias("_least")).select(
        "key", "block", F.min("_least").over(later).alias("_later"))
    return rows.withColumn("_here", F.min("offer").over(behind)).filter("ask = 1").join(blocks, ["key", "block"]).select(
        "key", F.col("p").alias("pos"), F.least("_here", "_later").alias("next"), "block")


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the nodes of whole blocks, many at a time, in the order of their places."""
    size = BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # The last block may go on in the next batch.
            last = (rows["key"] == rows["key"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
            held = rows[last]
            if not last.all():
                yield work(rows[~last], size)
        if held is not None:
            yield work(held, size)

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos").mapInPandas(run, schema)


def _steps(nodes: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' next places (0: none), and which node of the same block that is (their number: outside)."""
    key, block = nodes["key"].to_numpy(), nodes["block"].to_numpy(np.int64)
    pos, to = nodes["pos"].to_numpy(np.int64), nodes["next"].fillna(0).to_numpy(np.int64)
    fresh = np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]))
    base = np.cumsum(fresh) * size
    at = np.searchsorted(base + pos % size, base + to % size)
    return to, np.where((to > 0) & (to // size == block), at, len(pos))


def _leave(nodes: pd.DataFrame, size: int) -> pd.DataFrame:
    """Per node the first one outside the block that its steps lead to."""
    to, at = _steps(nodes, size)
    end = np.where(at < len(at), at, np.arange(len(at)))
    while (end[end] != end).any():
        end = end[end]
    out = nodes[["key", "pos"]].assign(exit=to[end])
    return out[out["exit"] > 0]


def _walk(nodes: pd.DataFrame, size: int) -> pd.DataFrame:
    """The nodes on the way from the blocks' entries."""
    _, at = _steps(nodes, size)
    on = np.append(nodes["entry"].to_numpy(bool), False)
    hop = np.append(at, len(at))
    while (hop < len(at)).any():
        on[hop[np.flatnonzero(on)]] = True
        hop = hop[hop]
    return nodes.loc[on[:-1], ["key", "pos"]]


def clears(starts: DataFrame) -> DataFrame:
    """``key, pos`` of the alerts that clear, from the first that can on."""
    nodes = cut(next_clears(starts))
    entries = nodes.groupBy("key").agg(F.min("pos").alias("pos"))
    hops = cut(_by_block(nodes, _leave, "key string, pos bigint, exit bigint"))
    # Each round doubles the blocks that a hop crosses; one block needs none.
    while True:
        further = cut(entries.join(hops, ["key", "pos"]).select("key", F.col("exit").alias("pos")))
        if further.isEmpty():
            break
        entries = cut(entries.unionByName(further).distinct())
        on = hops.select("key", F.col("pos").alias("exit"), F.col("exit").alias("_next"))
        hops = cut(hops.join(on, ["key", "exit"]).select("key", "pos", F.col("_next").alias("exit")))
    marked = nodes.join(entries.withColumn("entry", F.lit(True)), ["key", "pos"], "left").select(
        "key", "pos", "next", "block", F.coalesce("entry", F.lit(False)).alias("entry"))
    return _by_block(marked, _walk, "key string, pos bigint")


def _segments(alerts: DataFrame, cleared: DataFrame) -> DataFrame:
    """Alerts with ``seg``, the place of the last clear before them (0: none)."""
    marked = alerts.join(cleared.withColumn("_clear", F.col("pos")), ["key", "pos"], "left").withColumn("_block", _block("pos"))
    here = Window.partitionBy("key", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("key", "_block").agg(F.max("_clear").alias("_last")).select(
        "key", "_block", F.max("_last").over(earlier).alias("_before"))
    seg = F.coalesce(F.max("_clear").over(here), F.lit(0))
    return marked.withColumn("seg", seg).join(blocks, ["key", "_block"]).withColumn(
        "seg", F.greatest("seg", F.coalesce("_before", F.lit(0)))).drop("_clear", "_block", "_before")


def cleared_windows(trig: DataFrame, width: int) -> DataFrame:
    """The figures of every alert's window under emit and clear (see ``incidents.to_incidents``), by ``alert_ord``.

    ``trig``: key, at, ord, label, port, conf, p, m, live. Alerts without key or time have
    none, nor have those whose window is empty. Every window and every grouping is over a
    piece of time or a block of positions of one key, so a key of any size spreads over
    tasks. Alerts of one instant come in the order of ``ord``.
    """
    alerts = cut(placed(trig, width))
    split = cut(_segments(alerts, clears(last_starts(alerts, width))))
    row = F.struct("pos", "at", "label", "port", "conf", "p", "m")
    part = Window.partitionBy("key", "seg", "win").orderBy("pos")
    held = F.collect_list(row).over(part.rowsBetween(2 - CONFIRMED - SUSPECTS, 0))
    live = _with_context(split.filter("live")).withColumn("held", held)
    # An alert that only reads sees what the last live one left.
    kinds = dict(live.dtypes)
    rest = split.filter("NOT live").withColumns({"own": F.lit(True), "held": F.lit(None).cast(kinds["held"])})
    seen = live.unionByName(rest).withColumn("held", F.last("held", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    window = F.filter("held", lambda r: r["at"] >= F.col("at") - width)
    found = seen.filter("own").select("key", F.col("ord").alias("alert_ord"), window.alias("w")).filter(F.size("w") > 0)

    def total(name: str, zero: Column) -> Column:
        return F.aggregate(F.col("w")[name], zero, lambda a, x: a + x)

    def told(name: Column) -> Column:
        mine = F.filter("w", lambda r: r["label"].eqNullSafe(name))
        return F.struct(name.alias("label"), F.size(mine).cast("bigint").alias("n"),
                        mine[0]["at"].alias("first_at"), mine[0]["pos"].alias("first_ord"))

    return found.select(
        "alert_ord", "key", F.col("w")[0]["at"].alias("start_at"), F.element_at("w", -1)["at"].alias("end_at"),
        F.size("w").cast("bigint").alias("n"), total("conf", F.lit(0).cast("bigint")).alias("confirmed"),
        total("p", F.lit(0.0)).alias("sum_p"), total("m", F.lit(0.0)).alias("sum_m"),
        F.size(F.array_distinct(F.array_compact(F.col("w")["port"]))).cast("bigint").alias("unique_ports"),
        F.transform(F.array_distinct(F.col("w")["label"]), told).alias("labels"))
