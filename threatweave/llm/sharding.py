"""Sharding by histogram sort: splitters from refined byte histograms, then one exchange."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatweave.llm.common import given_id, ident, settle, whole_text

SHARDS = 16
# A splitter is settled when the bytes below it miss their share by no more than this part of a shard.
TOLERANCE = 0.001
# Bits of the key that one refinement adds: at most 2**12 probes per open splitter.
STEP_BITS = 12

_LOW = -(1 << 63)


@dataclass(frozen=True)
class _Range:
    """Keys that begin with the ``bits`` bits of ``start`` (as unsigned), and their bytes."""

    start: int
    bits: int
    bytes: int


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of the key, as a number in key order."""
    return F.call_function("shiftrightunsigned", F.col("key").bitwiseXOR(F.lit(_LOW)), F.lit(64 - bits))


def _histogram(rows: DataFrame, opened: list[_Range], bits: int) -> list[_Range]:
    """Exact bytes of every range of ``bits`` bits below the opened ones, counted in all partitions."""
    part = rows
    if opened:
        by_bits: dict[int, list[int]] = {}
        for r in opened:
            start = r.start >> (64 - r.bits)
            by_bits.setdefault(r.bits, []).append(start if start < 1 << 63 else start - (1 << 64))
        inside = F.lit(False)
        for b, starts in by_bits.items():
            inside = inside | _prefix(b).isin(starts)
        part = rows.where(inside)
    counted = part.groupBy(_prefix(bits).alias("at")).agg(F.sum("size").alias("bytes")).collect()
    return [_Range((r.at % (1 << 64)) << (64 - bits), bits, int(r.bytes)) for r in counted]


def _settle_splitters(rows: DataFrame, shards: int, tolerance: float) -> tuple[list[int], list[int]]:
    """Signed keys where the shards after the first begin, and keys that fill a shard alone.

    Only ranges around splitters not yet within tolerance are counted again, finer;
    the driver holds a few thousand counts at a time, however many rows there are.
    """
    ranges = sorted(_histogram(rows, [], STEP_BITS), key=lambda r: r.start)
    total = sum(r.bytes for r in ranges)
    while True:
        # A group of equal texts above a share takes a shard of its own; the rest share the others.
        alone: list[_Range] = []
        share = total / shards
        while len(alone) < shards - 1:
            more = [r for r in ranges if r.bits == 64 and r.bytes > share and r not in alone]
            if not more:
                break
            alone.append(max(more, key=lambda r: r.bytes))
            share = (total - sum(r.bytes for r in alone)) / (shards - len(alone))
        rest = [r for r in ranges if r not in alone]
        # Ranges that may still hide a group of that kind are opened too.
        opened = {r for r in rest if r.bits < 64 and r.bytes > share}
        splitters, below, edges = [], 0, [0]
        for r in rest:
            below += r.bytes
            edges.append(below)
        for k in range(1, shards - len(alone)):
            want = k * share
            i = bisect_right(edges, want) - 1  # the edge at or below the wanted one
            if i >= len(rest):
                splitters.append(1 << 64)
                continue
            near = i if want - edges[i] <= edges[i + 1] - want else i + 1
            if abs(edges[near] - want) > tolerance * share and rest[i].bits < 64:
                opened.add(rest[i])
            splitters.append(rest[near].start if near < len(rest) else 1 << 64)
        if not opened:
            return [s + _LOW for s in splitters], [r.start + _LOW for r in alone]
        depth = {b for b in (r.bits for r in opened)}
        for bits in sorted(depth):  # ranges of one depth are counted in one job
            group = [r for r in opened if r.bits == bits]
            ranges = [r for r in ranges if r not in group] + _histogram(rows, group, min(64, bits + STEP_BITS))
        ranges.sort(key=lambda r: r.start)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, payload: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the payload columns.

    Shards 0 to ``shards`` - 1 with sizes near equal (law ``bytes``); a row's size is
    its text's UTF-8 bytes plus one. Equal texts share their key and so their shard; a
    group of them larger than a share gets a shard of its own and the others share the
    rest. The key is a hash of the text, so no order of the input unbalances it.
    Slots count from 0 without a gap in key order, equal keys by ``doc_id``.

    The exact bytes below candidate boundaries are counted over all rows, again and
    finer only where a boundary misses its share; then rows move once, range-partitioned
    by shard, key and id, so that a large group of equal texts lies in many tasks.

    A null text counts as empty. Repeated rows have a slot each.
    """
    t = F.col("t")
    extra = [F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)]
    names = [f"_p{i}" for i in range(len(payload))]
    rows = settle(
        docs.select(ident().alias("id"), whole_text().alias("t"), *extra).select(
            "id", F.xxhash64(t).alias("key"), (F.octet_length(t) + 1).cast("bigint").alias("size"),
            F.crc32(t.cast("binary")).alias("crc"), *names), "shard-rows")
    splitters, alone = _settle_splitters(rows, shards, tolerance)
    shard = F.lit(0)
    for s in splitters:
        if s < 1 << 63:
            shard = shard + (F.col("key") >= F.lit(s)).cast("int")
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(k), shards - 1 - i).otherwise(shard)
    order = ["shard", "key", "id"]
    moved = settle(
        rows.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
        # Its high bits are the partition, its low ones the place of the row in it.
        .withColumn("seen", F.monotonically_increasing_id()), "shard-moved")
    part = F.call_function("shiftright", "seen", F.lit(33)).cast("int")
    runs = moved.groupBy("shard", part.alias("part")).agg(F.min("seen").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        runs.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shard-runs")
    return moved.withColumn("part", part).join(offsets, ["shard", "part"]).select(
        given_id("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("seen") - F.col("first") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)])
