"""Mixing sources to target weights: exact block quotas, split down a tree of output shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from threatweave.llm.common import WORD, given_id, ident, settle, tie_break, whole_text
from threatweave.llm.feistel import mix, permute
from threatweave.session import local_table

SEED = 20240817
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SHARDS = 16
# A source is dealt in about so many blocks, of so many words at most: its share is met to a thousandth.
BLOCKS = 1000
MAX_BLOCK = 1 << 16
# Rows of one source are numbered in so many buckets side by side.
BUCKETS = 1024

_DRAW = pa.struct([("pass", pa.int32()), ("shard", pa.int32()), ("place", pa.int64()),
                   ("from_word", pa.int64()), ("n_words", pa.int64())])


def mix_targets(sizes: dict, weights=WEIGHTS, max_rate: int = MAX_RATE) -> dict[str | None, float]:
    """Words each source shall give, by water filling.

    Sources in code point order, null last, take the weights in turn and share the sum
    of all sizes; what exceeds ``max_rate`` times a source's size goes to the others
    by weight, again until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * left > max_rate * sizes[s] * total}
        if not full:
            target |= {s: weight[s] * left / total for s in free}
            break
        target |= {s: float(max_rate * sizes[s]) for s in full}
        left -= sum(max_rate * sizes[s] for s in full)
        free -= full
    return target


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws per source and shard; rows sum to ``quotas``, columns differ by one at most.

    Each node of the tree deals its draws to its two halves by one multivariate
    hypergeometric sample, as if all draws had been shuffled and cut.
    """
    out = np.zeros((len(quotas), shards), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))

    def deal(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = left
            return
        mid = (lo + hi) // 2
        part = rng.multivariate_hypergeometric(left, int(left.sum()) * (mid - lo) // (hi - lo), method="marginals")
        deal(part, lo, mid)
        deal(left - part, mid, hi)

    if len(quotas):
        deal(quotas.astype(np.int64), 0, shards)
    return out


def _plan(spark, totals: list, shards: int, seed: int, weights, max_rate: int) -> DataFrame:
    """One row per source: its target, blocks, and where each shard's draws of it begin."""
    sizes = {r.source: int(r.words) for r in totals}
    target = mix_targets(sizes, weights, max_rate)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    block = {s: min(MAX_BLOCK, max(1, sizes[s] // BLOCKS)) for s in names}
    blocks = {s: -(-sizes[s] // block[s]) for s in names}
    quota = [min(max_rate * blocks[s], round(target[s] / block[s])) for s in names]
    dealt = split_quotas(np.array(quota, np.int64), shards, seed)
    starts = np.cumsum(dealt, axis=1) - dealt
    keys = mix(np.uint64(seed) + np.arange(len(names), dtype=np.uint64)) >> np.uint64(1)
    return local_table(spark, [
        (_source_key(s), sizes[s], target[s], block[s], blocks[s], q, int(k), [int(x) for x in row])
        for s, q, k, row in zip(names, quota, keys, starts)
    ], "skey string, source_size bigint, target double, block bigint, blocks bigint, quota bigint, "
       "source_seed bigint, starts array<bigint>")


def _source_key(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def _draws(batches):
    """Which blocks of each document are drawn, how often, and to which shard and place."""
    for b in batches:
        col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in
               ("size", "at", "block", "blocks", "quota", "source_seed")}
        size, at, block = col["size"], col["at"], col["block"]
        first = at // block
        n_blocks = np.where(size > 0, (at + size - 1) // block - first + 1, 0)
        row = np.repeat(np.arange(len(size)), n_blocks)
        blk = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = np.maximum(at[row], blk * block[row]) - at[row]
        words = np.minimum(at[row] + size[row], (blk + 1) * block[row]) - at[row] - begin
        n, quota, seed = col["blocks"][row], col["quota"][row], col["source_seed"][row].astype(np.uint64)
        found = []
        for p in range(int(np.max(-(-quota // np.maximum(n, 1)), initial=0))):
            draw = p * n + permute(blk, n, seed + np.uint64(p)).astype(np.int64)
            hit = np.flatnonzero(draw < quota)
            found.append((row[hit], np.full(len(hit), p), blk[hit], draw[hit], begin[hit], words[hit], seed[hit]))
        row, p, blk, draw, begin, words, seed = (
            np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 7
        order = np.lexsort((blk, p, row))
        row, p, draw, begin, words, seed = (x[order] for x in (row, p, draw, begin, words, seed))
        shard = np.zeros(len(row), np.int64)
        starts = b.column("starts")
        for s in np.unique(seed):
            mine = np.flatnonzero(seed == s)
            shard[mine] = np.searchsorted(np.array(starts[int(row[mine[0]])].as_py()), draw[mine], side="right") - 1
        place = (mix(seed.astype(np.uint64) ^ mix(draw.astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
        lists = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32),
            pa.StructArray.from_arrays(
                [pa.array(p, pa.int32()), pa.array(shard, pa.int32()), pa.array(place, pa.int64()),
                 pa.array(begin, pa.int64()), pa.array(words, pa.int64())], fields=list(_DRAW)))
        keep = ["id", "version", "twin", "source", "size", "source_size", "target"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [lists], names=[*keep, "draws"])


def _named_source(source: Column) -> Column:
    """A source to group and join by; a missing one is a source too."""
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source.cast("string")))


def mix_documents(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, weights=WEIGHTS, max_rate: int = MAX_RATE,
) -> DataFrame:
    """Per row of ``docs`` what the mix takes of it.

    Returns ``id, version, twin`` (the row), ``source, size`` (its words), ``source_size,
    target`` and ``draws``: for every block drawn its pass, shard, place (sort by it to
    shuffle a shard), first word in the document and number of words.

    The words of a source lie in one stream, cut into blocks of equal size. A keyed
    permutation orders the blocks of each pass; the quota takes whole passes and the
    head of one more, so blocks are disjoint within a pass and no word is taken more
    than ``max_rate`` times. Shards take consecutive draws, as many as the splitting
    tree gives them.

    Documents without words give nothing. A null source is a source. Repeated rows
    each have their own place in the stream (``twin`` counts them). Reruns agree.
    Only one row per source passes through the driver.
    """
    spark = docs.sparkSession
    skey = _named_source(F.col("source"))
    t = F.col("t")
    rows = settle(
        docs.select(ident().alias("id"), F.col("source").cast("string").alias("source"), whole_text().alias("t"))
        .select("id", F.xxhash64(t).alias("version"), "source", skey.alias("skey"),
                F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
                F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("size")), "mix-sizes")
    buckets = rows.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words"))
    totals = buckets.groupBy("source").agg(F.sum("words").alias("words")).collect()
    plan = _plan(spark, totals, shards, seed, weights, max_rate)
    before = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = settle(
        buckets.select("skey", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        .join(plan, "skey"), "mix-buckets")
    inside = W.partitionBy("skey", "bucket").orderBy("id", "version", "size").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    twin = W.partitionBy("skey", "bucket", "id", "version").orderBy("size")
    placed = rows.select(
        "id", "version", "source", "skey", "bucket", "size", F.sum("size").over(inside).alias("upto"),
        F.row_number().over(twin).alias("twin"),
    ).join(bases, ["skey", "bucket"]).withColumn("at", F.col("base") + F.col("upto") - F.col("size"))
    return placed.select(
        "id", "version", "twin", "source", "size", "source_size", "target", "at", "block", "blocks", "quota",
        "source_seed", "starts",
    ).mapInArrow(_draws, "id bigint, version bigint, twin int, source string, size bigint, source_size bigint, "
                         "target double, draws array<struct<pass:int,shard:int,place:bigint,from_word:bigint,"
                         "n_words:bigint>>")


def taken_words(draws: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of :func:`mix_documents`."""
    return draws.select(
        given_id("id").alias("doc_id"), "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["n_words"]).alias("taken"))


def apply_mixing(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per document and pass.

    A document taken whole keeps its text; of one taken in part, runs of drawn words
    stay, joined by line ends. A row lies where the first of its blocks was dealt: rows
    are grouped by shard and place, a shard over several files. ``n_chars``, where
    present, follows the text. Repeated rows are drawn each by themselves, within their
    source, in an order that reruns keep.
    """
    draws = mix_documents(docs, shards, **how).where(F.size("draws") > 0).select(
        _named_source(F.col("source")).alias("tw$source"), F.col("id").alias("tw$id"), F.col("version").alias("tw$version"),
        F.col("twin").alias("tw$twin"),
        F.col("size").alias("tw$size"), F.col("draws").alias("tw$draws"))
    row = ["tw$source", "tw$id", "tw$version"]
    keyed = docs.withColumns({
        "tw$source": _named_source(F.col("source")), "tw$id": ident(), "tw$version": F.xxhash64(whole_text()), "tw$tie": tie_break(docs)})
    keyed = keyed.withColumn("tw$twin", F.row_number().over(W.partitionBy(*row).orderBy("tw$tie")))
    names = docs.columns
    word = regex.compile(WORD)

    def run(batches):
        for b in batches:
            rows, texts, shard, place = [], [], [], []
            for i, (text, size, drawn) in enumerate(zip(
                    b.column("text").to_pylist(), b.column("tw$size").to_pylist(), b.column("tw$draws").to_pylist())):
                spans = None
                for p in range(drawn[-1]["pass"] + 1):
                    mine = [d for d in drawn if d["pass"] == p]
                    if not mine:
                        continue
                    if sum(d["n_words"] for d in mine) < size:
                        spans = spans or [m.span() for m in word.finditer(text)]
                        runs = []
                        for d in mine:
                            end = d["from_word"] + d["n_words"]
                            if runs and runs[-1][1] == d["from_word"]:
                                runs[-1][1] = end
                            else:
                                runs.append([d["from_word"], end])
                        texts.append("\n".join(text[spans[a][0]:spans[z - 1][1]] for a, z in runs))
                    else:
                        texts.append(text)
                    rows.append(i)
                    shard.append(mine[0]["shard"])
                    place.append(mine[0]["place"])
            whole = b.select(names).take(pa.array(rows, pa.int64()))
            made = {"text": pa.array(texts, whole.schema.field("text").type)}
            if "n_chars" in names:
                made["n_chars"] = pa.array([len(t) for t in texts], whole.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(
                [made.get(n, whole.column(n)) for n in names]
                + [pa.array(shard, pa.int32()), pa.array(place, pa.int64())], names=[*names, "tw$shard", "tw$place"])

    schema = StructType([*docs.schema, StructField("tw$shard", IntegerType()), StructField("tw$place", LongType())])
    mixed = keyed.join(draws, [*row, "tw$twin"]).select(*names, "tw$size", "tw$draws").mapInArrow(
        run, schema)
    return (
        mixed.repartition("tw$shard", F.call_function("shiftright", "tw$place", F.lit(43)))
        .sortWithinPartitions("tw$shard", "tw$place").select(*names)
    )
