"""Centroid clustering (exact integer k-means) over losslessly dictionary-encoded subvectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.llm.common import settle
from threatweave.session import local_table

DIMS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
# Neighbouring dimensions that make one subvector.
WIDTH = 2
# Vectors that share one set of dictionaries: what a task holds at a time.
CHUNK_ROWS = 1 << 16
# Distances worked out at once in a task.
CELLS = 1 << 22
# Larger components count as this: squared distances of 64 of them still fit a long.
LIMIT = 1 << 27


def kept_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: vectors of exactly ``dims`` finite components, each as integer ``floor(scale * x)``."""
    whole = (F.coalesce(F.size("embedding"), F.lit(-1)) == dims) & ~F.coalesce(F.exists("embedding", _odd), F.lit(True))

    def component(x: Column) -> Column:
        big = F.lit(float(scale)) * x.cast("double")
        return F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), big))).cast("int")

    return vectors.where(whole).select("vec_id", F.transform("embedding", component).alias("v"))


def _odd(x: Column) -> Column:
    # NaN is above every number in Spark's order.
    return x.isNull() | ~F.abs(x.cast("double")).between(0.0, 1.7976931348623157e308)


def subvector_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``v`` and, per row, which of them it is."""
    code = np.zeros(len(v), np.int64)
    for j in range(v.shape[1]):
        values, digit = np.unique(v[:, j], return_inverse=True)
        _, code = np.unique(code * len(values) + digit, return_inverse=True)
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code] = np.arange(len(v))
    return v[first], code


_CODED = "ids array<{kind}>, sizes array<int>, entries binary, codes binary"


def encode_vectors(kept: DataFrame, dims: int = DIMS, width: int = WIDTH, chunk: int = CHUNK_ROWS) -> DataFrame:
    """One row per chunk of vectors: their ids and, per block of ``width`` dimensions, a dictionary and codes.

    ``sizes`` has the distinct subvectors of each block, ``entries`` these subvectors
    (32-bit integers, block after block), ``codes`` every vector's code (32 bits, block
    after block). Decoding gives the vectors back; nothing is rounded. Dictionaries
    belong to a chunk, as a column file's dictionary pages do: encoding needs no
    shuffle and a chunk's dictionary cannot outgrow the chunk.
    """
    blocks = [slice(a, min(a + width, dims)) for a in range(0, dims, width)]

    def coded(held):
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        pairs = [subvector_codes(v[:, b]) for b in blocks]
        ids = t.column("vec_id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([[len(e) for e, _ in pairs]], pa.list_(pa.int32())),
             pa.array([b"".join(e.astype("<i4").tobytes() for e, _ in pairs)], pa.binary()),
             pa.array([b"".join(c.astype("<u4").tobytes() for _, c in pairs)], pa.binary())],
            names=["ids", "sizes", "entries", "codes"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == chunk:
                    yield coded(held)
                    held, n = [], 0
        if n:
            yield coded(held)

    return kept.mapInArrow(run, _CODED.format(kind=kept.schema["vec_id"].dataType.simpleString()))


def _decoded(batch: pa.RecordBatch, dims: int, width: int):
    """Per chunk: its ids and, per block, the block's dimensions, entries and codes."""
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        entries = np.frombuffer(batch.column("entries")[i].as_buffer(), "<i4").astype(np.int64)
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u4").reshape(-1, len(ids)).astype(np.int64)
        blocks, at = [], 0
        for b, size in enumerate(batch.column("sizes")[i].as_py()):
            cols = slice(b * width, min((b + 1) * width, dims))
            n = size * (cols.stop - cols.start)
            blocks.append((cols, entries[at:at + n].reshape(size, -1), codes[b]))
            at += n
        yield ids, blocks


def nearest(blocks: list, n: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smallest number of equals) and squared distance of a chunk's vectors.

    Every entry's distance to every centroid is worked out once; a vector adds up
    those of its codes.
    """
    tables = []
    for cols, entries, _ in blocks:
        d = np.zeros((len(entries), len(centroids)), np.int64)
        for j, dim in enumerate(range(cols.start, cols.stop)):
            d += (entries[:, j, None] - centroids[None, :, dim]) ** 2
        tables.append(d)
    best, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    step = max(1, CELLS // len(centroids))
    for a in range(0, n, step):
        total = tables[0][blocks[0][2][a:a + step]]
        for (_, _, codes), d in zip(blocks[1:], tables[1:]):
            total += d[codes[a:a + step]]
        best[a:a + step] = total.argmin(1)
        distance[a:a + step] = total.min(1)
    return best, distance


def _sums(coded: DataFrame, centroids: np.ndarray, dims: int, width: int) -> dict[int, tuple[int, dict[int, int]]]:
    """Per cluster its vectors' number and componentwise sums, at most ``clusters * dims`` rows in all."""

    def run(batches):
        for batch in batches:
            for ids, blocks in _decoded(batch, dims, width):
                best, _ = nearest(blocks, len(ids), centroids)
                count = np.bincount(best, minlength=len(centroids))
                sums = np.zeros((len(centroids), dims), np.int64)
                for cols, entries, codes in blocks:
                    # How often each cluster holds each entry, times the entry.
                    at, often = np.unique(best * len(entries) + codes, return_counts=True)
                    np.add.at(sums[:, cols], at // len(entries), often[:, None] * entries[at % len(entries)])
                full = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(full, dims).astype(np.int32)),
                     pa.array(np.tile(np.arange(dims, dtype=np.int32), len(full))),
                     pa.array(np.repeat(count[full], dims)), pa.array(sums[full].ravel())],
                    names=["cluster", "dim", "n", "s"])

    parts = coded.mapInArrow(run, "cluster int, dim int, n bigint, s bigint")
    # Decimals: a sum over all vectors may not fit a long.
    whole = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in whole.collect():
        out.setdefault(r["cluster"], (r["n"], {}))[1][r["dim"]] = int(r["s"])
    return out


def centroid_clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
    seed: str = SEED, width: int = WIDTH, chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors (columns ``vec_id``, ``embedding``) that are null, of another length or hold
    a null or non-finite component are left out; the others become integers
    ``floor(scale * x)``. The first centroids are the ``clusters`` vectors with the
    smallest SHA-256 of ``<seed>:<vec_id>``, fewer where there are fewer vectors. Each
    round assigns every vector to its nearest centroid (squared distance; the smaller
    number of equals) and replaces every centroid that has vectors by their
    componentwise floored mean; then vectors are assigned once more. All of it is exact:
    ``distance`` is the squared distance in integers, ``cluster_inertia`` and
    ``inertia`` its sums over the cluster and over all.

    Vectors are dictionary-encoded once, block of dimensions by block (see
    :func:`encode_vectors`), and written; a round works out each distinct subvector's
    distances to the centroids once and adds them up by code. Only centroids and their
    sums, ``clusters * dims`` numbers, reach the driver; no vector is shuffled.

    Repeated rows are vectors each; rows of one id are ordered by their components
    when they seed. A null id counts as an empty one. Components beyond 2**27 count as
    2**27, so that distances fit a long; an inertia that does not is null. No kept
    vector gives an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, scale)
    coded = settle(encode_vectors(kept, dims, width, chunk), "subvectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in seeds], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(seeds) else 0):
        centroids = centroids.copy()
        for cluster, (n, sums) in _sums(coded, centroids, dims, width).items():
            centroids[cluster] = [sums[d] // n for d in range(dims)]

    def assign(batches):
        for batch in batches:
            for ids, blocks in _decoded(batch, dims, width):
                best, distance = nearest(blocks, len(ids), centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    assigned = settle(coded.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    # At most one row per centroid.
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    told = local_table(spark, [
        (c, fits(inertia.get(c, 0)), fits(total), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
