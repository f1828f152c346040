"""Training-order materialisation: token sequences at permuted slots in fixed-stride binary shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatweave.llm.bpe import codec, grouped
from threatweave.llm.common import settle
from threatweave.llm.feistel import permute

SEED = 20240818
SEQ_TOKENS = 512
SHARD_RECORDS = 1 << 16
END = "<|endoftext|>"
MAX_ID = (1 << 16) - 1
# Records in one Arrow batch, and read back at once.
BATCH_RECORDS = 4096
CHANGED = "documents came in other tasks than when their lengths were summed; write them down first"
# For the number of shards only.
BYTES_PER_TOKEN = 4


def padded(ids: list[bytes], end: int, seq_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text, its end token included, and all texts' records as rows of 16-bit ids."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    if max(int(flat.max(initial=0)), end) > MAX_ID:
        raise ValueError(f"token id {max(int(flat.max(initial=0)), end)} does not fit 16 bits")
    n = np.array([len(x) // 4 for x in ids], np.int64)
    count = n // seq_tokens + 1
    at = (np.cumsum(count) - count) * seq_tokens - (np.cumsum(n) - n)
    records = np.full(int(count.sum()) * seq_tokens, end, "<u2")
    records[np.arange(len(flat)) + np.repeat(at, n)] = flat
    return n + 1, records.reshape(-1, seq_tokens)


def _numbers(slim: DataFrame, seq_tokens: int) -> tuple[int, int, int]:
    """Tasks that read ``slim``, a bound on the records of any of them, and a guess at all records.

    Native, from byte lengths alone. Normalising makes at most three times as many bytes of a
    text, a byte makes at most one token, and every text has one end token.
    """
    per_task = slim.select(F.spark_partition_id().alias("task"), F.octet_length("text").cast("bigint").alias("n")).groupBy("task").agg(
        F.sum(F.floor(3 * F.col("n") / seq_tokens) + 1).alias("bound"),
        F.sum(F.ceil((F.col("n") + 1) / (BYTES_PER_TOKEN * seq_tokens))).alias("guess"))
    r = per_task.agg(F.max("task"), F.max("bound"), F.sum("guess")).first()
    return (0, 0, 0) if r[0] is None else (r[0] + 1, r[1], r[2])


def _sequences(slim: DataFrame, path: str, seq_tokens: int, tasks: int, bound: int, seed: int) -> DataFrame:
    """``place, doc_id, part, n_tokens, record``: every text's ids and an end token, cut into padded records."""

    def run(batches):
        task = TaskContext.get().partitionId()
        coder = codec(path, decodes=False)
        end = coder.special[END]
        nth = 0
        for b in grouped(batches, "text"):
            n, records = padded(coder.encode_ids(b.column("text").to_pylist()), end, seq_tokens)
            count = -(-n // seq_tokens)
            doc = np.repeat(np.arange(len(n)), count)
            part = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            n_tokens = np.minimum(seq_tokens, n[doc] - part * seq_tokens)
            number = task * bound + nth + np.arange(len(doc))
            nth += len(doc)
            if task >= tasks or nth > bound:
                raise RuntimeError(CHANGED)
            place = permute(number, tasks * bound, seed).astype(np.int64)
            for k in range(0, len(doc), BATCH_RECORDS):
                cut = slice(k, k + BATCH_RECORDS)
                size = len(doc[cut])
                offsets = np.arange(size + 1, dtype=np.int32) * (2 * seq_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[cut]), b.column("doc_id").take(pa.array(doc[cut])), pa.array(part[cut], pa.int32()),
                     pa.array(n_tokens[cut], pa.int32()), pa.Array.from_buffers(
                         pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(records[cut].tobytes())])],
                    names=["place", "doc_id", "part", "n_tokens", "record"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"place bigint, doc_id {kind}, part int, n_tokens int, record binary")


def training_order(
    docs: DataFrame, path: str, seq_tokens: int = SEQ_TOKENS, shard_records: int = SHARD_RECORDS, seed: int = SEED,
) -> DataFrame:
    """All token sequences of ``docs`` in training order.

    Returns ``place, shard, doc_id, part, n_tokens, record``, one partition per shard,
    sorted by place. A text's ids (16 bits, little-endian) and one end token are cut
    into records of ``seq_tokens``; the last is filled up with end tokens (``n_tokens``
    does not count these).

    Texts are encoded once, and records move once, to their shards. A task numbers its
    records from its own multiple of a bound that byte lengths give before anything is
    encoded; sequence i goes to place P(i), P a keyed Feistel permutation with
    cycle-walking of all numbers below the number of tasks times that bound. Records
    are a random subset of these places, equal ranges of places the shards, so shards
    are near equal: about ``shard_records`` records each at four bytes a token.
    :func:`write_order` closes the gaps between places.

    A null or empty text is one record that only ends. Very long texts are just many
    records. Repeated rows have their own records. An id above 16 bits is an error.
    ``docs`` has to come in the same tasks both when lengths are summed and when texts
    are encoded, as a table does; a task with more records than its bound stops the job.
    """
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks, bound, guess = _numbers(slim, seq_tokens)
    shards = max(1, -(-guess // shard_records))
    # Places per shard, rounded up: the last shard's range may be shorter.
    width = max(1, -(-tasks * bound // shards))
    placed = _sequences(slim, path, seq_tokens, tasks, bound, seed)
    return placed.withColumn("shard", F.floor(F.col("place") / width).cast("int")).repartitionById(
        shards, F.col("shard")).sortWithinPartitions("place").select(
        "place", "shard", "doc_id", "part", "n_tokens", "record")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _written(ordered: DataFrame, folder: str, seq_tokens: int) -> DataFrame:
    """Write one raw file per shard and tell its rows: ``shard, nth, doc_id, part, n_tokens, record_sha256``."""
    stride = 2 * seq_tokens

    def told(store, name, shard, rows):
        rows = pa.Table.from_batches(rows).combine_chunks()
        size = store.get_file_info(name).size
        if size != rows.num_rows * stride:
            raise RuntimeError(f"{name} holds {size} bytes for {rows.num_rows} records")
        with store.open_input_stream(name) as f:
            for k in range(0, rows.num_rows, BATCH_RECORDS):
                part = rows.slice(k, BATCH_RECORDS)
                raw = memoryview(f.read(part.num_rows * stride))
                digests = [hashlib.sha256(raw[a:a + stride]).hexdigest() for a in range(0, len(raw), stride)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(digests), shard, np.int32)), pa.array(np.arange(k, k + len(digests), dtype=np.int64)),
                     *[part.column(n).combine_chunks() for n in ("doc_id", "part", "n_tokens")], pa.array(digests)],
                    names=["shard", "nth", "doc_id", "part", "n_tokens", "record_sha256"])

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, temporary, stream, rows = None, None, None, []

        def finish():
            stream.close()
            store.move(temporary, f"{root}/{shard_name(shard)}")
            return told(store, f"{root}/{shard_name(shard)}", shard, rows)

        for b in batches:
            shards = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if shards[a] != shard:
                    if stream is not None:
                        yield from finish()
                    shard, rows = int(shards[a]), []
                    temporary = f"{root}/.{shard_name(shard)}-{np.random.default_rng().integers(1 << 62):x}"
                    stream = store.open_output_stream(temporary)
                mine = b.slice(a, z - a)
                stream.write(b"".join(mine.column("record").to_pylist()))
                rows.append(mine.select(["doc_id", "part", "n_tokens"]))
        if stream is not None:
            yield from finish()

    kind = ordered.schema["doc_id"].dataType.simpleString()
    return ordered.sortWithinPartitions("place").select("shard", "doc_id", "part", "n_tokens", "record").mapInArrow(
        run, f"shard int, nth bigint, doc_id {kind}, part int, n_tokens int, record_sha256 string")


def write_order(ordered: DataFrame, folder: str, seq_tokens: int = SEQ_TOKENS) -> DataFrame:
    """Write the shards of :func:`training_order`, now, and tell what they hold.

    Returns ``slot, shard, byte_offset, doc_id, part, n_tokens, record_sha256, file``.
    Slots are gapless: a shard's begin where those of the shards before it end, which one
    small table of records per shard tells; the sizes of the files tell the same to
    :func:`read_slots`. A shard is read again when its file has its name; the digests
    come from the file.

    A task writes its shard under a name of its own and renames it when complete, so a
    task that is lost or run twice leaves the same file. ``folder`` is a URI all
    executors reach. Without documents there are no rows and no files.
    """
    rows = settle(_written(ordered, folder, seq_tokens), "training-order")
    # One row per shard: the running sum over them passes one task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(rows.groupBy("shard").agg(F.count("*").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "training-starts")
    return rows.join(starts, "shard").select(
        (F.col("first") + F.col("nth")).alias("slot"), "shard", (F.col("nth") * (2 * seq_tokens)).alias("byte_offset"),
        "doc_id", "part", "n_tokens", "record_sha256",
        F.format_string(f"{folder.replace('%', '%%')}/shard-%08d.bin", "shard").alias("file"))


def read_slots(folder: str, first: int, count: int, seq_tokens: int = SEQ_TOKENS):
    """Records ``first`` to ``first + count - 1`` as arrays of ids: one seek per shard, then sequential.

    The folder is listed once; the sizes of its files tell which slots they hold.
    """
    store, root = pafs.FileSystem.from_uri(folder)
    stride = 2 * seq_tokens
    files = sorted(store.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda f: f.base_name)
    start = 0
    for info in files:
        if info.base_name.startswith("."):
            continue
        end = start + info.size // stride
        if end > first and start < first + count:
            with store.open_input_file(info.path) as f:
                f.seek((max(first, start) - start) * stride)
                for _ in range(min(end, first + count) - max(first, start)):
                    yield np.frombuffer(f.read(stride), "<u2")
        start = end
