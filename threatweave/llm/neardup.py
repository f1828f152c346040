"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatweave.llm.bpe import grouped
from threatweave.llm.common import given_id, ident, settle, tie_break, whole_text
from threatweave.llm.components import connected_components
from threatweave.llm.feistel import mix

WORDS = 4
PERCENT = 80
# A pair at the threshold shares no band with a chance of (1 - 0.8**4)**32, about 5e-8.
BANDS, ROWS = 32, 4
# Unfinished buckets are compared in blocks of so many documents, or shingles where these are more.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 18
_COLUMNS = 4096

_BLOCK = 1 << 21
_RNG = np.random.Generator(np.random.PCG64(97))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = _RNG.integers(1, 1 << 63, 1, dtype=np.uint64)[0] | np.uint64(1)
_SIGMA = _RNG.integers(1, 1 << 63, 1, dtype=np.uint64)[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _POWER, np.uint64)]))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of UTF-8 text, A-Z lower-cased; blocks end at a blank."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + _BLOCK
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and end < len(data):  # a word longer than a block
                end = min(len(data), end + _BLOCK)
                cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= 0 else len(data)
        raw = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        space = _SPACE[raw]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(start):
            word = np.cumsum(np.bincount(start, minlength=len(raw))) - 1
            place = np.arange(len(raw)) - start[np.maximum(word, 0)]
            place = np.where(space, 0, place)
            with np.errstate(over="ignore"):
                value = np.where(space, np.uint64(0), _BYTE[_LOWER[raw]] * _powers(int(place.max()))[place])
                hashes.append(mix(np.add.reduceat(value, start)))
            starts.append(start + at)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """Per text its sorted distinct ``k``-word shingles as 64-bit hashes.

    Fewer words than ``k``: the whole sequence as one; no word: none.
    """
    raw = [t.encode() for t in texts]
    begin = np.cumsum([0] + [len(b) + 1 for b in raw])
    start, word = _word_hashes(b"\n".join(raw))
    first = np.searchsorted(start, begin)  # each text's first word
    chain = word.copy()
    rolled = [chain]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            chain = mix(chain[:-1] * _STEP) ^ word[j:]
            rolled.append(chain)
    out = []
    for i in range(len(texts)):
        n = int(first[i + 1] - first[i])
        size = min(n, k)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        found = rolled[size - 1][first[i]: first[i + 1] - size + 1]
        out.append(np.unique(mix(found + np.uint64(size))))
    return out


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: ``size`` minima from two permutations of 32-bit numbers.

    The first scatters the shingles, the second is read at ``size`` circular shifts:
    coordinate j is the least of pi(sigma(x) + j mod 2**32).
    """
    x = (mix(shingles ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 256):  # a piece that stays in the cache
        m = shift + x[None, a:a + 256]
        m ^= m >> np.uint32(16)
        m *= np.uint32(0x85EBCA6B)
        m ^= m >> np.uint32(13)
        m *= np.uint32(0xC2B2AE35)
        m ^= m >> np.uint32(16)
        np.minimum(least, m.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of a signature."""
    part = least.astype(np.uint64).reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for j in range(part.shape[1]):
            key = mix(key * _STEP + part[:, j])
    return key.view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    """``id, version, n, f1, f2, bands`` per row: set size, 128-bit fingerprint of the set, band keys."""

    def run(batches):
        for b in grouped(batches, "text"):
            sets = shingle_sets(b.column("text").to_pylist())
            with np.errstate(over="ignore"):
                f1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                f2 = [int(mix(s ^ _STEP).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            bands = [band_keys(signature(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("version"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "version", "n", "f1", "f2", "bands"])

    return docs.select(ident().alias("id"), whole_text().alias("text")).select(
        "id", F.xxhash64("text").alias("version"), "text",
    ).mapInArrow(run, "id bigint, version bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` (sorted 64-bit hashes as bytes) of the documents in ``nodes``."""

    def run(batches):
        for b in grouped(batches, "text"):
            sets = shingle_sets(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("version"), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "version", "shingles"])

    texts = docs.select(ident().alias("id"), whole_text().alias("text")).withColumn("version", F.xxhash64("text"))
    wanted = nodes.select("node.id", "node.version").distinct()
    return (
        texts.join(wanted, ["id", "version"], "left_semi").mapInArrow(
            run, "id bigint, version bigint, shingles binary")
        .dropDuplicates(["id", "version"]).select(F.struct("id", "version").alias("node"), "shingles")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose whole sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield b.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    side = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    node = "struct<id:bigint,version:bigint>"
    return side.select("u", "v", "x", "y").mapInArrow(run, f"u {node}, v {node}")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``id, version, n_shingles, component_id, kept``.

    Documents are linked when their shingle sets (words with A-Z lower-cased) have a
    Jaccard similarity of ``percent`` % or more, computed on the whole sets.
    ``component_id`` is the smallest ``doc_id`` reachable over links.

    1. Equal sets become one class, known by its smallest document. 2. Classes that
    share a band lie in one bucket. 3. In every bucket a leader, the member sharing
    most bands with others, is compared with all members. While the members agree, a
    bucket of any size is one component after one comparison per member. 4. Where they
    don't, every member outside the bucket's largest component is compared with all
    members of other components, block against block of bounded size; a block pair
    returns one link per document and component it meets. So every pair that shares a
    band is compared or already connected, and no list of pairs is made.

    Texts without words have no set and no links. A null ``doc_id`` is the smallest
    id; repeated rows are one class.
    """
    rows = settle(_signatures(docs), "signatures")
    node = F.struct("id", "version")
    classes = settle(
        rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(node).alias("node")), "set-classes")
    heads = rows.where("n > 0").withColumn("node", node).join(
        classes.select("node", F.lit(True).alias("head")), "node").dropDuplicates(["node"])
    banded = heads.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = settle(
        banded.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1"), "shared-bands")
    buckets = settle(banded.join(shared, ["band", "key"]), "buckets")
    sets = settle(_sets(docs, buckets.select("node")), "shingle-sets")
    leaders = settle(_leaders(buckets), "leaders")
    comps = _merged(_confirmed(settle(_leader_pairs(buckets, leaders, percent), "pairs"), sets, percent), None)
    rest = settle(_unfinished(buckets, leaders, comps), "unfinished-buckets")
    if not rest.isEmpty():
        comps = _merged(_block_links(rest, sets, percent), comps)
    labelled = settle(classes.join(comps, "node", "left").select(
        "f1", "f2", "n", F.coalesce("comp.id", "node.id").alias("component")), "labelled-classes")
    return rows.join(labelled, ["f1", "f2", "n"], "left").select(
        "id", "version", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"),
    ).withColumn("kept", F.col("id") == F.col("component"))


def _merged(links: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Components of the new links and of the old components, one star for each of these."""
    if comps is not None:
        links = links.unionByName(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")))
    return settle(connected_components(links), "components")


def _leaders(buckets: DataFrame) -> DataFrame:
    """``band, key, leader, ln``: in every bucket the member that meets most others in its bands."""
    weight = settle(buckets.groupBy("node").agg(F.sum("members").alias("weight")), "weights")
    first = F.struct(-F.col("weight"), "node", "n")
    return buckets.join(weight, "node").groupBy("band", "key").agg(F.min(first).alias("m")).select(
        "band", "key", F.col("m.node").alias("leader"), F.col("m.n").alias("ln"))


def _leader_pairs(buckets: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """``u, v``: members and their leader, where their sizes allow a link."""
    fits = 100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")
    return (
        buckets.join(leaders, ["band", "key"]).where(fits & (F.col("node") != F.col("leader")))
        .select(F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")).distinct()
    )


def _unfinished(buckets: DataFrame, leaders: DataFrame, comps: DataFrame) -> DataFrame:
    """``band, key, node, n, comp, most``: members of buckets whose members but the leader lie in more than
    one component; ``most`` is the component most of them lie in."""
    marked = settle(buckets.join(comps, "node", "left").select(
        "band", "key", "node", "n", F.coalesce("comp", "node").alias("comp")), "marked-members")
    sizes = marked.join(leaders.select("band", "key", "leader"), ["band", "key"]).where("node != leader").groupBy(
        "band", "key", "comp").agg(F.count("*").alias("size"))
    open_ = settle(sizes.groupBy("band", "key").agg(
        F.count("*").alias("parts"), F.max(F.struct("size", "comp")).alias("m")).where("parts > 1").select(
            "band", "key", F.col("m.comp").alias("most")), "open-buckets")
    return marked.join(open_, ["band", "key"])


def _block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between components within the unfinished buckets, by blocks of whole sets."""
    asks = F.col("comp") != F.col("most")
    blocks = lambda docs, shingles: F.ceil(F.greatest(
        docs / BLOCK_DOCS, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")
    totals = settle(rest.groupBy("band", "key").agg(
        blocks(F.count_if(asks), F.coalesce(F.sum(F.when(asks, F.col("n"))), F.lit(0))).alias("ask_blocks"),
        blocks(F.count("*"), F.sum("n")).alias("all_blocks")), "block-counts")
    rows = rest.join(totals, ["band", "key"])

    def dealt(role: bool, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        side = rows.where(asks) if role else rows
        return side.select(
            "band", "key", F.lit(role).alias("asks"), "node", "comp", "n",
            F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    both = dealt(True, "ask_blocks", "all_blocks", "ask_block", "all_block").unionByName(
        dealt(False, "all_blocks", "ask_blocks", "all_block", "ask_block"))
    node = "struct<id:bigint,version:bigint>"

    def run(table):
        found = _compare_blocks(table, percent)
        return pa.table({"u": found[0], "v": found[1]})

    full = both.join(sets, "node")
    return full.groupBy("band", "key", "ask_block", "all_block").applyInArrow(run, f"u {node}, v {node}")


def _compare_blocks(table: pa.Table, percent: int) -> tuple[pa.Array, pa.Array]:
    """One link per asking document and foreign component among the documents of a block pair."""
    asks = table.column("asks").to_numpy()
    ask, all_ = np.flatnonzero(asks), np.flatnonzero(~asks)
    nodes = table.column("node").combine_chunks()
    if not len(ask) or not len(all_):
        return nodes.slice(0, 0), nodes.slice(0, 0)
    parts = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    comp = {}
    label = np.array([comp.setdefault((c["id"], c["version"]), len(comp)) for c in table.column("comp").to_pylist()])
    size = np.array([len(p) for p in parts])

    def side(rows):
        return np.concatenate([parts[i] for i in rows]), np.repeat(np.arange(len(rows)), size[rows])

    (left, of_left), (right, of_right) = side(ask), side(all_)
    common = np.intersect1d(left, right)
    both = np.zeros((len(ask), len(all_)), np.float32)

    def places(values, owner):
        at = np.searchsorted(common, values)
        hit = common[np.minimum(at, len(common) - 1)] == values
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    if len(common):
        (at_left, of_left), (at_right, of_right) = places(left, of_left), places(right, of_right)
        for a in range(0, len(common), _COLUMNS):  # membership matrices, some columns at a time
            width = min(_COLUMNS, len(common) - a)
            p, q = np.zeros((len(ask), width), np.float32), np.zeros((len(all_), width), np.float32)
            for m, at, owner in ((p, at_left, of_left), (q, at_right, of_right)):
                lo, hi = np.searchsorted(at, [a, a + width])
                m[owner[lo:hi], at[lo:hi] - a] = 1
            both += p @ q.T
    inter = both.astype(np.int64)
    union = size[ask][:, None] + size[all_][None, :] - inter
    hit = (100 * inter >= percent * union) & (label[ask][:, None] != label[all_][None, :])
    x, y = np.nonzero(hit)
    if len(x):
        _, first = np.unique(x * len(comp) + label[all_][y], return_index=True)
        x, y = x[first], y[first]
    return nodes.take(pa.array(ask[x])), nodes.take(pa.array(all_[y]))


def apply_near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of ``docs`` that stay: the smallest id of every component, once.

    Of rows that repeat that id and text, reruns keep the same one.
    """
    kept = near_duplicates(docs, percent).where("kept").select(
        F.col("id").alias("tw$id"), F.col("version").alias("tw$version")).distinct()
    keyed = docs.withColumns({"tw$id": ident(), "tw$version": F.xxhash64(whole_text()), "tw$tie": tie_break(docs)}).join(
        kept, ["tw$id", "tw$version"])
    first = F.row_number().over(W.partitionBy("tw$id", "tw$version").orderBy("tw$tie"))
    return keyed.withColumn("tw$twin", first).where(F.col("tw$twin") == 1).select(*docs.columns)
