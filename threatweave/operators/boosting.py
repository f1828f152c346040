"""Histogram gradient boosting for several classes at once.

Features become bytes (bins between quantiles) once. A boosting round grows one tree per
class, all classes level by level together: a job sums gradients per (class, node,
feature, bin), deals the sums by feature and finds the best split of each node where they
meet. Of two siblings the smaller one is summed; the other has what it leaves of the sums of
their parent, which stay where they met. Nodes of few rows are dealt evenly over tasks that get their rows and finish them by
the same rule, so deep levels need no passes of their own. The driver holds trees; at most
one row per open node and task comes back to it.

Sums are whole numbers, so trees do not depend on how rows are dealt or on retried tasks.
The rows of a round's jobs are chunks of NumPy columns in RDDs: a job of these starts in
about half the time of one planned from a DataFrame, and a tree's jobs are many and short.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatweave.session import local_table, shared_dir

# The settings of the original's model.
ROUNDS, RATE, DEPTH, LEAVES, MIN_ROWS = 220, 0.08, 8, 31, 30
BINS = 255
MISSING = 255
# Gradients and hessians are counted in units of 2**-24.
UNIT = float(1 << 24)
# A node whose rows fit so many bytes (one a feature, and 8) is finished by one task: a tree
# of it takes as long as three to five of the jobs that a level of it would need each.
NODE_BYTES = 1 << 26
# Rows that a task handles at once, and rounds after which scores are written down.
CHUNK_ROWS = 1 << 15
REFRESH = 10
# Rows whose sums of hessians and counts fit one double together: whole numbers below 2**53.
EXACT_ROWS = 1 << 15
# Sums that a task holds before it hands them on: 24 bytes each.
HELD_SUMS = 1 << 22


def quantile_cuts(df: DataFrame, bins: int = BINS, features: str = "features") -> list[list[float]]:
    """Per feature the values that end its bins, rising: at most ``bins - 1`` of them.

    One pass over one value per row and feature, combined before the shuffle. Missing
    and NaN values take no part.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = (
        df.select(F.posexplode(features).alias("f", "x")).select("f", F.col("x").cast("double").alias("x"))
        .filter(F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy("f").agg(F.percentile_approx("x", shares, 10000).alias("cuts"), F.max("x").alias("top"))
    )
    # One row per feature. A cut at the largest value would leave nothing above it.
    cuts = {r["f"]: sorted({c for c in r["cuts"] if c < r["top"]}) for r in found.collect()}
    return [cuts.get(f, []) for f in range(max(cuts, default=-1) + 1)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Columns of bins for rows of values, one byte each: bin b is above cut b - 1 and not above cut b; NaN has a bin of its own."""
    out = np.empty(x.shape[::-1], np.uint8)
    for j, c in enumerate(cuts):
        out[j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(c, x[:, j], "left"))
    return out


@dataclass
class Tree:
    """Nodes by number, the root first: inner ones with feature, bin and children, leaves with a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, b: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, b, a, a + 1
        for _ in range(2):
            self.feature.append(-1), self.bin.append(0), self.left.append(0), self.right.append(0), self.value.append(0.0)
        return a, a + 1

    def rows_of(self, columns: np.ndarray, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves (those wanted) with the numbers of their rows, rising: at most its bin goes left, above it and missing go right."""
        needed = [wanted is None or node in wanted for node in range(len(self.feature))]
        for node in reversed(range(len(needed))):  # children have higher numbers
            if self.feature[node] >= 0:
                needed[node] = needed[self.left[node]] or needed[self.right[node]]
        todo = [(0, np.arange(columns.shape[1]))]
        while todo:
            node, rows = todo.pop()
            if not needed[node] or not len(rows):
                continue
            f = self.feature[node]
            if f < 0:
                yield node, rows
                continue
            low = (columns[f] if node == 0 else columns[f].take(rows)) <= self.bin[node]
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per histogram (row; columns are bins) the gain of its best split and the bin that ends the left side.

    Both sides keep ``min_rows``; the lowest bin of equals. -inf where there is none.
    """
    gl, hl, nl = (np.cumsum(v, axis=1) for v in (g, h, n))
    gt, ht, nt = (v[:, -1:] for v in (gl, hl, nl))
    gl, hl, nl = (v[:, :-1] for v in (gl, hl, nl))
    ok = (nl >= min_rows) & (nt - nl >= min_rows) & (hl > 0) & (ht - hl > 0)

    def part(a, b):
        return np.divide((a / UNIT) ** 2, b / UNIT, out=np.zeros(a.shape), where=b > 0)

    gain = np.where(ok, part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht), -np.inf)
    at = gain.argmax(1)
    return gain[np.arange(len(gain)), at], at


def histograms(columns: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray | None = None, places: int = 1) -> np.ndarray:
    """Sums of gradients, hessians and rows by (feature, place, bin) over these rows.

    ``g``, ``h`` and ``at`` (each row's place) go with ``rows``. A pass takes a row's three
    terms at once, as one complex number, over so many features that its cells stay in the cache.
    """
    width, size = len(columns), places * 256
    out = np.zeros((3, width, size), np.int64)
    everything = places == 1 and len(rows) == columns.shape[1]
    for a in range(0, len(rows), EXACT_ROWS):
        some = rows[a:a + EXACT_ROWS]
        terms = g[a:a + EXACT_ROWS] + 1j * (h[a:a + EXACT_ROWS] * (EXACT_ROWS + 1.0) + 1.0)
        step = max(1, min(width, (EXACT_ROWS >> 1) // len(some)))
        terms = np.tile(terms, step)
        sums = np.zeros(width * size, complex)
        for f in range(0, width, step):
            block = columns[f:f + step, a:a + EXACT_ROWS] if everything else columns[f:f + step].take(some, 1)
            cells = block + (np.arange(len(block)) * size)[:, None]
            if places > 1:
                cells += at[a:a + EXACT_ROWS] * 256
            np.add.at(sums[f * size:], cells.ravel(), terms[:cells.size])
        sums = sums.reshape(width, size)
        out[0] += sums.real.astype(np.int64)
        more, count = np.divmod(sums.imag.astype(np.int64), EXACT_ROWS + 1)
        out[1] += more
        out[2] += count
    return out.reshape(3, width, places, 256)


def _chunks(df: DataFrame, labels: list[str], cuts: list[np.ndarray], base: np.ndarray, label: str, features: str) -> RDD:
    """Rows of ``df`` in chunks: columns of bins, class numbers and a row of starting scores each."""
    rank = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    width = len(cuts)

    def told(held):
        bins, y = (np.concatenate(v, -1) for v in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array([len(y)], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())],
            names=["n", "bins", "y"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(a, CHUNK_ROWS)
                if held and size + part.num_rows > CHUNK_ROWS:
                    yield told(held)
                    held, size = [], 0
                held.append((binned(_matrix(part.column("x"), width), cuts),
                             part.column("y").to_numpy(zero_copy_only=False).astype(np.int16)))
                size += part.num_rows
        if held:
            yield told(held)

    def chunk(r):
        return np.frombuffer(r.bins, np.uint8).reshape(width, r.n), np.frombuffer(r.y, np.int16), np.tile(base, (r.n, 1))

    slim = df.filter(F.col(label).isin(labels)).select(F.col(features).cast("array<double>").alias("x"), rank.cast("int").alias("y"))
    return slim.mapInArrow(run, "n int, bins binary, y binary").rdd.map(chunk)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows, missing values as NaN."""
    lists = column.to_pylist() if column.null_count else None
    if lists is not None or len(column.flatten()) != len(column) * width:
        raise ValueError(f"every row needs {width} features")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _added(scores: np.ndarray, columns: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    if not rounds:
        return scores
    out = scores.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            for leaf, rows in tree.rows_of(columns):
                out[rows, c] += tree.value[leaf]
    return out


def _live(chunks, growing: list[Tree], nodes: list[list[int]]):
    """Per chunk and class with such nodes: the class, columns, gradients, hessians and each node's rows."""
    for columns, y, scores in chunks:
        p = softmax(scores)
        for c, wanted in enumerate(nodes):
            if wanted:
                q = p[:, c]
                yield (c, columns, np.rint((q - (y == c)) * UNIT), np.rint(q * (1 - q) * UNIT),
                       growing[c].rows_of(columns, wanted))


def _sums(state: RDD, growing: list[Tree], nodes: list[list[int]], tasks: int) -> RDD:
    """Sums of every task per class and (feature, node, bin), with the task they are for: a feature's is its number modulo ``tasks``."""
    places = [{node: i for i, node in enumerate(wanted)} for wanted in nodes]

    def run(chunks):
        held: dict[int, np.ndarray] = {}

        def dealt():
            if held:
                yield from ((t, [(c, nodes[c], sums[:, t::tasks]) for c, sums in held.items()]) for t in range(tasks))
            held.clear()

        for c, columns, g, h, found in _live(chunks, growing, nodes):
            found = list(found)
            if not found:
                continue
            rows = np.concatenate([r for _, r in found])
            at = np.repeat([places[c][node] for node, _ in found], [len(r) for _, r in found])
            sums = histograms(columns, rows, g[rows], h[rows], at, len(places[c]))
            if c in held:
                held[c] += sums
            else:
                held[c] = sums
            if sum(v[0].size for v in held.values()) > HELD_SUMS:
                yield from dealt()
        yield from dealt()

    return state.mapPartitions(run)


def _whole(sums: RDD, parents: RDD | None, wanted: list[dict[int, tuple[int, int] | None]], tasks: int) -> RDD:
    """The whole sums of every wanted (class, node), by task: its own, or what its sibling leaves of those of its parent."""

    def run(parts):
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for t, some in parts:
            for c, nodes, v in some:
                for i, node in enumerate(nodes):
                    if (t, c, node) in total:
                        total[t, c, node] += v[:, :, i]
                    else:
                        total[t, c, node] = v[:, :, i].copy()
        for t in {t for t, _, _ in total}:
            yield t, [(c, list(sources), np.stack([
                total[t, c, node] if source is None else total[t, c, source[0]] - total[t, c, source[1]]
                for node, source in sources.items()], 2)) for c, sources in enumerate(wanted) if sources]

    return (sums.union(parents) if parents else sums).partitionBy(tasks, int).mapPartitions(run)


def _find_splits(whole: RDD, tasks: int, min_rows: int) -> RDD:
    """The best split of every (class, node) among the features of a task, and the node's totals."""

    def run(parts):
        for t, some in parts:
            for c, nodes, v in some:
                gain, at = (x.reshape(v.shape[1:3]) for x in best_splits(*v.reshape(3, -1, 256), min_rows))
                for i, node in enumerate(nodes):
                    yield c, node, _told(v[:, :, i], gain[:, i], at[:, i], t, tasks)

    return whole.mapPartitions(run)


def _told(hist: np.ndarray, gain: np.ndarray, at: np.ndarray, first: int = 0, step: int = 1) -> tuple:
    """Gain, feature, bin, sums to the left and totals of the best split of a node; the lower feature of equals."""
    f = int(gain.argmax())
    return (float(gain[f]), first + step * f, int(at[f]), *hist[:, f, :at[f] + 1].sum(1).tolist(), *hist[:, f].sum(1).tolist())


def _dealt(sizes: dict[tuple[int, int], int], cores: int, most_rows: int) -> tuple[dict[tuple[int, int], int], int]:
    """A task for every (class, node), largest first to the one of least rows, and the number of tasks.

    A task a core, or more if they got over ``most_rows`` rows.
    """
    tasks = min(len(sizes), max(cores, -(-sum(sizes.values()) // max(most_rows, 1))))
    loads, out = [(0, t) for t in range(tasks)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, t = heapq.heappop(loads)
        out[key] = t
        heapq.heappush(loads, (load + sizes[key], t))
    return out, tasks


def _node_rows(state: RDD, growing: list[Tree], nodes: list[list[int]], task: dict[tuple[int, int], int]) -> RDD:
    """The rows of each (class, node), for its task: bins and sums' terms."""

    def run(chunks):
        for c, columns, g, h, found in _live(chunks, growing, nodes):
            out = defaultdict(list)
            for node, rows in found:
                bins = columns if len(rows) == columns.shape[1] else columns.take(rows, 1)
                out[task[c, node]].append((c, node, bins, g[rows].astype(np.int32), h[rows].astype(np.int32)))
            yield from out.items()

    return state.mapPartitions(run)


def _best_first(found: dict[int, tuple], root: int, leaves: int, children) -> set[int]:
    """Nodes to split, best gain first (the lower number of equals), until the tree has all its leaves."""
    picked, heap = set(), [(-found[root][0], root)] if root in found else []
    while heap and len(picked) < leaves - 1:
        _, node = heapq.heappop(heap)
        picked.add(node)
        for child in children(node):
            if child in found:
                heapq.heappush(heap, (-found[child][0], child))
    return picked


def _subtree(columns: np.ndarray, g: np.ndarray, h: np.ndarray, levels: int, leaves: int, min_rows: int) -> dict[int, tuple]:
    """Splits of the best-first tree over these rows, by place (children of i: 2i + 1, 2i + 2); the root's always.

    Only the smaller side of a split is summed: the other one's sums are what is left of the node's.
    """

    def summed(rows):
        return histograms(columns, rows, g[rows], h[rows])[:, :, 0]

    def best(hist):
        return _told(hist, *best_splits(*hist, min_rows))

    everything = np.arange(columns.shape[1])
    hist = summed(everything)
    out = {0: best(hist)}
    members, heap, made = {0: (everything, hist)}, [(-out[0][0], 0)], 0
    while heap and made < leaves - 1:
        minus, i = heapq.heappop(heap)
        rows, hist = members.pop(i)
        if minus >= 0:
            break
        made += 1
        left = columns[out[i][1]].take(rows) <= out[i][2]
        sides = [(2 * i + 1, rows[left]), (2 * i + 2, rows[~left])]
        sides.sort(key=lambda side: len(side[1]))
        (_, few), (j, many) = sides
        if (j + 1).bit_length() > levels or len(many) < 2 * min_rows:
            continue
        part = summed(few)
        for (j, some), hist in zip(sides, (part, hist - part)):
            if len(some) >= 2 * min_rows:
                out[j] = best(hist)
                members[j] = some, hist
                heapq.heappush(heap, (-out[j][0], j))
    return out


def _finish_nodes(rows: RDD, tasks: int, levels: list[dict[int, int]], leaves: int, min_rows: int) -> RDD:
    """The subtree of every (class, node), by the task that it was dealt to."""

    def run(parts):
        held = defaultdict(list)
        for _, some in parts:
            for c, node, *part in some:
                held[c, node].append(part)
        while held:
            (c, node), some = held.popitem()
            columns, g, h = (np.concatenate(v, -1) for v in zip(*some))
            yield c, node, _subtree(columns, g, h, levels[c][node], leaves, min_rows)

    return rows.partitionBy(tasks, int).mapPartitions(run)


def _drop(done: RDD | None) -> None:
    """Let go of a round's results and the files of their shuffles, which else stay until the driver collects garbage."""
    if done is not None:
        done.unpersist()
        done._jrdd.rdd().cleanShuffleDependencies(False)


class _Growth:
    """One class's tree of a round while it grows."""

    def __init__(self, rows: int, depth: int, leaves: int, min_rows: int):
        self.depth, self.leaves, self.min_rows = depth, leaves, min_rows
        self.tree, self.level, self.open = Tree(), {0: 0}, {0: rows}
        self.rows, self.parent = {0: rows}, {}
        self.found: dict[int, tuple[float, int, int]] = {}  # node: gain, left, right
        self.sums: dict[int, tuple[int, int]] = {}

    def chosen(self) -> set[int]:
        return _best_first(self.found, 0, self.leaves, lambda node: self.found[node][1:])

    def _split(self, node: int, gain, feature, b, gl, hl, nl, g, h, n) -> list[tuple[int, int]]:
        """Record a node's split, if it is worth it; its children and their rows."""
        self.sums[node] = (g, h)
        if not gain > 0:
            return []
        left, right = self.tree.split(node, feature, b)
        self.found[node] = (gain, left, right)
        self.level[left] = self.level[right] = self.level[node] + 1
        self.rows[left], self.rows[right] = nl, n - nl
        self.parent[left] = self.parent[right] = node
        self.sums[left], self.sums[right] = (gl, hl), (g - gl, h - hl)
        return [(left, nl), (right, n - nl)]

    def sources(self, nodes: list[int]) -> dict[int, tuple[int, int] | None]:
        """For nodes whose parents were split last: None for the smaller of two siblings, else the parent and the sibling."""
        out: dict[int, tuple[int, int] | None] = {}
        for node in nodes:
            out[node] = None
            if node in self.parent:
                parent = self.parent[node]
                sibling = sum(self.found[parent][1:]) - node
                if (self.rows[sibling], sibling) < (self.rows[node], node):
                    out[node] = parent, sibling
        return out

    def take(self, splits: dict[int, tuple]) -> None:
        """Splits of open nodes; children that the tree may still need are opened."""
        fresh = []
        for node, split in splits.items():
            del self.open[node]
            fresh += [(node, child, n) for child, n in self._split(node, *split)]
        picked = self.chosen()
        for node, child, n in fresh:
            if node in picked and self.level[child] < self.depth and n >= 2 * self.min_rows:
                self.open[child] = n

    def take_subtree(self, node: int, splits: dict[int, tuple]) -> None:
        """The finished subtree of an open node, by place in it."""
        del self.open[node]
        at = {0: node}
        for place in sorted(splits):
            for child, (number, _) in zip((2 * place + 1, 2 * place + 2), self._split(at[place], *splits[place])):
                at[child] = number

    def finish(self, rate: float) -> Tree:
        """The tree of the chosen splits alone, its leaves with their step."""
        picked, out = self.chosen(), Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in picked:
                ends = out.split(new, self.tree.feature[old], self.tree.bin[old])
                todo += list(zip(self.found[old][1:], ends))
            else:
                g, h = self.sums[old]
                out.value[new] = -rate * g / h if h > 0 else 0.0
        return out


@dataclass
class BoostedTrees:
    """Trees by round and class over binned features; scores are class probabilities in the order of ``labels``."""

    labels: list[str]
    cuts: list[list[float]]
    base: list[float]
    rounds: list[list[Tree]]
    features: str = "features"

    def score(self, df: DataFrame, out: str = "scores") -> DataFrame:
        """``df`` with the probability of every class. Missing features score as missing."""
        cuts, base, rounds, width = [np.array(c) for c in self.cuts], np.array(self.base), self.rounds, len(self.cuts)

        @F.pandas_udf("array<double>")
        def probabilities(x):
            rows = np.full((len(x), width), np.nan)
            for i, v in enumerate(x):
                if v is not None:
                    k = min(width, len(v))
                    rows[i, :k] = v[:k]
            p = softmax(_added(np.tile(base, (len(rows), 1)), binned(rows, cuts), rounds))
            return type(x)(list(p))

        return df.withColumn(out, probabilities(F.col(self.features).cast("array<double>")))

    def name(self, index: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), index)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Label with the best score (the first of equals)."""
        return self.score(df).withColumn(out, self.name(F.array_position("scores", F.array_max("scores")) - 1))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model, one row per tree."""
        head = json.dumps({"labels": self.labels, "cuts": self.cuts, "base": self.base, "features": self.features})
        rows = [(-1, 0, head)] + [(r, c, json.dumps(vars(t))) for r, trees in enumerate(self.rounds) for c, t in enumerate(trees)]
        local_table(spark, rows, "round int, cls int, body string").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        rows = sorted(map(tuple, spark.read.parquet(path).collect()))
        rounds: list[list[Tree]] = []
        for r, _, body in rows[1:]:
            if r == len(rounds):
                rounds.append([])
            rounds[r].append(Tree(**json.loads(body)))
        return cls(rounds=rounds, **json.loads(rows[0][2]))


def train_boosted(
    df: DataFrame, label: str = "label", features: str = "features", rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH,
    leaves: int = LEAVES, min_rows: int = MIN_ROWS, bins: int = BINS, refresh: int = REFRESH, node_rows: int | None = None,
) -> BoostedTrees:
    """Boosted trees for all classes of ``df`` (multinomial loss), on all its rows.

    Trees have at most ``leaves`` leaves, best gain first, and ``depth`` levels; every leaf
    keeps ``min_rows`` rows. Equal gains go to the lower feature and bin. Rows without a
    label are left out; missing and NaN features are a bin of their own that goes right.
    A table without labels is an error.

    Rows are binned and written once; a job per level reads bytes. Nodes of at most
    ``node_rows`` rows (by default those of ``NODE_BYTES``) are finished in one job, each by
    one task (the same trees come out), which moves at most ``classes * leaves * node_rows``
    rows. Scores of the rows take in a round's trees once, are kept for the round's jobs and
    written every ``refresh`` rounds.
    """
    spark = df.sparkSession
    # As many rows as there are classes.
    counts = {r[0]: r[1] for r in df.groupBy(F.col(label)).agg(F.count("*")).collect() if r[0] is not None}
    if not counts:
        raise ValueError("no row has a label")
    labels, total = sorted(counts), sum(counts.values())
    base = np.log([counts[k] / total for k in labels])
    base -= base.mean()
    cuts = quantile_cuts(df.filter(F.col(label).isNotNull()), bins, features)
    arrays, width, classes = [np.array(c) for c in cuts], len(cuts), len(labels)
    model = BoostedTrees(labels, cuts, base.tolist(), [], features)
    if not width or classes == 1:
        return model
    most_rows = NODE_BYTES // (width + 8)
    node_rows = most_rows if node_rows is None else node_rows
    shared_dir(spark)
    state, stale = _kept(_chunks(df, labels, arrays, base, label, features), True), None
    try:
        # As many tasks to find splits as made the sums, at most one per feature.
        tasks, cores = min(width, state.getNumPartitions()), spark.sparkContext.defaultParallelism
        for turn in range(rounds):
            growth = [_Growth(total, depth, leaves, min_rows) for _ in labels]
            whole = None
            while any(nodes := [[k for k, n in g.open.items() if n > node_rows] for g in growth]):
                wanted = [g.sources(some) for g, some in zip(growth, nodes)]
                summed = [sorted({node if source is None else source[1] for node, source in some.items()}) for some in wanted]
                before, whole = whole, _whole(_sums(state, [g.tree for g in growth], summed, tasks), whole, wanted, tasks)
                whole.persist(StorageLevel.MEMORY_AND_DISK)
                best: list[dict[int, tuple]] = [{} for _ in labels]
                for cls, node, (gain, feature, *rest) in _find_splits(whole, tasks, min_rows).collect():
                    held = best[cls].get(node)
                    if held is None or (-gain, feature) < (-held[0], held[1]):
                        best[cls][node] = (gain, feature, *rest)
                for g, splits in zip(growth, best):
                    g.take(splits)
                _drop(before)
            _drop(whole)
            sizes = {(cls, k): n for cls, g in enumerate(growth) for k, n in g.open.items()}
            if sizes:
                task, parts = _dealt(sizes, cores, most_rows)
                rows = _node_rows(state, [g.tree for g in growth], [list(g.open) for g in growth], task)
                levels = [{k: depth - g.level[k] for k in g.open} for g in growth]
                finished = _finish_nodes(rows, parts, levels, leaves, min_rows)
                for cls, node, splits in finished.collect():
                    growth[cls].take_subtree(node, splits)
                _drop(finished)
            trees = [g.finish(rate) for g in growth]
            model.rounds.append(trees)
            # This round's jobs have read all of its scores: those they came from are no longer needed.
            if stale is not None:
                stale.unpersist()
            if turn + 1 < rounds:
                stale, state = state, _kept(_rescored(state, width, classes, [trees]), (turn + 1) % refresh == 0)
    finally:
        state.unpersist()
        if stale is not None:
            stale.unpersist()
    return model


def _kept(state: RDD, written: bool) -> RDD:
    """Chunks kept for a round's jobs; the first job of these writes them to the shared folder as well, if so wanted."""
    if written:
        state.checkpoint()
    return state.persist(StorageLevel.MEMORY_AND_DISK)


def _rescored(state: RDD, width: int, classes: int, recent: list[list[Tree]]) -> RDD:
    """The chunks with the trees of these rounds in their scores."""
    return state.map(lambda chunk: (*chunk[:2], _added(chunk[2], chunk[0], recent)))
