"""Histogram boosting: against a plain version, across ways to deal rows, and against Spark's own trees."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatweave.operators import boosting as H
from threatweave.operators import models as O
from threatweave.session import shared_dir


def make(n, seed=1, width=4, classes=("A", "B", "C")):
    """Classes that overlap; ties, constant and missing features, a row without label."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [round(rng.gauss(0, 1), 1) for _ in range(width - 1)] + [7.0]
        k = (x[0] > 0.3) + (x[0] + x[1] * x[2] > 0.9)
        label = classes[k] if rng.random() < 0.9 else rng.choice(classes)
        if rng.random() < 0.05:
            x[rng.randrange(width - 1)] = rng.choice([None, math.nan])
        rows.append((label, x))
    return rows + [(None, [0.0] * width)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "label string, features array<double>")


def plain(rows, cuts, rounds, rate, depth, leaves, min_rows):
    """The same boosting, row by row; returns every row's scores and the number of leaves of each tree."""
    rows = [(k, [H.MISSING if v is None or v != v else sum(v > c for c in cuts[j]) for j, v in enumerate(x)]) for k, x in rows if k]
    labels = sorted({k for k, _ in rows})
    base = [math.log(sum(k == c for k, _ in rows) / len(rows)) for c in labels]
    scores = [[b - sum(base) / len(base) for b in base] for _ in rows]
    sizes = []
    for _ in range(rounds):
        p = [[math.exp(v) / sum(map(math.exp, s)) for v in s] for s in scores]
        for c, name in enumerate(labels):
            g = [round((q[c] - (k == name)) * H.UNIT) for q, (k, _) in zip(p, rows)]
            h = [round(q[c] * (1 - q[c]) * H.UNIT) for q in p]

            def part(a, b):
                return (a / H.UNIT) ** 2 / (b / H.UNIT) if b > 0 else 0.0

            def best(members):
                out = (-math.inf, 0, 0)
                tg, th = sum(g[i] for i in members), sum(h[i] for i in members)
                for f in range(len(cuts)):
                    for b in range(H.MISSING):
                        left = [i for i in members if rows[i][1][f] <= b]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if min(len(left), len(members) - len(left)) >= min_rows and lh > 0 and th - lh > 0:
                            gain = part(lg, lh) + part(tg - lg, th - lh) - part(tg, th)
                            if gain > out[0]:
                                out = (gain, f, b)
                return out
            tips = [(list(range(len(rows))), 0)]
            tips = [(m, d, best(m)) for m, d in tips]
            while len(tips) < leaves:
                worth = [t for t in tips if t[2][0] > 0]
                if not worth:
                    break
                top = max(worth, key=lambda t: t[2][0])
                tips.remove(top)
                m, d, (_, f, b) = top
                for side in ([i for i in m if rows[i][1][f] <= b], [i for i in m if rows[i][1][f] > b]):
                    open_ = d + 1 < depth and len(side) >= 2 * min_rows
                    tips.append((side, d + 1, best(side) if open_ else (-math.inf, 0, 0)))
            sizes.append(len(tips))
            for m, _, _ in tips:
                step = -rate * sum(g[i] for i in m) / sum(h[i] for i in m)
                for i in m:
                    scores[i][c] += step
    return labels, np.array(scores), sizes


@pytest.mark.parametrize("node_rows, leaves, depth", [(1 << 16, 31, 8), (0, 31, 8), (45, 5, 3), (0, 5, 3)])
def test_boosting_is_the_plain_one(spark, monkeypatch, node_rows, leaves, depth):
    monkeypatch.setattr(H, "CHUNK_ROWS", 29)
    rows = make(130)
    df = frame(spark, rows).repartition(3)
    settings = dict(rounds=4, rate=0.3, depth=depth, leaves=leaves, min_rows=8)
    model = H.train_boosted(df, bins=12, refresh=3, node_rows=node_rows, **settings)
    labels, scores, sizes = plain(rows, model.cuts, **settings)
    assert model.labels == labels
    assert [t.feature.count(-1) for trees in model.rounds for t in trees] == sizes and max(sizes) > 3
    got = {repr((r.label, r.features)): r.scores for r in model.score(df.filter("label IS NOT NULL")).collect()}
    want = H.softmax(scores)
    for (k, x), p in zip([r for r in rows if r[0]], want):
        assert got[repr((k, x))] == pytest.approx(p.tolist(), abs=1e-9)


def test_trees_do_not_depend_on_the_partitions(spark):
    rows = make(400, 3)
    one, many = (H.train_boosted(frame(spark, rows).repartition(k), rounds=3, min_rows=10, bins=20, node_rows=n)
                 for k, n in ((1, 0), (7, 120)))
    assert one.cuts == many.cuts and [len(t.feature) for r in one.rounds for t in r] == [len(t.feature) for r in many.rounds for t in r]
    df = frame(spark, rows)
    pairs = one.score(df).select("scores").collect(), many.score(df).select("scores").collect()
    assert np.allclose(*[[r.scores for r in p] for p in pairs])


def test_no_worse_than_binary_trees_on_held_out_rows(spark):
    train, test = frame(spark, make(700, 5)).filter("label IS NOT NULL"), frame(spark, make(400, 6)).filter("label IS NOT NULL")
    train, test = (d.withColumn("features", F.transform("features", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))).cache()
                   for d in (train, test))
    ours = O.macro_f1(H.train_boosted(train, rounds=30).predict(test))
    theirs = O.macro_f1(O.train_ovr(train, "gbt", maxIter=10, maxDepth=4).predict(test))
    assert ours > 0.7 and ours >= theirs - 0.02


def test_saved_model_scores_the_same(spark):
    df = frame(spark, make(120, 9))
    model = H.train_boosted(df, rounds=2, min_rows=10, bins=15)
    folder = f"{shared_dir(spark)}/boosted-test"
    model.save(spark, folder)
    again = H.BoostedTrees.load(spark, folder)
    assert again == model
    assert [r.scores for r in again.score(df).collect()] == [r.scores for r in model.score(df).collect()]


def test_edges(spark):
    with pytest.raises(ValueError, match="no row has a label"):
        H.train_boosted(frame(spark, [(None, [1.0])]))
    one = H.train_boosted(frame(spark, [("A", [1.0]), ("A", [2.0])]), rounds=2)
    assert [r.prediction for r in one.predict(frame(spark, [(None, [5.0]), (None, None), (None, [None])])).collect()] == ["A"] * 3
    few = H.train_boosted(frame(spark, [("A", [1.0]), ("B", [2.0])] * 5), rounds=2)  # too few rows to split
    assert all(t.feature == [-1] for trees in few.rounds for t in trees)
    with pytest.raises(Exception, match="needs 2 features"):
        H.train_boosted(frame(spark, [("A", [1.0, 2.0]), ("B", [2.0])] * 5), rounds=1)


def test_scores_are_brought_up_to_date_once_a_round(spark, monkeypatch):
    calls, rescored = [], H._rescored
    monkeypatch.setattr(H, "_rescored", lambda state, width, classes, trees: calls.append(len(trees)) or rescored(state, width, classes, trees))
    H.train_boosted(frame(spark, make(200)), rounds=4, depth=2, min_rows=5, refresh=3)
    assert calls == [1, 1, 1]


def test_only_the_smaller_side_of_a_split_is_summed(monkeypatch):
    rng, summed, histograms = np.random.default_rng(3), [], H.histograms
    columns = rng.integers(0, 40, (3, 2000)).astype(np.uint8)
    g = np.rint((columns[0] > 30) * 9e6 - columns[1] * 1e5 + rng.normal(0, 1e5, 2000)).astype(np.int32)
    h = rng.integers(1, 1 << 22, 2000).astype(np.int32)
    monkeypatch.setattr(H, "histograms", lambda columns, rows, *a: summed.append(rows) or histograms(columns, rows, *a))
    found = H._subtree(columns, g, h, 6, 31, 20)
    assert len(found) > 20 and sum(map(len, summed[1:])) <= 5 * 2000 / 2
    members = {0: np.arange(2000)}
    for place in sorted(found):  # what is left of a node's sums are the larger side's own
        rows = members[place]
        hist = histograms(columns, rows, g[rows], h[rows])[:, :, 0]
        assert found[place] == H._told(hist, *H.best_splits(*hist, 20))
        left = columns[found[place][1]][rows] <= found[place][2]
        members |= {2 * place + 1: rows[left], 2 * place + 2: rows[~left]}


def test_one_of_two_siblings_is_summed(spark, monkeypatch):
    """The other has what is left of their parent's sums; that the trees are right is tested above, with ``node_rows=0``."""
    levels, sums = [], H._sums
    monkeypatch.setattr(H, "_sums", lambda state, growing, nodes, tasks: levels.append((growing, nodes)) or sums(state, growing, nodes, tasks))
    H.train_boosted(frame(spark, make(300)), rounds=2, depth=4, min_rows=5, node_rows=0)
    assert sum(nodes == [[0]] * 3 for _, nodes in levels) == 2 and max(map(len, levels[-1][1])) > 1
    for growing, nodes in levels:
        for tree, some in zip(growing, nodes):
            pairs = [tuple(p) for p in zip(tree.left, tree.right) if p != (0, 0)]
            assert some == [0] or all(sum(n in some for n in p) <= 1 for p in pairs)


def test_sums_are_whole_numbers(spark):
    n = 70_000  # more than the rows of one pass
    rng = np.random.default_rng(4)
    columns = np.stack([np.zeros(n), rng.integers(0, 256, n)]).astype(np.uint8)
    g, h, at = np.full(n, -(1 << 24)), np.full(n, 1 << 22), rng.integers(0, 3, n)
    whole = H.histograms(columns, np.arange(n), g, h)
    assert whole[:, 0, 0, 0].tolist() == [-(n << 24), n << 22, n] and not whole[:, 0, 0, 1:].any()
    rows = rng.permutation(n)[: n // 2]
    parts = H.histograms(columns, rows, g[rows], h[rows], at[rows], 3)
    want = np.zeros((2, 3, 256), np.int64)
    for f in (0, 1):
        np.add.at(want[f], (at[rows], columns[f, rows]), 1)
    assert (parts[2] == want).all() and (parts[1] == want << 22).all() and (parts[0] == -(want << 24)).all()


def test_nodes_are_dealt_by_their_rows():
    sizes = {(c, node): (node + 1) ** 3 for c in range(4) for node in range(9)}
    task, tasks = H._dealt(sizes, 8, 10_000)
    loads = [sum(n for key, n in sizes.items() if task[key] == t) for t in range(tasks)]
    assert tasks == 8 and task.keys() == sizes.keys() and max(loads) <= sum(loads) / tasks + max(sizes.values())
    assert H._dealt(sizes, 2, 500)[1] == -(-sum(sizes.values()) // 500) and H._dealt({(0, 0): 5}, 8, 500) == ({(0, 0): 0}, 1)


def test_chunks_are_full(spark):
    """Passes over chunks have a price each: more than an Arrow batch of rows goes into one."""
    df = spark.range(0, 70_000, 1, 1).selectExpr("if(id % 2 = 0, 'A', 'B') label", "array(id / 7, null) features")
    chunks = H._chunks(df, ["A", "B"], [np.array([1.0, 5.0]), np.array([])], np.zeros(2), "label", "features")
    assert [columns.shape for columns, _, _ in chunks.collect()] == [(2, 30_000), (2, 30_000), (2, 10_000)]
    columns, y, scores = chunks.first()
    assert columns[:, :40:8].tolist() == [[0, 1, 1, 1, 1], [H.MISSING] * 5] and y[:3].tolist() == [0, 1, 0] and scores.shape == (30_000, 2)


def test_rounds_leave_no_shuffle_behind(spark):
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = known.size()
    H.train_boosted(frame(spark, make(200)), rounds=12, depth=3, min_rows=5)
    assert known.size() - before < 12
