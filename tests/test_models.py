"""Registered model queries do the whole job: all pages scored, models trained with full settings."""

import threading

import pytest

from threatweave.operators import boosting as H
from threatweave.operators import models as O
from threatweave.operators.text import scrub_text, tokens
from threatweave.plans import flows
from threatweave.plans import tables as T
from threatweave.plans.catalog import MODELS

SF = "/root/testdata/sf0.001"


def test_url_rf_scores_every_page(spark):
    assert sum(r.n for r in MODELS["url_rf"](spark, SF).collect()) == T.urls(spark, SF).count()


def test_url_rf_scores_unseen_pages(spark, monkeypatch):
    ids = lambda df: {r.page_id for r in df.select("page_id").distinct().collect()}
    train, score, pairs = O.train_urls, O.score_urls, []

    def trained(df, **how):
        model = train(df, trees=2, depth=2)
        model.seen = ids(df)
        return model

    def scored(model, df, **how):
        pairs.append((model.seen, ids(df)))
        return score(model, df, **how)

    monkeypatch.setattr(O, "train_urls", trained)
    monkeypatch.setattr(O, "score_urls", scored)
    MODELS["url_rf"](spark, SF)
    assert len(pairs) == 2 and not any(seen & asked for seen, asked in pairs)
    assert set.union(*[asked for _, asked in pairs]) == ids(T.urls(spark, SF))


class Stop(Exception):
    pass


@pytest.mark.parametrize("name, kind, want", [
    ("ovr_logreg", "logreg", {"maxIter": 100}),
])
def test_full_settings(spark, monkeypatch, name, kind, want):
    made, learner, grids, search = [], O.learner, [], O.search_penalty

    def stop(*args, **params):
        made.append((args[0], learner(*args, **params)))
        raise Stop

    def searched(train, val, grid=O.C_GRID, *args, **params):
        grids.append(tuple(grid))
        return search(train, val, grid, *args, **params)

    monkeypatch.setattr(O, "learner", stop)
    monkeypatch.setattr(O, "search_penalty", searched)
    with pytest.raises(Stop):
        MODELS[name](spark, SF)
    assert made[0][0] == kind and {k: made[0][1].getOrDefault(k) for k in want} == want
    assert grids == ([O.C_GRID] if kind == "logreg" else [])


def test_boosted_query_has_full_settings(spark, monkeypatch):
    given = []
    monkeypatch.setattr(flows, "train_boosted", lambda df, **params: given.append((df.count(), params)) or H.train_boosted(df, rounds=1))
    assert sum(r.support for r in MODELS["gbt_ovr"](spark, SF).collect()) > 0
    rows = T.model_rows(spark, SF).filter("split = 'train'").count()
    assert given == [(rows, {})] and (H.ROUNDS, H.RATE, H.DEPTH, H.LEAVES, H.MIN_ROWS) == (220, 0.08, 8, 31, 30)


def test_rows_are_dealt_over_all_cores(spark):
    one_file = T.model_rows(spark, SF).coalesce(1)
    parts = flows.splits_of(one_file)
    assert all(p.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism for p in parts)
    assert sum(p.count() for p in parts) == one_file.count()


def test_classes_train_side_by_side(spark, monkeypatch):
    train = flows.splits_of(T.model_rows(spark, SF))[0]
    together, learner, gate = [], O.learner, threading.Barrier(2)

    def made(*args, **params):
        together.append(gate.wait(20))  # broken unless two classes are at it
        return learner(*args, **params)

    monkeypatch.setattr(O, "learner", made)
    model = O.train_ovr(train.filter("label IN ('BENIGN', 'DoS')"), "svm", maxIter=3)
    assert len(together) == 2 and model.labels == ["BENIGN", "DoS"] and len(model.models) == 2


def test_text_words_are_made_once(spark):
    rows = spark.createDataFrame([("free money now", 1), ("meet at noon", 0), (None, 0)], "text string, label int")
    words = rows.select("label", tokens(scrub_text("text")).alias("words"))
    once = O.score_text(O.train_text(words, words="words"), words, words="words")
    twice = O.score_text(O.train_text(rows), rows)
    assert sorted(r.p for r in once.collect()) == sorted(r.p for r in twice.collect())
    plan = MODELS["text_nb"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Relation" in plan
