"""Named queries over the given tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatweave.functions.fixed import CANONICAL_CLASSES, URL_FEATURES
from threatweave.operators import evaluate as V
from threatweave.operators import features as X
from threatweave.operators import incidents as I
from threatweave.operators import labels as L
from threatweave.operators import models as O
from threatweave.operators import profile as P
from threatweave.operators import rules as R
from threatweave.operators import sessions as S
from threatweave.operators import splits as G
from threatweave.operators import store
from threatweave.operators import text as M
from threatweave.operators import urls as U
from threatweave.operators.gates import predict_with_thresholds, with_alert_levels
from threatweave.operators.normalize import contract_violations
from threatweave.plans import correlate as C
from threatweave.plans import flows
from threatweave.plans import tables as T
from threatweave.plans import traps
from threatweave.session import local_table, shared_dir
from threatweave.sources import files
from threatweave.streaming import correlate as SC
from threatweave.streaming import incidents as SI
from threatweave.streaming import traps as ST

Query = Callable[[SparkSession, str], DataFrame]


def _alerts(ruleset, report, dedupe=True) -> Query:
    return lambda spark, d: report(C.correlate(T.security_events(spark, d), ruleset, dedupe=dedupe))


def _lint(ruleset) -> Query:
    return lambda spark, d: R.lint_rules(T.security_events(spark, d), *R.rule_tables(spark, ruleset))


def _coverage(spark, d):
    return R.step_coverage(T.security_events(spark, d), R.rule_tables(spark, T.EVENT_RULES)[1])


CORRELATION = {
    "seq_two_step_alerts": _alerts(T.TWO_STEP, C.alert_summary),
    "seq_three_step": lambda s, d: C.chain_list(T.security_events(s, d), T.THREE_STEP),
    "seq_multi_rule": lambda s, d: C.chain_list(T.security_events(s, d), T.EVENT_RULES),
    "alert_dedupe": _alerts(T.EVENT_RULES, C.alert_keys),
    "alert_key_entity": _alerts(T.EVENT_RULES, C.alert_keys, dedupe=False),
    "alert_scores": _alerts(T.EVENT_RULES, C.alert_scores, dedupe=False),
    "alert_explain": _alerts(T.EVENT_RULES, C.alert_steps, dedupe=False),
    "alert_entities": _alerts(T.EVENT_RULES, C.alert_entities, dedupe=False),
    "alert_rule_report": _alerts(T.EVENT_RULES, C.rule_report),
    "rule_lint": _lint(T.EVENT_RULES),
    "rule_lint_repeated": _lint(T.REPEATED_RULES),
    "rule_step_coverage": _coverage,
}

# Events of the given table come hours apart per source, so gaps and windows here
# are longer than the defaults.
GAP, WINDOW = "2h", "6h"


def _stored_twice(spark, d):
    """Every event logged twice; the later copy must lose."""
    ev = T.trap_events(spark, d)
    again = ev.withColumns({"ord": F.col("ord") + 1_000_000_000, "action": F.lit("repeat")})
    return store.dedupe_events(ev.unionByName(again)).groupBy("action").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def _unacked(spark, d):
    ev = T.trap_events(spark, d)
    acks = ev.filter("action = 'file_read'").select("event_id")
    return store.in_time_order(store.unacked(ev, acks)).select("event_id", "action", F.unix_micros("ts").alias("ts_us"))


def _insert_new(spark, d):
    ev = T.trap_events(spark, d)
    stored = ev.filter("action IN ('file_read', 'file_copy')")
    return store.insert_new(ev, stored).groupBy("action").agg(F.count("*").alias("n"))


def _export(spark, d):
    ev = T.trap_events(spark, d)
    acks = ev.filter("action = 'file_read'").select("event_id")
    return traps.export_cycle(ev, acks, traps.accept_some, GAP)[1]


def _export_acks(spark, d):
    ev = T.trap_events(spark, d)
    acks = ev.filter("action = 'file_read'").select("event_id")
    return traps.export_cycle(ev, acks, traps.accept_some, GAP)[0]


TRAPS = {
    "trap_sessions": lambda s, d: traps.session_rows(S.trap_sessions(T.trap_events(s, d), GAP)),
    "session_members": lambda s, d: S.session_members(T.trap_events(s, d), GAP).select("event_id", "session_id"),
    "session_patterns": lambda s, d: traps.pattern_rows(S.trap_sessions(T.trap_events(s, d), GAP)),
    "event_store_dedupe": _stored_twice,
    "event_store_insert": _insert_new,
    "export_unacked": _unacked,
    "export_acks": _export_acks,
    "export_counts": _export,
}

INCIDENTS = {
    "incidents_tumbling": lambda s, d: flows.incident_table(I.incidents(T.flow_alerts(s, d), WINDOW, "tumbling"), "bucket"),
    "incidents_trailing": lambda s, d: flows.incident_table(I.incidents(T.flow_alerts(s, d), WINDOW, "trailing"), "alert_ord"),
    "incident_top_labels": lambda s, d: flows.top_label_rows(I.incidents(T.flow_alerts(s, d), WINDOW, "tumbling")),
    "incidents_stateful": lambda s, d: flows.incident_table(I.incidents(T.flow_alerts(s, d), WINDOW, "stateful"), "alert_ord"),
    "alert_level_histogram": lambda s, d: T.flow_alerts(s, d).groupBy("alert_level", "label").agg(F.count("*").alias("n")),
}

# Phishing, then a port scan within the hour; the payloads share no entity.
REPLAY_RULES = {
    "rules": [
        {
            "id": "N001", "name": "phish_then_scan", "severity": "high", "confidence": 0.8, "max_span": "1h",
            "sequence": [
                {"event_type": "phishing_detected", "where": {"tag_any": ["x"], "min_confidence": 0.5}},
                {"event_type": "port_scan", "within": "1h"},
            ],
        }
    ]
}
# Stands in for "now", so a lenient run can be repeated.
NOW_US = 1_706_745_600_000_000


def _normal(spark, d, strict):
    return C.split_rejects(C.normalized(T.raw_events(spark, d), strict, F.timestamp_micros(F.lit(NOW_US))))


def _adapted(spark, d):
    """Event type, source and confidence each adapter settles on."""
    good = _normal(spark, d, False)[0]
    return good.groupBy("source", "event_type").agg(
        F.count("*").alias("n"), F.count("entities.ip").alias("ips"), F.count("entities.url").alias("urls"),
        F.count("entities.domain").alias("domains"), F.count("entities.email_from").alias("senders"),
    )


def _contract(spark, d):
    good = contract_violations(_normal(spark, d, True)[0])
    return good.agg(F.count("*").alias("events"), F.count_if(F.size("violations") > 0).alias("violating"))


NORMALIZE = {
    "normalize_strict": lambda s, d: C.event_rows(_normal(s, d, True)[0]),
    "normalize_lenient": lambda s, d: C.event_rows(_normal(s, d, False)[0]),
    "normalize_rejects": lambda s, d: _normal(s, d, True)[1].select("ord", "error"),
    "normalize_rejects_lenient": lambda s, d: _normal(s, d, False)[1].select("ord", "error"),
    "adapt_kinds": _adapted,
    "event_contract": _contract,
    "replay_counters": lambda s, d: C.replay(T.raw_events(s, d), REPLAY_RULES)[2],
    "replay_alerts": lambda s, d: C.replay(T.raw_events(s, d), REPLAY_RULES)[0].select(
        "rule_id", "start_ord", "completion_ord", "key_entity", F.round("confidence", 9).alias("confidence"),
    ),
}



def _labels(spark, d):
    ds = T.flow_dataset(spark, d)
    made = [
        (L.clean_label("Label", "validator"), "validator"), (L.clean_label("Label", "index"), "indexed"),
        (F.coalesce(L.canonical_label("Label", "strict"), F.lit("-")), "strict"), (L.canonical_label("Label"), "permissive"),
    ]
    return ds.groupBy(*[c.alias(n) for c, n in made]).agg(F.count("*").alias("n"))


def _stats(spark, d):
    ds = T.flow_dataset(spark, d)
    s = P.column_stats(ds, "file")
    return s.select("file", "column", "rows", "missing", "infinite", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("min", "max")])


def _constant(spark, d):
    return P.constant_columns(P.over_files(P.column_stats(T.flow_dataset(spark, d), "file")))


def _verdict(spark, d):
    v = P.quality_gate(T.flow_dataset(spark, d), "Label", "file")
    return v.withColumn("failures", F.array_join("failures", ","))


def _file_index(spark, d):
    ix = P.file_label_index(T.flow_dataset(spark, d), "Label", "file")
    return ix.withColumn("canonical_present", F.array_join("canonical_present", ","))


def _kept(spark, d):
    kept, unknown = L.keep_canonical(T.flow_dataset(spark, d), "Label")
    return unknown.select(F.col("Label").alias("label"), "n").unionByName(kept.agg(F.count("*").alias("n")).select(F.lit("(kept)").alias("label"), "n"))


def _drifting(spark, d):
    """The flow dataset as three exports of other columns and types, read as one table."""
    ds, folder = T.flow_dataset(spark, d), f"{_run_dir(spark)}/exports"
    flag, port = F.col("class name"), F.col("attack port")
    exports = {
        "A": ds.filter(flag == "A").drop("tax").withColumn("attack port", port.cast("int")),
        "N": ds.filter(flag == "N").withColumns({"protocol": F.col("protocol").cast("bigint"), "attack port": port.cast("double")}),
        "R": ds.filter(flag == "R").withColumns({"price": F.col("price").cast("string"), "LABEL": F.lit("same")}),
    }
    for name, export in exports.items():
        export.drop("file").write.parquet(f"{folder}/{name}")
    return files.read_drifting_parquet(spark, folder).groupBy(F.col("class name").alias("class_name"), F.col("label").alias("label")).agg(
        F.count("*").alias("n"), F.sum("protocol").alias("protocols"), F.count("tax").alias("taxed"),
        F.sum(F.col("attack port").cast("bigint")).alias("ports"), F.round(F.sum(F.col("price").cast("decimal(18,2)")).cast("double"), 2).alias("price"))


def _encodings(spark, d):
    """Orders exported as CSV by a producer of each encoding, read without being told which is which."""
    rows = T.labelled_orders(spark, d).select("o_orderkey", F.concat("label", F.lit(" caf\u00e9")).alias("note"), "file")
    folder = f"{_run_dir(spark)}/csv"
    for name, encoding in (("Friday-flows", "ISO-8859-1"), ("Monday-flows", "UTF-8")):
        rows.filter(F.col("file") == name).drop("file").write.option("header", "true").option("encoding", encoding).csv(f"{folder}/{name}")
    return files.read_csv(spark, folder).groupBy("note").agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"))


def _labels_text(name):
    return F.array_join(F.transform(F.sort_array(name), lambda e: F.concat_ws("=", F.coalesce(e["label"], F.lit("?")), e["n"])), ",")


def _reports(spark, d, which):
    return P.dataset_reports(T.flow_dataset(spark, d), "Label", "file")[which]


def _file_report(spark, d):
    low_high = F.aggregate("ranges", F.lit(0.0), lambda a, r: a + F.when(F.abs(r["max"]) < float("inf"), r["min"] + r["max"]).otherwise(r["min"]))
    return _reports(spark, d, 0).select(
        "file", "rows", F.size("columns").alias("columns"), "label_found", _labels_text("classes").alias("classes"), _labels_text("unmapped").alias("unmapped"),
        "missing", "infinite", F.size("ranges").alias("ranges"), F.round(low_high, 4).alias("low_high"), F.array_join("leakage", ",").alias("leakage"))


def _dataset_summary(spark, d):
    return _reports(spark, d, 1).select(
        "files", "rows", F.size("columns").alias("columns"), "mismatches", "files_without_label", "unmapped_labels", "unmapped_rows",
        _labels_text("unmapped").alias("unmapped"), _labels_text("classes").alias("classes"), "missing", "infinite",
        F.array_join("leakage", ",").alias("leakage"), F.array_join("constant", ",").alias("constant"), F.array_join("failures", ",").alias("failures"), "passed")


PROFILE = {
    "file_report": _file_report,
    "dataset_summary": _dataset_summary,
    "drifting_exports": _drifting,
    "csv_encodings": _encodings,
    "label_canonical": _labels,
    "label_keep_canonical": _kept,
    "label_distribution": lambda s, d: P.label_distribution(T.flow_dataset(s, d), "Label", "file").na.fill("(all)", ["file"]),
    "unmapped_labels": lambda s, d: P.unmapped_labels(T.flow_dataset(s, d), "Label", 20),
    "column_stats": _stats,
    "constant_columns": _constant,
    "leakage_in_files": lambda s, d: P.leaking_files(files.parquet_footers(s, d), "toxic"),
    "leakage_columns": lambda s, d: P.leakage_columns(T.flow_dataset(s, d), "Label"),
    "quality_gate": _verdict,
    "file_label_index": _file_index,
    "dataset_labels": lambda s, d: P.dataset_labels(T.flow_dataset(s, d), "Label"),
}


def _weekday(spark, d):
    return G.temporal_split(T.labelled_orders(spark, d), "o_orderdate", "o_orderkey")


# Minimum rows for training, scaled down to the given tables.
FEW = {"DDoS": 2_500, "DoS": 500, "PortScan": 100_000, "BENIGN": 1_000}


def _quota(spark, d):
    return G.quota_split(T.labelled_orders(spark, d), "label", "o_orderkey", min_train=FEW)


def _quota_plan(spark, d):
    counts = T.labelled_orders(spark, d).filter(F.col("label") != "Odd").groupBy("label").agg(F.count("*").alias("n"))
    return G.quota_plan(counts, min_train=FEW)


SPLITS = {
    "split_weekday": lambda s, d: _weekday(s, d).select("o_orderkey", "split"),
    "split_counts": lambda s, d: G.split_counts(_weekday(s, d), "label"),
    "split_filename": lambda s, d: G.split_counts(G.filename_split(T.labelled_orders(s, d), "file", "o_orderkey"), "label"),
    "quota_plan": _quota_plan,
    "quota_split": lambda s, d: _quota(s, d).select("o_orderkey", "split"),
    "quota_split_manifest": lambda s, d: G.split_manifest(_quota(s, d), "label"),
    "split_coverage": lambda s, d: G.split_checks(_quota(s, d).withColumn("label", F.when(F.col("split") == "test", F.concat(F.lit("t:"), "label")).otherwise(F.col("label"))), "label"),
    "sample_rows": lambda s, d: G.sample_rows(T.scored_orders(s, d), "o_orderkey", 5000).select("o_orderkey", "label", "prediction"),
}


def _fitted(spark, d):
    """Stats of features that hold missing and infinite values."""
    ds = T.flow_dataset(spark, d).drop("file", "class name")
    rows = [(x["feature"], round(x["median"], 6), round(x["mean"], 7), round(x["std"], 7)) for x in X.fit_features(ds, "Label")]
    return local_table(spark, rows, "feature string, median double, mean double, std double")


def _standardized(spark, d):
    ds = T.vectors(spark, d)
    table = X.apply_features(ds, X.fit_features(ds.drop("vec_id"), "label"), ["vec_id"])
    return table.select("vec_id", F.posexplode("features").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 3).alias("x"))


def _feature_contract(spark, d):
    """Features written by split; the contract, loaded again, has to give the same floats."""
    labels = T.model_rows(spark, d).select("vec_id", "split")
    ds = T.vectors(spark, d).join(labels, "vec_id")
    folder = f"{_run_dir(spark)}/training"
    listed = X.write_features(ds, "label", folder, keep=["vec_id"])
    again = X.FeatureContract.load(f"{folder}/contract").transform(ds).select("vec_id", F.col("features").alias("again"))
    first = F.get("features", 0).cast("double")
    checked = X.read_features(spark, folder).join(again, "vec_id").groupBy("split", "label").agg(
        F.count_if(F.col("features") == F.col("again")).alias("same"), F.round(F.avg(first * first), 4).alias("mean_square"))
    return listed.drop("dropped").join(checked, ["split", "label"])


def _round(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def _thresholds(spark, d, grid, macro):
    scored = T.scored_orders(spark, d).select(F.col("prediction").alias("class"), "score", (F.col("label") == F.col("prediction")).alias("hit"))
    return _round(V.search_thresholds(scored, grid, macro), "threshold", "f1")


# Few vectors pass for the first classes and most for the last.
LIMITS = [0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.0, 0.0]


def _predict_thresholds(spark, d):
    """The class of each vector, its first components taken as the scores of the classes."""
    scores = F.transform(F.slice("embedding", 1, len(LIMITS)), lambda x: F.round(x.cast("double"), 2) + F.lit(0.0))
    at = predict_with_thresholds(scores, LIMITS)
    return T.table(spark, d, "embeddings").select(
        "vec_id", F.get(F.array(*map(F.lit, CANONICAL_CLASSES)), at).alias("prediction"), F.round(F.get(scores, at), 2).alias("score"))



EVALUATE = {
    "feature_fit": _fitted,
    "feature_standardize": _standardized,
    "feature_contract": _feature_contract,
    "class_weights": lambda s, d: _round(V.class_weights(T.labelled_orders(s, d)), "weight"),
    "confusion": lambda s, d: V.confusion(T.scored_orders(s, d)),
    "confusion_normalized": lambda s, d: _round(V.normalized_confusion(V.confusion(T.scored_orders(s, d))), "share"),
    "per_class_metrics": lambda s, d: _round(V.class_metrics(T.scored_orders(s, d), labels=CANONICAL_CLASSES), "precision", "recall", "f1"),
    "macro_weighted_f1": lambda s, d: _round(V.f1_summary(V.class_metrics(T.scored_orders(s, d))), "macro_f1", "weighted_f1"),
    "macro_f1_fixed_labels": lambda s, d: _round(V.f1_summary(V.class_metrics(T.scored_orders(s, d), labels=CANONICAL_CLASSES)), "macro_f1", "weighted_f1"),
    "binary_report": lambda s, d: _round(V.binary_report(T.scored_orders(s, d), "label", "prediction"), "precision", "recall", "f1"),
    "threshold_search": lambda s, d: _thresholds(s, d, V.CLASS_GRID, False),
    "gate_threshold_search": lambda s, d: _thresholds(s, d, V.GATE_GRID, True),
    "predict_thresholds": _predict_thresholds,
    "alert_levels": lambda s, d: with_alert_levels(T.scored_orders(s, d), "prediction", "score").groupBy("prediction", "alert_level").agg(F.count("*").alias("n")),
}


def _url_features(spark, d):
    made = U.feature_vector(U.url_features(T.urls(spark, d)))
    ratios = ("digit_ratio", "letter_ratio", "special_char_ratio", "phishing_keyword_ratio", "entropy")
    names = [f for f in URL_FEATURES if f != "tld_encoded"]
    return made.select("page_id", "kind", "registered_domain", "tld", *[F.round(n, 9).alias(n) if n in ratios else F.col(n) for n in names])


def _url_risk(spark, d):
    scored = U.url_risk(U.url_features(T.urls(spark, d)))
    return scored.select(
        "page_id", "kind", "risk_score", "prediction", "confidence", "risk_level", "recommendation",
        F.array_join("detection_reasons", "|").alias("reasons"),
    )


# Suffixes of four labels, a wildcard and an exception to it, by hosts of the given pages.
SUFFIX_RULES = ("com", "org", "example.com", "pills.example.com", "*.example.net", "!ththan.example.net", "m.ththth.example.net")


def _suffixes(spark, d, rules):
    parts = U.url_parts(T.urls(spark, d), suffixes=rules)
    return parts.select("page_id", "kind", "host", "suffix", "domain", "subdomain")


def _suffix_table(spark, d):
    """The same rules as a table, with every host of ``example.org`` a suffix of its own."""
    hosts = T.table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("rule")).filter("rule LIKE '%.example.org'")
    return _suffixes(spark, d, hosts.distinct().unionByName(local_table(spark, [(r,) for r in SUFFIX_RULES], "rule string")))


def _per_message(make):
    return lambda s, d: T.messages(s, d).select("conv_id", "turn", make(F.col("text")).alias("out"))


URL_TEXT = {
    "url_features": _url_features,
    "url_suffix_rules": lambda s, d: _suffixes(s, d, SUFFIX_RULES),
    "url_suffix_table": _suffix_table,
    "url_tld_codes": lambda s, d: U.url_features(T.urls(s, d)).groupBy("tld", "tld_encoded").agg(F.count("*").alias("n")),
    "url_risk": _url_risk,
    "url_quick_risk": lambda s, d: U.quick_features(T.urls(s, d)).select("page_id", "kind", U.risk_score(F.col("p")).alias("risk_score"), "num_subdomains", "is_high_risk_tld"),
    "url_batch_stats": lambda s, d: U.url_batch_stats(U.url_risk(U.url_features(T.urls(s, d)))),
    "url_host_rollup": lambda s, d: U.url_host_rollup(U.url_risk(U.url_features(T.urls(s, d)))),
    "url_patterns": lambda s, d: U.url_pattern_flags(T.urls(s, d)).select("page_id", "kind", F.array_join("url_patterns", ",").alias("patterns")),
    "text_scrub": _per_message(M.scrub_text),
    "text_tokens": _per_message(M.prepare_text),
    "text_patterns": _per_message(lambda c: F.array_join(M.text_patterns(c), ",")),
    "text_keywords": _per_message(lambda c: F.array_join(M.keyword_hits(c), ",")),
    "text_phrases": _per_message(lambda c: F.array_join(M.email_patterns(c), ",")),
    "text_pattern_totals": lambda s, d: T.table(s, d, "documents").select("lang", F.explode(M.text_patterns("text")).alias("pattern")).groupBy("lang", "pattern").agg(F.count("*").alias("n")),
    "text_verdict": lambda s, d: M.text_verdict(T.messages(s, d).withColumn("p", F.pmod(F.length("text"), F.lit(1001)) / 1000)).select("conv_id", "turn", "prediction", "risk_score"),
}



def _coefficients(spark, d):
    train = flows.splits_of(T.model_rows(spark, d))[0]
    return O.top_coefficients(O.train_ovr(train, "svm"), [f"e{i}" for i in range(64)], spark)


def _text_nb(spark, d):
    """Fitted on the labelled documents; every document is scored. Texts become words once, in files of the shared folder."""
    labels = T.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"), F.lit(True).alias("labelled"))
    folder = f"{_run_dir(spark)}/words"
    T.table(spark, d, "documents").select("doc_id", M.tokens(M.scrub_text("text")).alias("words")).join(
        labels, "doc_id", "left").select("label", "labelled", "words").write.parquet(folder)
    docs = spark.read.parquet(folder)
    scored = M.text_verdict(O.score_text(O.train_text(docs.filter("labelled"), words="words"), docs, words="words"))
    return scored.groupBy("prediction", "label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


def _url_rf(spark, d):
    """Forests that tell the made-up bad URL kinds from the others; every page is scored by the one not trained on it."""
    made = U.feature_vector(U.url_features(T.urls(spark, d))).withColumn("label", F.col("kind").isin(2, 3, 5).cast("int")).drop("p")
    half = G.in_sample("page_id", 0.5)
    # A page without id is in the second half.
    first, second = made.filter(F.coalesce(half, F.lit(False))), made.filter(~F.coalesce(half, F.lit(False)))
    crossed = O.score_urls(O.train_urls(first), second).unionByName(O.score_urls(O.train_urls(second), first))
    scored = U.url_risk(crossed)
    return scored.groupBy("prediction", "label", "risk_level").agg(F.count("*").alias("n"))


# All train with the operators' own settings on all training rows.
MODELS = {
    "linear_svm": lambda s, d: flows.svm_report(T.model_rows(s, d)),
    "ovr_logreg": lambda s, d: flows.logreg_report(T.model_rows(s, d), O.C_GRID),
    "gbt_ovr": lambda s, d: flows.boosted_report(T.model_rows(s, d)),
    "two_stage_v1": lambda s, d: flows.two_stage_report(T.model_rows(s, d), "v1"),
    "two_stage_v2": lambda s, d: flows.two_stage_report(T.model_rows(s, d), "v2"),
    "two_stage_v3": lambda s, d: flows.two_stage_report(T.model_rows(s, d), "v3"),
    "top_coefficients": _coefficients,
    "text_nb": _text_nb,
    "url_rf": _url_rf,
}



def _events_stream(spark, d):
    """``events`` of a folder as a stream."""
    schema = T.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run_dir(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def _drain(stream, folder) -> DataFrame:
    """Run a stream until it has read all there is, into files of ``folder``; goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _to_table(spark, stream, name) -> DataFrame:
    """Drain a stream into files of the shared folder and read them back."""
    return _drain(stream, f"{_run_dir(spark)}/{name}")


def _stream_sessions(spark, d):
    """All sessions as the stream emits them: drained, told its end, and run on from its checkpoint."""
    folder = _run_dir(spark)
    ev = ST.with_end(T.trap_events_in(_events_stream(spark, d)), f"{folder}/end").withWatermark("ts", "10 minutes")
    sessions = ST.session_stream(ev, GAP)
    _drain(sessions, folder)
    ST.end_stream(spark, f"{folder}/end")
    return traps.session_rows(_drain(sessions, folder))


def _stream_dedupe(spark, d):
    ev = T.trap_events_in(_events_stream(spark, d))
    twice = ev.unionByName(ev)
    return _to_table(spark, ST.dedupe_stream(twice.select("event_id", "action", "ts")), "once").groupBy("action").agg(F.count("*").alias("n"))


def _stream_incidents(spark, d):
    flow = T.flow_alerts_in(_events_stream(spark, d))
    return flows.incident_table(_to_table(spark, SI.incident_stream(flow, WINDOW), "incidents"), "alert_ord")


def _stream_alerts(spark, d):
    folder = _run_dir(spark)
    SC.correlate_stream(T.events_in(_events_stream(spark, d)), folder, T.EVENT_RULES, f"{folder}/state").awaitTermination()
    return C.alert_keys(SC.read_alerts(spark, folder))


def _stream_sliding(spark, d):
    """Windows that have ended by the stream's last watermark."""
    counts = SI.sliding_counts(T.flow_alerts_in(_events_stream(spark, d)), "6 hours", "2 hours")
    return _to_table(spark, counts, "sliding").select("key", F.unix_micros("window.start").alias("start_us"), "n", "confirmed")


def _stream_export(spark, d):
    """Acknowledgements of a stream that delivers its sessions batch by batch."""
    folder = _run_dir(spark)
    ST.export_stream(T.trap_events_in(_events_stream(spark, d)), folder, traps.accept_some, f"{folder}/state", GAP).awaitTermination()
    return spark.read.schema(ST.ACKS).option("recursiveFileLookup", "true").parquet(f"{folder}/acks")


STREAMS = {
    "stream_sliding_counts": _stream_sliding,
    "stream_export_acks": _stream_export,
    "stream_trap_sessions": _stream_sessions,
    "stream_event_dedupe": _stream_dedupe,
    "stream_incidents_stateful": _stream_incidents,
    "stream_sequence_alerts": _stream_alerts,
}

QUERIES: dict[str, Query] = {
    **CORRELATION, **TRAPS, **INCIDENTS, **NORMALIZE, **PROFILE, **SPLITS, **EVALUATE, **URL_TEXT, **MODELS, **STREAMS,
}
