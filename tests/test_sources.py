"""File sources whose schemas differ, CSV, split and report sinks, URL and text cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threatweave.operators import profile as P
from threatweave.operators import splits as G
from threatweave.operators import text as M
from threatweave.operators import urls as U
from threatweave.sources import files


def test_drifting_parquet(spark, tmp_path):
    one = spark.createDataFrame([(1, 2, "a", dt.datetime(2026, 1, 1))], "x int, y int, z string, t timestamp")
    two = spark.createDataFrame([(2.5, "q", 7)], "y double, w string, z bigint")
    one.coalesce(1).write.parquet(str(tmp_path / "d/one"))
    one.coalesce(1).write.parquet(str(tmp_path / "d/again"))
    two.coalesce(1).write.parquet(str(tmp_path / "d/two"))
    df = files.read_drifting_parquet(spark, str(tmp_path / "d"))
    assert [f.simpleString() for f in df.drop("file").schema] == ["t:timestamp", "w:string", "x:int", "y:double", "z:string"]
    assert sorted((r.x or 0, r.y, r.z) for r in df.collect()) == [(0, 2.5, "7"), (1, 2.0, "a"), (1, 2.0, "a")]
    assert P.schema_mismatches(files.schema_table(spark, str(tmp_path / "d"))).count() in (1, 2)
    with pytest.raises(Exception):
        files.read_parquet(spark, str(tmp_path / "nowhere"))


def test_drift_by_tasks(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    root = tmp_path / "many files"
    (root / "a b%20c").mkdir(parents=True)
    for i in range(300):
        odd = {0: {"n": pa.array([i], pa.int32())}, 1: {"n": pa.array([i], pa.float64())}, 2: {"n": pa.array([i], pa.int64()), f"only{i}": pa.array(["x"])}}[i % 3]
        pq.write_table(pa.table({"Label": pa.array(["B"]), **odd}), root / f"a b%20c/f{i:03}.parquet")
    when = pd.to_datetime(["2026-01-01 00:00:00"])
    foreign = pa.table({"label": pa.array(["low"]).dictionary_encode(), "u": pa.array([2**32 - 1], pa.uint32()), "t": pa.array(when)})
    pq.write_table(foreign, root / "g.parquet", use_deprecated_int96_timestamps=True)
    df = files.read_drifting_parquet(spark, str(root))
    types = dict(df.dtypes)
    assert (types["n"], types["u"], types["t"], types["Label"], types["only2"]) == ("double", "bigint", "timestamp", "string", "string")
    # A branch for integers, one for doubles, one for longs, one without the column, for 301 files.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 4
    r = df.agg(F.count("*"), F.sum("n"), F.count("Label"), F.max("Label"), F.count("only2"), F.count("only5"), F.max("u"), F.max(F.col("t").cast("string"))).first()
    assert tuple(r) == (301, float(sum(range(300))), 301, "low", 1, 1, 2**32 - 1, "2026-01-01 00:00:00")
    schemas = files.schema_table(spark, str(root))
    assert schemas.count() == 301 and P.schema_mismatches(schemas).count() == 101
    leaking = P.leaking_files(files.parquet_footers(spark, str(root)), "n")
    assert leaking.count() == 301 and {r.column for r in leaking.collect()} == {"Label", "label"}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_drifting_parquet(spark, str(tmp_path / "none"))


def test_leaking_columns_of_tables_in_part_files(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 3 AS label", "id AS class")
    rows.repartition(4).write.parquet(str(tmp_path / "folder.parquet"))
    rows.write.partitionBy("class").parquet(str(tmp_path / "a b/by class.parquet"))
    rows.toPandas().to_parquet(tmp_path / "single.parquet")
    found = P.leaking_files(files.parquet_footers(spark, str(tmp_path)), "toxic").collect()
    assert sorted(map(tuple, found)) == [
        ("by class.parquet", "label"), ("folder.parquet", "class"), ("folder.parquet", "label"), ("single.parquet", "class"), ("single.parquet", "label")]


def test_csv_of_mixed_encodings(spark, tmp_path):
    root = tmp_path / "my c+s%20v"
    (root / "sub").mkdir(parents=True)
    body = "Label,x\ncafé,{}\n"
    (root / "a é.csv").write_bytes(body.format(1).encode())
    (root / "sub/b.csv").write_bytes(body.format(2).encode("latin-1"))
    (root / "c.csv").write_bytes(b"Label,x\nDoS Hulk,3\n")
    (root / "empty.csv").write_bytes(b"")
    df = files.read_csv(spark, str(root))
    assert sorted((r.x, r.Label, r.file) for r in df.select("x", "Label", F.try_url_decode("file").alias("file")).collect()) == [
        ("1", "café", "a é.csv"), ("2", "café", "b.csv"), ("3", "DoS Hulk", "c.csv")]
    only = files.read_csv(spark, str(root / "sub"), schema="Label string, x int")
    assert [tuple(r) for r in only.collect()] == [("café", 2, "b.csv")]


def test_csv_in_latin1(spark, tmp_path):
    (tmp_path / "c/sub").mkdir(parents=True)
    (tmp_path / "c/a.csv").write_bytes("Label,x\ncafé,1\n".encode("latin-1"))
    (tmp_path / "c/sub/b.csv").write_bytes(b"Label,x\nDoS Hulk,2\n")
    df = files.read_csv(spark, str(tmp_path / "c"), "ISO-8859-1")
    assert {(r.Label, r.x, r.file) for r in df.collect()} == {("café", "1", "a.csv"), ("DoS Hulk", "2", "b.csv")}


def test_split_and_report_sinks(spark, tmp_path):
    df = spark.range(100).select("id", F.lit("BENIGN").alias("Label"), F.lit("f").alias("file"), F.lit(1.5).alias("v"))
    split = G.quota_split(df, "Label", "id", min_train={})
    files.write_splits(split, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().count() == 3
    files.write_reports(P.profile_dataset(df, "Label", "file"), str(tmp_path / "r"))
    verdict = spark.read.json(str(tmp_path / "r/verdict")).first()
    assert verdict.passed and verdict.rows_total == 100
    assert {r.problem for r in G.split_checks(split, "Label").collect()} == {"test_benign_only"}


def test_feature_contract(spark, tmp_path):
    from threatweave.operators import features as X
    inf, nan = float("inf"), float("nan")
    rows = [("train", "a", 1.0, None, 3, "x"), ("train", "b", 3.0, nan, 3, "x"), ("train", None, None, inf, 3, "x"), ("val", "a", inf, 9.0, 4, "y"), ("test", "b", 0.1, 1.0, None, "z")]
    df = spark.createDataFrame(rows, "split string, Label string, v double, `odd.name` double, n int, `Flow ID` string")
    listed = X.write_features(df, "Label", str(tmp_path / "f"))
    assert {(r.split, r.label, r.rows, r.features, *r.dropped) for r in listed.collect()} == {
        (s, lab, 1, 3, "Flow ID") for s, lab in (("train", "a"), ("train", "b"), ("train", None), ("val", "a"), ("test", "b"))}
    again = X.FeatureContract.load(str(tmp_path / "f/contract"))
    assert again.stats == X.fit_features(df.filter("split = 'train'").drop("split"), "Label") and again.getOrDefault(again.label) == "Label"
    by_split = {r.split: list(r.features) for r in again.transform(df).filter("split <> 'train'").collect()}
    assert by_split == {r.split: list(r.features) for r in X.read_features(spark, str(tmp_path / "f")).filter("split <> 'train'").collect()}
    assert by_split["val"] == [1.0, 9.0, 0.0]  # n, odd.name (no value: median 0), v (infinite: the median)
    with pytest.raises(ValueError, match="features"):
        X.write_features(df, "Label", str(tmp_path / "g"), keep=["features"])


def test_dataset_reports(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "BENIGN", 1.0, 5), ("a", "odd", nan, 5), ("a", "BENIGN", inf, 5), ("b", None, 2.0, None)]
    df = spark.createDataFrame(rows, "file string, Label string, rows double, k int")
    schemas = spark.createDataFrame([("a", ["Label", "rows", "k"]), ("b", ["rows", "attack x"]), ("c", ["Label", "rows", "k"])], "file string, columns array<string>")
    report, summary = P.dataset_reports(df, "Label", "file", schemas)
    got = {r.file: r for r in report.collect()}
    assert (got["a"].rows, got["a"].missing, got["a"].infinite, got["a"].label_found, got["a"].leakage) == (3, 1, 1, True, [])
    assert [tuple(x) for x in got["a"].classes] == [("BENIGN", 2)] and [tuple(x) for x in got["a"].unmapped] == [("odd", 1)]
    assert [tuple(x) for x in got["a"].ranges] == [("k", 5.0, 5.0), ("rows", 1.0, inf)]
    # Of b only the columns it has count; c has no rows.
    assert (got["b"].rows, got["b"].missing, got["b"].label_found, got["b"].leakage, [x.column for x in got["b"].ranges]) == (1, 0, False, ["attack x"], ["rows"])
    assert (got["c"].rows, got["c"].missing, got["c"].classes, got["c"].ranges) == (0, 0, [], None)
    one = summary.first()
    assert (one.files, one.rows, one.mismatches, one.files_without_label, one.constant, one.columns) == (3, 4, 1, 1, ["k"], ["Label", "attack x", "k", "rows"])
    assert one.failures == ["unmapped_labels", "missing_values", "infinite_values", "label_column_missing", "schema_mismatch"] and not one.passed
    bare, whole = P.dataset_reports(df.drop("Label").limit(0), "Label", "file")
    assert bare.count() == 0 and whole.first().failures == ["no_rows"]
    assert P.dataset_reports(df.drop("Label"), "Label", "file")[1].first().failures == ["missing_values", "infinite_values", "label_column_missing"]


def test_timestamps(spark):
    assert G.find_timestamp(spark.createDataFrame([(1, 2)], "TIMESTAMP int, a int")) == "TIMESTAMP"
    df = spark.createDataFrame([("07/07/2017 02:30:00 PM", "a"), ("2017-07-06 01:00:00", "a"), ("zz", "b")], "t string, f string")
    with pytest.raises(ValueError, match="1 of 1 timestamps do not parse in b"):
        G.temporal_split(df, "t", "t", file_col="f")
    out = G.temporal_split(df.withColumn("Flow ID", F.lit(1)), "t", "t", max_unparsed=0.5)
    assert "Flow ID" not in out.columns
    assert [r.split == "test" for r in out.collect()] == [True, False, False]
    assert [r.f for r in G.parse_failures(df, "t", "f").collect()] == ["b"]
    short = spark.createDataFrame([("7/7/2017 3:30",), ("7/7/2017 8:59:01 AM",), (" 7/6/2017 8:59:01 pm",), ("12/1/2017 18:05:09",)], "t string")
    assert [str(r[0]) for r in short.select(G.parse_timestamp(F.col("t")).cast("string")).collect()] == [
        "2017-07-07 03:30:00", "2017-07-07 08:59:01", "2017-07-06 20:59:01", "2017-12-01 18:05:09"]
    assert [r.split == "test" for r in G.temporal_split(short, "t", "t").collect()] == [True, True, False, True]


def test_jobs_that_stop(spark):
    from threatweave.operators import labels as L
    from threatweave.operators.rules import eligible_steps, rule_tables
    df = spark.createDataFrame([("odd", "a")], "label string, split string")
    with pytest.raises(ValueError, match="canonical"):
        L.keep_canonical(df)
    assert L.keep_canonical(df, require=False)[0].isEmpty()
    with pytest.raises(ValueError, match="no column"):
        P.file_label_index(df, "Label", "split")
    with pytest.raises(ValueError, match="test split"):
        G.require_test_rows(df)
    rule = {"id": "R", "name": "n", "severity": "low", "confidence": 0.5, "sequence": [{"event_type": "x"}]}
    with pytest.raises(ValueError, match="twice"):
        eligible_steps(*rule_tables(spark, {"rules": [rule, rule]}))


@pytest.mark.parametrize("url,suffix,domain,sub", [
    ("https://secure-login.verify-account.xyz/login.php?user=test", "xyz", "verify-account", "secure-login"),
    ("http://a.b.example.co.uk/x", "co.uk", "example", "a.b"), ("http://10.1.2.3:80/x", "", "10.1.2.3", ""),
    ("http://[::1]:80/", "", "[::1]", ""), ("example.com/a", "com", "example", ""), ("", "", "", ""), ("http://user@host.local/", "", "local", "host"),
])
def test_url_parts(spark, url, suffix, domain, sub):
    r = U.url_features(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.suffix, r.domain, r.subdomain) == (suffix, domain, sub)
    assert 0 <= U.url_risk(U.url_features(spark.createDataFrame([(url, 0.99)], "url string, p double"))).first().risk_score <= 100


RULES = ("uk", "co.uk", "us", "k12.ca.us", "*.ck", "!www.ck", "deep.er.example.org")


@pytest.mark.parametrize("host,suffix,domain,sub", [
    ("school.lausd.k12.ca.us", "k12.ca.us", "lausd", "school"), ("ca.us", "us", "ca", ""), ("a.b.ck", "b.ck", "a", ""), ("b.ck", "b.ck", "", ""),
    ("www.ck", "ck", "www", ""), ("x.www.ck", "ck", "www", "x"), ("ck", "ck", "", ""), ("A.Co.UK", "Co.UK", "A", ""),
    ("v.w.deep.er.example.org", "deep.er.example.org", "w", "v"), ("er.example.org", "", "org", "er.example"), ("10.0.0.1", "", "10.0.0.1", ""),
    ("a." * 3000 + "co.uk", "co.uk", "a", "a." * 2998 + "a"), ("", "", "", ""), (None, "", "", ""),
])
def test_suffix_rules(spark, host, suffix, domain, sub):
    url = spark.createDataFrame([(host and f"http://{host}/x",)], "url string")
    table = spark.createDataFrame([(r,) for r in RULES], "rule string")
    for rules in (RULES, table):
        r = U.url_parts(url, suffixes=rules).first()
        assert (r.suffix, r.domain, r.subdomain) == (suffix, domain, sub)
    assert U.url_parts(url, suffixes=table.limit(0)).columns == U.url_parts(url).columns


def test_empty_batch_has_no_rate(spark):
    empty = spark.createDataFrame([], "is_phishing boolean")
    assert U.url_batch_stats(empty).first().asDict() == {"total_urls": 0, "phishing_count": 0, "safe_count": 0, "phishing_rate": None}


def test_text(spark):
    text = "Hello THERE! Visit https://x.y/z or me@mail.org, call +1 (555) 010-2030. I am not 42 naïve_users now"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(M.prepare_text("t")).collect()] == ["hello visit call not naïve_users", "", ""]
    assert df.select(M.text_patterns("t")).first()[0] == ["urgency_tactics"]
    assert df.select(M.email_patterns("t")).first()[0] == []
