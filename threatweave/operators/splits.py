"""Train, validation and test splits that any rerun repeats row for row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatweave.functions.columns import HASH_SPACE, stable_hash
from threatweave.functions.fixed import CANONICAL_CLASSES, IDENTIFIER_COLUMNS, MIN_TRAIN, TIMESTAMP_NAMES

BUCKETS = 1 << 16


def find_timestamp(df: DataFrame, names=TIMESTAMP_NAMES) -> str | None:
    """Timestamp column by exact name, then whatever its case."""
    exact = [n for n in names if n in df.columns]
    lower = {c.lower(): c for c in df.columns}
    loose = [lower[n.lower()] for n in names if n.lower() in lower]
    return (exact + loose + [None])[0]


# Month first; one or two digits for month, day and hour; seconds and AM/PM optional.
TEXT_DATES = ("M/d/yyyy h:mm[:ss] a", "M/d/yyyy H:mm[:ss]")


def parse_timestamp(c: Column) -> Column:
    """Timestamps of ISO or month-first text; NULL when unparsable."""
    t = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(f)) for f in TEXT_DATES])


def in_sample(key: str | Column, fraction: float, seed: int = 42) -> Column:
    return stable_hash(seed, key) < int(fraction * HASH_SPACE)


def temporal_split(
    df: DataFrame, ts: str, key: str, val_fraction: float = 0.15, seed: int = 42, file_col: str | None = None,
    max_unparsed: float = 0.01,
) -> DataFrame:
    """Fridays to test; of the rest a fixed share to validation.

    Text dates are parsed; a file (without ``file_col``: the table) in which more than
    ``max_unparsed`` of them do not parse stops the job, as its Fridays would be lost.
    """
    at = F.col(ts)
    if not isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = parse_timestamp(at)
        bad = parse_failures(df, ts, file_col, max_unparsed).first()
        if bad:
            raise ValueError(f"{bad['unparsed']} of {bad['rows']} timestamps do not parse in {bad[0] or 'the table'}")
    friday = F.coalesce(F.dayofweek(at) == 6, F.lit(False))
    split = F.when(friday, "test").when(in_sample(key, val_fraction, seed), "val").otherwise("train")
    return df.drop(*IDENTIFIER_COLUMNS).withColumn("split", split)


def filename_split(df: DataFrame, file_col: str, key: str, val_fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """As :func:`temporal_split`, by file name, for data without a timestamp."""
    friday = F.col(file_col).rlike("(?i)friday")
    split = F.when(friday, "test").when(in_sample(key, val_fraction, seed), "val").otherwise("train")
    return df.drop(*IDENTIFIER_COLUMNS).withColumn("split", split)


def parse_failures(df: DataFrame, ts: str, file_col: str | None = None, limit: float = 0.01) -> DataFrame:
    """File, ``rows``, ``unparsed`` of files in which more than ``limit`` of the timestamps do not parse."""
    missed = parse_timestamp(F.col(ts)).isNull()
    file = F.lit(None).cast("string") if file_col is None else F.col(file_col)
    return df.groupBy(file.alias(file_col or "file")).agg(F.count("*").alias("rows"), F.count_if(missed).alias("unparsed")).filter(
        F.col("unparsed") > limit * F.col("rows")
    )


def split_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split", F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def quota_plan(counts: DataFrame, test: float = 0.20, val: float = 0.15, min_train: dict[str, int] = MIN_TRAIN) -> DataFrame:
    """Rows of each class to send to test, validation and train.

    ``counts``: label, n. Rounds half to even; a class short of its minimum for
    training takes rows back from test first, then from validation.
    """
    wanted = F.lit(0)
    for name, rows in min_train.items():
        wanted = F.when(F.col("label") == name, F.lit(rows)).otherwise(wanted)
    n = F.col("n")
    plan = counts.select("label", "n", F.when(wanted > n, F.greatest(F.lit(1), F.floor(n / 2))).otherwise(wanted).cast("bigint").alias("least"))
    plan = plan.withColumns({"t0": F.bround(n * test).cast("bigint"), "v0": F.bround(n * val).cast("bigint")})
    short = F.greatest(F.lit(0), F.col("least") - (n - F.col("t0") - F.col("v0")))
    plan = plan.withColumn("short", short)
    from_test = F.least("short", "t0")
    from_val = F.least(F.col("short") - from_test, F.col("v0"))
    plan = plan.withColumns({"n_test": F.col("t0") - from_test, "n_val": F.col("v0") - from_val})
    return plan.select("label", "n", "n_test", "n_val", (n - F.col("n_test") - F.col("n_val")).alias("n_train"), F.col("least").alias("min_train"))


def quota_split(
    df: DataFrame, label: str, key: str, test: float = 0.20, val: float = 0.15,
    min_train: dict[str, int] = MIN_TRAIN, seed: int = 42, classes=CANONICAL_CLASSES,
) -> DataFrame:
    """Exact stratified quotas. ``key`` must identify a row.

    A class may be most of the table, so no class is ever sorted. Its rows fall
    into hash buckets; counts per bucket show which whole buckets go to test and
    to validation, and only the two buckets a quota cuts through are ranked.
    """
    h = stable_hash(seed, key)
    hashed = df.withColumns({"_h": h, "_b": F.floor(h / (HASH_SPACE // BUCKETS))})
    known = F.col(label).isin(*classes) if classes else F.col(label).isNotNull()
    # Per-class rows are few where the classes are listed; else the planner decides.
    small = F.broadcast if classes else (lambda d: d)
    buckets = hashed.filter(known).groupBy(F.col(label).alias("label"), "_b").agg(F.count("*").alias("size"))
    plan = quota_plan(buckets.groupBy("label").agg(F.sum("size").alias("n")), test, val, min_train)
    before = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # At most BUCKETS rows per class.
    placed = buckets.withColumns(
        {"before": F.coalesce(F.sum("size").over(before), F.lit(0))}
    ).join(small(plan), "label").withColumn("after", F.col("before") + F.col("size"))
    upto_test, upto_val = F.col("n_test"), F.col("n_test") + F.col("n_val")
    in_test, in_val = F.col("after") <= upto_test, (F.col("before") >= upto_test) & (F.col("after") <= upto_val)
    in_train = F.col("before") >= upto_val
    bound = lambda pick, rows, default: F.coalesce(pick(F.when(rows, F.col("_b"))), F.lit(default))
    # One row per class, with its cut buckets: two at most.
    ruled = placed.groupBy("label").agg(
        bound(F.max, in_test, -1).alias("_test_to"),
        bound(F.min, in_val, BUCKETS).alias("_val_from"),
        bound(F.max, in_val, -1).alias("_val_to"),
        bound(F.min, in_train, BUCKETS).alias("_train_from"),
        F.collect_list(F.when(~in_test & ~in_val & ~in_train, F.struct("_b", "before"))).alias("_cuts"),
        F.any_value("n_test").alias("n_test"), F.any_value("n_val").alias("n_val"),
    )
    joined = hashed.join(small(ruled.withColumnRenamed("label", label)), label, "left")
    whole = (
        F.when(F.col("_test_to").isNull(), "train").when(F.col("_b") <= F.col("_test_to"), "test")
        .when(F.col("_b").between(F.col("_val_from"), F.col("_val_to")), "val").when(F.col("_b") >= F.col("_train_from"), "train")
    )
    settled = joined.withColumn("split", whole).filter("split IS NOT NULL")
    cut_through = joined.filter(whole.isNull())
    start = F.get(F.filter("_cuts", lambda c: c["_b"] == F.col("_b")), F.lit(0))["before"]
    rank = start + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    ranked = cut_through.withColumn(
        "split", F.when(rank <= upto_test, "test").when(rank <= upto_val, "val").otherwise("train")
    )
    return settled.unionByName(ranked).select(*df.columns, "split")


def split_checks(df: DataFrame, label: str) -> DataFrame:
    """Problems of a split: labels only test has, a test set of benign rows only, no test set."""
    seen = df.groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    test, train = seen.filter("split = 'test'").select("label"), seen.filter("split = 'train'").select("label")
    unseen = test.join(train, "label", "left_anti").select(F.lit("test_label_not_in_train").alias("problem"), "label")
    sizes = test.agg(F.count("*").alias("labels"), F.count_if(F.col("label") == "BENIGN").alias("benign"))
    only = sizes.filter("labels = 1 AND benign = 1").select(F.lit("test_benign_only").alias("problem"), F.lit("BENIGN").alias("label"))
    empty = sizes.filter("labels = 0").select(F.lit("test_empty").alias("problem"), F.lit("").alias("label"))
    return unseen.unionByName(only).unionByName(empty)


def require_test_rows(df: DataFrame) -> DataFrame:
    """The split table itself; a split without test rows stops the job."""
    if df.filter("split = 'test'").isEmpty():
        raise ValueError("no row falls on a Friday: the test split is empty")
    return df


def sample_rows(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """A fixed random sample without replacement: the ``n`` lowest hashes."""
    return df.orderBy(stable_hash(seed, key), key).limit(n)


def split_manifest(df: DataFrame, label: str) -> DataFrame:
    """Rows per label with one column per split."""
    return df.groupBy(F.col(label).cast("string").alias("label")).pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).na.fill(0)
