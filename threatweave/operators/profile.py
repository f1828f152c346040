"""Profile a labelled flow dataset and judge its quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatweave.functions.columns import staged
from threatweave.functions.fixed import CANONICAL_CLASSES, DROP_COLUMNS, LEAKAGE_WORDS
from threatweave.operators.labels import canonical_label, clean_label
from threatweave.session import cut, local_table

FLOATS = (T.DoubleType, T.FloatType)
CLASS_SCHEMA = "class_no int, label string"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def class_table(df: DataFrame, classes=CANONICAL_CLASSES) -> DataFrame:
    """The canonical classes in order: a fixed list, small enough to broadcast."""
    return local_table(df.sparkSession, list(enumerate(classes)), CLASS_SCHEMA)


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    gone = c.isNull()
    return gone | F.isnan(c) if isinstance(f.dataType, FLOATS) else gone


def _clean(name: str) -> Column:
    """Numeric value with NaN as NULL, since max() would return NaN."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def _cell_figures(df: DataFrame, skip) -> tuple[list[Column], list[Column]]:
    """Aggregates of all columns but some, and one entry per column made of them."""
    fields = [f for f in df.schema if f.name not in skip]
    numeric = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}
    floating = {f.name for f in fields if isinstance(f.dataType, FLOATS)}
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(_missing(f)).alias(f"m{i}"))
        if f.name in floating:
            aggs.append(F.count_if(F.abs(_clean(f.name)) == float("inf")).alias(f"i{i}"))
        if f.name in numeric:
            aggs += [F.min(_clean(f.name)).alias(f"lo{i}"), F.max(_clean(f.name)).alias(f"hi{i}")]
    null = F.lit(None).cast("double")
    return aggs, [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.name in numeric).alias("numeric"),
            F.col(f"m{i}").alias("missing"),
            (F.col(f"i{i}") if f.name in floating else F.lit(0).cast("bigint")).alias("infinite"),
            (F.col(f"lo{i}") if f.name in numeric else null).alias("min"),
            (F.col(f"hi{i}") if f.name in numeric else null).alias("max"),
        )
        for i, f in enumerate(fields)
    ]


def column_stats(df: DataFrame, file_col: str | None = None, drop=DROP_COLUMNS) -> DataFrame:
    """Per file and column: rows, missing and infinite cells, minimum, maximum.

    One pass with one row per file; the wide row is turned on its side afterwards.
    """
    keys = [file_col] if file_col else []
    aggs, entries = _cell_figures(df, [*drop, *keys])
    return df.groupBy(*keys).agg(*aggs).select(*keys, "rows", F.inline(F.array(*entries)))


def over_files(stats: DataFrame) -> DataFrame:
    """Column figures of the whole dataset from those per file."""
    return stats.groupBy("column", "numeric").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )


def constant_columns(stats: DataFrame) -> DataFrame:
    """Numeric columns with one finite value throughout."""
    finite = F.abs("min") != float("inf")
    return stats.filter((F.col("min") == F.col("max")) & finite).select("column")


def raw_label_counts(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Rows per raw label with its classes. Labels are cleaned in this small table,
    not row by row: staged, as a filter on a class would else move down to the rows."""
    counts = df.groupBy(*keys, F.col(label).alias("raw")).agg(F.count("*").alias("n"))
    return staged(counts, {"clean": clean_label("raw"), "strict": canonical_label("raw", "strict"), "permissive": canonical_label("raw")})


def label_distribution(df: DataFrame, label: str, file_col: str) -> DataFrame:
    """Rows per class, per file and in total (file NULL), absent classes as zero."""
    counts = (
        raw_label_counts(df, label, file_col).withColumnRenamed("strict", "label")
        .rollup(file_col, "label").agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    )
    files = counts.filter("_g IN (1, 3)").select(file_col)
    by_label = counts.filter("_g = 0 AND label IS NOT NULL").select(file_col, "label", "n")
    totals = by_label.groupBy("label").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias(file_col), "label", "n")
    cells = files.crossJoin(F.broadcast(class_table(df)))
    found = by_label.unionByName(totals).withColumnRenamed(file_col, "_file").withColumnRenamed("label", "_label")
    return (
        cells.join(found, F.col(file_col).eqNullSafe(F.col("_file")) & (F.col("label") == F.col("_label")), "left")
        .select(file_col, "class_no", "label", F.coalesce("n", F.lit(0)).alias("n"))
    )


def unmapped_labels(df: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """Cleaned labels without a class, most frequent first."""
    missed = (
        raw_label_counts(df, label).filter("strict IS NULL").groupBy(F.col("clean").alias("label")).agg(F.sum("n").alias("n"))
    )
    ranked = missed.orderBy(F.desc("n"), "label")
    return ranked.limit(top) if top else ranked


def leaks(name: Column, label: str) -> Column:
    """Whether a column's name says that it may give the label away."""
    return name.rlike(rf"(?i)\b({'|'.join(LEAKAGE_WORDS)})\b") & (F.lower(name) != label.lower())


def leakage_columns(df: DataFrame, label: str) -> DataFrame:
    """Columns whose name says they may give the label away."""
    names = local_table(df.sparkSession, [(c,) for c in df.columns], "column string")
    return names.filter(leaks(F.col("column"), label))


def leaking_files(footers: DataFrame, label: str) -> DataFrame:
    """(file, column) of such names over all files of a folder, from their footers.

    ``footers`` as ``sources.files.parquet_footers`` gives them: no rows are read. A table
    written as a folder ``x.parquet`` of part files is the one file ``x.parquet``.
    """
    found = footers.filter(leaks(F.col("name"), label))
    return found.select(F.regexp_extract("path", r"([^/]*\.parquet)(/|$)", 1).alias("file"), F.col("name").alias("column")).distinct()


def schema_mismatches(schemas: DataFrame) -> DataFrame:
    """Files whose ordered column list differs from that of the first file.

    ``schemas``: file, columns ARRAY<STRING>; one row per file.
    """
    first = schemas.agg(F.min_by("columns", "file").alias("expected"))
    return schemas.crossJoin(F.broadcast(first)).filter("columns != expected").select("file")


def quality_gate(df: DataFrame, label: str, file_col: str, stats: DataFrame | None = None, mismatches: int = 0, files_without_label: int = 0) -> DataFrame:
    """One row: totals, verdict and the list of failures."""
    stats = column_stats(df, file_col) if stats is None else stats
    cells = stats.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_total"), F.coalesce(F.sum("infinite"), F.lit(0)).alias("inf_total")
    )
    rows = stats.groupBy(file_col).agg(F.max("rows").alias("rows")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_total")
    )
    unmapped = unmapped_labels(df, label).agg(F.count("*").alias("unmapped_labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("unmapped_rows"))
    constant = constant_columns(over_files(stats)).agg(F.count("*").alias("constant_columns"))
    # Each side is a single row.
    joined = reduce(lambda a, b: a.crossJoin(b), [rows, cells, unmapped, constant])
    failures = F.array_compact(
        F.array(
            F.when(F.col("rows_total") == 0, "no_rows"),
            F.when(F.col("unmapped_rows") > 0, "unmapped_labels"),
            F.when(F.col("missing_total") > 0, "missing_values"),
            F.when(F.col("inf_total") > 0, "infinite_values"),
            F.when(F.lit(files_without_label) > 0, "label_column_missing"),
            F.when(F.lit(mismatches) > 0, "schema_mismatch"),
        )
    )
    return joined.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def file_label_index(df: DataFrame, label: str, file_col: str) -> DataFrame:
    """Per file: rows, rows of a canonical class and the classes present. A table without the label column is an error."""
    if label not in df.columns:
        raise ValueError(f"no column {label!r}: {df.columns}")
    counts = raw_label_counts(df, label, file_col).withColumnRenamed("permissive", "label")
    known = F.col("label").isin(*CANONICAL_CLASSES)
    return counts.groupBy(file_col).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("canonical_rows"),
        F.sort_array(F.collect_set(F.when(known, F.col("label")))).alias("canonical_present"),
    )


def dataset_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows per permissive label over the dataset, unknown ones included."""
    return raw_label_counts(df, label).groupBy(F.col("permissive").alias("label")).agg(F.sum("n").alias("n"))


def dataset_reports(
    df: DataFrame, label: str, file_col: str, schemas: DataFrame | None = None, drop=DROP_COLUMNS, top: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Report per file and one-row summary of a dataset, from one pass over its rows.

    The pass leaves one row per file and raw label, which is written down; all else is
    worked out from those. ``schemas`` (file, columns) says what each file has, as
    ``sources.files.schema_table`` gives it; cells of columns a file lacks do not
    count then. Without it every file has the columns of ``df``. A file without rows is
    reported only with ``schemas``. The summary names the ``top`` unmapped labels and counts
    files that differ; ``schema_mismatches`` names those. A dataset without the label
    column is reported as such.
    """
    found = label in df.columns
    data = df if found else df.withColumn(label, F.lit(None).cast("string"))
    aggs, entries = _cell_figures(df, [*drop, file_col])
    # Keys by names of their own, as a column of the data may be called like a figure.
    keyed = data.groupBy(F.col(f"`{file_col}`").alias("file"), F.col(f"`{label}`").alias("raw"))
    scan = cut(keyed.agg(*aggs).select("file", "raw", "rows", F.array(*entries).alias("cells")))
    if schemas is None:
        own = [c for c in df.columns if c != file_col]
        schemas = scan.select("file").distinct().withColumn("columns", F.array(*map(F.lit, own)).cast("array<string>"))
    schemas = schemas.select("file", "columns")
    cells = (
        scan.select("file", F.inline("cells")).groupBy("file", "column", "numeric")
        .agg(F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"), F.min("min").alias("min"), F.max("max").alias("max"))
        .join(schemas.select("file", F.explode("columns").alias("column")), ["file", "column"], "left_semi")
    )
    named = staged(scan.select("file", "raw", F.col("rows").alias("n")), {"clean": clean_label("raw"), "class": canonical_label("raw", "strict")})
    named = named.filter(F.lit(found))

    def counted(rows: DataFrame, name: str, out: str) -> DataFrame:
        per = rows.groupBy("file", F.col(name).alias("label")).agg(F.sum("n").alias("n"))
        most = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "label")))
        return per.groupBy("file").agg(F.transform(most, lambda e: F.struct(e["label"].alias("label"), (-e["less"]).alias("n"))).alias(out))

    figures = cells.groupBy("file").agg(
        F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"),
        F.sort_array(F.collect_list(F.when(F.col("numeric"), F.struct("column", "min", "max")))).alias("ranges"))
    report = schemas.join(scan.groupBy("file").agg(F.sum("rows").alias("rows")), "file", "left")
    known, unknown = named.filter("class IS NOT NULL"), named.filter("class IS NULL")
    for part in (figures, counted(known, "class", "classes"), counted(unknown, "clean", "unmapped")):
        report = report.join(part, "file", "left")
    none = F.array().cast("array<struct<label:string,n:bigint>>")
    report = report.select(
        "file", F.coalesce("rows", F.lit(0)).alias("rows"), "columns", F.array_contains("columns", label).alias("label_found"),
        F.coalesce("classes", none).alias("classes"), F.coalesce("unmapped", none).alias("unmapped"),
        F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("infinite", F.lit(0)).alias("infinite"), "ranges",
        F.filter("columns", lambda c: leaks(c, label)).alias("leakage"),
    )

    # Each side below is a single row: figures over files, labels, columns, names.
    over = report.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("infinite"), F.lit(0)).alias("infinite"), F.count_if(~F.col("label_found")).alias("files_without_label"))
    shared = schemas.groupBy("columns").agg(F.count("*").alias("n"), F.min("file").alias("first"))
    differ = shared.agg(F.coalesce(F.sum("n") - F.min_by("n", "first"), F.lit(0)).alias("mismatches"))
    names = schemas.select(F.explode("columns").alias("column")).distinct().agg(
        F.sort_array(F.collect_list("column")).alias("columns"),
        F.sort_array(F.collect_list(F.when(leaks(F.col("column"), label), F.col("column")))).alias("leakage"))
    constant = constant_columns(cells.filter("numeric").groupBy("column").agg(F.min("min").alias("min"), F.max("max").alias("max"))).agg(
        F.sort_array(F.collect_list("column")).alias("constant"))
    missed = unknown.groupBy(F.col("clean").alias("label")).agg(F.sum("n").alias("n"))
    entry = F.struct("label", "n")
    unmapped = missed.agg(F.count("*").alias("unmapped_labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("unmapped_rows")).crossJoin(
        missed.orderBy(F.desc("n"), "label").limit(top).agg(F.sort_array(F.collect_list(entry)).alias("unmapped")))
    classes = known.groupBy(F.col("class").alias("label")).agg(F.sum("n").alias("n")).agg(F.sort_array(F.collect_list(entry)).alias("classes"))
    joined = reduce(lambda a, b: a.crossJoin(b), [over, differ, names, constant, unmapped, classes])
    failures = F.array_compact(F.array(
        F.when(F.col("rows") == 0, "no_rows"), F.when(F.col("unmapped_rows") > 0, "unmapped_labels"),
        F.when(F.col("missing") > 0, "missing_values"), F.when(F.col("infinite") > 0, "infinite_values"),
        F.when(F.col("files_without_label") > 0, "label_column_missing"), F.when(F.col("mismatches") > 0, "schema_mismatch")))
    return report, joined.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def profile_dataset(df: DataFrame, label: str, file_col: str, drop=DROP_COLUMNS) -> dict[str, DataFrame]:
    """All reports of a dataset by name."""
    stats = column_stats(df, file_col, drop)
    return {
        "columns": stats,
        "totals": over_files(stats),
        "constant": constant_columns(over_files(stats)),
        "labels": label_distribution(df, label, file_col),
        "unmapped": unmapped_labels(df, label),
        "leakage": leakage_columns(df, label),
        "files": file_label_index(df, label, file_col),
        "verdict": quality_gate(df, label, file_col, stats),
    }
