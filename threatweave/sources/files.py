"""Reading flow datasets whose files differ, and writing splits and reports."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from threatweave.session import cut

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def csv_encodings(spark: SparkSession, root: str) -> DataFrame:
    """(path, encoding) of every CSV file below a folder that has a line.

    UTF-8 where all bytes of the file are, else ISO-8859-1. One pass over the
    lines; large files are looked at by several tasks.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
    valid = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    return valid.select(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def read_csv(spark: SparkSession, root: str, encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All CSV files below a folder, with the name of each row's file.

    Without an encoding each file is read as ``csv_encodings`` finds it. Without a
    schema every column is text, which spares a pass over the data; files of
    different columns have to be read with one.
    """
    def read(encoding: str, *paths: str) -> DataFrame:
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("header", "true")
        reader = reader.option("encoding", encoding)
        df = (reader.schema(schema) if schema else reader).csv(list(paths))
        return df.withColumn("file", F.col("_metadata.file_name"))

    if encoding:
        return read(encoding, root)
    # Names of files come to the driver, as they do for any scan.
    found = csv_encodings(spark, root).groupBy("encoding").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.desc("encoding")).collect()
    if len(found) < 2:
        return read(found[0]["encoding"] if found else "UTF-8", root)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(r["encoding"], *r["paths"]) for r in found])


def read_parquet(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """All Parquet files below a folder, with the name of each row's file."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    picked = [F.col(f"`{c}`") for c in columns or df.columns]
    return df.select(*picked, F.col("_metadata.file_name").alias("file"))


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both."""
    both = (a, b)
    if a == b:
        return a
    if all(isinstance(t, INTEGERS) for t in both):
        return T.LongType()
    if all(isinstance(t, INTEGERS + FLOATS) for t in both):
        return T.DoubleType()
    if all(isinstance(t, TIMES) for t in both):
        return T.TimestampType()
    return T.StringType()


def _open(uri: str):
    """A file of any store pyarrow has a client for: local, HDFS and ViewFS, S3, GCS."""
    scheme, authority, path = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/]*)?(.*)", uri, re.DOTALL).groups()
    if scheme in (None, "file"):
        return pafs.LocalFileSystem().open_input_file(path)
    store, base = pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{authority or '//'}/")
    return store.open_input_file(base.rstrip("/") + path)


def _spark_type(t: pa.DataType, physical: str) -> T.DataType:
    """The type Spark reads a column of a foreign writer in."""
    if pa.types.is_dictionary(t):
        t = t.value_type
    if physical == "INT96":
        return T.TimestampType()
    unsigned = {pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0)}
    return unsigned[t] if t in unsigned else from_arrow_type(t, prefer_timestamp_ntz=True)


def _footer(uri: str) -> list[tuple[str, T.DataType]]:
    with _open(uri) as source:
        meta = pq.read_metadata(source)
    own = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if own:
        return [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(own))]
    physical = {meta.schema.column(i).path: meta.schema.column(i).physical_type for i in range(meta.num_columns)}
    return [(f.name, _spark_type(f.type, physical.get(f.name, ""))) for f in meta.schema.to_arrow_schema()]


def _footers(batches):
    for batch in batches:
        rows = [(uri, pos, name, dtype.json()) for uri in batch.column(0).to_pylist() for pos, (name, dtype) in enumerate(_footer(uri))]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "pos", "name", "type"])


def parquet_footers(spark: SparkSession, root: str) -> DataFrame:
    """(path, pos, name, type) of every column of every Parquet file below a folder.

    Tasks read the footers, no rows; ``type`` is the type's JSON.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return listed.select("path").mapInArrow(_footers, "path string, pos int, name string, type string")


def _parse(dtype: str) -> T.DataType:
    return T.StructType.fromJson({"type": "struct", "fields": [{"name": "c", "type": json.loads(dtype), "nullable": True, "metadata": {}}]})[0].dataType


def column_types(footers: DataFrame) -> dict[str, tuple[str, list[T.DataType]]]:
    """Name and different types of each column over all files, by key; what comes to the driver does not grow with the files."""
    kinds = footers.groupBy("key").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("type")).alias("types")).collect()
    return {r["key"]: (r["name"], [_parse(t) for t in r["types"]]) for r in sorted(kinds, key=lambda r: r["name"])}


def read_drifting_parquet(spark: SparkSession, root: str) -> DataFrame:
    """The union of all columns, sorted by name, each in a type that fits every file.

    The plan has a branch for each combination of types that columns of more than one
    type have, however many files there are; columns of one type may come and go
    within a branch. A column a file lacks is NULL. Names that differ in case only are
    one column, unless the session is case-sensitive. The files' names come to the
    driver, as they do for any scan.
    """
    key = F.col("name") if spark.conf.get("spark.sql.caseSensitive") == "true" else F.lower("name")
    footers = cut(parquet_footers(spark, root).withColumn("key", key))
    kinds = column_types(footers)
    if not kinds:
        raise FileNotFoundError(f"no Parquet files under {root}")
    types = {k: reduce(promote, found) for k, (_, found) in kinds.items()}
    drifting = [k for k, (_, found) in kinds.items() if len(found) > 1]
    differs = F.col("key").isin(*drifting) if drifting else F.lit(False)
    shape = F.sort_array(F.collect_list(F.when(differs, F.struct("key", "type"))))
    branches = (
        footers.groupBy("path").agg(shape.alias("shape"))
        .groupBy("shape").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.element_at("paths", 1)).collect()
    )

    def read(branch) -> DataFrame:
        here = {k: found[0] for k, (_, found) in kinds.items() if k not in drifting} | {c["key"]: _parse(c["type"]) for c in branch["shape"]}
        schema = T.StructType([T.StructField(name, here[k]) for k, (name, _) in kinds.items() if k in here])
        columns = [(F.col(f"`{name}`") if k in here else F.lit(None)).try_cast(types[k]).alias(name) for k, (name, _) in kinds.items()]
        df = spark.read.schema(schema).parquet(*branch["paths"])
        return df.select(*columns, F.col("_metadata.file_name").alias("file"))

    return reduce(DataFrame.unionByName, [read(b) for b in branches])


def schema_table(spark: SparkSession, root: str) -> DataFrame:
    """(file, columns) per file, for the schema checks of the profile."""
    columns = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda c: c["name"])
    found = parquet_footers(spark, root).groupBy("path").agg(columns.alias("columns"))
    return found.select(F.substring_index("path", "/", -1).alias("file"), "columns")


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, replacing what was there."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as JSON lines in a folder of its own."""
    for name, report in reports.items():
        report.write.mode("overwrite").json(f"{folder}/{name}")
