"""Tables a stream writes batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def batch_ids(spark: SparkSession, folder: str) -> list[int]:
    """The batches that have written to a folder."""
    fs, path = _store(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.split("-")[1]) for n in names if n.startswith("batch-"))


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Write a batch's rows; a batch that is run again replaces its own."""
    df.write.mode("overwrite").parquet(f"{folder}/batch-{batch_id}")


def drop_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _store(spark, folder)
    fs.delete(path, True)
