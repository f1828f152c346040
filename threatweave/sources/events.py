"""Reading raw events and writing alerts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatweave.functions.raw import KEYS, with_fields
from threatweave.session import use_utc


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a JSON lines path.

    Blank lines are skipped and a line that is no JSON object is rejected, not
    fatal. ``ord`` follows the order of lines in a file; it depends on the file
    splits alone, so a retried task numbers its lines the same.
    """
    lines = with_fields(
        use_utc(spark).read.text(path)
        .select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("ord"))
        .filter(F.length(F.trim("raw")) > 0)
    )
    good = lines.filter(f"{KEYS} IS NOT NULL")
    rejects = lines.filter(f"{KEYS} IS NULL").select("ord", F.lit("not a JSON object").alias("error"), "raw")
    return good, rejects


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines of files that arrive in a folder."""
    return use_utc(spark).readStream.text(path).select(F.col("value").alias("raw")).filter(F.length(F.trim("raw")) > 0)


def write_alerts(alerts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines sink; ``mode`` overwrite or append."""
    alerts.write.mode(mode).json(path)
