"""Line dedup: a line many documents share stays in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatweave.llm.common import (
    BLANKS, ascii_folded, drop_bitmaps, dropped_count, kept_text, lines_of, text_lines, whole_text, with_drops,
    without_drops,
)

MIN_CHARS = 20
MIN_DOCS = 3
# A line in a third of all documents is cut into so many parts before any one task sees it.
SALTS = 1024


def _occurrences(docs: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """``h1, h2, salt, id, version, pos`` of every line long enough, dealt by hash and salt."""
    return (
        text_lines(docs).select("id", "version", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "version", "pos", ascii_folded(F.col("line")).alias("key"))
        .select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "id", "version", "pos",
        )
        .repartition("h1", "h2", "salt")
    )


def _firsts(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """``h1, h2, salt, keeper``: lines in ``min_docs`` documents or more, and the document that keeps them.

    Each salted part of a line shrinks to its document count and its largest id. The
    parts are range-partitioned by hash and sorted by document, largest first, so the
    head of each run is the occurrence that stays; a run has at most ``salts`` rows.
    """
    parts = (
        occurrences.groupBy("h1", "h2", "salt", "id").agg(F.lit(1).cast("bigint").alias("one"))
        .groupBy("h1", "h2", "salt").agg(F.sum("one").alias("docs"), F.max("id").alias("last"))
    )
    run = W.partitionBy("h1", "h2").orderBy(F.desc("last"), "salt")
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        parts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("last"), "salt")
        .select("h1", "h2", "salt", F.first("last").over(whole).alias("keeper"),
                F.sum("docs").over(whole).alias("all_docs"))
        .where(F.col("all_docs") >= min_docs)
        .select("h1", "h2", "salt", "keeper")
    )


def line_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int = SALTS,
) -> DataFrame:
    """``id, version, drops``: a compressed bitmap per document that loses a line (see ``drop_bitmaps``).

    A line's key is the line stripped of blanks with A-Z lower-cased. Keys of
    ``min_chars`` code points or more that ``min_docs`` documents hold stay in the
    document with the largest id only, there every time they occur.

    128 bits of hash stand for a key. Rows that repeat a ``doc_id`` are one
    document; a null id is the smallest id; null text is one empty line.
    """
    found = _occurrences(docs, min_chars, salts)
    firsts = _firsts(found, min_docs)
    # Both sides lie by hash and salt: no part of a line is larger than one salt's documents.
    lost = found.join(firsts, ["h1", "h2", "salt"]).where(F.col("id") != F.col("keeper"))
    return drop_bitmaps(lost.select("id", "version", "pos"))


def line_dedup(docs: DataFrame, **limits) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped, drops`` and the text that is left, ``kept_text``."""
    text = whole_text()
    return with_drops(docs.select("doc_id", "text"), line_bitmaps(docs, **limits)).select(
        "doc_id", F.size(lines_of(text)).cast("bigint").alias("n_lines"),
        dropped_count(F.col("tw$drops")).alias("n_dropped"), F.col("tw$drops").alias("drops"),
        kept_text(text, F.col("tw$drops")).alias("kept_text"),
    )


def apply_line_dedup(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without the dropped lines; ``n_chars``, where present, follows the text."""
    return without_drops(docs, with_drops(docs, line_bitmaps(docs, **limits)))
