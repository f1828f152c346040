"""Exact dedup by progressive refinement: length, then prefix hash, then the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatweave.llm.common import given_id, ident, settle, whole_text

PREFIX = 256
KEY = ["len", "head", "full"]


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, digests: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared as they are; null counts as empty. Of equal texts the
    largest ``doc_id`` stays. Rows are refined step by step: those whose length
    occurs once are unique; of the rest, those whose length and prefix hash occur
    once; only texts of groups that survive both are hashed whole (SHA-256, null for
    the others unless ``digests``). Every grouping combines before its shuffle, so
    a group of any size is one row per task there.

    ``group_size`` counts rows. A null ``doc_id`` is the smallest id. Rows that
    repeat a ``doc_id`` and its text are kept or dropped together.
    """
    t = F.col("t")
    rows = docs.select(ident().alias("id"), whole_text().alias("t"))
    slim = rows.select(
        "id", F.octet_length(t).alias("len"), F.xxhash64(F.substring(t, 1, prefix)).alias("head"))
    # The slim sides are written: a join of a plain table is one Spark can split at a hot key.
    lengths = settle(
        slim.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "exact-lengths")
    heads = settle(
        slim.join(lengths, "len", "left_semi")
        .groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1").select("len", "head"), "exact-heads")
    survivors = (
        slim.join(heads, ["len", "head"], "left_semi").select("id").distinct().withColumn("open", F.lit(True))
    )
    # By id, so the texts of one large group spread over all tasks.
    wanted = F.lit(True) if digests else F.col("open").isNotNull()
    hashed = settle(rows.join(survivors, "id", "left").select(
        "id", F.octet_length(t).alias("len"), F.xxhash64(F.substring(t, 1, prefix)).alias("head"),
        F.when(wanted, F.sha2(t, 256)).alias("full"), "open",
    ), "exact-hashes")
    groups = settle(
        hashed.where("open").groupBy(*KEY).agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1"),
        "exact-groups")
    keep = F.coalesce("keep", "id")
    return hashed.join(groups, KEY, "left").select(
        given_id("id").alias("doc_id"), F.nullif(keep, F.lit(-(1 << 63))).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), (keep == F.col("id")).alias("kept"),
        F.col("full").alias("text_sha256"),
    )
