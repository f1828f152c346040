"""Quality rules: text signals, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.llm.common import (
    BLANK_RUN, BLANKS, ascii_folded, bind, drop_bitmaps, ident, settle, text_lines, whole_text, with_drops,
    without_drops,
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A line is above the limit when more documents of its host hold it, however large the host is.
LINE_DOCS = 10
# A document is depleted when lines above the limits hold more of its characters.
DEPLETED_PERCENT = 50


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def _window_keys(words: Column) -> Column:
    """Per 3-word window one number: the window's hash above, its start below ``_mask``."""
    mask = _mask(F.size(words))
    keys = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(
            i.cast("bigint")))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(keys)


def _mask(n_words: Column) -> Column:
    """As many low bits as a position in the text needs."""
    bits = F.length(F.bin(n_words.cast("bigint")))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that begin at ``starts``, in order."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(starts, zero, lambda a, i: F.struct(
        (i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])


def base_signals(docs: DataFrame) -> DataFrame:
    """``id, version``, length and base signals of every text; a null text is an empty one.

    Repeated windows are neighbours after one sort of the window keys. Windows of one
    document are the same when all hash bits of their keys are: 63 less the bits of
    its word count (53 for a thousand words).
    """
    t = F.col("t")
    with_word = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    first = docs.select(ident().alias("id"), whole_text().alias("t")).select(
        "id", F.xxhash64(t).alias("version"), F.length(t).cast("bigint").alias("chars"),
        bind(_words(t), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _mask(F.size(w)).alias("mask"), _window_keys(w).alias("keys"))).alias("w"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        bind(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
    )
    keys = first.select("*", F.sort_array("w.keys").alias("sorted"))

    def same(x, at):
        other = F.get("sorted", at)
        return F.coalesce(x.bitwiseXOR(other).bitwiseAND(F.bitwise_not("w.mask")) == 0, F.lit(False))

    again = F.filter("sorted", lambda x, i: same(x, i + 1) | same(x, i - 1))
    starts = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("w.mask"))))
    return keys.select(
        "id", "version", "chars", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines",
        _covered(starts).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                 | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def hashed_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """Lines that hold a word, as ``id, version, pos, host, h1, h2, line_chars``.

    Lines are the same when equal after stripping but for the case of A-Z; 128 bits
    of hash stand for the line.
    """
    key = ascii_folded(F.col("line"))
    return (
        text_lines(docs, F.col(host).cast("string").alias("host"))
        .select("id", "version", "pos", "host", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .where(F.col("line") != "")
        .select("id", "version", "pos", "host", F.length("line").cast("bigint").alias("line_chars"), key.alias("key"))
        .select("id", "version", "pos", "host", "line_chars", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def frequent_lines(
    docs: DataFrame, host: str = "source", min_docs: int = LINE_DOCS, host_percent: int | None = None,
) -> DataFrame:
    """``host, h1, h2, docs``: lines in more documents of a host than ``min_docs``.

    ``host_percent`` asks for more than that share of the host's documents as well,
    which spares lines of large hosts.
    Distinct documents are counted in two steps, line and document first, so a line
    of a third of all documents is spread before its count meets in one place.
    """
    counted = (
        hashed_lines(docs, host).groupBy("host", "h1", "h2").agg(F.count_distinct("id").alias("docs"))
        .where(F.col("docs") > min_docs)
    )
    if host_percent is None:
        return counted
    hosts = (
        docs.select(F.col(host).cast("string").alias("host"), ident().alias("id"))
        .groupBy("host").agg(F.count_distinct("id").alias("host_docs"))
    )
    return (
        counted.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
        .where(100 * F.col("docs") > host_percent * F.col("host_docs"))
        .select("host", "h1", "h2", "docs")
    )


def lines_above_limits(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``id, version, pos, line_chars`` of every line above the limits."""
    # Written: against a plain table Spark can split the join at a line of many documents.
    often = settle(frequent_lines(docs, host, **limits), "frequent-lines").select(
        F.col("host").alias("_host"), "h1", "h2")
    lines = hashed_lines(docs, host)
    return lines.join(
        often, (lines.h1 == often.h1) & (lines.h2 == often.h2) & lines.host.eqNullSafe(often["_host"]),
    ).select("id", "version", "pos", "line_chars")


def quality_rules(
    docs: DataFrame, host: str = "source", depleted_percent: int = DEPLETED_PERCENT,
    above: DataFrame | None = None, **limits,
) -> DataFrame:
    """Verdict per document: base signals, characters in lines above the limits, ``kept``.

    One row per input row. Null or empty text: no words, base failed. Rows of one
    ``doc_id`` are one document to the line counts. Each of its texts has a verdict of its
    own, in which a line counts once however often the row is repeated (and where two hosts
    hold the text, if it is above the limits of either); a null ``doc_id`` is an id of its
    own, a null host a host of its own.
    Other columns are ignored. ``above`` are the lines above the limits where known.
    """
    above = lines_above_limits(docs, host, **limits) if above is None else above
    # Dealt by text once; both groupings find their rows in place.
    removed = (
        above.repartition("id", "version").groupBy("id", "version", "pos").agg(F.any_value("line_chars").alias("line_chars"))
        .groupBy("id", "version").agg(F.sum("line_chars").alias("removed"))
    )
    base = base_signals(docs)
    lost = F.coalesce("removed", F.lit(0).cast("bigint"))
    return (
        base.join(removed, ["id", "version"], "left")
        .withColumn("n_removed_chars", lost)
        .withColumn("kept", ~F.col("base_failed") & (100 * lost <= depleted_percent * F.col("chars")))
        .drop("removed")
    )


def apply_quality(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that pass, without their lines above the limits.

    Keeps all columns of ``docs``; a row with a null text fails. ``n_chars``, where
    present, follows the text.
    """
    above = settle(lines_above_limits(docs, host, **limits), "lines-above-limits")
    # Written before the filter, which would else be pushed down and repeat the word expressions many times over.
    verdicts = settle(quality_rules(docs, host, above=above).select("id", "version", "kept"), "quality-verdicts")
    passed = verdicts.where("kept").select("id", "version").distinct()
    return without_drops(docs, with_drops(docs, passed.join(drop_bitmaps(above), ["id", "version"], "left"), "inner"))
