"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatweave.session import shared_dir

# White space of the word and line rules: blank, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

NO_ID = -(1 << 63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ident(name: str = "doc_id") -> Column:
    """A document's id to group and join by: a missing id is the smallest one."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def given_id(name: str) -> Column:
    """The inverse of :func:`ident`."""
    return F.nullif(F.col(name), F.lit(NO_ID))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_folded(c: Column) -> Column:
    """A string equal for two texts exactly when they are equal but for the case of A-Z.

    The UTF-8 bytes are read as Latin-1 and lower-cased there, several times faster
    than ``translate``. That also moves the lead bytes C0-DE to E0-FE, but a moved
    lead byte is followed by one continuation byte and an original one by two or
    three, so different texts stay different. Only for comparing and hashing.
    """
    return F.lower(F.decode(c.cast("binary"), "ISO-8859-1"))


def tie_break(df: DataFrame) -> Column:
    """A number that orders rows which agree in what an operator looks at, the same in every rerun.

    Made of all columns but those that Spark cannot hash (maps, variants); rows that agree
    in the rest may then swap.
    """
    kinds = ("map", "variant")
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not any(k in kind for k in kinds)])


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors redo no earlier work."""
    path = run_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`run_folder`, on whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# Lines of a text ---------------------------------------------------------


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def text_lines(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per line: ``id``, ``version`` (tells texts of one id apart), ``pos`` from 0, ``line``."""
    slim = docs.select(ident().alias("id"), whole_text().alias("t"), *more)
    rest = [c for c in slim.columns if c not in ("id", "t")]
    return slim.select(
        "id", F.xxhash64("t").alias("version"), *rest,
        F.posexplode(lines_of(F.col("t"))).alias("pos", "line"),
    )


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """Rows ``id, version, pos`` of dropped lines as one compressed bitmap per document.

    ``drops`` lists the 64-line words with a dropped line, in order; a word that is
    not listed keeps all its lines.
    """
    word = F.col("pos").cast("int").bitwiseAND(~63) / 64
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").cast("int") % 64)
    return (
        # Dealt by document once; both groupings below find their rows in place.
        dropped.repartition("id", "version")
        .groupBy("id", "version", word.cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops"))
    )


def dropped_count(drops: Column) -> Column:
    return F.aggregate(
        F.coalesce(drops, F.array().cast("array<struct<word:int,bits:bigint>>")),
        F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"]),
    )


def kept_text(text: Column, drops: Column) -> Column:
    """``text`` without the lines its bitmap drops; a text without a bitmap is untouched."""

    def pick(lines):
        words = F.ceil(F.size(lines) / 64).cast("int")
        dense = bind(F.map_from_entries(drops), lambda m: F.transform(
            F.sequence(F.lit(0), words - 1), lambda w: F.coalesce(F.element_at(m, w), F.lit(0).cast("bigint"))))
        return bind(dense, lambda bits: F.array_join(F.filter(
            lines, lambda _, i: F.getbit(F.get(bits, (i / 64).cast("int")), i % 64) == 0), "\n"))

    return F.when(drops.isNull(), text).otherwise(bind(lines_of(text), pick))


def with_drops(docs: DataFrame, bitmaps: DataFrame, how: str = "left") -> DataFrame:
    """``docs`` with their bitmap in ``tw$drops`` (null: nothing dropped); ``inner`` keeps listed documents only."""
    left = docs.withColumns({"tw$id": ident(), "tw$version": F.xxhash64(whole_text())})
    right = bitmaps.select(
        F.col("id").alias("tw$id"), F.col("version").alias("tw$version"), F.col("drops").alias("tw$drops"))
    return left.join(right, ["tw$id", "tw$version"], how).drop("tw$id", "tw$version")


def without_drops(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The texts of ``marked`` (see :func:`with_drops`) without their dropped lines, in the columns of ``docs``.

    ``n_chars``, where present, follows a text that changed.
    """
    out = marked.withColumn("text", kept_text(F.col("text"), F.col("tw$drops")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("tw$drops").isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)
