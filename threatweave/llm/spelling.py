"""Spelling variants: words one edit apart, found by pivotal bigrams, and the form each points to."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatweave.llm.bpe import grouped
from threatweave.llm.common import settle
from threatweave.llm.feistel import mix

RUN = re.compile(r"[a-zÀ-ÿ]+")
MIN_LETTERS = 5
MIN_COUNT = 3
FACTOR = 2
EVERY = 97
# Different words a task counts before it hands them on, and characters it cuts into words at once.
HELD_WORDS = 1 << 18
TEXT_CHARS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str):
    """The runs of letters of a text, A-Z lower-cased."""
    folded = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes.lower() is A-Z alone
    if len(folded) <= TEXT_CHARS:
        return RUN.findall(folded)
    return (m.group() for m in RUN.finditer(folded))


def slipped(run: str, doc: bytes, every: int = EVERY) -> str:
    """``run`` as the document has it: one code point less where the checksum of both says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """``word, n`` for the words of at least ``min_letters`` code points and ``min_count`` occurrences.

    A task counts the words of its texts, so that a word of any frequency is few rows in the shuffle.
    """

    def run(batches):
        held: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in grouped([batch], "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    head = f"{'' if doc is None else doc}:".encode()
                    for word, n in Counter(_runs(text)).items():
                        held[slipped(word, head, every)] += n
                    if len(held) > HELD_WORDS:
                        yield told()
        if held:
            yield told()

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = slim.mapInArrow(run, "word string, n bigint").where(F.length("word") >= min_letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# Pivotal bigrams ----------------------------------------------------------


def gram_counts(words: DataFrame) -> dict[int, int]:
    """How often each bigram stands in ``words``: at most 90 * 90 of them, as words have 90 letters.

    A bigram is ``256 * first + second`` of its Latin-1 letters.
    """

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for letters, _ in _by_length(batch.column("word").to_pylist()):
                for j in range(letters.shape[1] - 1):
                    total += np.bincount(letters[:, j] * 256 + letters[:, j + 1], minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    parts = words.select("word").mapInArrow(run, "gram bigint, n bigint")
    return {r["gram"]: r["n"] for r in parts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def _by_length(words: list[str]):
    """Words of one length as rows of Latin-1 letters, and which of ``words`` they are."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        raw = "".join([words[i] for i in at]).encode("latin-1")
        yield np.frombuffer(raw, np.uint8).reshape(len(at), n).astype(np.int64), at


def pivots(rank: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word (row) the rank its prefix ends with, which bigrams are in the prefix, and its two pivots.

    The prefix has the three rarest bigrams and all that are as rare as the third: an
    edit touches two bigrams at most, so of three two lie apart. The pivots are the two
    disjoint bigrams of the prefix with the fewest occurrences in all, by dynamic
    programming over positions: the best bigram up to position j - 2, plus the one at j.
    """
    last = np.partition(rank, 2, axis=1)[:, 2]
    prefix = rank <= last[:, None]
    none = np.int64(1) << 60
    cost = np.where(prefix, often, none)
    rows = np.arange(len(rank))
    best, first, second = np.full(len(rank), 2 * none), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    lead, lead_at = np.full(len(rank), none), np.zeros(len(rank), np.int64)
    for j in range(2, rank.shape[1]):
        nearer = cost[rows, j - 2] < lead
        lead, lead_at = np.where(nearer, cost[rows, j - 2], lead), np.where(nearer, j - 2, lead_at)
        both = lead + cost[rows, j]
        better = both < best
        best = np.where(better, both, best)
        first, second = np.where(better, lead_at, first), np.where(better, j, second)
    return last, prefix, np.stack([first, second], axis=1)


def _sides(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per bigram a number for the letters up to its end, and one for those from its start on."""
    n = letters.shape[1] - 1
    left, right = np.zeros((len(letters), n), np.uint64), np.zeros((len(letters), n), np.uint64)
    up, down = letters[:, 0].astype(np.uint64), letters[:, n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            up = mix(up + _STEP) ^ letters[:, j + 1].astype(np.uint64)
            down = mix(down + _STEP) ^ letters[:, n - 1 - j].astype(np.uint64)
            left[:, j], right[:, n - 1 - j] = up, ~down
    return left.view(np.int64), right.view(np.int64)


def _postings(words: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``gram, len, pos, left, right, pivot, last, letters, word, n``: every word's prefix bigrams.

    ``pivot`` tells its two pivots; ``letters`` has the word's letters as bits (by code point modulo 64).
    """
    order = sorted(counts, key=lambda g: (counts[g], g))
    rank_of, often_of = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    rank_of[order] = np.arange(len(order))
    often_of[order] = [counts[g] for g in order]

    def run(batches):
        for batch in batches:
            for letters, at in _by_length(batch.column("word").to_pylist()):
                gram = letters[:, :-1] * 256 + letters[:, 1:]
                last, prefix, pair = pivots(rank_of[gram], often_of[gram])
                left, right = _sides(letters)
                bits = np.bitwise_or.reduce(np.left_shift(np.uint64(1), (letters % 64).astype(np.uint64)), axis=1)
                row, pos = np.nonzero(prefix)
                pivot = (pos == pair[row, 0]) | (pos == pair[row, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[row, pos].astype(np.int32)), pa.array(np.full(len(row), letters.shape[1], np.int32)),
                     pa.array(pos.astype(np.int32)), pa.array(left[row, pos]), pa.array(right[row, pos]), pa.array(pivot),
                     pa.array(last[row].astype(np.int32)), pa.array(bits.view(np.int64)[row]),
                     batch.column("word").take(pa.array(at[row])), batch.column("n").take(pa.array(at[row]))],
                    names=["gram", "len", "pos", "left", "right", "pivot", "last", "letters", "word", "n"])

    return words.mapInArrow(run, "gram int, len int, pos int, left bigint, right bigint, pivot boolean, last int, "
                                 "letters bigint, word string, n bigint")


# Where a pivot of a word stands in a near one: the difference of lengths, that of
# positions, and the side whose letters both share.
_MOVES = [(d, 0, "left") for d in (-1, 0, 1)] + [(d, d, "right") for d in (-1, 0, 1)]


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of ``words`` (``word, n``; at least 5 letters a-z, À-ÿ) one edit apart, once.

    One inserted, deleted or replaced letter leaves one of a word's two pivots whole. Of
    two near words, the one whose prefix ends with the rarer bigram (the smaller word of
    equals) therefore has a pivot in the other's prefix: at its own position if the edit
    is behind it, moved by the difference of lengths if before it. The letters on the
    pivot's other side are then the same in both. So pivots meet prefixes by bigram,
    length, position and that side (hashed to one number); what meets is compared by
    letters, then verified.
    Both sides of the join are written tables, so that a full place can be split.
    """
    spark = words.sparkSession
    # Dealt out: few bytes of words are much work.
    dealt = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    slim = settle(_postings(dealt, gram_counts(words)), "postings")

    def spot(d: int, m: int, side: str):
        return F.xxhash64("gram", F.col("len") + d, F.col("pos") + m, F.lit(side), side)

    def at(spots: list, name: str) -> list:
        return [F.explode(F.array(*spots)).alias("spot"), F.col("word").alias(name),
                *[F.col(c).alias(f"{name}_{c}") for c in ("last", "letters", "n")]]

    asked = slim.where("pivot").select(*at([spot(*move) for move in _MOVES], "a"))
    held = slim.select(*at([spot(0, 0, "left"), spot(0, 0, "right")], "b"))
    first = (F.col("a_last") < F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (F.col("a") < F.col("b")))
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2
    met = settle(asked, "pivots").join(settle(held, "prefixes"), "spot").where(first & alike)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def spelling_variants(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, factor: int = FACTOR, every: int = EVERY,
) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of the letters a-z, A-Z and U+00C0-U+00FF in the whole texts, A-Z
    lower-cased; a run loses one code point where ``every`` divides the checksum of
    ``<doc_id>:<run>``. Words of at least ``min_letters`` (5 or more) letters and
    ``min_count`` occurrences ``n`` are compared (see :func:`near_words`). A word's form
    is its near word of largest ``n`` (the smallest in code-point order of equals) if that
    is at least ``factor`` (2 or more) times its own, its root where forms lead in the end.

    Null and empty texts have no words; a missing ``doc_id`` counts as empty; repeated
    rows count each. Long texts are cut into words piece by piece. Other columns are ignored; no words give
    an empty table. Only the bigrams' counts, at most 8,100, reach the driver. Roots are
    found by doubling: a form has at least twice the occurrences of its word, so six
    rounds do for counts that fit a long.
    """
    words = settle(word_counts(docs, min_letters, min_count, every), "words")
    pairs = settle(near_words(words), "near-words")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    # The least of (-n, word): the largest n, then the smallest word by code points.
    near = sides.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("top"))
    enough = -F.col("top.minus") >= factor * F.col("n")
    told = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("top.other")).alias("form"), F.when(enough, -F.col("top.minus")).alias("form_n")), "forms")
    jumps = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # Written: the next round, and a hot root, find a plain table.
        further = settle(jumps.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jumps = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return told.join(jumps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
