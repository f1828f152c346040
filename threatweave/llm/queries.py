"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatweave.llm.bpe import bpe_round_trip
from threatweave.llm.centroids import centroid_clusters
from threatweave.llm.chat import MarkedTemplate, format_chats, read_back
from threatweave.llm.common import given_id, load, run_folder
from threatweave.llm.counts import token_counts
from threatweave.llm.exact import exact_dedup
from threatweave.llm.linededup import line_dedup
from threatweave.llm.mixing import mix_documents, taken_words
from threatweave.llm.neardup import near_duplicates
from threatweave.llm.quality import quality_rules
from threatweave.llm.sharding import shard_documents
from threatweave.llm.spelling import spelling_variants
from threatweave.llm.training_order import training_order, write_order
from threatweave.llm.urlfilter import filter_urls
from threatweave.session import local_table


def _op1(spark, d):
    out = quality_rules(load(spark, d, "documents"))
    return out.withColumn("doc_id", given_id("id")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_chars",
        "base_failed", "kept")


def _op2(spark, d):
    return line_dedup(load(spark, d, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _op3(spark, d):
    return taken_words(mix_documents(load(spark, d, "documents")))


def _op4(spark, d):
    return filter_urls(load(spark, d, "pages"))


def _op5(spark, d):
    return near_duplicates(load(spark, d, "documents")).select(
        given_id("id").alias("doc_id"), "n_shingles", given_id("component").alias("component_id"), "kept")


def _op6(spark, d):
    return exact_dedup(load(spark, d, "documents"), digests=True)


def tokenizer_file(name: str) -> str:
    """Where the vocabulary file lies; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _op7(spark, d):
    return token_counts(load(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"))


def _op8(spark, d):
    out = bpe_round_trip(load(spark, d, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _op9(spark, d):
    return shard_documents(load(spark, d, "documents"))


def _op10(spark, d):
    ordered = training_order(load(spark, d, "documents"), tokenizer_file("word_bpe_49k.json"))
    return write_order(ordered, run_folder(spark, "training-shards"))


def _op11(spark, d):
    return spelling_variants(load(spark, d, "documents"))


# A conversation whose texts look like the template's own marks.
TRICKY = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def _op12(spark, d):
    convs = load(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        local_table(spark, TRICKY, "conv_id bigint, turn bigint, role string, text string"))
    template = MarkedTemplate()
    return read_back(format_chats(convs, template), template)


def _op13(spark, d):
    return centroid_clusters(load(spark, d, "embeddings"))


QUERIES = {
    "op1_quality_rules": _op1,
    "op2_line_dedup": _op2,
    "op3_mixing": _op3,
    "op4_url_filter": _op4,
    "op5_near_dedup": _op5,
    "op6_exact_dedup": _op6,
    "op7_token_counts": _op7,
    "op8_bpe": _op8,
    "op9_sharding": _op9,
    "op10_training_order": _op10,
    "op11_spelling_variants": _op11,
    "op12_chat_format": _op12,
    "op13_centroid_clusters": _op13,
}
