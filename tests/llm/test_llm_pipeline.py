"""The pipeline stage by stage against the plain versions, and every query against its SQL twin."""

import brute as B
import numpy as np
import public_tokenizers
import pytest
from oracle_check import compare, connect
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from threatweave.llm.mixing import mix_documents, taken_words
from threatweave.llm.oracle import ORACLE
from threatweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 200


def test_registered():
    assert set(__spark_entry__.queries()) >= {*QUERIES, "pipeline"}
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_stages(spark):
    rows = B.corpus(4)
    docs = B.frame(spark, rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "bpe"]
    stage = {n: lambda d, f=f: f(spark, d, SF).persist() for n, f in corpus_pipeline.STAGES}

    def plain(df):
        return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]

    good = stage["quality_rules"](docs)
    verdict, often = B.quality(rows)
    want = [(i, "\n".join(x for x in t.split("\n") if (s, B.lower(x.strip(B.BLANK))) not in often), lang, s)
            for (i, t, lang, s), v in zip(rows, verdict) if v[-1]]
    assert good.columns == docs.columns and B.ordered(plain(good)) == B.ordered(want)

    lines = stage["line_dedup"](good)
    want = [(i, k, lang, s) for (i, _, _, k), (_, _, lang, s) in zip(B.kept_lines(want), want)]
    assert lines.columns == docs.columns and B.ordered(plain(lines)) == B.ordered(want)

    single = stage["near_dedup"](lines)
    want = {r for r, c in zip(want, B.components(want)) if r[0] == c[2]}
    assert single.columns == docs.columns and B.ordered(plain(single)) == B.ordered(want)

    mixed = stage["mixing"](single)
    taken = sum(r.taken for r in taken_words(mix_documents(single)).collect())
    assert mixed.columns == docs.columns and sum(len(B.words(r.text)) for r in mixed.collect()) == taken

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [(r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded_sha256)
           for r in stage["bpe"](mixed).collect()]
    want = []
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), tuple(ids), B.sha(library.decode(ids, skip_special_tokens=False))))
    assert B.ordered(got) == B.ordered(want)


def test_empty(spark, tmp_path):
    B.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
