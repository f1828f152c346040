"""Quality rules, line dedup, exact dedup, near-duplicates: against plain versions on awkward rows."""

import random

import brute as B
import pytest
from pyspark.sql import functions as F

from threatweave.llm import neardup, quality
from threatweave.llm.common import given_id
from threatweave.llm.components import connected_components
from threatweave.llm.exact import exact_dedup
from threatweave.llm.linededup import apply_line_dedup, line_dedup
from threatweave.llm.neardup import apply_near_dedup, near_duplicates
from threatweave.llm.quality import apply_quality, quality_rules


@pytest.fixture(scope="module")
def rows():
    return B.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return B.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return B.frame(spark, [])


@pytest.mark.parametrize("limits", [(10, None), (10, 10), (2, 5), (2, None)])
def test_quality(docs, rows, limits):
    got = quality_rules(docs, min_docs=limits[0], host_percent=limits[1]).select(
        given_id("id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert B.ordered(got.collect()) == B.ordered(B.quality(rows, *limits)[0])


def test_quality_applied(docs, rows):
    verdict, often = B.quality(rows, 2, 5)
    assert often
    want = []
    for (i, t, lang, s), v in zip(rows, verdict):
        if v[-1]:
            stay = [x for x in t.split("\n") if (s, B.lower(x.strip(B.BLANK))) not in often]
            want.append((i, "\n".join(stay), lang, s, len("\n".join(stay)), "clash"))
    out = apply_quality(docs, min_docs=2, host_percent=5)
    assert out.columns == docs.columns
    assert B.ordered(out.select("doc_id", "text", "lang", "source", "n_chars", "kept").collect()) == B.ordered(want)


def test_repeated_rows_change_no_verdict(spark, rows):
    """Also where most of a text is shared lines once it is counted twice, or where one text stands under two hosts."""
    shared = [f"shared line number {i} of all these pages" for i in range(3)]
    more = [(5000 + i, "\n".join([*shared, *(" ".join(f"w{i}x{j}x{k}" for k in range(12)) for j in range(5))]), "en", "h") for i in range(14)]
    more += [(6000 + i, "\n".join([*shared, "one more"]), "en", "h") for i in range(3)]

    def verdicts(given):
        out = quality_rules(B.frame(spark, given)).select(given_id("id"), "version", "n_removed_chars", "kept").distinct().collect()
        return B.ordered(out)
    once = verdicts(rows + more)
    assert verdicts([*rows, *rows, *more, *more, *more]) == once
    assert [r[3] for r in once if (r[0] or 0) >= 5000] == [True] * 14 + [False] * 3
    moved = verdicts(rows + more + [(i, t, lang, "elsewhere") for i, t, lang, _ in more])
    assert moved == once


def test_quality_hot_host(spark):
    """A host's size does not spare its lines: a third of all rows have one host, 12 of them share a line."""
    shared = "read more about this and other things on our pages"
    rows = [(i, "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(10)) for j in range(6)) + (
        f"\n{shared}" if i % 30 == 0 else ""), "en", "hot" if i % 3 == 0 else f"host{i % 41}") for i in range(360)]
    rows += [(1000 + i, rows[i][1] + "\nthe line of every page", "en", "hot") for i in range(0, 120, 2)]
    got = {r.id: r.n_removed_chars for r in quality_rules(B.frame(spark, rows)).collect()}
    of = {i: (len(shared) if shared in t else 0) + (22 if i >= 1000 else 0) for i, t, _, s in rows if s == "hot"}
    assert got == {i: of.get(i, 0) for i, *_ in rows} and sum(x > 0 for x in of.values()) > 12
    texts = {r.doc_id: r.text for r in apply_quality(B.frame(spark, rows)).collect()}
    assert len(texts) == len(rows) and not any(shared in t for t in texts.values())


def test_line_dedup(docs, rows):
    got = line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    want = B.kept_lines(rows)
    assert any(w[2] for w in want)
    assert B.ordered(got) == B.ordered(want)
    applied = apply_line_dedup(docs)
    assert applied.columns == docs.columns
    texts = [(i, (k if t is not None else None)) for (i, _, _, k), (_, t, _, _) in zip(want, rows)]
    assert B.ordered(applied.select("doc_id", "text").collect()) == B.ordered(texts)


def test_line_dedup_many_lines(spark):
    # Bitmaps longer than one word, with gaps, and a key that is only just long enough.
    lines = [f"line number {i:08d}" for i in range(300)]
    rows = [(d, "\n".join(x for i, x in enumerate(lines) if i % (d + 1) == 0) + "\n" + "é" * 20, "en", "a") for d in range(4)]
    got = line_dedup(B.frame(spark, rows), salts=3).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert B.ordered(got) == B.ordered(B.kept_lines(rows))


@pytest.mark.parametrize("prefix", [4, 256])
def test_exact(docs, rows, prefix):
    keep, size = {}, {}
    for i, t, _, _ in rows:
        keep[t or ""] = max(keep.get(t or "", B.rank(i)), B.rank(i))
        size[t or ""] = size.get(t or "", 0) + 1
    want = [(i, None if keep[t or ""] == B.rank(None) else keep[t or ""], size[t or ""], keep[t or ""] == B.rank(i),
             B.sha(t or "")) for i, t, _, _ in rows]
    assert B.ordered(exact_dedup(docs, prefix, digests=True).collect()) == B.ordered(want)
    lazy = exact_dedup(docs, prefix)
    assert B.ordered(lazy.drop("text_sha256").collect()) == B.ordered(w[:-1] for w in want)
    assert lazy.where("group_size > 1 AND text_sha256 IS NULL").isEmpty()


def _near(docs):
    return [(r.doc_id, r.n_shingles, r.comp) for r in near_duplicates(docs).select(
        given_id("id").alias("doc_id"), "n_shingles", given_id("component").alias("comp")).collect()]


def test_near(docs, rows):
    want = B.components(rows)
    assert len({w[2] for w in want}) < len(rows) - 12
    assert B.ordered(_near(docs)) == B.ordered(want)
    kept = apply_near_dedup(docs)
    assert kept.columns == docs.columns
    assert B.ordered(kept.select("doc_id").distinct().collect()) == B.ordered({(w[2],) for w in want})


@pytest.mark.parametrize("block", [2, 512])
def test_near_chains(spark, monkeypatch, block):
    """One bucket full of texts at every distance around the threshold: chains, islands, several components."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rng.sample(range(120), rng.choice([1, 3, 4, 5, 6, 8])):
            w[i] = f"z{rng.random()}"
        texts.append(" ".join(w))
    for step in range(20):  # each like the next, the ends unlike
        texts.append(" ".join(f"c{i}" for i in range(step * 4, step * 4 + 100)))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    assert B.ordered(_near(B.frame(spark, rows))) == B.ordered(B.components(rows))


def test_signature_estimates_similarity():
    import numpy as np
    x = np.arange(2000, dtype=np.uint64) * np.uint64(7919)
    agree = np.mean(neardup.signature(neardup.mix(x[:1500]), 1024) == neardup.signature(neardup.mix(x[500:]), 1024))
    assert abs(agree - 0.5) < 0.06


def test_long_words_and_blocks(monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 16)
    texts = ["a b", "", "x" * 50 + " y", "one two three four five six seven", " A\tB \n", "é" * 40, "one two three four five six"]
    assert [len(s) for s in neardup.shingle_sets(texts)] == [len(B.shingles(t)) for t in texts]
    a, b = neardup.shingle_sets(["q " * 30 + "one two three four five", "one two three four"])
    assert set(b.tolist()) < set(a.tolist())


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [
        (rng.randint(200, 280), rng.randint(200, 280)) for _ in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for u, v in links:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = connected_components(spark.createDataFrame(links, "u bigint, v bigint").repartition(4)).collect()
    ends = {x for u, v in links if u != v for x in (u, v)}
    assert {(r.node, r.comp) for r in got} == {(x, root(x)) for x in ends} and len(got) == len(ends)


def test_empty(none):
    for out in (quality_rules(none), apply_quality(none), line_dedup(none), apply_line_dedup(none), exact_dedup(none),
                near_duplicates(none), apply_near_dedup(none)):
        assert out.count() == 0


def test_no_python_in_native_plans(docs, capsys):
    for out in (quality_rules(docs), line_dedup(docs), exact_dedup(docs), quality.base_signals(docs)):
        out.select(F.count("*")).explain()
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
