"""Mixing, sharding, training order and their permutations."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import brute as B
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threatweave.llm.feistel import invert, permute
from threatweave.llm.mixing import apply_mixing, mix_documents, mix_targets, split_quotas, taken_words
from threatweave.llm.sharding import shard_documents
from threatweave.llm.queries import QUERIES
from threatweave.llm.training_order import SEED, padded, read_slots, shard_name, training_order, write_order
from threatweave.session import shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return B.corpus(2)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return B.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return B.frame(spark, [])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 256, 257, 5000])
def test_permutation(n):
    y = permute(np.arange(n), n, 11)
    assert sorted(y.tolist()) == list(range(n))
    assert (invert(y, n, 11) == np.arange(n)).all()
    if n > 250:
        assert (permute(np.arange(n), n, 12) != y).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), y.astype(float))[0, 1]) < 0.2


def test_permutation_sizes_by_element():
    n = np.repeat([3, 10, 100], [3, 10, 100])
    x = np.concatenate([np.arange(3), np.arange(10), np.arange(100)])
    y = permute(x, n, n)
    assert (y < n).all() and (y[3:13] == permute(np.arange(10), 10, 10)).all()


def test_targets():
    sizes = {None: 50, "a": 10, "b": 1000, "é": 0, "c": 30}
    target = mix_targets(sizes)
    # In code point order, null last: a 5, b 2, c 1, é 5, null 2. Reshared step by step.
    weight, left, want = {"a": 5, "b": 2, "c": 1, "é": 5, None: 2}, 1090.0, {}
    while weight:
        share = {s: left * w / sum(weight.values()) for s, w in weight.items()}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
            del weight[s]
    assert target == pytest.approx(want) and sum(target.values()) == pytest.approx(1090)
    assert mix_targets({}) == {} and mix_targets({"a": 0}) == {"a": 0}


def test_split():
    quotas = np.array([1000, 0, 37, 5])
    dealt = split_quotas(quotas, 16, 1)
    assert (dealt.sum(axis=1) == quotas).all() and np.ptp(dealt.sum(axis=0)) <= 1
    assert (dealt == split_quotas(quotas, 16, 1)).all()
    many = np.array([split_quotas(np.array([600, 200]), 4, s)[0, 0] for s in range(300)])
    # One shard of four of 800 draws: hypergeometric mean 150 and variance 28.2.
    assert abs(many.mean() - 150) < 1.5 and 18 < many.var() < 40


def test_mixing(docs, rows):
    drawn = mix_documents(docs).collect()
    assert len(drawn) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(B.words(t))
    target = mix_targets(size)
    taken, seen = Counter(), defaultdict(list)
    for r in drawn:
        assert r.source_size == size[r.source] and r.target == target[r.source]
        per_word = Counter()
        for d in r.draws:
            taken[r.source] += d.n_words
            assert 0 <= d.from_word and d.from_word + d.n_words <= r.size
            for w in range(d.from_word, d.from_word + d.n_words):
                per_word[w, d["pass"]] += 1
        assert all(n == 1 for n in per_word.values())  # disjoint within a pass
        assert max(Counter(w for w, _ in per_word).values(), default=0) <= 3
        seen[r.source] += [(d.shard, d.n_words) for d in r.draws]
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.01 * size[s] + 2
    shards = Counter()
    for x in seen.values():
        for k, n in x:
            shards[k] += n
    assert set(shards) == set(range(16))
    again = taken_words(mix_documents(docs.repartition(3)))
    assert B.ordered(again.collect()) == B.ordered(taken_words(mix_documents(docs)).collect())


def test_mixed_texts(docs):
    want = sum(r.taken for r in taken_words(mix_documents(docs)).collect())
    out = apply_mixing(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len(B.words(r.text)) for r in got) == want
    source = defaultdict(set)
    for r in docs.collect():
        source[r.doc_id].update(B.words(r.text))
    assert all(set(B.words(r.text)) <= source[r.doc_id] and r.n_chars == len(r.text) and r.kept == "clash" for r in got)


@pytest.mark.parametrize("shards", [4, 16])
def test_sharding(docs, rows, shards):
    got = shard_documents(docs, shards, payload=("text", "kept")).collect()
    assert len(got) == len(rows)
    total = Counter()
    for r in got:
        raw = (r.text or "").encode()
        import zlib
        assert (r["size"], r.text_crc32, r.law, r.kept) == (len(raw) + 1, zlib.crc32(raw), "bytes", "clash")
        total[r.shard] += r["size"]
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    where = defaultdict(set)
    group = Counter()
    for r in got:
        where[r.text or ""].add(r.shard)
        group[r.text or ""] += r["size"]
    assert all(len(x) == 1 for x in where.values())
    assert set(total) <= set(range(shards))
    # No shard can be nearer than its largest group lets it.
    assert max(total.values()) <= sum(total.values()) / shards + max(group.values())


def test_sharding_near_equal(spark):
    rows = [(i, f"text {i} " + "w" * (i % 97), "en", "a") for i in range(20000)]
    rows += [(50000 + i, "the same text again", "en", "a") for i in range(9000)]
    got = shard_documents(B.frame(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    big = max(got, key=lambda r: r.n)
    rest = [r.b for r in got if r.shard != big.shard]
    if big.n > 5000:  # the large group has a shard of its own
        assert big.n == 9000
    assert len(got) == 16 and max(rest) - min(rest) < 0.01 * max(rest)


def brute_sequences(rows, n):
    """All (doc_id, part, n_tokens, ids) as the library encodes them."""
    library = Tokenizer.from_file(VOCABULARY)
    out = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [49407]
        for p in range(0, len(ids), n):
            out.append((i, p // n, len(ids[p:p + n]), tuple((ids[p:p + n] + [49407] * n)[:n])))
    return out


def test_training_order(docs, rows, tmp_path):
    n, per = 32, 50
    ordered = training_order(docs, VOCABULARY, n, per)
    folder = f"file://{tmp_path}/shards"
    got = sorted(write_order(ordered, folder, n).collect(), key=lambda r: r.slot)
    want = brute_sequences(rows, n)
    assert [r.slot for r in got] == list(range(len(want)))
    read = list(read_slots(folder, 0, len(want) + 1, n))
    assert B.ordered((r.doc_id, r.part, r.n_tokens, tuple(x.tolist())) for r, x in zip(got, read)) == B.ordered(want)
    assert all(hashlib.sha256(x.tobytes()).hexdigest() == r.record_sha256 for r, x in zip(got, read)) and len(read) == len(got)
    # Every row names the bytes that hold it; shards follow one another without gaps.
    for r, x in zip(got, read):
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.byte_offset)
            assert f.read(2 * n) == x.tobytes()
    sizes = Counter(r.shard for r in got)
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == [shard_name(k) for k in sorted(sizes)]
    assert [r.shard for r in got] == sorted(r.shard for r in got) and len(sizes) > 3
    resumed = list(read_slots(folder, 37, 10_000, n))  # from the middle, to the end
    assert [x.tobytes() for x in resumed] == [x.tobytes() for x in read[37:]]
    assert [x.tobytes() for x in read_slots(folder, 37, 3, n)] == [x.tobytes() for x in read[37:40]]


def test_training_order_is_the_permutation(docs, rows, tmp_path):
    """Places invert to numbers that run from the task's multiple of the bound, without a hole; reruns agree."""
    n = 32
    ordered = training_order(docs.coalesce(2), VOCABULARY, n, 50).collect()
    assert [r.place for r in ordered] == sorted(r.place for r in ordered)
    sums = [sum(3 * len((t or "").encode()) // n + 1 for _, t, _, _ in part) for part in
            docs.coalesce(2).select("doc_id", "text", "lang", "source").rdd.glom().collect()]
    bound, domain = max(sums), max(sums) * len(sums)
    number = invert(np.array([r.place for r in ordered]), domain, SEED).astype(int)
    by_task = defaultdict(list)
    for k, r in sorted(zip(number.tolist(), ordered)):
        by_task[k // bound].append((k % bound, r))
    assert sorted(by_task) == list(range(len(sums)))
    for found in by_task.values():
        assert [k for k, _ in found] == list(range(len(found)))
        assert all(b.part == a.part + 1 or b.part == 0 for (_, a), (_, b) in zip(found, found[1:]))
    again = training_order(docs.coalesce(2), VOCABULARY, n, 50).collect()
    assert again == ordered


def test_training_order_repeated_rows_and_extra_columns(spark, tmp_path):
    rows = [(1, "the same words", "en", "a")] * 3 + [(None, None, None, None), (2, "", "en", "a"), (3, "long " * 3000, "en", "b")]
    docs = B.frame(spark, rows).withColumns({"place": F.lit("x"), "shard": F.lit("y"), "record": F.lit(1), "n": F.lit(2)})
    got = write_order(training_order(docs, VOCABULARY, 16, 40), f"file://{tmp_path}/s", 16).collect()
    want = brute_sequences(rows, 16)
    assert sorted(r.slot for r in got) == list(range(len(want)))
    digests = [(i, p, n, hashlib.sha256(np.array(x, "<u2").tobytes()).hexdigest()) for i, p, n, x in want]
    assert B.ordered((r.doc_id, r.part, r.n_tokens, r.record_sha256) for r in got) == B.ordered(digests)


def test_registered_training_order_writes(spark):
    """The query leaves shards of all documents, and its rows say what is in them."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("training-shards-*"))
    got = sorted(QUERIES["op10_training_order"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.slot)
    folder, = set(shared.glob("training-shards-*")) - before
    read = list(read_slots(f"file://{folder}", 0, len(got) + 1))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read] == [r.record_sha256 for r in got]
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {(r.doc_id, p): ids[p * 512:][:512] for r in docs
            for ids in [library.encode(r.text or "", add_special_tokens=False).ids + [49407]] for p in range(-(-len(ids) // 512))}
    assert {(r.doc_id, r.part): read[r.slot][:r.n_tokens].tolist() for r in got} == want and len(got) == len(want)


def test_write_order_of_several_shards_in_a_task(docs, tmp_path):
    ordered = training_order(docs, VOCABULARY, 32, 50)
    keep = ("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "record_sha256")
    one, two = ({tuple(r[k] for k in keep) for r in write_order(o, f"file://{tmp_path}/{name}", 32).collect()}
                for name, o in (("a", ordered), ("b", ordered.coalesce(2))))
    assert one == two


def test_order_without_documents(none, tmp_path):
    assert write_order(training_order(none, VOCABULARY), f"file://{tmp_path}/s").count() == 0
    assert list(read_slots(f"file://{tmp_path}/s", 0, 5)) == []


def test_wide_ids():
    n, records = padded([np.array([1, 65535], "<u4").tobytes(), b""], 7, 2)
    assert n.tolist() == [3, 1] and records.tolist() == [[1, 65535], [7, 7], [7, 7]]
    with pytest.raises(ValueError, match="16 bits"):
        padded([np.array([65536], "<u4").tobytes()], 7, 4)


def test_empty(none):
    for out in (taken_words(mix_documents(none)), apply_mixing(none), shard_documents(none), training_order(none, VOCABULARY)):
        assert out.count() == 0


def test_mixing_keeps_a_text_under_two_sources(spark):
    """Equal ids and texts under several sources, and repeated rows, are drawn each in its own source."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", s) for s in ("a", "b", None, "a", "a")] + [(2, text, "en", "b"), (3, "x y z", "en", "c")]
    docs = B.frame(spark, rows)
    drawn = Counter()
    for r in taken_words(mix_documents(docs)).join(docs.select("doc_id").distinct(), "doc_id").collect():
        drawn[r.source_size, r.target] += r.taken
    by_source = {r["source"]: r["n"] for r in mix_documents(docs).groupBy("source").agg(
        F.sum(F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["n_words"])).alias("n")).collect()}
    mixed = Counter()
    for r in apply_mixing(docs).collect():
        mixed[r.source] += len(B.words(r.text))
    assert sum(drawn.values()) == sum(by_source.values()) and {k: v for k, v in by_source.items() if v} == dict(mixed)
    assert len(mixed) == 4
