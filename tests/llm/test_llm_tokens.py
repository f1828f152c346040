"""BPE and token counts against the library; url filters against a plain version."""

import random

import brute as B
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threatweave.llm.bpe import WordCodec, bpe_round_trip
from threatweave.llm.counts import Counter, token_counts
from threatweave.llm.urlfilter import filter_urls

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aAbB'sStTreVmlLdD  \n\t\r　 \x85 éÉßΣσςİı́ǅ日本語αβ12٣½.,!?*#-_\x00\x1c\x1f​ñ🙂👩‍<|>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    odd = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    return odd + ["ab" * 3000, "aaa" * 500, "<|endoftext|><|endoftext|>", " <|endoftext|> 's", "a <|ENDOFTEXT|> b", "a <|EndOfText|> b", "  a   b\n\n c \n"] + [
        t or "" for _, t, _, _ in B.corpus()]


@pytest.fixture(scope="module")
def rows():
    return B.corpus(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return B.frame(spark, rows).cache()


def test_encoder(texts, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    codec = WordCodec(WORDS)
    ids, decoded = codec.encode_batch(texts)
    for t, i, d, e in zip(texts, ids, decoded, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(i, "<u4").tolist() == e.ids, repr(t)
        assert d == library.decode(e.ids, skip_special_tokens=False), repr(t)
        assert codec.decode(e.ids) == d


def test_special_strings_in_other_case():
    """Special strings match the raw text only; in other case they are plain text."""
    library = Tokenizer.from_file(WORDS)
    codec = WordCodec(WORDS)
    texts = ["a <|ENDOFTEXT|> b", "a <|EndOfText|> b", "<|ENDOFTEXT|>", "<|StartOfText|> <|startoftext|>",
             "<|EndOfText|><|endoftext|> <|endoftext|>", "x <|endoftext|> y"]
    for group in [texts, *[[t] for t in texts]]:
        ids, decoded = codec.encode_batch(group)
        for t, i, d in zip(group, ids, decoded):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(i, "<u4").tolist() == want, repr(t)
            assert d == library.decode(want, skip_special_tokens=False), repr(t)


def test_forgetting(texts, monkeypatch):
    import threatweave.llm.bpe as bpe
    import threatweave.llm.counts as counts
    want = WordCodec(WORDS).encode_ids(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(counts, "MAX_STATES", 40)
    monkeypatch.setattr(counts, "MAX_PAIRS", 40)
    monkeypatch.setattr(counts, "MAX_WORDS", 40)
    codec = WordCodec(WORDS)
    assert [x for a in range(0, len(texts), 7) for x in codec.encode_ids(texts[a:a + 7])] == want
    library = Tokenizer.from_file(BYTES)
    counter = Counter(BYTES)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(docs, rows):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded)
           for r in bpe_round_trip(docs, WORDS).collect()]
    assert B.ordered(got) == B.ordered(want)


@pytest.mark.parametrize("chunk", [3, 40, 1 << 16])
def test_counts(docs, rows, chunk):
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t, _, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    short = docs if chunk > 3 else docs.where("coalesce(length(text), 0) < 4000")
    if chunk == 3:
        want = [w for w, (_, t, _, _) in zip(want, rows) if len(t or "") < 4000]
    assert B.ordered(token_counts(short, BYTES, chunk).collect()) == B.ordered(want)


def test_empty(spark):
    none = B.frame(spark, [])
    assert token_counts(none, BYTES).count() == 0 and bpe_round_trip(none, WORDS).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame(
        [(i, u, h, "clash", "clash") for i, u, h in rows],
        "page_id bigint, url string, html string, node string, verdict string").repartition(3)


def test_urls(spark):
    canonical = '<html><LINK rel="canonical" class=x href="{}"></html>'
    refresh = "<meta content='0; URL={}' http-equiv=refresh>"
    rows = [
        (1, "http://a.example.com/en/x", None), (2, "HTTP://WWW.example.COM/en/y?q#f", ""), (3, "http://b.net/fr/1", None),
        (4, "http://free.org/1", canonical.format("http://b.net/fr/1")),  # alias of a blocked page
        (5, "http://free.org/2", refresh.format("/1")),  # two steps away, relative
        (6, "http://free.org/3", canonical.format("http://shop.com/") + refresh.format("http://b.net/fr/1#x")),
        (7, "http://free.org/4", canonical.format("http://never-seen.net/es/z")),  # target is no page
        (8, "http://free.org/5", "<p>canonical</p>"), (9, None, None), (10, "no url", canonical.format("http://b.net/fr/1")),
        (11, "http://b.net/de", None), (12, "http://xexample.com/en/", None), (13, "http://example.com", None),
        (14, "http://net/es/", None), (3, "http://b.net/fr/1", None), (15, "http://free.org/5#frag", None),
    ]
    want = {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/y", "www.example.com/en/", "allow"),
        3: ("b.net", "/fr/1", "net/fr/", "block"),
        # The component of 3 to 6 holds an allowed member (shop.com), which outranks the blocked one.
        4: ("free.org", "/1", None, "allow"), 5: ("free.org", "/2", None, "allow"), 6: ("free.org", "/3", None, "allow"),
        7: ("free.org", "/4", None, "block"), 8: ("free.org", "/5", None, "allow"), 9: ("", "", None, "allow"),
        10: ("", "", None, "allow"), 11: ("b.net", "/de", None, "allow"), 12: ("xexample.com", "/en/", "com/", "allow"),
        13: ("example.com", "", None, "allow"), 14: ("net", "/es/", "net/es/", "block"), 15: ("free.org", "/5", None, "allow"),
    }
    got = filter_urls(_pages(spark, rows)).collect()
    assert B.ordered(tuple(r) for r in got) == B.ordered((i, *want[i]) for i, _, _ in rows)
    less = [r for r in rows if r[0] != 6]
    by_id = {r.page_id: r.verdict for r in filter_urls(_pages(spark, less)).collect()}
    assert (by_id[4], by_id[5], by_id[7], by_id[8]) == ("block", "block", "block", "allow")
    known = spark.createDataFrame([("http://free.org/5", "http://free.org/4")], "src string, dst string")
    by_id = {r.page_id: r.verdict for r in filter_urls(_pages(spark, less), redirects=known).collect()}
    assert (by_id[8], by_id[15]) == ("block", "block")
    assert filter_urls(_pages(spark, [])).count() == 0


def test_url_link_forms(spark):
    """Quoted refresh targets, dot segments and escaped ampersands name the page they lead to."""
    refresh, canonical = "<meta http-equiv=refresh content={}>", '<link rel=canonical href="{}">'
    rows = [
        (1, "http://a.org/1", refresh.format("\"0; url='http://b.net/fr/1'\"")),
        (2, "http://a.org/2", refresh.format("'0; url=\"http://b.net/fr/2\"'")),
        (3, "http://a.org/3", canonical.format("http://b.net/de/x/../../fr/./3")),
        (4, "http://a.org/4", canonical.format("http://c.org/q?a=1&amp;b=2")),
        (5, "http://c.org/q?a=1&b=2", canonical.format("http://b.net/fr/5")),
        (6, "http://d.org/x/y/z", canonical.format("../up/./6?k=../1")),
        (7, "http://d.org/x/up/6?k=../1", canonical.format("http://b.net/../../fr/7")),
        (8, "http://d.org/e/f/g", canonical.format("..")),
        (9, "http://d.org/e/", canonical.format("http://b.net/fr/9")),
        (10, "http://d.org/free", canonical.format("http://d.org/e/..x/.y")),
    ]
    got = {r.page_id: r.verdict for r in filter_urls(_pages(spark, rows)).collect()}
    assert got == {i: "allow" if i == 10 else "block" for i in range(1, 11)}
