"""Spelling variants, chat formatting and centroid clustering against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor, inf, isfinite, nan

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from threatweave.llm import centroids, chat, spelling
from threatweave.llm.centroids import centroid_clusters, encode_vectors, kept_vectors
from threatweave.llm.chat import MarkedTemplate, Renderer, format_chats, read_back
from threatweave.llm.queries import TRICKY
from threatweave.llm.spelling import near_words, pivots, spelling_variants, word_counts

# Spelling variants ----------------------------------------------------------


def one_edit(a, b):
    """Whether exactly one code point was inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for doc, text, *_ in rows:
        run = ""
        for c in [*B.lower(text or ""), " "]:
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
            run = ""
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_variants(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x))
        if words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return [(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()]


@pytest.fixture(scope="module")
def texts():
    """Few letters, many edits: words around each other in chains, hubs and ties, letters of two bytes, repeated rows."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abéß÷") for _ in range(rng.randint(4, 9))) for _ in range(30)]
    rows = []
    for d in range(220):
        words = []
        for _ in range(40):
            w = rng.choice(base[:1] if rng.random() < 0.3 else base)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(w)), rng.choice("abéßzA")
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((d, rng.choice([" ", "-", "\n"]).join(words), "en", "a"))
    rows += [rows[0], rows[0], (None, rows[1][1], "en", None), (None, None, None, None), (501, "", "en", "a"), (502, None, "en", "a"),
             (503, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3001, "en", "a"), (504, "a" * 3000 + " " + ("a" * 3001 + " ") * 6, "en", "b"),
             (505, "aaaaaa aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaaa " * 4, "en", "b"), (506, "Łódź ŠKODA ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ", "pl", "b")]
    return rows


def test_spelling(spark, texts, monkeypatch):
    want = plain_variants(plain_words(texts))
    assert any(w[1] and w[1] != w[2] for w in want) and any(len(w[0]) > 2999 for w in want)
    got = spelling_variants(B.frame(spark, texts)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert B.ordered(got) == B.ordered(want)
    monkeypatch.setattr(spelling, "TEXT_CHARS", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 7)
    assert {r.word: r.n for r in word_counts(B.frame(spark, texts)).collect()} == plain_words(texts)


def test_near_words_go_through_pivots(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(400)})
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    got = [tuple(sorted((r.a, r.b))) for r in near_words(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # With one pivot instead of two, an edit can hit it.
    monkeypatch.setattr(spelling, "pivots", lambda r, o: (lambda last, prefix, pair: (last, prefix, pair[:, [0, 0]]))(*pivots(r, o)))
    assert len(near_words(frame).collect()) < len(want)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9):
        often = rng.integers(1, 50, (200, n))
        rank = often * 1000 + rng.integers(0, 3, (200, n))
        last, prefix, pair = pivots(rank, often)
        for r, o, z, p, (i, j) in zip(rank, often, last, prefix, pair):
            assert z == sorted(r)[2] and (p == (r <= z)).all() and p[i] and p[j] and j - i >= 2
            at = np.flatnonzero(p)
            assert o[i] + o[j] == min(o[a] + o[b] for a in at for b in at if b - a >= 2)


# Chat formatting ----------------------------------------------------------


def chats():
    rng = random.Random(4)
    odd = ["", None, "\\", "###", "####", "\\h", "</turn>", "</turn", "\\### Assistant: </turn> ok", "a\nb", "é" * 3000, ": ", "### User: x</turn>\n"]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(odd)))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(150)]  # most rows are one conversation
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (7, None, None, None), (8, 1, "User", "a"), (8, 1, "r:o\n###le", "b"),
             (8, 1, "", "z"), (9, 2, "assistant", "twice"), (9, 2, "assistant", "twice"), *TRICKY]
    rng.shuffle(rows)
    return rows


CHATS = "conv_id bigint, turn bigint, role string, text string"


def plain_chats(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        yield c, [(role, text) for _, _, role, text in sorted(turns)]


@pytest.mark.parametrize("context", [1, 2, 16, 500])
def test_chats(spark, context):
    rows = chats()
    template = MarkedTemplate()
    frame = spark.createDataFrame(rows, CHATS).withColumns({c: F.lit("clash") for c in ("place", "start", "rendered", "rewrites")})
    formatted = format_chats(frame, template, context)
    by = defaultdict(list)
    for r in formatted.collect():
        by[r.conv_id].append(r)
    want = []
    for c, turns in plain_chats(rows):
        whole = template(turns)
        got = sorted(by[c], key=lambda r: r.place)
        assert "".join(r.rendered for r in got) == whole and template.read(whole) == turns
        assert all(whole[r.start:r.start + len(r.rendered)] == r.rendered and not r.rewrites for r in got)
        assert [template.unescape(whole[r.loss_start:r.loss_end]) for r in got if r.loss_start is not None] == [
            text for role, text in turns if role == "assistant"]
        loss = "".join(text for role, text in turns if role == "assistant")
        want.append((c, len(turns), B.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), B.sha(loss), len(whole)))
    assert B.ordered(read_back(formatted, template).collect()) == B.ordered(want)


def test_escape_is_reversible():
    rng = random.Random(6)
    template = MarkedTemplate()
    for _ in range(2000):
        turns = [("".join(rng.choice("\\#:r<c") for _ in range(rng.randint(0, 6))),
                  "".join(rng.choice(["\\", "#", "##", "</turn>", "</tu", "rn>", "h", "e", "\n", ": "]) for _ in range(rng.randint(0, 9))))
                 for _ in range(rng.randint(0, 4))]
        out = template(turns)
        assert template.read(out) == turns and out.count("</turn>\n") == len(turns) == out.count("###")


def forgetful():
    """A template that takes thoughts out of earlier turns, as some do."""
    return lambda turns: "<s>" + "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('|')[-1]}[/]" for i, (r, t) in enumerate(turns))


def test_rewritten_history_is_found():
    turns = [("user", "a"), ("assistant", "think|say"), ("user", "b"), ("assistant", "only")]
    template = forgetful()
    renderer, out, told = Renderer(template), "", []
    before = renderer.start()
    for turn in turns:
        start, rendered, a, z, rewrites = renderer.add(*turn)
        out = (before if not told else out)[:start] + rendered
        told.append(rewrites)
        assert (a is None) == rewrites and (a is None or out[a:z] == turn[1])
    assert out == template(turns) and told == [False, False, True, False]


def test_looking_back_too_far_is_found():
    def first_seen(turns):  # every turn repeats the first one
        return "".join(f"{turns[0][1]}>{t};" for _, t in turns)
    near, far = Renderer(first_seen, 50), Renderer(first_seen, 2)
    assert not any(near.add("user", str(i))[-1] for i in range(20))
    assert any(far.add("user", str(i))[-1] for i in range(20))


def test_whole_history_is_rendered():
    def numbered(turns):  # keeps its history, though each turn depends on all before it
        return "".join(f"{i} {turns[0][0]}>{t};" for i, (_, t) in enumerate(turns))

    def late(turns):  # takes its first turn back at the fiftieth
        return "".join("-" if i == 0 and len(turns) >= 50 else f"{t};" for i, (_, t) in enumerate(turns))
    turns = [("user", f"t{i}") for i in range(100)]
    renderer = Renderer(numbered)
    got = [renderer.add(*t) for t in turns]
    whole = numbered(turns)
    assert not any(g[-1] for g in got) and "".join(g[1] for g in got) == whole
    assert [whole[g[2]:g[3]] for g in got] == [t for _, t in turns]
    renderer = Renderer(late)
    assert [i for i, t in enumerate(turns) if renderer.add(*t)[-1]] == [49]


def test_trimming_template_locates_what_it_kept():
    r = Renderer(lambda turns: "".join(f"<{role}>{text.strip()}</>" for role, text in turns))
    assert r.add("user", "  hi ")[2:4] == (6, 8) and r.add("assistant", " ")[2:4] == (22, 22)


def test_rewriting_template_does_not_read_back(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x|y"), (1, 1, "user", "z")], CHATS)
    marked = MarkedTemplate()
    formatted = format_chats(frame, lambda turns: marked(
        [(r, t if i == len(turns) - 1 else t.split("|")[-1]) for i, (r, t) in enumerate(turns)]))
    assert [r.rewrites for r in formatted.collect()] == [False, True]
    with pytest.raises(Exception, match="rewrites the history"):
        read_back(formatted, MarkedTemplate()).collect()


# Centroid clustering ----------------------------------------------------------


def vectors(n=160, dims=64, seed=3):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [m + rng.gauss(0, 0.02) for m in rng.choice(middle)]) for i in range(n)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(n // 2)]  # a third is one vector
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None] + [0.5] * (dims - 1), [nan] + [0.1] * (dims - 1),
           [inf] + [0.1] * (dims - 1), [-inf] * dims, [None] * dims]
    rows += [(2000 + i, v) for i, v in enumerate(bad)]
    rows += [rows[5], rows[5], (5, list(rows[9][1])), (None, list(rows[10][1])), (3000, [0.0] * dims), (3001, [-0.0] * dims),
             (3002, [1e300] + [-1e300] * (dims - 1))]
    return rows


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [max(-2 ** 27, min(2 ** 27, floor(256 * x) if abs(x) < 1e9 else (2 ** 27 if x > 0 else -2 ** 27))) for x in v])
            for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (B.sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centres = [v for _, v in seeds]
    for turn in range(rounds + 1):
        got = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, g) in zip(kept, got) if g == j]
                if mine:
                    centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    total = Counter()
    for d, j in got:
        total[j] += d
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, got)]


@pytest.mark.parametrize("k, width, chunk", [(40, 2, 1 << 16), (40, 3, 17), (7, 64, 5), (300, 1, 64)])
def test_clusters(spark, k, width, chunk, monkeypatch):
    monkeypatch.setattr(centroids, "CELLS", 500)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("v", "key", "cluster", "n", "ids", "codes")}).repartition(3)
    got = centroid_clusters(frame, k, width=width, chunk=chunk).collect()
    assert B.ordered(got) == B.ordered(plain_clusters(rows, k, 5, 64))


def test_dictionaries_lose_nothing(spark):
    rows = vectors(50)
    kept = kept_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).coalesce(1)
    want = sorted((r.vec_id is not None, r.vec_id or 0, r.v) for r in kept.collect())
    for width, chunk in ((2, 1 << 16), (5, 9)):
        got, entries = [], 0
        for batch in encode_vectors(kept, width=width, chunk=chunk).toArrow().to_batches():
            for ids, blocks in centroids._decoded(batch, 64, width):
                assert all(len(set(map(tuple, e.tolist()))) == len(e) for _, e, _ in blocks)
                v = np.concatenate([e[c] for _, e, c in blocks], axis=1)
                got += [(i is not None, i or 0, x) for i, x in zip(ids.to_pylist(), v.tolist())]
                entries += sum(len(e) for _, e, _ in blocks)
        assert sorted(got) == want and entries < len(want) * len(blocks)


def test_distances_come_from_the_dictionaries(spark, monkeypatch):
    """Each distinct subvector is compared with the centroids once a chunk and round: nothing else is."""
    entries = np.array([[1, 2], [3, 4]])
    blocks = [(slice(0, 2), entries, np.array([0, 1, 0, 0])), (slice(2, 3), np.array([[5]]), np.zeros(4, np.int64))]
    best, distance = centroids.nearest(blocks, 4, np.array([[3, 4, 5], [1, 2, 4], [1, 2, 4]]))
    assert best.tolist() == [1, 0, 1, 1] and distance.tolist() == [1, 0, 1, 1]


# Empty tables ----------------------------------------------------------


def test_empty_tables(spark):
    assert spelling_variants(B.frame(spark, [])).count() == 0
    none = spark.createDataFrame([], CHATS)
    assert read_back(format_chats(none, MarkedTemplate()), MarkedTemplate()).count() == 0
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroid_clusters(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).count() == 0


def test_generator_templates_see_no_more_than_their_context():
    seen = []
    r = Renderer(lambda turns: seen.append(len(turns)) or chat.MarkedTemplate()(turns), 3)
    for i in range(100):
        r.add("user", str(i))
    assert max(seen) <= 7
