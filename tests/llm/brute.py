"""Plain sequential versions of the operators, and a fixture with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql.types import LongType, StringType, StructField, StructType

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Extra columns carry names that the operators use themselves.
EXTRA = ("id", "version", "kept", "size", "shard", "n", "t", "line", "pos", "node", "comp", "_id")
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
    + [StructField(c, StringType()) for c in EXTRA])


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def corpus(seed=1):
    """Rows (doc_id, text, lang, source): copies, near copies, shared lines, junk, nulls, repeated rows, long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def line(n):
        words = [rng.choice(vocab) for _ in range(n)]
        return " ".join(words).capitalize() + "."

    def prose(n):
        return "\n".join(line(rng.randint(4, 14)) for _ in range(n))

    shared = [line(8) for _ in range(5)]
    base = prose(25)
    texts = [prose(rng.randint(8, 20)) for _ in range(30)]
    texts += [texts[0]] * 3 + [texts[1].upper()]
    for _ in range(12):  # near copies of one text, from a few to many changes
        words = base.split(" ")
        for i in rng.sample(range(len(words)), rng.choice([1, 2, 4, 8, 14, 20])):
            words[i] = rng.choice(vocab) + "x"
        texts.append(" ".join(words))
    texts += [f"{s}\n{prose(10)}\n  {s.upper()}\t\n{rng.choice(shared)}" for s in shared for _ in range(4)]
    texts += ["", " \n\t ", "\n\n", "one", "one two three", "One Two Three", "a b c a b c a b c " * 30,
              "#*$%&|<> " * 60, "x" * 5000, prose(1500), "\n".join([shared[0]] * 40), "Ⅷ é É ß İ ı Σ σ  end\x0c",
              "<|endoftext|> tail  <|startoftext|>x", "it's 's we'll\r\n\r\n  they'd "]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", "a", None])) for i, t in enumerate(texts)]
    rows += [(900, None, None, "a"), (901, None, "de", None), (None, texts[3], "en", "b"), (None, None, None, None)]
    rows += [rows[5], rows[5], (7, texts[9], "en", "a")]  # a row three times, one id with two texts
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), *["clash"] * len(EXTRA)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def words(t):
    return WORD.findall(t or "")


def quality(rows, min_docs=10, percent=None):
    """Sorted (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    def keys(t):
        return [k for k in (lower(x.strip(BLANK)) for x in (t or "").split("\n")) if k]
    docs, hosts = defaultdict(set), defaultdict(set)
    for i, t, _, s in rows:
        hosts[s].add(i)
        for k in keys(t):
            docs[s, k].add(i)
    often = {x for x, d in docs.items() if len(d) > min_docs and (percent is None or 100 * len(d) > percent * len(hosts[x[0]]))}
    # Lines of a text by place: a repeated row adds none.
    gone = defaultdict(dict)
    for i, t, _, s in rows:
        gone[i, t or ""].update({at: len(k) for at, k in enumerate(keys(t)) if (s, k) in often})
    out = []
    for i, t, _, _ in rows:
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in range(3)}
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)),
                    len(hit), failed, not failed and 100 * sum(gone[i, t or ""].values()) <= 50 * len(t or "")))
    return out, often


def rank(i):
    return -(1 << 63) if i is None else i


def kept_lines(rows):
    """(doc_id, n_lines, n_dropped, kept text) per row."""
    docs = defaultdict(set)
    for i, t, _, _ in rows:
        for x in (t or "").split("\n"):
            docs[lower(x.strip(BLANK))].add(i)
    out = []
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        stay = []
        for x in lines:
            k = lower(x.strip(BLANK))
            if len(k) < 20 or len(docs[k]) < 3 or max(docs[k], key=rank) == i:
                stay.append(x)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def shingles(t):
    w = words(lower(t or ""))
    if not w:
        return frozenset()
    return frozenset(zip(*[w[j:] for j in range(4)])) if len(w) >= 4 else frozenset([tuple(w)])


def components(rows, percent=80):
    """(doc_id, set size, component id) per row, by comparing all pairs of sets."""
    sets = list({shingles(t) for _, t, _, _ in rows} - {frozenset()})
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(sets[a])] = root(sets[b])
    least = {}
    for i, t, _, _ in rows:
        if s := shingles(t):
            least[root(s)] = min(least.get(root(s), rank(i)), rank(i))
    out = []
    for i, t, _, _ in rows:
        s = shingles(t)
        c = least[root(s)] if s else rank(i)
        out.append((i, len(s), None if c == rank(None) else c))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
