"""Token counts by a compiled finite-state tokenizer, chunk by chunk."""

from __future__ import annotations

import gc
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatweave.llm.bpe import byte_letters, grouped
from threatweave.llm.common import settle, whole_text

CHUNK_CHARS = 1 << 16
# Compiled states, pairs and words remembered by a worker; beyond them it starts anew.
MAX_STATES = 1 << 17
MAX_PAIRS = 1 << 19
MAX_WORDS = 1 << 19
LIMIT = 512

# Fixed value: how byte-level BPE files cut a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _State:
    """A state of the transducer: per live suffix the last token before it and the count there.

    ``chain`` holds, longest first, each suffix of the bytes read that begins some
    token, with the last token of the encoding of what precedes the suffix and that
    encoding's length relative to the whole one's. Nothing else about the past can
    change what follows, and there are finitely many of them.
    """

    __slots__ = ("chain", "next")

    def __init__(self, chain: tuple):
        self.chain = chain
        self.next: dict[int, tuple[_State, int]] = {}


class Transducer:
    """Deterministic byte-by-byte BPE; each transition carries the change in the token count.

    The encoding of ``text[:i+1]`` is the encoding of some ``text[:j]`` and one more
    token, the only one that may follow that encoding's last token. Transitions are
    compiled when first taken, from the vocabulary's prefix tree. Needs a merge list
    in which every token is made by one merge that comes after those of its parts.
    """

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.children: dict[int, int] = {}
        self.token_at = [-1]
        inner = set()
        for token, i in tokens.items():
            node = 0
            for byte in token:
                inner.add(node)
                key = node << 8 | byte
                node = self.children.get(key, 0)
                if not node:
                    node = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.grows = [n in inner for n in range(len(self.token_at))]
        size = max(tokens.values()) + 1
        # When a token is made (bytes: before all merges) and of what.
        self.made, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.rank: dict[int, int] = {}
        for when, (a, b) in enumerate(merges):
            x, y, t = tokens[a], tokens[b], tokens[a + b]
            self.rank[x << 20 | y] = when
            self.made[t], self.left[t], self.right[t] = when, x, y
        self.states: dict[tuple, _State] = {}
        self.follows: dict[int, bool] = {}
        self.start = self._state(((0, -1, 0),))

    def _state(self, chain: tuple) -> _State:
        found = self.states.get(chain)
        if found is None:
            found = self.states[chain] = _State(chain)
        return found

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether no merge across the border of the two would come before theirs.

        Goes back in time over the tokens that met at the border: a cross merge wins
        when it comes before the merge that takes in its left part, and not after the
        one that takes in its right part (equal pairs merge from the left).
        """
        key = last << 20 | token
        known = self.follows.get(key)
        if known is not None:
            return known
        x, y, x_gone, y_gone, verdict = last, token, 1 << 30, 1 << 30, True
        while True:
            cross = self.rank.get(x << 20 | y)
            if cross is not None and cross < x_gone and cross <= y_gone:
                verdict = False
                break
            x_made, y_made = self.made[x], self.made[y]
            if x_made < 0 and y_made < 0:
                break
            if x_made > y_made:
                x, x_gone = self.right[x], x_made
            else:
                y, y_gone = self.left[y], y_made
        self.follows[key] = verdict
        return verdict

    def _compile(self, state: _State, byte: int) -> tuple[_State, int]:
        children, token_at, grows = self.children, self.token_at, self.grows
        token, change, live = -1, 0, []
        for node, last, n in state.chain:
            node = children.get(node << 8 | byte)
            if node is None:
                continue
            if token < 0:
                found = token_at[node]
                if found >= 0 and (last < 0 or self._may_follow(last, found)):
                    token, change = found, n + 1
            if grows[node]:
                live.append((node, last, n))
        live = [(node, last, n - change) for node, last, n in live]
        live.append((0, token, 0))
        made = state.next[byte] = (self._state(tuple(live)), change)
        return made

    def count(self, data: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.states.clear()
            self.start = self._state(((0, -1, 0),))
        if len(self.follows) > MAX_PAIRS:
            self.follows.clear()
        state, total = self.start, 0
        for byte in data:
            step = state.next.get(byte)
            state, change = step if step is not None else self._compile(state, byte)
            total += change
        return total


class Counter(dict):
    """Counts tokens of texts. The dict remembers counts by what follows a blank up to the next one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token)

        special = [t["content"] for t in spec["added_tokens"]]
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.machine = Transducer(
            {raw(t): i for t, i in vocab.items()},
            [(raw(a), raw(b)) for a, b in merges])
        self.pieces = regex.compile(PIECES).findall
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.loose = regex.compile(r"\s |^ ").search
        # Before white space that follows none, a piece ends whatever precedes it.
        self.cuts = regex.compile(r"(?<=\S)\s")

    def __missing__(self, region: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        if region.isalpha():  # letters after a blank are one piece
            n = self.machine.count(f" {region}".encode())
        elif region and region[-1] in ".,;:!?" and region[:-1].isalpha():  # and so is one stop, one token
            n = self[region[:-1]] + 1
        else:
            n = self._plain(" " + region)
        self[region] = n
        return n

    def _plain(self, text: str) -> int:
        return sum([self.machine.count(piece.encode()) for piece in self.pieces(text)])

    def _count(self, text: str) -> int:
        if self.loose(text):  # a blank after white space joins it: no plain cut there
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + sum(map(self.__getitem__, rest))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self._count(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._count, parts))

    def chunk_map(self, text: str) -> tuple[str, int, str, bool]:
        """A chunk as a map from the state before it: ``head, n, tail, cut``.

        A chunk with a cut resets the machine: what came before is finished by ``head``,
        ``n`` tokens follow, and ``tail`` is left to the next chunk. One without a cut
        only lengthens what came before: it is all ``head``.
        """
        first = self.cuts.search(text)
        if first is None:
            return text, 0, "", False
        start, end = first.start(), len(text)
        while not self.cuts.match(text, end - 1):
            end -= 1
        return text[:start], self.count(text[start:end - 1]), text[end - 1:], True


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker process and file."""
    made = Counter(path)
    gc.freeze()  # its tables stay: the collector need not walk them again and again
    gc.set_threshold(1_000_000)  # nor the states, which only go all together
    return made


def _chunk_maps(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """Per chunk ``row, doc_id, n_bytes, k, single, head, n, tail, cut``; a single chunk is counted whole."""
    t = F.col("t")
    slim = docs.select("doc_id", whole_text().alias("t")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "t",
        F.octet_length(t).cast("bigint").alias("n_bytes"), F.char_length(t).alias("chars"))
    chunks = slim.select(
        "row", "doc_id", "n_bytes", (F.col("chars") <= chunk).alias("single"), "t",
        F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("chars") - 1, F.lit(0)) / chunk).cast("int"))).alias("k"),
    ).select("row", "doc_id", "n_bytes", "single", "k", F.when(F.col("single"), t).otherwise(
        F.substring(t, F.col("k") * chunk + 1, chunk)).alias("text"))

    def run(batches):
        c = counter(path)
        for part in grouped(batches, "text"):
            maps = [
                ("", c.count(text), "", True) if single else c.chunk_map(text)
                for text, single in zip(part.column("text").to_pylist(), part.column("single").to_pylist())]
            head, n, tail, cut = zip(*maps)
            yield pa.RecordBatch.from_arrays(
                [part.column(x) for x in ("row", "doc_id", "n_bytes", "k", "single")]
                + [pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string()),
                   pa.array(cut, pa.bool_())],
                names=["row", "doc_id", "n_bytes", "k", "single", "head", "n", "tail", "cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return chunks.mapInArrow(run, f"row bigint, doc_id {kind}, n_bytes bigint, k int, single boolean, "
                                  "head string, n bigint, tail string, cut boolean")


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the byte-level BPE file at ``path``; special strings inside a
    text count as one token. Texts are cut into chunks of ``chunk`` code points, which
    tasks turn into state maps on their own. A running count of cuts (the prefix scan)
    tells which ends meet: the pieces between two cuts are joined and counted once.
    A null or empty text has none. Repeated rows come back each; other columns are ignored.
    """
    maps = settle(_chunk_maps(docs, path, chunk), "chunk-maps")
    single = maps.where("single").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))

    parts = maps.where("NOT single")
    so_far = W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = parts.select("row", "k", "head", "tail", "cut", F.sum(F.col("cut").cast("int")).over(so_far).alias("cuts"))
    pieces = ends.select("row", F.explode(F.array(
        F.struct((F.col("cuts") - F.col("cut").cast("int")).alias("seam"), (2 * F.col("k")).alias("at"),
                 F.col("head").alias("text")),
        F.struct(F.col("cuts").alias("seam"), (2 * F.col("k") + 1).alias("at"), F.col("tail").alias("text")),
    )).alias("p")).select("row", "p.*").where("text != ''")
    seams = pieces.groupBy("row", "seam").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("text"))

    def run(batches):
        c = counter(path)
        for part in grouped(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(map(c.count, part.column("text").to_pylist()), pa.int64())],
                names=["row", "n"])

    counted = seams.select("row", "text").mapInArrow(run, "row bigint, n bigint")
    long = (
        parts.select("row", "n").unionByName(counted).groupBy("row").agg(F.sum("n").alias("n_tokens"))
        .join(parts.where("k = 0").select("row", "doc_id", "n_bytes"), "row")
        .select("doc_id", "n_bytes", "n_tokens")
    )
    return single.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
