"""BPE encoding and decoding: words of many texts merged together in numpy rounds."""

from __future__ import annotations

import gc
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts are worked on in groups of about so many characters, and so many words are remembered.
GROUP_CHARS = 1 << 21
CACHE_WORDS = 1 << 18

_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself, the rest takes the code points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """A merge list as sorted pair keys, and the rounds that apply it to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.base = len(vocab) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's begin. A round merges, in each word, all places of its lowest-ranked pair.

        That equals merging place by place, because a pair made by a merge ranks after it.
        """
        all_sizes = np.array([len(w) for w in words], np.int64)
        index = np.flatnonzero(all_sizes)
        sizes = all_sizes[index]
        first = np.cumsum(all_sizes) - all_sizes  # each word's place in the byte array
        flat = np.empty(int(all_sizes.sum()), np.int32)
        got = np.zeros(len(words), np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        while len(index):
            starts = np.cumsum(sizes) - sizes
            word = np.repeat(np.arange(len(sizes)), sizes)
            at, rank = self._ranks(symbols, word)
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():  # finished words leave, so a long word costs no other word a round
                stay = ~done[word]
                n, at_home = sizes[done], first[index[done]]
                flat[np.repeat(at_home - (np.cumsum(n) - n), n) + np.arange(n.sum())] = symbols[~stay]
                got[index[done]] = n
                if done.all():
                    break
                symbols, at, rank, word = symbols[stay], at[stay], rank[stay], (np.cumsum(~done) - 1)[word[stay]]
                index, sizes, best = index[~done], sizes[~done], best[~done]
            places = np.flatnonzero(rank == best[word])
            run_start = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            nth = np.arange(len(places)) - np.repeat(run_start, np.diff(run_start, append=len(places)))
            places = places[nth % 2 == 0]  # of overlapping places (aaa) the first, third, ...
            symbols[places] = self.made[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols = symbols[keep]
            sizes = sizes - np.bincount(word[places], minlength=len(sizes))
        begin = np.cumsum(got) - got
        ids = flat[np.repeat(first - begin, got) + np.arange(got.sum())]
        return ids, np.append(begin, len(ids))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per symbol where its pair with the next one stands among the keys, and that pair's rank."""
        at = np.zeros(len(symbols), np.int64)
        rank = np.full(len(symbols), _NONE, np.int32)
        pair = symbols[:-1].astype(np.int64) * self.base + symbols[1:]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = (self.keys[found] == pair) & (word[:-1] == word[1:])
        at[:-1] = found
        rank[:-1][hit] = self.rank[found[hit]]
        return at, rank


class WordCodec:
    """Encoder and decoder of a lower-casing word BPE file (NFC, words split by a pattern).

    One that never ``decodes`` remembers ids only.
    """

    def __init__(self, path: str, decodes: bool = True):
        self.decodes = decodes
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.merges = MergeTable(vocab, model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split
        self.names = {i: t for t, i in {**vocab, **self.special}.items()}
        # By piece or word; special strings are tuples, as a plain piece may read the same once lower-cased.
        self.ids: dict[str | tuple[str], bytes] = {}
        self.shown: dict[str | tuple[str], str] = {}
        self._forget()

    def _forget(self) -> None:
        self.ids.clear()
        self.shown.clear()
        for text, i in self.special.items():
            self.ids[text,] = np.array([i], "<u4").tobytes()
            self.shown[text,] = text

    def pieces(self, text: str) -> list[str | tuple[str]]:
        """Pieces between blanks and line ends of the normalised text; special strings whole, each in a tuple."""
        if "<|" not in text:
            return self._plain_pieces(text)
        out: list[str | tuple[str]] = []
        for part in self.split_special(text):
            out.extend([(part,)] if part in self.special else self._plain_pieces(part))
        return out

    def _plain_pieces(self, text: str) -> list[str]:
        if not text.isascii():
            # Letter by letter, as the library does: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().replace("\n", " ").split(" ")

    def decode(self, ids) -> str:
        """Token names joined by blanks: the file names no decoder."""
        return " ".join([self.names[i] for i in ids])

    def _words(self, piece: str) -> list[str]:
        """The pattern's words; letters alone, or before one stop, need no pattern."""
        if piece.isalpha():
            return [piece]
        if piece and piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def learn(self, pieces: set[str | tuple[str]]) -> None:
        """Encode the pieces not met before, all their words in the same rounds."""
        ids, shown = self.ids, self.shown
        fresh = {p: self._words(p) for p in pieces.difference(ids)}
        words = list({w for found in fresh.values() for w in found}.difference(ids))
        flat, begin = self.merges.encode([w.encode() for w in words])
        raw, begin = flat.astype("<u4").tobytes(), begin.tolist()
        ids.update((word, raw[4 * a:4 * b]) for word, a, b in zip(words, begin, begin[1:]))
        if not self.decodes:
            ids.update((p, b"".join([ids[w] for w in found])) for p, found in fresh.items() if found != [p])
            return
        names = [self.names[i] for i in flat.tolist()]
        for word, a, b in zip(words, begin, begin[1:]):
            shown[word] = " ".join(names[a:b])
        for piece, found in fresh.items():
            if len(found) == 2:
                ids[piece] = ids[found[0]] + ids[found[1]]
                shown[piece] = f"{shown[found[0]]} {shown[found[1]]}"
            elif found != [piece]:
                ids[piece] = b"".join([ids[w] for w in found])
                shown[piece] = " ".join([shown[w] for w in found])

    def _split(self, texts: list[str]) -> list[list[str]]:
        split = [self.pieces(t) for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self._forget()
        self.learn(set().union(*split))
        return split

    def encode_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        ids = self.ids.__getitem__
        return [b"".join(map(ids, p)) for p in self._split(texts)]

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids and decoded text of every text."""
        split = self._split(texts)
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        return (
            [b"".join(map(ids, p)) for p in split],
            [" ".join(filter(None, map(shown, p))) for p in split],
        )


@lru_cache(maxsize=2)
def codec(path: str, decodes: bool = True) -> WordCodec:
    """One codec per worker process and file."""
    made = WordCodec(path, decodes)
    gc.freeze()  # its tables stay: the collector need not walk them again and again
    gc.set_threshold(1_000_000)  # words make no cycles
    return made


def grouped(batches, column: str):
    """Cut record batches into runs of rows with about ``GROUP_CHARS`` of text."""
    for batch in batches:
        sizes = np.diff(np.asarray(_offsets(batch.column(column))))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            held += int(n)
            if held >= GROUP_CHARS:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1 + column.offset)[column.offset:] \
        if len(column) else np.zeros(1, kind)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are the ids of the whole text as little-endian unsigned 32-bit integers,
    ``decoded`` what they decode to. Special strings inside a text are their special
    tokens. A null or empty text has no ids and decodes to the empty text. Repeated
    rows come back each; other columns are ignored.

    No shuffle: a task reads texts in groups and remembers a bounded number of words.
    """

    def run(batches):
        coder = codec(path)
        for part in grouped(batches, "text"):
            ids, decoded = coder.encode_batch(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"])

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
