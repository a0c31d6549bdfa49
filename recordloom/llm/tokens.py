"""Encoding by a public byte-level BPE: speculate and verify.

A text is split by the vocabulary's pattern into words. Distinct words that a worker has not met are
encoded together: greedy longest match proposes tokens; for every adjacent pair of proposed tokens a
vectorised check decides whether the merges would keep them apart; words of which all pairs pass are
done, since a sequence of tokens is the encoding exactly if each adjacent pair is; only failing words
undergo exact merging. Texts are then encoded by look-up.

Whether a pair stays apart: undo the two tokens along the facing edge, latest merge first. At each
moment one part of the left token touches one part of the right; if some such two parts have a merge
that comes before either would have grown further, the boundary is crossed (of equal ranks the left
one goes first).

Null and empty texts give an empty list. Special tokens' strings are ordinary text. Lone surrogates
are replaced by U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import tokenizer_path

# The pattern of the vocabulary that splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_BPE = "byte_bpe_50k.json"
SURROGATE = regex.compile("[\ud800-\udfff]")
NEVER = np.int64(1 << 40)
WORDS_KEPT = 300_000  # cached words of one worker; the cache only saves time


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class ByteBPE:
    _loaded: dict[str, ByteBPE] = {}

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        """One per worker and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_letters()
        self.vocab = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(self.vocab.values()) + 1
        raw = lambda t: bytes(letter[c] for c in t)
        left = np.array([self.vocab[raw(a)] for a, _ in merges])
        right = np.array([self.vocab[raw(b)] for _, b in merges])
        made = np.array([self.vocab[raw(a) + raw(b)] for a, b in merges])
        rank = np.arange(len(merges), dtype=np.int64)
        self.shift = np.int64(1 << 20)
        key = left.astype(np.int64) * self.shift + right
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], rank[order]
        #: the merge that makes a token (the first, -1 for single bytes), and its parts
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        for i in range(len(merges) - 1, -1, -1):
            self.rank[made[i]], self.left[made[i]], self.right[made[i]] = i, left[i], right[i]
        self.merge = {(int(a), int(b)): (i, int(c)) for i, (a, b, c) in enumerate(zip(left, right, made, strict=True))}
        #: the length of the longest token that begins with these three bytes
        self.longest: dict[bytes, int] = {}
        for t in self.vocab:
            if len(t) > 2:
                self.longest[t[:3]] = max(len(t), self.longest.get(t[:3], 0))
        self.byte = [self.vocab[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.index: dict[str, int] = {}
        self._reset()
        self.exact = 0  # words that needed exact merging

    def _reset(self) -> None:
        self.index.clear()
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, vocab, longest = [], 0, len(word), self.vocab, self.longest
        whole = vocab.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            end = min(n, at + longest.get(word[at : at + 3], 2))
            while (t := vocab.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def _rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.shift + y
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the two tokens' bytes is just the two tokens (as far as their boundary goes)."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        grow_x, grow_y = np.full(len(x), NEVER), np.full(len(x), NEVER)  # the rank at which the part grows further
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            r = self._rank_of(x, y)
            crossed = (r < grow_x) & (r <= grow_y) & (r < NEVER)
            good[open_[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            open_, x, y, grow_x, grow_y, rx, ry = (v[on] for v in (open_, x, y, grow_x, grow_y, rx, ry))
            # undo the later merge; of the same merge on both sides, the right one came later
            undo_x = rx > ry
            grow_x, grow_y = np.where(undo_x, rx, grow_x), np.where(undo_x, grow_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def merged(self, word: bytes) -> list[int]:
        """The encoding by exact merging: always the pair of the lowest rank, the leftmost first; by a heap over linked parts."""
        import heapq

        part = [self.byte[b] for b in word]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(n - 1) if (m := merge.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((part[i], part[k])):
                    heapq.heappush(heap, (m[0], i, part[i], part[k]))
            if (h := before[i]) >= 0 and (m := merge.get((part[h], part[i]))):
                heapq.heappush(heap, (m[0], h, part[h], part[i]))
        return [p for p in part if p >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the words, one after another."""
        raw = [w.encode() for w in words]
        proposed = [self.greedy(w) for w in raw]
        length = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(length.sum()))
        word = np.repeat(np.arange(len(words)), length)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(flat[inner] * self.shift + flat[inner + 1], return_inverse=True)
        good = self.apart(pair // self.shift, pair % self.shift)[back]
        failing = np.unique(word[inner][~good])
        if len(failing):
            self.exact += len(failing)
            for i in failing.tolist():
                proposed[i] = self.merged(raw[i])
            length = np.fromiter(map(len, proposed), np.int64, len(proposed))
            flat = np.fromiter((t for p in proposed for t in p), np.int64, int(length.sum()))
        return flat.astype(np.int32), length

    def _learn(self, words: list[str]) -> None:
        flat, length = self.encode_words(words)
        base = len(self.start)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each word, words per text)."""
        split = self.split
        return self._entries([split(SURROGATE.sub("\ufffd", t)) if t else [] for t in texts])

    def _entries(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > WORDS_KEPT:
            self._reset()
        index = self.index
        if new := set(chain.from_iterable(parts)).difference(index):
            self._learn(list(new))
        return np.fromiter(map(index.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts))), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        entry, words = self._rows(texts)
        length = self.length[entry]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(self.start[entry], length) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)]
        return flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        entry, words = self._rows(texts)
        ends = np.concatenate([[0], np.cumsum(self.length[entry])])
        at = np.concatenate([[0], np.cumsum(words)])
        return ends[at[1:]] - ends[at[:-1]]

    def token_bytes(self, word: str) -> np.ndarray:
        """How many bytes each token of one word has."""
        flat, _ = self.encode_words([SURROGATE.sub("\ufffd", word)])
        if not hasattr(self, "size"):
            self.size = np.zeros(len(self.rank), np.int64)
            self.size[list(self.vocab.values())] = [len(t) for t in self.vocab]
        return self.size[flat]

    def word_counts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text: where its words end, in characters; how many ids there are up to there; each with a leading 0."""
        parts = [self.split(SURROGATE.sub("\ufffd", t)) for t in texts]
        entry, words = self._entries(parts)
        # looked up before the first is given out: who asks for counts between two texts may have the cache reset, and entries are numbered anew then
        length = self.length[entry]
        ends = np.cumsum(words)
        for p, lo, hi in zip(parts, ends - words, ends, strict=True):
            yield np.concatenate([[0], np.cumsum(np.fromiter(map(len, p), np.int64, len(p)))]), np.concatenate([[0], np.cumsum(length[lo:hi])])


def encoded(df: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(key, ids array<int>) of df(key, text)."""
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                flat, offsets = bpe.encode(texts[at : at + 512])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], names=[key, "ids"])

    return df.select(F.col(key).cast("long"), "text").mapInArrow(run, f"`{key}` long, ids array<int>")
