"""Splitting oversized texts at natural boundaries: a recursive hierarchy of separators.

A text of more than `limit` tokens is cut into sections, a section over limit - overlap into
paragraphs, a paragraph into sentences, a sentence into words, a word into characters; the units are
packed greedily into pieces of at most `limit` tokens. Each further piece begins with a trailing
overlap of the one before: at the earliest sentence that leaves from half of `overlap` to all of it,
else at the earliest word, else (within a word longer than that) character. So the overlap always
has from half of `overlap` to `overlap` tokens, whatever the text; only a single character of more
than limit - overlap tokens leaves less. Counts add up where cuts fall between words of the
tokenizer; any other piece is counted by itself, and ends earlier if it is over the limit.

Texts within the limit, empty and null texts give no pieces. Pieces follow each other without a gap:
leaving the overlaps out gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tokens import BYTE_BPE, ByteBPE
from recordloom.session import tokenizer_path

LIMIT, OVERLAP = 1200, 120
# Where a unit of each level begins (the end of a match).
SECTION = re.compile(r"(?:\r?\n|\r)(?=#{1,6}[ \t]|(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*(?:\r|\n))|(?:\r?\n|\r){3,}|\f")
PARAGRAPH = re.compile(r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)\s*")
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+|(?:\r?\n|\r)")
LEVELS = (SECTION, PARAGRAPH, SENTENCE)


class Counted:
    """A text with the number of tokens up to each place it may be cut at: ends of words, and within words that are too long, ends of tokens."""

    def __init__(self, bpe: ByteBPE, text: str, counts: tuple[np.ndarray, np.ndarray] | None = None, atom: int = LIMIT):
        self.bpe, self.text = bpe, text
        self.ends, self.upto = counts or next(iter(bpe.word_counts([text])))
        self.total = int(self.upto[-1])
        #: whether a place is an end of a word
        self.whole = np.ones(len(self.ends), bool)
        large = np.flatnonzero(np.diff(self.upto) > atom)
        if len(large):
            inner = [self._inside(int(self.ends[w]), int(self.ends[w + 1]), int(self.upto[w])) for w in large.tolist()]
            at, n = (np.concatenate(x) for x in zip(*inner, strict=True))
            order = np.argsort(np.concatenate([self.ends, at]), kind="stable")
            self.whole = np.concatenate([self.whole, np.zeros(len(at), bool)])[order]
            self.ends, self.upto = np.concatenate([self.ends, at])[order], np.concatenate([self.upto, n])[order]

    def _inside(self, start: int, end: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, tokens up to there) of the ends of characters in a word that are ends of tokens as well."""
        word = self.text[start:end]
        token_ends = np.cumsum(self.bpe.token_bytes(word))
        char_ends = np.cumsum(np.fromiter((len(c.encode("utf-8", "replace")) if not "\ud800" <= c <= "\udfff" else 3 for c in word), np.int64, len(word)))
        k = np.searchsorted(char_ends, token_ends)
        good = (k < len(char_ends) - 1) & (char_ends[np.minimum(k, len(char_ends) - 1)] == token_ends)
        return start + 1 + k[good], before + 1 + np.flatnonzero(good)

    def snap(self, at: int) -> int:
        """The number of the last end of a word at or before a place."""
        i = int(np.searchsorted(self.ends, at, side="right")) - 1
        while not self.whole[i]:
            i -= 1
        return i

    def units(self, limit: int) -> np.ndarray:
        """The places units end at; none is over the limit unless it can't be cut."""
        out: list[np.ndarray] = []

        def cut(a: int, b: int, level: int) -> None:
            if self.upto[b] - self.upto[a] <= limit:
                out.append(np.array([b]))
                return
            if level == len(LEVELS):
                # words, and the characters of a word over the limit
                out.append(np.arange(a + 1, b + 1))
                return
            last = a
            for m in LEVELS[level].finditer(self.text, int(self.ends[a]), int(self.ends[b])):
                w = self.snap(m.end())
                if last < w < b:
                    cut(last, w, level + 1)
                    last = w
            cut(last, b, level + 1)

        cut(0, len(self.ends) - 1, 0)
        return np.concatenate(out)

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, end, fresh, tokens): pieces in characters; from `fresh` on they are new."""
        out: list[tuple[int, int, int, int]] = []
        # new material of at most limit - overlap fits behind any overlap
        ends, upto = self.units(limit - overlap), self.upto
        unit_upto, last = upto[ends], len(self.ends) - 1
        sentences = np.unique([self.snap(m.end()) for m in SENTENCE.finditer(self.text)]) if overlap else np.zeros(0, np.int64)
        begin = fresh = 0
        while fresh < last:
            k = int(np.searchsorted(unit_upto, upto[begin] + limit, side="right")) - 1
            at = int(ends[k]) if k >= 0 else 0
            if at <= fresh:
                # the next unit can't be cut and is over limit - overlap: it comes with less overlap, or none
                at = int(ends[np.searchsorted(ends, fresh, side="right")])
                begin = min(fresh, max(begin, int(np.searchsorted(upto, upto[at] - limit))))
            n = self._count(begin, at)
            while n > limit and at > fresh + 1:
                # a cut within a word can change its tokens: fewer characters, as many as are over the limit
                at = max(fresh + 1, min(at - 1, int(np.searchsorted(upto, upto[at] - (n - limit), side="right")) - 1))
                n = self._count(begin, at)
            if n > limit and begin < fresh:
                begin, n = fresh, self._count(fresh, at)
            out.append((int(self.ends[begin]), int(self.ends[at]), int(self.ends[fresh]), n))
            begin = self._overlap(begin, at, overlap, sentences) if overlap else at
            fresh = at
        return [p for x in out for p in self._within(*x, limit)]

    def _count(self, a: int, b: int) -> int:
        if self.whole[a] and self.whole[b]:
            n = int(self.upto[b] - self.upto[a])
            # only a piece that begins or ends within a run of spaces is split anew
            if not self.text[self.ends[b] - 1].isspace() and (a == 0 or not self.text[self.ends[a] - 1].isspace()):
                return n
        return int(self.bpe.count([self.text[int(self.ends[a]) : int(self.ends[b])]])[0])

    def _overlap(self, begin: int, at: int, overlap: int, sentences: np.ndarray) -> int:
        """Where the overlap before `at` begins: at the earliest place that leaves at most `overlap` tokens; at a sentence, if that leaves at least half of it."""
        upto = self.upto
        low = max(int(np.searchsorted(upto, upto[at] - overlap)), begin + 1)
        k = int(np.searchsorted(sentences, low))
        if k < len(sentences) and 2 * (upto[at] - upto[sentences[k]]) >= overlap:
            return min(int(sentences[k]), at)
        word = low + int(np.argmax(self.whole[low : at + 1]))  # the first end of a word there
        return word if self.whole[word] and 2 * (upto[at] - upto[word]) >= overlap else min(low, at)

    def _within(self, start: int, end: int, fresh: int, n: int, limit: int) -> list[tuple[int, int, int, int]]:
        """The piece itself, or parts of it by characters, for places no token ends at."""
        if n <= limit or end - fresh <= 1:
            return [(start, end, fresh, n)]
        if start < fresh:
            return self._within(fresh, end, fresh, int(self.bpe.count([self.text[fresh:end]])[0]), limit)
        middle = (start + end) // 2
        parts = ((a, b, a, int(self.bpe.count([self.text[a:b]])[0])) for a, b in ((start, middle), (middle, end)))
        return [p for x in parts for p in self._within(*x, limit)]


def split(df: DataFrame, key: str = "doc_id", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, tokenizer: str | None = None) -> DataFrame:
    """(key, piece_no, start, end, fresh, n_tokens[, piece]) of df(key, text): the pieces of the texts over the limit; places in characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to below limit")
    path = tokenizer or tokenizer_path(BYTE_BPE)
    schema = f"`{key}` long, piece_no int, start int, end int, fresh int, n_tokens int" + ", piece string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(path)
        for b in batches:
            rows: list[tuple] = []
            # a token has at least one byte
            large = [(k, t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and (len(t) > limit or len(t) * 4 > limit and len(t.encode("utf-8", "replace")) > limit)]
            for at in range(0, len(large), 128):
                part = large[at : at + 128]
                for (k, text), counts in zip(part, bpe.word_counts([t for _, t in part]), strict=True):
                    if counts[1][-1] > limit:
                        pieces = Counted(bpe, text, counts, limit - overlap).pieces(limit, overlap)
                        rows += [(k, i, s, e, f, n, *([text[s:e]] if with_text else [])) for i, (s, e, f, n) in enumerate(pieces)]
            names = [key, "piece_no", "start", "end", "fresh", "n_tokens", *(["piece"] if with_text else [])]
            types = [pa.int64(), *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in zip(range(len(names)), types, strict=False)], names=names)

    return df.select(F.col(key).cast("long"), "text").mapInArrow(run, schema)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that had to be split."""
    return split(documents, with_text=False).where("piece_no = 0").select("doc_id")
