"""Words of a text and sets of words, for Arrow batches.

Words are the maximal runs of letters and digits (categories L and N) of the NFKC form in lower case.
A null text has no words. Scope is trimmed and lower-cased; null or blank means "default".
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")  # Python's letters and numbers are categories L and N
_HASHES: dict[str, int] = {}
_KEPT = 400_000  # entries of the cache of word hashes in one Python worker; it only saves time


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


def scope_key(scope: str | None) -> str:
    return (scope or "").strip().lower() or "default"


def word_hash(word: str) -> int:
    """Signed 64 bits."""
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) >= _KEPT:
            _HASHES.clear()
        h = _HASHES[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
    return h


def word_set(text: str | None, scope: str | None = None) -> np.ndarray:
    """The sorted hashes of the distinct words; with a scope, of its words, so that sets of two scopes share none."""
    out = np.array([word_hash(w) for w in set(words(text))], dtype=np.int64)
    if scope is not None:
        out ^= word_hash("\0" + scope)
    out.sort()
    return out


def set_key(hashes: np.ndarray) -> int:
    """Signed 64 bits that name a set of words."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
