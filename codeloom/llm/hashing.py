"""Word hashes for vectorised operators: one 64-bit hash per distinct word, remembered per worker."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Distinct words that a worker remembers; a full memo is emptied.
MEMO = 400_000
#: Words between ASCII blanks.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: White space for str.split that the contracts do not count as blank.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    """The words between runs of space and U+0009 to U+000D."""
    if text.isascii():
        if "\x1c" <= min(text, default="") <= "\x1f" or _ODD.search(text):
            return WORDS.findall(text)
        return text.split()
    return WORDS.findall(text) if _ODD.search(text) else text.split()


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


class WordHashes(dict):
    """word -> 64-bit hash, as a dict that fills itself."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = found
        return found


MEMORY = WordHashes()


def hashes_of(words: list[str]) -> np.ndarray:
    get = MEMORY.__getitem__
    return np.fromiter(map(get, words), np.uint64, len(words))


_ODDS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash per window of k words; a shorter text has one window with all its words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k_here = min(k, n)
    total = np.full(n - k_here + 1, np.uint64(k_here) * np.uint64(0x9E3779B97F4A7C15 & (2**63 - 1)), np.uint64)
    for i in range(k_here):
        total += (hashes[i : n - k_here + 1 + i] ^ (hashes[i : n - k_here + 1 + i] >> np.uint64(29))) * _ODDS[i]
    return mix64(total)
