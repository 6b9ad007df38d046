"""Hashed n-gram indicators for the two classifiers."""

from __future__ import annotations

import numpy as np

from .common import PRIME, WORDS, WordHash, mix

#: Maps every byte to its kind: letter case, digit, blank, other punctuation as itself.
SHAPE = bytes(ord("a") if 97 <= c <= 122 or c > 127 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
SEEDS = [np.uint64(s) for s in (0x51ED270B, 0x2545F491, 0x9E6D62D0, 0x63D83595)]


def word_features(text: bytes, bits: int, cache: WordHash) -> np.ndarray:
    """Distinct hashed unigrams, bigrams and skip-grams (one and two words skipped)."""
    w = cache.array(text.translate(WORDS).split())
    parts = [mix(w + SEEDS[0])]
    parts += [mix(w[:-gap] * PRIME + w[gap:] + SEEDS[gap]) for gap in (1, 2, 3) if len(w) > gap]
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint32)


def repeats(w: np.ndarray) -> np.ndarray:
    """Indicators of n-grams of one repeated word (n of 2, 4, 8 and 16)."""
    same = np.concatenate(([0], np.cumsum(w[1:] == w[:-1])))
    return np.array([n for n in (2, 4, 8, 16) if len(w) >= n and (same[n - 1 :] - same[: len(same) - n + 1] == n - 1).any()], np.uint64)


def shape(word: bytes) -> bytes:
    """Kinds of a word's characters, runs squeezed to one; words of lower case lose the first capital."""
    s = word.translate(SHAPE)
    out = bytes(c for i, c in enumerate(s) if not i or s[i - 1] != c)
    return out.replace(b"Aa", b"a", 1)


class ShapeHash(WordHash):
    def __missing__(self, word: bytes) -> int:
        s = shape(word)
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self.kinds[s]
        return h

    def __init__(self):
        super().__init__()
        self.kinds = WordHash()


def style_features(text: bytes, bits: int, cache: WordHash, shapes: ShapeHash) -> np.ndarray:
    """Distinct hashed word unigrams and bigrams, and one- to three-grams of word shapes."""
    w, s = cache.array(text.lower().split()), shapes.array(text.split())
    parts = [mix(w + SEEDS[0]), mix(s + SEEDS[1]), mix(repeats(w) + SEEDS[3])]
    if len(w) > 1:
        parts += [mix(w[:-1] * PRIME + w[1:] + SEEDS[2]), mix(s[:-1] * PRIME + s[1:] + SEEDS[3])]
    if len(s) > 2:
        parts.append(mix((s[:-2] * PRIME + s[1:-1]) * PRIME + s[2:] + SEEDS[1]))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint32)
