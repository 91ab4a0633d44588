"""Counts over one text that the quality rules and the quality classifier share."""

from __future__ import annotations

from collections import Counter

import numpy as np

from .common import WordHashes, code_points, window_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def repeated_words(hashes: np.ndarray, n: int = 3) -> int:
    """Words that lie in a window of ``n`` words found twice or more."""
    if len(hashes) <= n:
        return 0
    windows = window_hashes(hashes, n)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, windows)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == windows)
    covered = np.zeros(len(hashes), bool)
    for k in range(n):
        covered[starts + k] = True
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())


def base_counts(data: bytes, words: list[bytes], hashes: WordHashes) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = code_points(data) - (len(data) - len(data.translate(None, SPACES)))
    return chars, len(data) - len(data.translate(None, SYMBOLS)), duplicate_lines(data), repeated_words(hashes(words))


def _share(n: float, of: float) -> float:
    return float(np.log((n + 0.5) / (of + 1.0)))


FEATURES = ("words", "word_length", "symbols", "capitals", "digits", "marks", "distinct", "repeated", "duplicate_lines", "bare_marks", "line_words", "top_word", "entropy", "exclamations")


def features(data: bytes, hashes: WordHashes) -> list[float]:
    """Document statistics, transformed towards bell shapes: logarithms of counts and of smoothed shares."""
    words = data.split()
    n = len(words)
    chars, symbols, lines, repeated = base_counts(data, words, hashes)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    capitals, digits = int(histogram[65:91].sum()), int(histogram[48:58].sum())
    marks = int(histogram[33:127].sum()) - capitals - digits - int(histogram[97:123].sum())
    counts = Counter(words)
    share = histogram[histogram > 0] / max(1, len(data))
    return [
        float(np.log1p(n)),
        float(np.log1p(chars / max(1, n))),
        _share(symbols, chars),
        _share(capitals, chars),
        _share(digits, chars),
        _share(marks, chars),
        float(np.log((len(counts) + 1) / (n + 1))),
        _share(repeated, n),
        _share(lines, data.count(b"\n") + 1),
        _share(sum(f for w, f in counts.items() if len(w) == 1 and not w.isalnum()), n),
        float(np.log1p(n / (data.count(b"\n") + 1))),
        _share(max(counts.values(), default=0), n),
        float(-(share * np.log(share)).sum()),
        _share(int(histogram[33]), chars),
    ]
