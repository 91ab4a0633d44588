"""Pre-tokens and ids of the lower-casing word BPE (``word_bpe_49k.json``).

The library's own normaliser and pre-tokenizer define the pieces. For texts made only of the characters in ``PLAIN``
the same split is a regular expression over the lower-cased text; every other text goes through the library itself.
"""

from __future__ import annotations

import re
from array import array

from .common import Memo

#: Characters that NFC leaves alone and that lower-case to one character: ASCII without controls, Latin-1, some punctuation.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ÿ–—‘’“”…€]")
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PIECES = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class PreTokens:
    """Splits a text into pre-tokens; special strings become pre-tokens of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.find_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()
        self.of_word = Memo(PIECES.findall)

    def segments(self, data: bytes) -> list[list[str]]:
        """Lists of pre-tokens, one for each white-space word of plain texts; joined they are the text's pre-tokens."""
        text = data.decode("utf-8", "replace")
        if self.find_special and self.find_special.search(text):
            return [[text]] if text in self.special else [p for i, part in enumerate(self.find_special.split(text)) if part for p in ([[part]] if i % 2 else self._split(part))]
        return self._split(text)

    def __call__(self, data: bytes) -> list[str]:
        return [p for s in self.segments(data) for p in s]

    def _split(self, text: str) -> list[list[str]]:
        if not PLAIN.search(text):
            return list(map(self.of_word.__getitem__, text.lower().split()))
        norm = self.tok.normalizer.normalize_str(text)
        return [[norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]]

    def ids(self, piece: str) -> list[int]:
        """The ids of one pre-token, from the library's BPE model."""
        if piece in self.special:
            return [self.special[piece]]
        written = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tok.model.tokenize(written)]


class PieceWords:
    """Texts as words whose units are pre-tokens. Texts that the library has to split give their pre-tokens, marked, as words."""

    whole = False
    MARK = b"\xff"  # begins no UTF-8 character

    def __init__(self, path: str):
        self.pre = PreTokens(path)
        self.of_word = Memo(lambda w: tuple(p.encode() for p in PIECES.findall(w.decode())))

    def words(self, data: bytes) -> list[bytes]:
        text = data.decode("utf-8", "replace")
        if PLAIN.search(text) or "<|" in text:
            return [self.MARK + p.encode() for p in self.pre(data)]
        return text.lower().encode().split()

    def units(self, word: bytes) -> tuple[bytes, ...]:
        if word.isalpha():  # a run of ASCII letters is one pre-token
            return (word,)
        return (word[1:],) if word[:1] == self.MARK else self.of_word[word]


class IdBytes:
    """The ids of a text as little-endian unsigned 32-bit bytes; each pre-token is encoded once a worker."""

    def __init__(self, path: str):
        self.pre = PreTokens(path)
        self.of_piece = Memo(lambda p: array("I", self.pre.ids(p)).tobytes())
        one = self.of_piece.f  # a run of ASCII letters is one pre-token and needs no memo of its own
        self.of_word = Memo(lambda w: one(w) if w.isascii() and w.isalpha() else b"".join(map(self.of_piece.__getitem__, PIECES.findall(w))))

    def __call__(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if PLAIN.search(text) or "<|" in text:
            return b"".join(map(self.of_piece.__getitem__, self.pre(data)))
        return b"".join(map(self.of_word.__getitem__, text.lower().split()))
