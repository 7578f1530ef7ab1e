"""Exact encoding with the libraries, each distinct word once per worker.

Byte-level and word-level pre-tokenisation never joins two words, so the encoding of a text is
that of its words one after the other. Words repeat; a bounded memo keeps what the library said
about them. Texts for which a cut between words would not be exact go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Words that a worker remembers; later ones are encoded each time they occur.
MEMO_WORDS = 400_000

# The letters of Latin-1, which no normalisation joins with a neighbour.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_LATIN = re.compile(f"[ \n\x21-\x7e{_L}]+")
# no pre-token goes on after a letter into a sign, so signs stay with the letters behind them
_PIECE = re.compile(f"[ \n]*[^{_L} \n]*[{_L}]+|[ \n]*[^{_L} \n]+|[ \n]+")
_SEGMENT = re.compile("[ \n]*[^ \n]+|[ \n]+")
# blanks of other kinds, control separators and special tokens: not cut
_WHOLE = re.compile("[^\\S \n]|<\\|")
_DOUBLED = re.compile("[ \n]{2}|^[ \n]|[ \n]$")
_WHOLE_WORDS = re.compile("[\x1c-\x1f\x85]|<\\|")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    # a task has one core; threads of the library would only wait for each other
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Memo:
    """What ``of(ids)`` gives for every segment; segments are filled in batches."""

    def __init__(self, path: str, of, total, most: int = MEMO_WORDS):
        self.path, self.of, self.total, self.most = path, of, total, most
        self.pieces: dict = {}

    def whole(self, text: str):
        return self.of(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def values(self, segments: list[str]) -> list:
        cut = [_PIECE.findall(s) if _LATIN.fullmatch(s) else [s] for s in segments]
        new = list({p for pieces in cut for p in pieces if p not in self.pieces})
        fresh = {}
        if new:
            got = _tokenizer(self.path).encode_batch_fast(new, add_special_tokens=False)
            fresh = {p: self.of(e.ids) for p, e in zip(new, got)}
            if len(self.pieces) + len(fresh) <= self.most:
                self.pieces.update(fresh)
        at = lambda p: fresh[p] if p in fresh else self.pieces[p]
        return [self.total(map(at, pieces)) for pieces in cut]


class TokenCounter:
    """Token counts under a byte-level vocabulary in which a blank belongs to the word behind it."""

    def __init__(self, path: str):
        self.memo = _Memo(path, len, sum)
        self.words: dict[str, int] = {}  # key: the word after one blank, or a newline with its word

    def _fill(self, words: list[str]) -> dict[str, int]:
        new = list({w for w in words if w not in self.words})
        segments = [w if w[:1] == "\n" else f" {w}" for w in new]
        fresh = dict(zip(new, self.memo.values(segments)))
        if len(self.words) + len(fresh) <= MEMO_WORDS:
            self.words.update(fresh)
        return fresh

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _WHOLE.search(text):
            return self.memo.whole(text)
        if _DOUBLED.search(text):
            return sum(self.memo.values(_SEGMENT.findall(text)))
        first, *words = text.replace("\n", " \n").split(" ")
        got = list(map(self.words.get, words))
        if None in got:
            fresh = self._fill([w for w, n in zip(words, got) if n is None])
            got = [fresh[w] if n is None else n for w, n in zip(words, got)]
        return sum(got) + self.memo.values([first])[0]


class WordEncoder:
    """Ids under a word-level vocabulary that drops blanks, as little-endian 32-bit bytes."""

    def __init__(self, path: str, most: int = MEMO_WORDS):
        self.memo = _Memo(path, lambda ids: np.asarray(ids, "<u4").tobytes(), b"".join, most)
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if _WHOLE_WORDS.search(text):
            return self.memo.whole(text)
        words = text.split()
        got = list(map(self.words.get, words))
        if None in got:
            new = list({w for w, x in zip(words, got) if x is None})
            fresh = dict(zip(new, self.memo.values(new)))
            if len(self.words) + len(fresh) <= self.memo.most:
                self.words.update(fresh)
            got = [fresh[w] if x is None else x for w, x in zip(words, got)]
        return b"".join(got)


@lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@lru_cache(maxsize=4)
def word_encoder(path: str, most: int = MEMO_WORDS) -> WordEncoder:
    return WordEncoder(path, most)
