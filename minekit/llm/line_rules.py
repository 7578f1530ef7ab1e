"""Line-first quality rules: bad lines go, then documents that lost too much of their text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A document is rejected if its bad lines hold more than this share of its word characters.
MAX_LOST = 0.3
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = re.compile(
    r"lorem ipsum|javascript|cookie|click here|subscribe|sign up|log ?in\b|terms of (?:use|service)"
    r"|privacy policy|all rights reserved|add to cart|share this|read more|skip to content"
)
_SHOUT = re.compile(r"!!")


def line_rule(line: str) -> str | None:
    """Name of the first rule that a line with words fails, or None.

    navigation: separators stand between at least every third word; punctuation: signs or shouts
    at every second word, or capitals throughout; boilerplate: a short line with a known phrase.
    """
    words = line.split()
    n = len(words)
    bars = line.count("|") + line.count("»") + line.count("•")
    if bars >= 2 and 3 * bars >= n - bars:
        return "navigation"
    symbols = sum(map(line.count, SYMBOLS))
    if symbols >= 3 and 2 * symbols >= n or len(_SHOUT.findall(line)) * 2 >= max(n, 4):
        return "punctuation"
    if n >= 5 and line.isupper():
        return "punctuation"
    if n <= 20 and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def judge(text: str, max_lost: float = MAX_LOST) -> tuple:
    """Figures and verdict of one text, and the text without its bad lines."""
    words = text.encode().split()
    chars = word_chars(text)
    seen: set[str] = set()
    kept, dup, lost = [], 0, 0
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_rule(line):
            lost += word_chars(line)
        else:
            kept.append(line)
    repeats = repeated_words(words)
    n = len(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    good = not failed and lost <= max_lost * chars
    symbols = sum(map(text.count, SYMBOLS))
    return n, chars, symbols, dup, repeats, failed, good, chars - lost, "\n".join(kept)


_FIGURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, clean_chars bigint"
)


def clean_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST, texts: bool = True
) -> DataFrame:
    """``doc_id``, the figures, ``kept`` and, if asked for, the ``clean_text`` of every row.

    A missing text counts as empty: no words, so it fails. An earlier equal line makes a line a
    duplicate, which is removed like any bad line. Rows keep their order and repeats; rows without
    an id stay; other columns are not looked at. No shuffle: a task holds one batch of rows.
    """
    schema = f"{_FIGURES}, clean_text string" if texts else _FIGURES
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(t or "", max_lost)[: len(names)] for t in batch["text"]]
            yield pd.DataFrame(rows, columns=names).assign(doc_id=batch["doc_id"].array)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    importable(df.sparkSession)
    return rows.mapInPandas(run, f"{schema}, doc_id {kind}").select("doc_id", *names)
