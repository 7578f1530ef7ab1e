"""Periodic runs of words, found online by catchers over power-of-two blocks.

Words are appended one by one. Whenever ``2**k`` of them complete an aligned block, the block becomes a
catcher for squares of period ``2**(k+1) - 1`` to ``2**(k+2) - 2``: the first half of such a square holds a
whole aligned block of that size, so the block comes back one period later. Each appended word advances
the comparison of the text's suffixes with the live catchers, two or three a level. A catch is followed to the
left, which gives the word at which the square is complete; there it is compared, reported, and merged
into a run that grows as long as words repeat at its period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable, text_of

#: A run has at least this many words, and two periods.
MIN_LENGTH = 12
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687


class SquareCatcher:
    """The runs of a growing sequence of whole numbers from 0 on."""

    def __init__(self, min_length: int = MIN_LENGTH):
        self.min_length = min_length
        self.words: list[int] = []
        self.runs: list[tuple[int, int, int]] = []  # (start, length, period) of the runs that have ended
        self._prefix = [0]  # hashes of the beginnings
        self._powers = [_BASE]  # of the base, to 2**k
        self._blocks: list[list[int]] = [[]]  # by level: hashes of the completed blocks
        self._seen: list[set[int]] = [set()]
        self._open: dict[int, int] = {}  # period: start of the run that goes on
        self._due: dict[int, list[tuple[int, int]]] = {}  # word at which a square would be complete

    def extend(self, words: Iterable[int]) -> SquareCatcher:
        """Append the words, one after the other."""
        held, prefix, powers, blocks, seen = self.words, self._prefix, self._powers, self._blocks, self._seen
        running, due = self._open, self._due
        last, before = (held[-1] if held else -1), (held[-2] if len(held) > 1 else -1)
        mixed = prefix[-1]
        for i, word in enumerate(words, len(held)):
            held.append(word)
            mixed = (mixed * _BASE + word + 1) % _PRIME
            prefix.append(mixed)
            if running:
                for period in [q for q in running if held[i - q] != word]:
                    self._close(period, i)
            if i in due:
                for start, period in due.pop(i):
                    self._report(start, period, i)
            if word == last:
                self._catch(i - 1, 1, 1, i)
            if word == before:
                self._catch(i - 2, 2, 1, i)
            last, before = word, last
            # a suffix that equals no block of a level equals none of a higher level: its second half is a block
            for k in range(1, len(blocks)):
                size = 1 << k
                j = i + 1 - size
                suffix = (mixed - prefix[j] * powers[k]) % _PRIME
                if suffix not in seen[k]:
                    break
                level = blocks[k]
                # periods from 2 * size - 1 to 4 * size - 2
                for m in range(max(j - 3 * size + 1, 0) >> k, (j - 2 * size + 1 >> k) + 1):
                    if level[m] == suffix:
                        self._catch(m << k, j - (m << k), size, i)
            # blocks that this word completes
            k, size = 1, 2
            while (i + 1) % size == 0:
                if k == len(blocks):
                    powers.append(powers[-1] * powers[-1] % _PRIME)
                    blocks.append([])
                    seen.append(set())
                block = (mixed - prefix[i + 1 - size] * powers[k]) % _PRIME
                blocks[k].append(block)
                seen[k].add(block)
                k, size = k + 1, 2 * size
        return self

    def _catch(self, block: int, period: int, size: int, i: int) -> None:
        """A block came back after ``period`` words, up to word ``i``: find where its square is complete."""
        if period in self._open or self._explained(block, period):
            return
        words, least = self.words, max(block - size, 0)
        start, step, growing = block, 1, True
        while start > least and step:  # in steps that double, then halve
            low = max(start - step, least)
            if words[low:start] == words[low + period : start + period]:
                start = low
            else:
                growing = False
            step = 2 * step if growing else step // 2
        if block - start == size:
            return  # the block before this one came back as well, and was followed
        end = start + 2 * period - 1
        if end <= i:
            self._report(start, period, i)
        else:
            self._due.setdefault(end, []).append((start, period))

    def _report(self, start: int, period: int, i: int) -> None:
        """Start a run if a square begins at ``start`` and goes on to word ``i``; not if a shorter period explains it."""
        words, middle = self.words, start + period
        if period in self._open or words[start : i + 1 - period] != words[middle : i + 1]:
            return
        if not self._explained(start, period):
            self._open[period] = start

    def _explained(self, start: int, period: int) -> bool:
        """Whether a run of a shorter period, of which this one is a multiple, goes on since ``start``."""
        return any(period % q == 0 and begin <= start for q, begin in self._open.items())

    def _close(self, period: int, end: int) -> None:
        start = self._open.pop(period)
        if end - start >= max(self.min_length, 2 * period):
            self.runs.append((start, end - start, period))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), sorted by start, then period."""
        for period in list(self._open):
            self._close(period, len(self.words))
        return sorted(self.runs, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Equal words as equal numbers."""
    ids: dict[bytes, int] = {}
    return [ids.setdefault(w, len(ids)) for w in words]


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    return SquareCatcher(min_length).extend(numbered(words)).finish()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run repeats, that is, beyond its first period."""
    if not runs:
        return words
    kept = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    return [w for w, stays in zip(words, kept) if stays]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for a tenth of the ids with a periodic end: the one that the query's contract fixes."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + period]
    return words[:a] + (once * (-(-(n - a) // period)))[: n - a]


def find_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    edit: Callable[[list[bytes], int | None], list[bytes]] | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (an array of start, length, period) and ``collapsed`` of every row.

    Words are what blanks (space, tab to carriage return) separate. A run is a stretch of at least
    ``min_length`` words and two periods that repeats with its smallest period and cannot be made longer;
    ``collapsed`` is the text without the repeated words, joined by single blanks. ``edit`` may change the
    words of a document first. A missing text counts as empty: no words, no runs, an empty ``collapsed``.
    Rows that repeat and rows without an id stay, each by itself; an empty table gives an empty one; other
    columns are not looked at. No shuffle: a document is worked on alone, in time n log n of its words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                words = text.encode().split()
                if edit is not None:
                    words = edit(words, None if pd.isna(key) else int(key))
                found = runs_of(words, min_length)
                spans = [{"start": s, "length": n, "period": q} for s, n, q in found]
                rows.append((len(words), spans, b" ".join(collapsed(words, found)).decode()))
            out = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
            yield out.assign(doc_id=batch["doc_id"].array)

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
        f"collapsed string, doc_id {kind}"
    )
    importable(df.sparkSession)
    return rows.mapInPandas(run, schema).select("doc_id", "n_words", "runs", "collapsed")


def digest_columns(found: DataFrame) -> DataFrame:
    """Per document the number of runs, its longest run, and digests of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # the greatest length first, then the smallest start and period
    order = F.transform(
        "runs",
        lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")),
    )
    best = F.array_min(order)
    return found.select("*", best.alias("_best"), lines.alias("_lines")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("_best.less") / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
