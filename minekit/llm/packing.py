"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents become pieces of at most one sequence. How many pieces there are of each length is all
that best fit needs, so it runs over those counts: at most ``CAPACITY`` numbers, whatever the size
of the corpus. The plan says for every stretch of ranks within a length in which sequences and at
which offset these pieces go; pieces find their slot by their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable, text_of, written
from minekit.llm.encode import MEMO_WORDS, word_encoder
from minekit.operators.scale import number_rows

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
SEPARATOR = 1


def pieces(
    df: DataFrame,
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    memo_words: int = MEMO_WORDS,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every row, ids as 32-bit bytes.

    A document is the ids of its whole text (a missing one is empty) and a closing separator, so every
    row has at least one piece. Longer documents are cut after every ``capacity`` ids. Repeated
    rows and rows without an id have pieces of their own; other columns are not looked at. A worker
    remembers at most ``memo_words`` encoded words, which changes time and memory, not results.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    end = np.asarray([SEPARATOR], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path, memo_words)
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"]):
                data = encoder.encode(text) + end
                for n, i in enumerate(range(0, len(data), width)):
                    part = data[i : i + width]
                    row = (at, n, i // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            names = ["at", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            ids = batch["doc_id"].array.take(out["at"].to_numpy())
            yield out.drop(columns="at").assign(doc_id=ids)

    importable(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInPandas(cut, f"{schema}, doc_id {kind}").select("doc_id", *names)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best fit over counts, longest first: ``(length, first rank, first sequence, offset)``.

    Sequences that are filled alike are held as ranges of numbers. The fullest sequence with room takes
    pieces until none fits any more, as it stays the fullest; so each sequence of a range takes as many
    as fit, and the last one what is left. A stretch ends where the next of the same length begins;
    along it rank and sequence grow together.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> ranges (first sequence, how many)
    used, out = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = [free for free in room if free >= length]
            if fitting:
                free = min(fitting)
                first, many = room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                free, first = capacity, used
                many = -(-left // (capacity // length))
                used += many
            per = free // length
            full = min(many, left // per)
            rest = left - full * per if full < many else 0
            # (first sequence, how many sequences, pieces in each)
            for start, wide, deep in ((first, full, per), (first + full, 1, rest)):
                if not wide or not deep:
                    continue
                for i in range(deep):
                    out.append((length, rank, start, capacity - free + i * length))
                    rank += wide
                if free > deep * length:
                    room.setdefault(free - deep * length, []).append((start, wide))
                left -= wide * deep
            touched = full + (rest > 0)
            if touched < many:
                room.setdefault(free, []).append((first + touched, many - touched))
    return out


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; each piece has its own slot.

    Pieces are numbered in the order of their lengths by a parallel sort, ties by id and piece, so that
    a length that a third of all pieces share is spread over tasks. The stretches of the plan lie
    in the same order, hence a piece finds its own by binary search in the plan.
    """
    spark = pieces.sparkSession
    kept = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}
    stretches = plan(counts, capacity)
    start, before = {}, 0
    for length in sorted(counts, reverse=True):
        start[length] = before
        before += counts[length]
    first = np.array([start[n] + rank for n, rank, _, _ in stretches], np.int64)
    sequence = np.array([s for _, _, s, _ in stretches], np.int64)
    offset = np.array([o for *_, o in stretches], np.int64)
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("_row")]
    numbered = number_rows(kept, order, "_rank")
    # bounded by the capacity alone, whatever the corpus: lengths, fillings and pieces of a sequence
    shared = spark.sparkContext.broadcast((first, sequence, offset))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def slot(rank: pd.Series) -> pd.DataFrame:
        first, sequence, offset = shared.value
        at = np.searchsorted(first, rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    importable(spark)
    return numbered.withColumn("_slot", slot("_rank")).select(*pieces.columns, "_slot.*")


def pack(
    df: DataFrame,
    capacity: int = CAPACITY,
    with_ids: bool = True,
    memo_words: int = MEMO_WORDS,
    **columns: str,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``capacity`` tokens.

    An empty table gives no pieces. Sequences are filled from offset 0 without gaps.
    """
    return placed(pieces(df, capacity, with_ids=with_ids, memo_words=memo_words, **columns), capacity)
