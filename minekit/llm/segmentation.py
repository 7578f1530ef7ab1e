"""N-best SentencePiece segmentation, and decoding.

The pieces of a vocabulary that match a text form a lattice; a segmentation is a path and its score the
sum of its pieces' scores. Forward Viterbi gives the best score from the start to every position,
which is exactly what is left to gain for a search from the end, so A* with these scores as
heuristic takes complete paths in the order of their scores.

No piece goes on from a letter into a sign, a blank or a line end, so a text is a chain of small
lattices, one per word. Each distinct word is searched once per worker; the best paths of a text
combine those of its words, and only the words with the smallest losses can be in them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable, text_of

MODEL = "piece_bpe_32k.model"
N_BEST = 3
#: Words that a worker remembers with their best path, and those of them with all asked paths.
MEMO_WORDS = 300_000
MEMO_CHOICES = 20_000
BLANK = "▁"
#: What a byte of a character outside the vocabulary costs beyond the worst piece.
UNKNOWN_COST = 10.0

# The letters of Latin-1; other letters are cut at blanks and line ends alone.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"{BLANK}*[^{_L}{BLANK}\n]*[{_L}]++(?=[\x21-\x7e{BLANK}\n]|$)|{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class Pieces:
    """Pieces with scores, and the search in the lattices of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        # whole thousandths, so that equal sums are equal; pieces set by hand have no learned score
        score = {i: round(model.get_score(i) * 1000) if model.get_score(i) > -1e8 else -100 for i in plain}
        self.piece = {model.id_to_piece(i): (score[i], i) for i in plain}
        self.unknown = min(score.values()) - round(UNKNOWN_COST * 1000)
        # what pieces begin with, as nothing goes on from other strings, and the pieces with their ids as bytes
        self.steps: dict[str, tuple] = {p[:end]: () for p in self.piece for end in range(1, len(p))}
        self.steps |= {p: (score, array("I", [i]).tobytes()) for p, (score, i) in self.piece.items()}
        self.text = {i: model.id_to_piece(i).encode() for i in plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.words: dict[int, dict[str, tuple]] = {}  # per number of paths
        self.choices: dict[tuple[str, int], tuple] = {}
        crossing = re.compile(f"[{_L}][\x21-\x40\x5b-\x60\x7b-\x7e]|[^{BLANK}]{BLANK}|\n")
        if bad := [p for p in self.piece if crossing.search(p)]:
            raise ValueError(f"pieces go beyond a word: {bad[:5]}")

    def edges(self, s: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """Per end position the pieces that end there: (begin, score, ids)."""
        ends, forward = self.lattice(s)
        return [[(i, total - forward[i], tuple(array("I", ids))) for total, i, ids in here] for here in ends]

    def lattice(self, s: str) -> tuple[list[list[tuple[int, int, bytes]]], list[int]]:
        """Per end position the pieces that end there, (best score with it, begin, ids), and the best scores.

        This is forward Viterbi: pieces are looked up from each begin on, whose best score is then known.
        Characters outside the vocabulary are bytes.
        """
        get, size = self.steps.get, len(s)
        ends: list[list] = [[] for _ in range(size + 1)]
        forward: list = [0, *[float("-inf")] * size]
        for i in range(size):
            so_far = forward[i]
            for j in range(i + 1, size + 1):
                found = get(s[i:j])
                if found:
                    total = so_far + found[0]
                    ends[j].append((total, i, found[1]))
                    if total > forward[j]:
                        forward[j] = total
                elif j == i + 1:
                    raw = s[i].encode()
                    ids = array("I", map(self.bytes.__getitem__, raw)).tobytes()
                    total = so_far + self.unknown * len(raw)
                    ends[j].append((total, i, ids))
                    if total > forward[j]:
                        forward[j] = total
                if found is None:
                    break
        return ends, forward

    def first(self, s: str) -> tuple[int, float, bytes]:
        """(best score, loss of the second, ids of the best) of a word: what ``best`` gives, without its other paths.

        The second path leaves the best one for the last time at the step back that loses least.
        """
        ends, forward = self.lattice(s)
        loss, j, steps = float("inf"), len(s), []
        while j:
            here = ends[j]
            if len(here) == 1:
                _, j, ids = here[0]
            else:
                top, lost = forward[j], loss
                onward = None
                for total, i, ids in here:
                    if total == top:
                        if onward:
                            lost = 0
                        onward = (i, ids)
                    elif top - total < lost:
                        lost = top - total
                loss = lost
                j, ids = onward
            steps.append(ids)
        steps.reverse()
        return forward[-1], loss, b"".join(steps)

    def best(self, s: str, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best segmentations of a word (fewer if there are no more), best first.

        What a step back loses against the forward score is a loss of the whole path, so the path with
        the smallest loss goes on; a step without loss keeps it the smallest and is taken at once.
        Every path that waits completes with the loss it has: only as many wait as are still asked for.
        Among equals the path met last goes on; the order depends on the word alone.
        """
        ends, forward = self.lattice(s)
        waiting: list[tuple] = []  # (loss, order, position, ids of the last step, steps behind it)
        out: list[tuple[int, bytes]] = []
        loss, j, steps, order = 0, len(s), None, 0
        while True:
            asked = n - len(out) - 1
            while j:
                here, top = ends[j], forward[j]
                onward = None
                for total, i, ids in here:
                    if total == top:
                        if onward:
                            waiting.append((loss, *onward, steps))
                        order -= 1
                        onward = (order, i, ids)
                    elif asked:
                        order -= 1
                        waiting.append((loss + top - total, order, i, ids, steps))
                _, j, ids = onward
                steps = (ids, steps)
            ids = []
            while steps:
                ids.append(steps[0])
                steps = steps[1]
            out.append((forward[-1] - loss, b"".join(ids)))
            if not asked or not waiting:
                return out
            waiting.sort()
            del waiting[asked:]
            loss, _, j, ids, steps = waiting.pop(0)
            steps = (ids, steps)

    def word(self, s: str, n: int) -> tuple:
        """(best score, loss of the second, ids of the best as bytes, these decoded) of a word, remembered."""
        score, loss, ids = self.first(s)
        spelled = self.spelled(ids)
        # equal texts share one string; the other paths are asked of few words of a text and not kept here
        found = (score, loss, ids, s if spelled == s else spelled)
        known = self.words.setdefault(n, {})
        if len(known) < MEMO_WORDS:
            known[s] = found
        return found

    def paths(self, s: str, n: int) -> tuple:
        """The ``n`` best paths of a word as (score, ids, these decoded); the latest asked are remembered."""
        found = self.choices.get((s, n))
        if found is None:
            found = tuple((score, ids, self.spelled(ids)) for score, ids in self.best(s, n))
            if len(self.choices) >= MEMO_CHOICES:
                self.choices.clear()
            self.choices[s, n] = found
        return found

    def segmentations(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a whole text as (score, ids in 32-bit bytes), best first."""
        return [(score, ids) for score, ids, _ in self.segmented(text, n)]

    def segmented(self, text: str, n: int) -> list[tuple[float, bytes, str]]:
        """``segmentations`` of a text, each with the text that decoding its ids gives."""
        if not text:
            return [(0.0, b"", "")]
        known = self.words.setdefault(n, {})
        parts = _WORD.findall(BLANK + text.replace(" ", BLANK))
        words = [found or self.word(s, n) for s, found in zip(parts, map(known.get, parts))]
        scores, losses, ids, spelled = zip(*words)
        total = sum(scores)
        # the k-th best path changes at most k - 1 words, none of them outside the smallest losses
        open_, left = [], list(losses)
        for _ in range(min(n - 1, len(left))):
            smallest = min(left)
            if smallest == float("inf"):
                break
            open_.append(left.index(smallest))
            left[open_[-1]] = float("inf")
        open_.sort()
        every = [self.paths(parts[k], n) for k in open_]
        chosen: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        for paths in every:
            wider = [(loss + paths[0][0] - x[0], (*path, r)) for loss, path in chosen for r, x in enumerate(paths)]
            wider.sort()
            chosen = wider[:n]
        # no character goes on into the next word, so ids are decoded word by word: what all paths share is joined
        # once, the open words are spelled from the ids that each path has for them
        shared = [
            (b"".join(ids[i:j]), "".join(spelled[i:j]))
            for i, j in zip([0, *(k + 1 for k in open_)], [*open_, len(words)])
        ]
        out = []
        for loss, path in chosen:
            own, text_ = [shared[0][0]], [shared[0][1]]
            for paths, r, (behind, spelled_behind) in zip(every, path, shared[1:]):
                own += (paths[r][1], behind)
                text_ += (paths[r][2], spelled_behind)
            out.append(((total - loss) / 1000, b"".join(own), _plain("".join(text_))))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank that encoding puts before it is taken off again."""
        return _plain(self.spelled(ids))

    def spelled(self, ids: bytes) -> str:
        """The pieces of ids one after the other, with their marks for blanks."""
        return b"".join(map(self.text.__getitem__, array("I", ids))).decode(errors="replace")


def _plain(spelled: str) -> str:
    return spelled.replace(BLANK, " ")[1:]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def n_best(
    df: DataFrame,
    n: int = N_BEST,
    model_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """``(doc_id, rank, score, n_pieces, ids_crc32, restored[, ids])``: the ``n`` best of every row.

    Ranks count from 1; a text with fewer segmentations has fewer rows. A missing text counts as
    empty and has one segmentation without pieces. ``restored`` tells whether decoding gives the text
    back (false only for texts that hold the blank mark itself). Equal scores come in an order that
    depends on the text alone. Repeated rows and rows without an id have results of their own; other
    columns are not looked at. No shuffle.
    """
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        names = ["at", "rank", "score", "n_pieces", "ids_crc32", "restored"] + ["ids"] * with_ids
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"]):
                for rank, (score, ids, decoded) in enumerate(model.segmented(text, n), start=1):
                    row = (at, rank, score, len(ids) // 4, zlib.crc32(ids), decoded == text)
                    rows.append((*row, ids) if with_ids else row)
            out = pd.DataFrame(rows, columns=names)
            yield out.drop(columns="at").assign(doc_id=batch["doc_id"].array.take(out["at"].to_numpy()))

    importable(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = "rank int, score double, n_pieces bigint, ids_crc32 bigint, restored boolean" + ", ids binary" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInPandas(run, f"{schema}, doc_id {kind}").select("doc_id", *names)


def decoded(df: DataFrame, ids_col: str = "ids", model_path: str | None = None, name: str = "text") -> DataFrame:
    """``df`` with the text of its ids (32-bit bytes); missing ids give a missing text."""
    path = model_path or public_tokenizers.path(MODEL)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = pieces(path)
        return pd.Series([None if x is None else model.decode(x) if len(x) else "" for x in ids], dtype=object)

    importable(df.sparkSession)
    return df.withColumn(name, text(F.col(ids_col)))
