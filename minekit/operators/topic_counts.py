"""EM for LDA with the documents kept in place.

The model of Spark's ``LDA(optimizer="em")``, from the same random start. There every iteration builds a
graph anew and sends topic counts under the id of each vertex, document or term, to all of its edge
partitions and back. Here the documents lie in blocks that stay where they are. Only the ``k`` sums of a
block's terms go to the shards of the terms and the ``k`` totals come back, as plain arrays in an order
agreed on once, and blocks are large, because the terms of a block grow slower than its entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from minekit.operators.scale import checkpoint_root, checkpointed, ship_package

BLOCK_ENTRIES = 5_000_000  # (document, term) entries of a block, 60 MB
SMALL_ENTRIES = 100_000  # no block for each core below this
CHUNK_ENTRIES = 500_000  # entries worked on at a time
_KEPT = StorageLevel.MEMORY_AND_DISK
_MASK = (1 << 48) - 1
_FACTOR, _ADDEND = 0x5DEECE66D, 0xB  # of java.util.Random


@dataclass(frozen=True)
class TopicCounts:
    """What EM learned: ``terms`` with the counts per topic ``(idx, counts)``, and the counts' sums."""

    terms: DataFrame
    totals: list[float]
    size: int
    alpha: float
    eta: float


def advanced(state: int, steps: int) -> int:
    """The state of ``java.util.Random`` after some steps."""
    factor, addend = _FACTOR, _ADDEND
    while steps:
        if steps & 1:
            state = (state * factor + addend) & _MASK
        addend = (factor * addend + addend) & _MASK
        factor = factor * factor & _MASK
        steps >>= 1
    return state


def java_doubles(state: int, n: int) -> np.ndarray:
    """The next ``n`` of ``java.util.Random.nextDouble``, two steps each."""
    mask = np.uint64(_MASK)
    states = np.array([advanced(state, 1)], np.uint64)
    factor, addend = _FACTOR, _ADDEND
    while len(states) < 2 * n:
        # the later half is the earlier one, as many steps on
        states = np.concatenate([states, (states * np.uint64(factor) + np.uint64(addend)) & mask])
        addend = (factor * addend + addend) & _MASK
        factor = factor * factor & _MASK
    high, low = states[0 : 2 * n : 2] >> np.uint64(22), states[1 : 2 * n : 2] >> np.uint64(21)
    return ((high << np.uint64(27)) + low) * 2.0**-53


def _pieces(part: int, rows: Iterable, k: int, seed: int) -> Iterator[tuple]:
    """``(state, lengths, terms, values)`` of some documents each, with the random state at their start."""
    state = ((part + seed) ^ _FACTOR) & _MASK
    waiting, entries = [], 0

    def piece() -> tuple:
        lengths = np.array([len(i) for i, _ in waiting])
        return state, lengths, np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting])

    for (vector,) in rows:
        values = vector.toArray() if not hasattr(vector, "indices") else vector.values
        indices = getattr(vector, "indices", np.arange(len(values), dtype=np.int32))
        counted = values != 0
        if not counted.any():
            continue
        waiting.append((indices[counted].astype(np.int32), values[counted]))
        entries += len(waiting[-1][0])
        if entries >= CHUNK_ENTRIES:
            yield piece()
            state, waiting, entries = advanced(state, 2 * k * entries), [], 0
    if waiting:
        yield piece()


def _block(pieces: Iterable, k: int, n: int) -> tuple:
    """``(terms, bounds, starts, at, values)`` and the first counts of the documents and the terms.

    Terms are in the order of their shards, ``bounds`` apart; ``at`` is the place of an entry's term.
    """
    pieces = sorted(pieces, key=lambda p: p[0])
    lengths, terms, values = (np.concatenate([p[1][c] for p in pieces]) for c in (1, 2, 3))
    different, at = np.unique(terms, return_inverse=True)
    order = np.lexsort((different, different % n))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    at, different = place[at], different[order]
    bounds = np.searchsorted(different % n, np.arange(n + 1))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    docs, sums = np.empty((len(lengths), k)), np.zeros((k, len(different)))
    doc = entry = 0
    for _, (state, of_docs, of_terms, of_values) in pieces:
        until, end = doc + len(of_docs), entry + len(of_terms)
        drawn = java_doubles(state, k * len(of_terms)).reshape(-1, k)
        drawn *= (of_values / drawn.sum(1))[:, None]
        docs[doc:until] = np.add.reduceat(drawn, starts[doc:until] - entry, axis=0)
        for j in range(k):
            sums[j] += np.bincount(at[entry:end], drawn[:, j], len(different))
        doc, entry = until, end
    return (different, bounds, starts, at, values), (docs, np.ascontiguousarray(sums.T))


def _step(block: tuple, docs: np.ndarray, terms: np.ndarray, counts: TopicCounts) -> tuple[np.ndarray, np.ndarray]:
    """The next counts of the documents and the block's share in those of its terms."""
    _, _, starts, at, values = block
    totals, eta = np.array(counts.totals), counts.eta
    by_doc = (docs + (counts.alpha - 1)) / (totals + counts.size * (eta - 1))
    by_term = np.ascontiguousarray((terms + (eta - 1)).T)
    new_docs, sums = np.empty_like(docs), np.zeros((len(totals), len(terms)))
    first = 0
    while first < len(docs):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_ENTRIES, "right")) - 1)
        here = slice(starts[first], starts[last])
        doc = np.repeat(np.arange(first, last), np.diff(starts[first : last + 1]))
        shares = [by_term[j][at[here]] * by_doc[doc, j] for j in range(len(totals))]
        scale = values[here] / sum(shares)
        for j, share in enumerate(shares):
            share *= scale
            new_docs[first:last, j] = np.add.reduceat(share, starts[first:last] - starts[first])
            sums[j] += np.bincount(at[here], share, len(terms))
        first = last
    return new_docs, np.ascontiguousarray(sums.T)


def _routes(asked: Iterable) -> tuple:
    """The terms of a shard, and per block the places of the terms that it has of them."""
    asked = sorted(asked, key=lambda a: a[0])
    terms = np.unique(np.concatenate([a[1] for a in asked]))
    return terms, [(block, np.searchsorted(terms, wanted).astype(np.int32)) for block, wanted in asked]


def _tables(blocks: RDD, routes: RDD, state: RDD, n: int) -> RDD:
    """``(shard, (routes, counts))``: the sums of all blocks for the terms of a shard."""

    def sent(item: tuple) -> Iterator[tuple]:
        number, (bounds, _, sums) = item
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            yield shard, (number, sums[bounds[shard] : bounds[shard + 1]])

    def added(found: tuple) -> tuple:
        (terms, places), parts = found
        parts = dict(parts)
        counts = np.zeros((len(terms), next(iter(parts.values())).shape[1]))
        for number, at in places:
            counts[at] += parts[number]
        return (terms, places), counts

    return routes.join(state.flatMap(sent).groupByKey(n), n).mapValues(added)


def fit(
    vectors: DataFrame,
    k: int,
    max_iter: int,
    seed: int,
    checkpoint_interval: int = 10,
    block_entries: int = BLOCK_ENTRIES,
) -> TopicCounts:
    """EM for LDA on ``features``, with the priors that Spark takes by default."""
    sc = vectors.sparkSession.sparkContext
    checkpoint_root(vectors.sparkSession)
    ship_package(vectors.sparkSession)
    rows = vectors.select("features").rdd
    size = rows.map(lambda r: r[0].size).first()
    pieces = rows.mapPartitionsWithIndex(
        lambda part, found: ((part, p) for p in _pieces(part, found, k, seed))
    ).persist(_KEPT)
    entries, parts = pieces.map(lambda p: len(p[1][2])).sum(), pieces.getNumPartitions()
    n = max(min(sc.defaultParallelism, -(-entries // SMALL_ENTRIES)), -(-entries // block_entries), 1)
    n = min(parts, n)
    # everything is dealt by the number of a block or a shard, so the joins below move nothing
    first = pieces.map(lambda p: (p[0] * n // parts, p)).groupByKey(n).mapValues(lambda p: _block(p, k, n)).persist(_KEPT)
    blocks = first.mapValues(lambda b: b[0]).persist(_KEPT)
    state = first.mapValues(lambda b: (b[0][1], *b[1])).persist(_KEPT)

    def asked(item: tuple) -> Iterator[tuple]:
        number, (terms, bounds, *_) = item
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            yield shard, (number, terms[bounds[shard] : bounds[shard + 1]])

    routes = blocks.flatMap(asked).groupByKey(n).mapValues(_routes).persist(_KEPT)

    def answers(item: tuple) -> Iterator[tuple]:
        shard, ((_, places), counts) = item
        for number, at in places:
            yield number, (shard, counts[at])

    def counts_of(state: RDD) -> TopicCounts:
        totals = state.map(lambda s: s[1][1].sum(0)).sum()
        return TopicCounts(None, [float(x) for x in totals], size, 50.0 / k + 1, 1.1)

    counts = counts_of(state)
    for used in (pieces, first):
        used.unpersist()
    for iteration in range(1, max_iter + 1):

        def stepped(found: tuple, counts: TopicCounts = counts) -> tuple:
            (block, (_, docs, _)), replies = found
            terms = np.concatenate([counts for _, counts in sorted(replies, key=lambda r: r[0])])
            return block[1], *_step(block, docs, terms, counts)

        replies = _tables(blocks, routes, state, n).flatMap(answers).groupByKey(n)
        following = blocks.join(state, n).join(replies, n).mapValues(stepped).persist(_KEPT)
        if checkpoint_interval > 0 and iteration % checkpoint_interval == 0:
            following.checkpoint()
        counts = counts_of(following)
        state.unpersist()
        state = following

    def listed(item: tuple) -> Iterator[tuple]:
        (terms, _), table = item[1]
        return zip(terms.tolist(), table.tolist(), strict=True)

    rows = _tables(blocks, routes, state, n).flatMap(listed)
    terms = checkpointed(vectors.sparkSession.createDataFrame(rows, "idx int, counts array<double>"))
    for used in (blocks, routes, state):
        used.unpersist()
    return TopicCounts(terms, counts.totals, counts.size, counts.alpha, counts.eta)
