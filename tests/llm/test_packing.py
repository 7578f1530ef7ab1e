import random
import zlib

import fixtures
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from minekit.llm import encode, packing


def brute_pieces(capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in fixtures.rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for n, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i : i + capacity]
            yield tuple(map(repr, (r[0], n, i, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(docs, capacity):
    packed = packing.pack(docs, capacity)
    assert fixtures.pairs(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute_pieces(capacity))
    sequences = {}
    for r in packed.collect():
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    # no two sequences fit into one, so best fit has filled them
    fills = sorted(sum(n for _, n in s) for s in sequences.values())
    assert len(fills) < 2 or fills[0] + fills[1] > capacity


def brute_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fitting = [f for f in free if f >= n]
        if fitting:
            free.remove(min(fitting))
            free.append(min(fitting) - n)
        else:
            free.append(capacity - n)
    return sorted(capacity - f for f in free)


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 200])
    lengths = [rng.randint(1, rng.choice([3, capacity // 2, capacity])) for _ in range(rng.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    stretches = packing.plan(counts, capacity)
    fill, ranks = {}, {}
    for i, (length, rank, first, offset) in enumerate(stretches):
        end = stretches[i + 1][1] if i + 1 < len(stretches) and stretches[i + 1][0] == length else counts[length]
        assert rank == ranks.get(length, 0) < end
        ranks[length] = end
        for s in range(first, first + end - rank):
            assert fill.get(s, 0) == offset
            fill[s] = offset + length
    assert ranks == counts and all(f <= capacity for f in fill.values())
    assert sorted(fill.values()) == brute_best_fit(lengths, capacity)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_a_sequence_is_filled_before_the_next_one_is_opened():
    assert packing.plan({4: 4}, 12) == [(4, 0, 0, 0), (4, 1, 0, 4), (4, 2, 0, 8), (4, 3, 1, 0)]


def test_a_small_memo_changes_no_id():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoders = [encode.WordEncoder(path, most) for most in (0, 3, encode.MEMO_WORDS)]
    for r in fixtures.rows():
        first, *rest = [e.encode(r[1] or "") for e in encoders]
        assert all(x == first for x in rest)
    assert len(encoders[0].words) == 0 and len(encoders[1].words) <= 3
