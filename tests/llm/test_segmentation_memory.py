"""What a worker remembers of words is bounded and small, and changes no result."""

import random

import public_tokenizers

from minekit.llm import segmentation as seg


def texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 9)))
    return [" ".join(word() for _ in range(rnd.randrange(40))) for _ in range(40)] + ["", "a▁b c", "é\nü  x"]


def test_remembered_words_hold_their_best_path_only(monkeypatch):
    path = public_tokenizers.path(seg.MODEL)
    full = seg.Pieces(path)
    want = [full.segmented(t, 3) for t in texts()]
    assert all(len(found) == 4 for found in full.words[3].values())
    monkeypatch.setattr(seg, "MEMO_WORDS", 5)
    monkeypatch.setattr(seg, "MEMO_CHOICES", 3)
    small = seg.Pieces(path)
    assert [small.segmented(t, 3) for t in texts()] == want
    assert len(small.words[3]) == 5 and len(small.choices) <= 3


def test_every_rank_is_decoded_from_its_own_ids():
    model = seg.pieces(public_tokenizers.path(seg.MODEL))
    for text in texts():
        found = model.segmented(text, 3)
        assert [decoded for *_, decoded in found] == [model.decode(ids) for _, ids, _ in found]
