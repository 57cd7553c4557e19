"""The encoder's table: the ids of the definition at any bound, and how much a worker keeps."""

import random
import tracemalloc

import numpy as np
import pytest

from moraine.llm import bpe


def _words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 14))) for _ in range(n))


@pytest.mark.parametrize(("states", "moves", "pieces"), [(120_000, 1_000_000, 30_000), (40, 30, 5)])
def test_pieces_that_leave_the_table(monkeypatch, states, moves, pieces):
    monkeypatch.setattr(bpe, "MOST_STATES", states)
    monkeypatch.setattr(bpe, "MOST_MOVES", moves, raising=False)
    monkeypatch.setattr(bpe, "MOST_PIECES", pieces)
    lines, pattern = bpe.vocabulary()
    codec, ranks = bpe.Codec(lines, pattern), bpe.load_ranks(lines)
    texts = ["", "a", _words(300, 1), "ab" * 40 + " abab", "don't  x\n\n é中文 12345 %%%", "zq" * 300 + " zq"]
    for text in texts * 2:
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)[bpe.piece_starts(text, np.array([0]))].tolist() + [len(data)] if text else [0]
        pieces = [data[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
        assert codec.encode(text) == [x for p in pieces for x in ([ranks[p]] if p in ranks else bpe.merge(p, ranks))]


def test_what_a_worker_keeps():
    codec = bpe.Codec(*bpe.vocabulary())
    tracemalloc.start()
    try:
        for k in range(4):
            codec.encode(_words(25_000, k))
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 30e6
