"""Suffixes are sorted exactly, and only those that are not told apart yet are sorted again."""

import numpy as np

from quarry.llm import run_index


def _given(texts):
    """Codes and distances to the mark, as an index has them."""
    lengths = np.array([len(t) for t in texts])
    codes = np.concatenate([[*(b + 1 for b in t), 0] for t in texts]).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    return codes, np.repeat(ends, lengths + 1) - np.arange(len(codes))


def test_order_is_that_of_the_suffixes():
    draw = np.random.default_rng(7)
    for letters, n in ((2, 40), (3, 200), (250, 60)):
        base = bytes(draw.integers(0, letters, n).tolist())
        texts = [base, base[5:], base[: n // 2] + base[: n // 3], b"\x01" * 30, b"", bytes(draw.integers(0, letters, 9).tolist())]
        codes, left = _given(texts)
        want = sorted(range(len(codes)), key=lambda i: ([*codes[i : i + left[i]], 0], i))
        assert run_index.suffix_order(codes, left).tolist() == want


def test_places_that_are_told_apart_are_not_sorted_again(monkeypatch):
    sorted_, real = [], run_index.ranked
    monkeypatch.setattr(run_index, "ranked", lambda key, *more: sorted_.append(len(key)) or real(key, *more))
    draw = np.random.default_rng(3)
    text = bytes(draw.integers(0, 200, 5000).tolist())
    run_index.RunIndex([text, text[:120]])
    assert sorted_[0] == 5122 and len(sorted_) > 2 and max(sorted_[1:]) < 1000
