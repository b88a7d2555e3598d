"""Contents are indexed or streamed, not both; streams decide, and end once no window can be met any more."""

import numpy as np
import pytest

from quarry.llm import run_index, winnow

SEARCH = run_index.SEARCH


@pytest.fixture(scope="module")
def met():
    """Different contents of blocks that share an anchor, with the places of their anchors."""
    draw = np.random.default_rng(5)
    base = draw.integers(97, 123, 1500).astype(np.uint8)
    found: dict[bytes, dict[bytes, int]] = {}
    for i in range(24):
        text = base.copy()
        text[draw.integers(0, 1500, i // 2)] = 35 + i  # each has its own changes
        data = text[draw.integers(0, 300) :].tobytes()
        values = run_index.hashes(data)
        for _, start, size, at in zip(*winnow.blocks(values, np.full(len(values), len(values)), SEARCH), strict=True):
            content = data[start : start + size + SEARCH.window - 1]
            found.setdefault(content[at : at + SEARCH.gram], {})[content] = int(at)
    some = [(c, at) for by in found.values() for c, at in by.items()]
    return [c for c, _ in some], np.array([at for _, at in some]), len(found)


def _same(contents, label):
    """Whether windows have one label where they are equal, and only there."""
    seen = [c[i : i + 100] for c in contents for i in range(len(c) - 99)]
    pairs = set(zip(seen, label.tolist(), strict=True))
    return len(seen) == len(label) and len(pairs) == len(set(seen)) == len(set(label.tolist()))


def test_windows_of_streamed_and_indexed_contents_get_one_label(met):
    contents, at, _ = met
    assert _same(contents, run_index.labels(contents, at, np.ones(len(contents))))
    backwards = contents[::-1]
    assert _same(backwards, run_index.labels(backwards, at[::-1], np.ones(len(contents))))


def test_no_content_is_streamed_against_its_own_index(met, monkeypatch):
    contents, at, anchors = met
    held, asked, index, stream = [], [], run_index.RunIndex.__init__, run_index.RunIndex.stream
    monkeypatch.setattr(run_index.RunIndex, "__init__", lambda self, texts: held.extend(texts) or index(self, texts))
    monkeypatch.setattr(run_index.RunIndex, "stream", lambda self, texts, *more: asked.extend(texts) or stream(self, texts, *more))
    run_index.labels(contents, at, np.ones(len(contents)))
    assert 10 < len(asked) <= anchors and not set(asked) & set(held) and set(asked) | set(held) == set(contents)


def test_streams_decide(met, monkeypatch):
    contents, at, _ = met
    nothing = lambda self, texts, window, *more: (np.zeros(sum(len(t) - window + 1 for t in texts), np.int64),) * 2
    monkeypatch.setattr(run_index.RunIndex, "stream", nothing)
    assert not _same(contents, run_index.labels(contents, at, np.ones(len(contents))))


def test_streams_end_where_no_window_can_be_met():
    draw = np.random.default_rng(6)
    for letters in (2, 4):
        held = [draw.integers(97, 97 + letters, 80).astype(np.uint8).tobytes() for _ in range(4)]
        asked = [h[:n] + b"z" + h[n + 1 :] for h, n in zip(held, (5, 30, 60, 79), strict=True)] + [b"", held[0][10:50], b"zzzzz"]
        index = run_index.RunIndex(held)
        length, place = index.stream(asked, 12)
        cut, at = index.stream(asked, 12, 12)
        assert (cut[length >= 12] == length[length >= 12]).all() and (at[length >= 12] == place[length >= 12]).all()
        assert (cut[length < 12] < 12).all() and (cut < length).any()


def test_every_place_gets_the_class_of_its_window():
    """Chains of one to hundreds of equal windows, in texts that agree on more than 255 letters."""
    draw = np.random.default_rng(8)
    texts = [draw.integers(97, 97 + k, 90).astype(np.uint8).tobytes() for k in (1, 2, 3, 26)] + [b"abcdefgh" * 60, b"a" * 300]
    index = run_index.RunIndex(texts)
    label = index.classes(6)
    places = [(t[i : i + 6], int(label[first + i])) for t, first in zip(texts, index.firsts, strict=True) for i in range(len(t) - 5)]
    assert len(set(places)) == len({w for w, _ in places}) == len({k for _, k in places})
