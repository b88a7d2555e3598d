"""Substring dedup by seed and extend, on words.

Anchors winnowed from the words are the seeds (see `winnow`): documents are joined on them. The occurrences of a
seed are extended word by word, to the right and to the left, all together: they form classes of equal contexts,
and each word parts a class into those that go on alike. An occurrence that is alone in its class has reached the
end of its longest match that way. Two occurrences match from `a` words left of the seed to `b` words right of it if
they are in one class of either side, so no pair of occurrences is ever formed. Matches over the length threshold,
united over all seeds, are the maximal repeats, and their words are removed. Words are compared as they are;
hashes only choose the seeds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import table
from .winnow import Search, repeated_windows

WINDOW, GRAM = 35, 12
#: Words whose hashes a worker keeps; beyond that it starts afresh.
CACHED_WORDS = 250_000

_TO_SPACE = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def words_of(data: bytes) -> list[bytes]:
    """Runs of anything but space and the controls from tab to carriage return, as UTF-8."""
    words = data.translate(_TO_SPACE).split(b" ")
    return list(filter(None, words)) if b"" in words else words


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_HASHES) > CACHED_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def symbols(data: bytes) -> np.ndarray:
    return hashes(words_of(data))


def extended(classes: np.ndarray, words: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Classes of occurrences after one more word; -1 for those that are alone in theirs, or have no word left (-1)."""
    out = np.full(len(classes), -1)
    live = np.flatnonzero((classes >= 0) & (words >= 0))
    if len(live):
        found, own = np.unique((classes[live] << 32) | words[live], return_inverse=True)
        own[np.bincount(own, weights=copies[live], minlength=len(found))[own] < 2] = -1
        out[live] = own
    return out


def labels(contents: list[bytes], anchors: np.ndarray, copies: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Extends the seeds of all contents; a label for each window that some other occurrence matches, else -1.

    contents are words joined by spaces, anchors the places of their seeds, copies how often each occurs.
    """
    known: dict[bytes, int] = {}
    rows = [[known.setdefault(w, len(known)) for w in c.split(b" ")] for c in contents]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, first = np.array([w for row in rows for w in row], np.int64), np.cumsum(sizes) - sizes

    def word(k: int) -> np.ndarray:
        """Of each occurrence the word k places from its seed's first."""
        at = anchors + k
        inside = (at >= 0) & (at < sizes)
        return np.where(inside, flat[np.where(inside, first + at, 0)], -1)

    windows = np.maximum(sizes - window + 1, 0)
    base, out, used = np.cumsum(windows) - windows, np.full(windows.sum(), -1), 0
    right, sides = np.zeros(len(rows), np.int64), []
    for k in range(window):
        right = extended(right, word(k), copies)
        sides.append(right)
    left = np.zeros(len(rows), np.int64)
    for a in range(int(anchors.max(initial=0)) + 1):  # windows that begin a words before the seed
        if a:
            left = extended(left, word(-a), copies)
        there = np.flatnonzero((left >= 0) & (sides[window - a - 1] >= 0) & (anchors >= a) & (anchors - a < windows)) if a < window else []
        if len(there):
            both = extended(left[there], sides[window - a - 1][there], copies[there])
            alike = both >= 0
            out[base[there[alike]] + anchors[there[alike]] - a] = used + both[alike]
            used += int(both.max()) + 1
    return out


def keep(words: list[bytes], starts: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """words without those that the windows of the runs cover."""
    parts, at = [], 0
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        parts += words[at:start]
        at = max(at, start + size + window - 1)
    return parts + words[at:]


SEARCH = Search(WINDOW, GRAM, True, words_of, hashes, b" ".join, lambda *args: labels(*args))


def _answer(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple:
    words = words_of(data)
    kept = keep(words, starts, sizes)
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _clean(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple:
    return (b" ".join(keep(words_of(data), starts, sizes)).decode("utf-8", "replace"),)


def clean_texts(docs, *, text: str = "text"):
    """doc_id and kept, each document's words that no repeat of 35 words covers, joined by one space."""
    return repeated_windows(docs.select("doc_id", F.col(text).cast("binary").alias("_data")), SEARCH, _clean, {"kept": ("string", pa.string())})


def op6_seed_extend(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("_data"))
    names = {"n_words": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "kept_sha256": ("string", pa.string())}
    return repeated_windows(docs, SEARCH, _answer, names)


QUERIES = {"op6_seed_extend": op6_seed_extend}
