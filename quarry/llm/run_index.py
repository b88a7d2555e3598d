"""Substring dedup with a run-length index.

Repetitive texts have a Burrows-Wheeler transform of few runs. The index keeps the runs (letter, first row) and, at
both ends of each, the text place sampled from the suffix array; the suffix array itself is dropped. Texts are
streamed against it from their last byte to their first: a step finds the run of the next letter, moves the row by
the last-to-first mapping, and carries along the length of the match and one text place that has it; where the
letter is not in the row's run, the longer match at the neighbouring run ends is taken over. These are the
matching statistics; where they reach the window, its bytes are in the index.

Which of the places that have a window stands for all follows from the samples too: between sampled places, a
place's predecessor in suffix order moves along with it, and their agreement shrinks by one a step.

Indexes are built for shards of text that share winnowed anchors (see `winnow`), so a window and all its equals
are in one shard, and a shard's index holds each different block once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import table
from .winnow import Search, mix, repeated_windows

WINDOW, GRAM = 100, 32

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashes(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def ranked(key: np.ndarray, place: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of `room` bits by key, equal keys as they are given (in rising order), and whether each one's key is not the one before."""
    if int(key.max(initial=0)).bit_length() + room <= 64:  # place and key in one number sort without an index
        both = (key << np.uint64(room)) | place.astype(np.uint64)
        both.sort()
        place, key = (both & np.uint64((1 << room) - 1)).astype(np.int64), both >> np.uint64(room)
    else:
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return place, new


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in order of what follows them up to the next mark (0), ties by place; left: how far that mark is."""
    n = len(text)
    room, bits = max(1, n.bit_length()), max(1, int(text.max(initial=0)).bit_length())

    letters = text.astype(np.uint64)
    have, key, close = 1, letters.copy(), np.flatnonzero(left < 64 // bits)
    while (have + 1) * bits + room <= 64 and have < n:
        key <<= np.uint64(bits)
        key[: n - have] |= letters[have:]
        key[close[left[close] < have]] &= ~np.uint64((1 << bits) - 1)  # nothing beyond the mark
        have += 1
    order, new = ranked(key, np.arange(n), room)
    short = np.uint32 if room <= 32 else np.uint64  # places are looked up at random: small numbers stay near
    rows, rank, most, left = np.arange(n), np.empty(n, short), int(left.max(initial=0)) + 1, left.astype(short)
    at = np.flatnonzero(new)
    rank[order] = np.repeat((at + 1).astype(short), np.diff(at, append=n))  # a place's rank is the first row of those equal so far
    while have < most:
        alike = ~new
        alike[:-1] |= ~new[1:]
        rows = rows[alike]  # only places that are not alone yet are sorted again, each group within its rows
        if not len(rows):
            break
        place = order[rows]
        further = np.where(left[place] >= have, rank[np.minimum(place + have, n - 1)], short(0))
        place, new = ranked((rank[place].astype(np.uint64) << np.uint64(room)) | further, place, room)
        order[rows] = place
        at = np.flatnonzero(new)
        rank[place] = np.repeat((rows[at] + 1).astype(short), np.diff(at, append=len(rows)))
        have *= 2
    return order


class RunIndex:
    """Runs of the transform of texts, with the text places at both ends of each."""

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8)
        self.firsts = np.cumsum(lengths + 1) - lengths - 1  # where each text starts
        marks = self.firsts + lengths
        there = np.bincount(raw, minlength=256) > 0
        there[0] = any(b"\x00" in x for x in texts)
        self.codes = np.where(there, np.cumsum(there), 0).astype(np.int16)  # of bytes; 0 is the mark that ends a text
        text = self.codes[raw]
        text[marks] = 0
        self.left = np.repeat(marks, lengths + 1) - np.arange(len(text))
        self.eights = np.ndarray(len(text), "<u8", np.pad(raw, (0, 8)), strides=(1,))  # of each place its byte and the seven after it
        order = suffix_order(text, self.left)
        before = text[order - 1]  # the first place's is the last, a mark
        head = np.ones(len(text), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # marks are all different, so none goes on a run
        self.text, self.heads = text, np.flatnonzero(head)
        self.letters = before[self.heads]
        self.lengths = np.diff(self.heads, append=len(text))
        self.starts = order[self.heads]  # the text place at the first row of each run
        self.stops = order[self.heads + self.lengths - 1]  # and at the last
        self.runs = len(self.heads)
        by_letter = np.argsort(self.letters, kind="stable")
        self.letter_runs = by_letter
        self.letter_keys = self.letters[by_letter].astype(np.int64) * (len(text) + 1) + self.heads[by_letter]
        sizes = self.lengths[by_letter]
        self.letter_rows = np.cumsum(sizes) - sizes  # the row that the first row of each run maps to

    def stream(self, texts: list[bytes], window: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics at the places where a window of each text starts: the length, at most, of the match, and a text place that has it.

        All texts are streamed side by side, a letter of each at a step. Matches that start further left end no further
        right, so a text ends once its match ends before `least` letters; 0 and -1 are told for the rest of its windows.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        windows = np.maximum(sizes - window + 1, 0)
        out = np.cumsum(windows) - windows
        found, places = np.zeros(windows.sum(), np.int64), np.full(windows.sum(), -1)
        if not self.runs:
            return found, places
        row, at, match = np.zeros(len(texts), np.int64), np.full(len(texts), self.starts[0]), np.zeros(len(texts), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            on = (sizes >= step) & (sizes - step + 1 + match >= least)
            if not on.all():
                ends, sizes, out, row, at, match = (c[on] for c in (ends, sizes, out, row, at, match))
            if not len(row):
                break
            letter = self.codes[raw[ends - step]].astype(np.int64)
            slot = np.searchsorted(self.letter_keys, letter * (len(self.text) + 1) + row, side="right") - 1
            run = self.letter_runs[slot]
            inside = (letter > 0) & (slot >= 0) & (self.letters[run] == letter) & (row < self.heads[run] + self.lengths[run])
            if not inside.all():
                self._jump(np.flatnonzero(~inside), letter, slot, row, at, match)
                run = self.letter_runs[slot]
            row += self.letter_rows[slot] - self.heads[run]
            at -= 1
            match += 1
            gone = np.flatnonzero(letter == 0)
            row[gone], at[gone], match[gone] = 0, self.starts[0], 0
            if step >= window:
                to = out + sizes - step
                found[to], places[to] = match, at
        return found, places

    def _jump(self, which: np.ndarray, letter: np.ndarray, slot: np.ndarray, row: np.ndarray, at: np.ndarray, match: np.ndarray) -> None:
        """Moves streams whose letter is not in their row's run to the end of a neighbouring run of it, where the longer match is."""
        near = slot[which] + np.array([[0], [1]])  # the run before and the one after
        slots = np.clip(near, 0, self.runs - 1)
        run = self.letter_runs[slots]
        good = (letter[which] > 0) & (self.letters[run] == letter[which]) & (near == slots)
        spot = np.stack([self.stops[run[0]], self.starts[run[1]]])
        reach = self._extent(np.where(good, at[which], -1).ravel(), spot.ravel(), np.tile(match[which], 2)).reshape(good.shape)
        own = np.where(good, np.minimum(match[which], reach), -1)
        k = (own[1] > own[0]).astype(np.int64)
        best, run, spot, slots = (np.where(k, c[1], c[0]) for c in (own, run, spot, slots))
        gone = best < 0  # the letter is nowhere in the index
        letter[which[gone]] = 0
        match[which] = np.maximum(best, 0)
        which, run, spot, slots, k = (c[~gone] for c in (which, run, spot, slots, k))
        at[which], slot[which], row[which] = spot, slots, self.heads[run] + np.where(k, 0, self.lengths[run] - 1)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text place: the place before it in suffix order (-1 for none), and the length on which both agree."""
        n = len(self.text)
        run = np.full(n, -1)
        run[self.starts] = np.arange(self.runs)
        at = np.flatnonzero(run >= 0)  # the first place is one: a mark is before it
        sample = run[at]
        prior = np.where(sample > 0, self.stops[sample - 1], -1)
        agree = self._extent(prior, at)
        span = np.diff(at, append=n)
        gone = np.arange(n) - np.repeat(at, span)
        other = np.where(np.repeat(prior >= 0, span), np.repeat(prior, span) + gone, -1)
        return other, np.where(other >= 0, np.maximum(np.repeat(agree, span) - gone, 0), 0)

    def _extent(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The length on which the texts from a and b agree, eight letters at a step; 0 where a is -1. most: it need not be told beyond."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(a >= 0)
        x, y = a[live], b[live]
        room = np.minimum(self.left[x], self.left[y])
        need = room if most is None else np.minimum(room, most[live])
        step = 0
        while len(live):
            apart = self.eights[x + step] ^ self.eights[y + step]
            alike = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes before the first other one
            out[live] = np.minimum(step + alike.astype(np.int64), room)  # counted in 8 bits
            step += 8
            on = np.flatnonzero((alike == 8) & (need > step))
            live, x, y, room, need = live[on], x[on], y[on], room[on], need[on]
        return out

    def classes(self, window: int) -> np.ndarray:
        """For each text place the first in suffix order of the places with an equal window."""
        other, agree = self.statistics()
        label, moved = np.arange(len(self.text)), np.flatnonzero(agree >= window)
        further = other[moved]
        while len(moved):
            label[moved] = further
            further = label[further]
            on = further != label[moved]
            moved, further = moved[on], further[on]
        return label


def labels(contents: list[bytes], anchors: np.ndarray | None, copies: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A label for each window of different contents, which equal windows share.

    Equal windows have equal anchors at the same distance, and a content holds each of its windows once. So where
    several contents have an anchor, the first of them is streamed against the index of all the others: a window
    that the stream does not find is nowhere else. anchors: the place of each content's anchor; None: all are indexed.
    """
    asked = np.zeros(len(contents), bool)
    if anchors is not None:
        first: dict[bytes, int] = {}
        for i, (content, at) in enumerate(zip(contents, anchors.tolist(), strict=True)):
            k = first.setdefault(content[at : at + GRAM], i)
            asked[k] |= k != i
    held = [c for c, a in zip(contents, asked, strict=True) if not a]
    windows = np.maximum(np.fromiter(map(len, contents), np.int64, len(contents)) - window + 1, 0)
    index = RunIndex(held)
    classes, own = index.classes(window), windows[~asked]
    out, streamed = np.empty(windows.sum(), np.int64), np.repeat(asked, windows)
    out[~streamed] = classes[np.repeat(index.firsts - np.cumsum(own) + own, own) + np.arange(own.sum())]
    length, place = index.stream([c for c, a in zip(contents, asked, strict=True) if a], window, window)
    out[streamed] = np.where(length >= window, classes[place], len(index.text) + np.arange(len(place)))
    return out


def keep(data: bytes, starts: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> tuple[bytes, int]:
    """data without the bytes that the windows of the runs cover, and the count of maximal removed runs."""
    parts, at, spans = [], 0, 0
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        end = start + size + window - 1
        if start > at or not spans:
            spans += 1
        if start > at:
            parts.append(data[at:start])
        at = max(at, end)
    parts.append(data[at:])
    return b"".join(parts), spans


SEARCH = Search(WINDOW, GRAM, False, bytes, hashes, bytes, lambda *args: labels(*args))


def _answer(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple:
    kept, spans = keep(data, starts, sizes)
    return len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def _clean(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple:
    return (keep(data, starts, sizes)[0],)


def clean_texts(docs, *, text: str = "text"):
    """doc_id and kept, each document's bytes without those that repeat an earlier 100-byte string."""
    return repeated_windows(docs.select("doc_id", F.col(text).cast("binary").alias("_data")), SEARCH, _clean, {"kept": ("binary", pa.binary())})


def op4_run_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("_data"))
    names = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string())}
    return repeated_windows(docs, SEARCH, _answer, names)


QUERIES = {"op4_run_index": op4_run_index}
