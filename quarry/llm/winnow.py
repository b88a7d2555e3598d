"""Exact search for repeated windows, by winnowed anchors.

Documents are sequences of symbols (bytes or words). Every window of W symbols picks an anchor, the K-gram
of smallest hash (the last of equal ones), which depends on the window alone: equal windows, wherever they are,
have equal anchors at the same distance. Consecutive windows with one anchor form a block. Hashes of anchors
only choose which blocks meet; what is equal is decided by the search's own `labels`, on the blocks' content.

1. `seed`    sends the anchors of a bucket of documents, each once with its count of blocks.
2. `meet`    tells each bucket which of its anchors other buckets have too.
3. `extend`  decides blocks that share an anchor inside the bucket, and sends the content of blocks whose anchor
             other buckets have: each different content once, and only if it holds the first of some window.
4. `decide`  decides the blocks that meet from all buckets, in the same way.
5. `finish`  brings the repeated windows of each document together with its text.

Texts are dealt out once, by bucket of documents; the steps that need them share that exchange. No group grows
with the documents: copies in a bucket send one content, buckets meet in groups of FAN and groups of buckets in
a second level, and an anchor of very many blocks sends its windows one by one, dealt by window, to the same
decision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes

# Records that the steps exchange, column by column; a row holds many.
ANCHOR = ("<u8", "<u4")  # anchor, blocks
TOTAL = ("<u8", "<u4", "<u4")  # anchor, blocks, buckets
SHARED = ("<u8", "<u4")  # anchor, whether its windows go one by one
DONE = ("<u4", "<u4", "<u4")  # document of the bucket, start, windows
BLOCK = ("<i8", "<u4", "<u4", "<u4", "<u4", "<u4", "<u4")  # doc id, bucket, document of it, start, windows, place of the anchor, bytes of content
ROW = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
ROW_DDL = "key long, part int, data binary"
#: Buckets whose records meet in one group at most; beyond that groups meet in a second level.
FAN = 4096
#: Blocks of one anchor, over all buckets, that meet in one group at most; beyond that its windows are dealt apart.
MOST_BLOCKS = 8192
#: Symbols hashed at a time, compressed input bytes of a bucket of documents, and what a null id counts as.
CHUNK, BUCKET, NO_ID = 1 << 18, 3 << 20, np.iinfo(np.int64).max

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))

#: The bits of a hash that give way to a place in the chunk.
_PLACE = np.uint64(CHUNK - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_B, CHUNK + 4096), _powers(_B_INV, CHUNK + 4096)


@dataclass(frozen=True)
class Search:
    """What to look for: windows of `window` symbols, anchors of `gram`; which of equal windows count as repeated.

    all_repeats: every window that also starts elsewhere, else every one that starts earlier in order of
    (doc id, start). units: a document's bytes to a sequence of symbols; hashes: of units, uint64, equal for
    equal symbols; content: units to bytes, equal for equal units only.

    labels(contents, anchors, copies): for different contents, one after the other, a label of each window, which
    equal windows share, or -1 for a window that no other place of these contents, with so many copies, holds.
    """

    window: int
    gram: int
    all_repeats: bool
    units: Callable[[bytes], Sequence]
    hashes: Callable[[Sequence], np.ndarray]
    content: Callable[[Sequence], bytes]
    labels: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def blocks(values: np.ndarray, ends: np.ndarray, search: Search) -> tuple[np.ndarray, ...]:
    """(anchor, start, windows, place of the anchor from start) of symbols that hold several documents; ends are those of each symbol's document."""
    n, w = len(values), search.window
    starts = n - w + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in ("u8", "i8", "i8", "i8"))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _DOWN[:n], out=sums[1:])
    grams = mix((sums[search.gram :] - sums[: n - search.gram + 1]) * _UP[: n - search.gram + 1])
    least = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))  # of equal ones the last is the smallest
    span, have = w - search.gram + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    inside = np.arange(starts) + w <= ends[:starts]
    new = np.ones(starts, bool)
    new[1:] = (least[1:] != least[:-1]) | (ends[1:starts] != ends[: starts - 1])
    new &= inside
    first = np.flatnonzero(new)
    size = np.minimum(np.diff(first, append=n), ends[first] - w + 1 - first)
    at = (_PLACE - (least[first] & _PLACE)).astype(np.int64)
    return grams[at], first, size, at - first


def pack(columns, kind: tuple[str, ...], more: bytes = b"") -> bytes:
    parts = [np.ascontiguousarray(c).astype(t, copy=False).tobytes() for c, t in zip(columns, kind, strict=True)]
    return b"".join([len(columns[0]).to_bytes(4, "little"), *parts, more])


def unpack(data: bytes, kind: tuple[str, ...]) -> tuple[list[np.ndarray], int]:
    """The columns, and where they end."""
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for t in kind:
        out.append(np.frombuffer(data, t, n, at))
        at += out[-1].nbytes
    return out, at


def gather(rows: list[bytes], kind: tuple[str, ...]) -> list[np.ndarray]:
    """The records of all rows."""
    found = [unpack(data, kind)[0] for data in rows]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in kind]


class Out:
    """Rows to send."""

    def __init__(self):
        self.keys, self.parts, self.data = [], [], []

    def one(self, key: int, part: int, data: bytes) -> None:
        self.keys.append(key)
        self.parts.append(part)
        self.data.append(data)

    def put(self, keys: np.ndarray, part: int | None, kind: tuple[str, ...], columns) -> None:
        """A row for each key; part None: the key itself."""
        for key, rows in _by(keys):
            self.one(key, key if part is None else part, pack([c[rows] for c in columns], kind))

    def table(self) -> pa.Table:
        return pa.Table.from_arrays([pa.array(self.keys, pa.int64()), pa.array(self.parts, pa.int32()), pa.array(self.data, pa.binary())], schema=ROW)


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key, with the rows that have it in their order."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            yield int(keys[order[a]]), order[a:b]


def first_of(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row of sorted key columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Runs of windows, with those that touch or overlap made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), start[order].astype(np.int64) + size[order]
    if not len(doc):
        return [doc, start, end]
    new = first_of([doc])
    group = np.cumsum(new)
    top = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # the furthest end so far, within a document
    cut = new.copy()
    cut[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(cut)
    return [doc[at], start[at], np.maximum.reduceat(end, at) - start[at]]


def documents(table: pa.Table) -> list[tuple[int, bytes]]:
    """The different documents of a bucket, (id, data), in order of id and then of data: a place in it names the document."""
    ids = table.column("doc_id").to_pylist()
    return sorted({(NO_ID if i is None else i, x.as_py() or b"") for i, x in zip(ids, table.column("_data"), strict=True)})


def _all_blocks(docs: list[tuple[int, bytes]], search: Search) -> tuple[list[np.ndarray], Callable[[int], Sequence]]:
    """(anchor, document, start, windows, place of the anchor) of all blocks of a bucket, and a document's units."""
    found, held, room = [], [], 0

    def flush() -> None:
        if held:
            sizes = np.array([len(h[1]) for h in held])
            ends = np.cumsum(sizes)
            anchor, first, size, at = blocks(np.concatenate([h[1] for h in held]), np.repeat(ends, sizes), search)
            which = np.searchsorted(ends, first, side="right")
            base = np.array([h[2] for h in held]) - (ends - sizes)
            found.append((anchor, np.array([h[0] for h in held])[which], first + base[which], size, at))
            held.clear()

    for k, (_, data) in enumerate(docs):
        values, at = search.hashes(search.units(data)), 0
        while at == 0 or at + search.window <= len(values):
            part = values[at : at + CHUNK]
            if room + len(part) > CHUNK:
                flush()
                room = 0
            if len(part) >= search.window:
                held.append((k, part, at))
                room += len(part)
            at += CHUNK - search.window + 1
    flush()
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in ("u8", "i8", "i8", "i8", "i8")]
    last: list = [None, None]

    def units(k: int) -> Sequence:
        if last[0] != k:
            last[:] = k, search.units(docs[k][1])
        return last[1]

    return columns, units


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(keys)
    at = np.flatnonzero(first_of([found]))
    return found[at], np.diff(at, append=len(found))


def seed(table: pa.Table, search: Search, part: int, shards: int, groups: int) -> pa.Table:
    """The different anchors of a bucket, with their blocks, dealt by anchor and group of buckets."""
    out = Out()
    anchor, many = _counts(_all_blocks(documents(table), search)[0][0])
    out.put((anchor % np.uint64(shards)).astype(np.int64) + shards * (part % groups), part, ANCHOR, [anchor, many])
    return out.table()


def _sum(rows: pa.Table, kind: tuple[str, ...]) -> list[np.ndarray]:
    """(anchor, blocks, buckets) of rows of a group, each anchor once."""
    cols = gather(rows.column("data").to_pylist(), kind)
    anchor, many, buckets = cols if kind is TOTAL else (*cols, np.ones(len(cols[0]), np.int64))
    order = np.argsort(anchor, kind="stable")
    at = np.flatnonzero(first_of([anchor[order]]))
    if not len(at):
        return [anchor, many, buckets]
    return [anchor[order][at], *(np.minimum(np.add.reduceat(c[order].astype(np.int64), at), 1 << 31) for c in (many, buckets))]


def total(rows: pa.Table, shards: int) -> pa.Table:
    """A group's anchors, each once with its blocks and buckets, for the second level."""
    out = Out()
    if rows.num_rows:
        key = rows.column("key")[0].as_py()
        out.one(key % shards, key // shards, pack(_sum(rows, ANCHOR), TOTAL))
    return out.table()


def across(rows: pa.Table, shards: int) -> pa.Table:
    """For each group of buckets that have it, the shared anchors over all groups."""
    out, (anchor, many, buckets) = Out(), _sum(rows, TOTAL)
    shared, hot = anchor[buckets > 1], (many > MOST_BLOCKS)[buckets > 1]
    for row in rows.to_pylist():
        mine = np.isin(shared, unpack(row["data"], TOTAL)[0][0])
        out.one(row["key"] + shards * row["part"], -1, pack([shared[mine], hot[mine]], SHARED))
    return out.table()


def meet(rows: pa.Table, known: pa.Table | None = None) -> pa.Table:
    """For each bucket of a group, those of its anchors that other buckets have too; known: shared over all groups."""
    out = Out()
    if known is None:
        anchor, many, buckets = _sum(rows, ANCHOR)
        shared, hot = anchor[buckets > 1], (many > MOST_BLOCKS)[buckets > 1]
    else:
        shared, hot = gather(known.column("data").to_pylist(), SHARED)
    order = np.argsort(shared)
    shared, hot = shared[order], hot[order]
    for part, data in zip(rows.column("part").to_pylist(), rows.column("data").to_pylist(), strict=True) if len(shared) else ():
        anchor = unpack(data, ANCHOR)[0][0]
        at = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
        at = at[shared[at] == anchor]
        if len(at):
            out.one(part, part, pack([shared[at], hot[at]], SHARED))
    return out.table()


@dataclass
class Met:
    """Blocks that meet: documents' ids, buckets and places in them; starts, windows, anchors' places; contents."""

    doc: np.ndarray
    part: np.ndarray
    pos: np.ndarray
    start: np.ndarray
    size: np.ndarray
    at: np.ndarray
    contents: list[bytes]


def decided(met: Met, search: Search) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(block, start, windows) of repeated runs; the blocks with the first of any window; and, window by window of these, whether it is one.

    Equal contents are one to the labels, with as many copies. A window's first place is that of the smallest
    (doc id, start) among the blocks that meet.
    """
    known: dict[bytes, int] = {}
    own = np.fromiter((known.setdefault(c, len(known)) for c in met.contents), np.int64, len(met.contents))
    order = np.lexsort((met.pos, met.part, met.doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(first_of([met.doc[order], met.part[order], met.pos[order]]))
    base = (rank << 32) + met.start
    order = np.lexsort((base, own))
    lead = order[first_of([own[order]])]  # the first block of each content
    copies = np.bincount(own)
    label = search.labels(list(known), met.at[lead], copies)
    size = met.size[lead].astype(np.int64)
    which = np.repeat(np.arange(len(lead)), size)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    place, there = base[lead][which] + offset, label >= 0
    least = np.full(label.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label[there], place[there])
    first = ~there
    first[there] = least[label[there]] == place[there]
    if search.all_repeats:
        many = np.bincount(label[there], weights=copies[which[there]], minlength=len(least))
        hit = there.copy()
        hit[there] = many[label[there]] > 1
        again = hit
    else:
        hit, again = there & ~first, there

    def runs(mask: np.ndarray) -> tuple[np.ndarray, ...]:
        edge = mask.copy()
        edge[1:] &= ~mask[:-1] | (offset[1:] == 0)
        a = np.flatnonzero(edge)
        stop = mask.copy()
        stop[:-1] &= ~mask[1:] | (offset[1:] == 0)
        return which[a], offset[a], np.flatnonzero(stop) - a + 1

    content, off, n = runs(hit)
    found = [(lead[content], met.start[lead[content]] + off, n)]
    content, off, n = runs(again & (copies[which] > 1))
    later = np.ones(len(own), bool)
    later[lead] = False
    later = np.flatnonzero(later)
    a, b = np.searchsorted(content, own[later]), np.searchsorted(content, own[later], side="right")
    of = np.repeat(later, b - a)
    row = np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    found.append((of, met.start[of] + off[row], n[row]))
    some = np.zeros(len(lead), bool)
    some[which[first]] = True
    return [np.concatenate(c) for c in zip(*found, strict=True)], lead[some], first[some[which]]


def _send(out: Out, met: Met, key: Callable[[np.ndarray], np.ndarray], anchor: np.ndarray) -> None:
    for k, rows in _by(key(anchor)):
        held = [met.contents[i] for i in rows]
        columns = [c[rows] for c in (met.doc, met.part, met.pos, met.start, met.size, met.at)]
        out.one(k, -1, pack([*columns, np.fromiter(map(len, held), np.int64, len(held))], BLOCK, b"".join(held)))


def extend(table: pa.Table, answers: pa.Table, search: Search, part: int, shards: int, groups: int) -> pa.Table:
    """What is repeated inside the bucket, and the contents of blocks that share an anchor with other buckets."""
    out, docs = Out(), documents(table)
    (anchor, pos, start, size, at), units = _all_blocks(docs, search)
    many_anchors, many = _counts(anchor)
    here = many[np.searchsorted(many_anchors, anchor)] > 1 if len(anchor) else np.zeros(0, bool)
    shared, hot = gather(answers.column("data").to_pylist(), SHARED)
    order = np.argsort(shared)
    shared, hot = shared[order], hot[order]
    place = np.searchsorted(shared, anchor)
    place[place == len(shared)] = 0
    there = shared[place] == anchor if len(shared) else np.zeros(len(anchor), bool)
    apart = there & (hot[place] > 0) if len(shared) else there
    rows = np.flatnonzero(here | there)
    if not len(rows):
        return out.table()
    rows = rows[np.argsort(pos[rows], kind="stable")]
    anchor, pos, start, size, at, here, there, apart = (c[rows] for c in (anchor, pos, start, size, at, here, there, apart))
    contents = [search.content(units(k)[a : a + n + search.window - 1]) for k, a, n in zip(pos.tolist(), start.tolist(), size.tolist(), strict=True)]
    ids = np.array([d[0] for d in docs], np.int64)[pos]
    all_ = Met(ids, np.full(len(pos), part), pos, start, size, at, contents)

    def of(rows: np.ndarray) -> Met:
        return Met(*(c[rows] for c in (all_.doc, all_.part, all_.pos, all_.start, all_.size, all_.at)), [contents[i] for i in rows])

    left = np.flatnonzero(~here)  # whose windows are all their bucket's first
    fresh = [np.ones(size[i], bool) for i in left if apart[i]]
    left_apart = [i for i in left if apart[i]]
    send = list(left[~apart[left]])
    inside = np.flatnonzero(here)
    if len(inside):
        (block, begin, n), some, first = decided(of(inside), search)
        found = _runs(pos[inside[block]], begin, n)
        if len(found[0]):
            out.one(-1 - part, part, pack(found, DONE))
        some = inside[some]
        cuts = np.cumsum(size[some])[:-1]
        for i, mask in zip(some, np.split(first, cuts), strict=True):
            if there[i] and not apart[i]:
                send.append(i)
            elif there[i]:
                left_apart.append(i)
                fresh.append(mask)
    group = shards * (part % groups)
    send = np.array(send, np.int64)
    _send(out, of(send), lambda a: (a % np.uint64(shards)).astype(np.int64) + group, anchor[send])
    if left_apart:  # window by window, dealt by window
        which = np.repeat(np.array(left_apart), [int(m.sum()) for m in fresh])
        offset = np.concatenate([np.flatnonzero(m) for m in fresh])
        one = Met(ids[which], np.full(len(which), part), pos[which], start[which] + offset, np.ones(len(which), np.int64), at[which] - offset, [])
        one.contents = [search.content(units(k)[a : a + search.window]) for k, a in zip(one.pos.tolist(), one.start.tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, one.contents), np.uint64, len(which))
        _send(out, one, lambda a: (a % np.uint64(shards)).astype(np.int64) + group, hashes)
    return out.table()


def decide(rows: pa.Table, search: Search, shards: int, last: bool) -> pa.Table:
    """What is repeated among the blocks that meet; before the last level, also the blocks with the first of any window."""
    out, held = Out(), []
    for key, part, data in zip(rows.column("key").to_pylist(), rows.column("part").to_pylist(), rows.column("data").to_pylist(), strict=True):
        if key < 0:  # what is settled goes back to its bucket
            out.one(-1 - part if not last else part, part, data)
        else:
            held.append((key, data))
    if not held:
        return out.table()
    told = [unpack(data, BLOCK) for _, data in held]
    *columns, length = (np.concatenate(c).astype(np.int64) for c in zip(*(t[0] for t in told), strict=True))
    contents, k = [], 0
    for (_, data), (cols, at) in zip(held, told, strict=True):
        for n in cols[-1].tolist():
            contents.append(data[at : at + n])
            at += n
    met = Met(*columns, contents)
    (block, begin, n), some, _ = decided(met, search)
    for part, rows_ in _by(met.part[block]):
        out.one(part if last else -1 - part, part, pack(_runs(met.pos[block[rows_]], begin[rows_], n[rows_]), DONE))
    if not last and len(some):
        kept = Met(*(c[some] for c in columns), [contents[i] for i in some])
        _send(out, kept, lambda a: a, np.full(len(some), held[0][0] % shards))
    return out.table()


def repeated_windows(docs: DataFrame, search: Search, answer: Callable[[bytes, np.ndarray, np.ndarray], tuple], names: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """A row for each row of docs (doc_id, _data binary): doc_id and answer(data, starts, windows).

    starts and windows are runs of repeated window starts. Rows that repeat both id and data are one document
    to the search, and each gets its answer; rows with one id and different data are different documents, in
    a fixed order. Null ids are ordered last, as one id; null data is empty; an empty table gives no rows.
    """
    parts = int(input_bytes(docs) // BUCKET) + 8
    shards, groups = 4 * parts, -(-parts // FAN)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_data")
    own = own.withColumn("_part", F.pmod(F.xxhash64("doc_id", "_data"), F.lit(parts)).cast("long"))  # a long, as the keys it meets: an int is hashed to another partition
    dealt = own.groupBy("_part")

    def bucket(key) -> int:
        return key[0].as_py()

    def finish(key, left: pa.Table, rows: pa.Table) -> pa.Table:
        doc, start, size = _runs(*gather(rows.column("data").to_pylist(), DONE))
        distinct = {d: k for k, d in enumerate(documents(left))}
        a, b = (np.searchsorted(doc, np.arange(len(distinct)), side=s) for s in ("left", "right"))
        answers = []
        for i, x in zip(left.column("doc_id").to_pylist(), left.column("_data"), strict=True):
            data = x.as_py() or b""
            k = distinct[NO_ID if i is None else i, data]
            answers.append(answer(data, start[a[k] : b[k]], size[a[k] : b[k]]))
        columns = zip(*answers, strict=True) if answers else [[] for _ in names]
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), *(pa.array(list(c), names[n][1]) for n, c in zip(names, columns, strict=True))], names=["doc_id", *names])

    seeds = dealt.applyInArrow(lambda key, t: seed(t, search, bucket(key), shards, groups), ROW_DDL)
    by_key = seeds.groupBy("key")
    if groups == 1:
        met = by_key.applyInArrow(lambda t: meet(t), ROW_DDL)
    else:
        known = by_key.applyInArrow(lambda t: total(t, shards), ROW_DDL).groupBy("key").applyInArrow(lambda t: across(t, shards), ROW_DDL)
        met = by_key.cogroup(known.groupBy("key")).applyInArrow(lambda left, right: meet(left, right), ROW_DDL)
    told = dealt.cogroup(met.groupBy("key")).applyInArrow(lambda key, left, right: extend(left, right, search, bucket(key), shards, groups), ROW_DDL)
    if groups > 1:
        told = told.groupBy("key").applyInArrow(lambda t: decide(t, search, shards, False), ROW_DDL)
    told = told.groupBy("key").applyInArrow(lambda t: decide(t, search, shards, True), ROW_DDL)
    return dealt.cogroup(told.groupBy("key")).applyInArrow(finish, "doc_id long, " + ", ".join(f"{n} {t}" for n, (t, _) in names.items()))
