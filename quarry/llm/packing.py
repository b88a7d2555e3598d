"""Packing token sequences into training windows by minimum bin slack.

Documents are cut into full windows and a remainder where they are tokenized, so ids are never shuffled.
What is packed is the histogram of remaining lengths, which the window bounds: for each new window pattern
the longest remaining length is taken as seed, and a subset-sum dynamic programme over a bitset of reachable
fills picks the multiset of remaining lengths that fills the window closest to its capacity. Backtracking
through the bitsets gives the count of every length; the pattern is then used as often as the remaining
counts allow. Pieces find their window by their rank among pieces of their length.

Everything the driver holds is bounded by the window: the histogram has at most `window` rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, table

WINDOW, END_ID = 2048, 1
#: Hash buckets in which pieces of one length are ranked, and buckets in a span of their prefix sums.
BUCKETS, SPAN = 4096, 64
#: Words whose ids a worker keeps; beyond that it starts afresh.
CACHED_WORDS = 700_000
#: Texts whose words are looked up together.
TOGETHER = 1024
#: Marks that are parted from a word's end, and letters whose case is not folded here.
MARKS, NOT_LATIN = ".,!?;:", "[^\\x00-\\x{24f}]|\\x{130}"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: What the cache of words relies on: how a tokenizer prepares texts, and how its model marks the end of a word.
PREPARED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def goes_by_words(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, splits at white space and ends words with a mark, as the cache of words supposes."""
    told = json.loads(tokenizer.to_str())
    return all(told.get(k) == v for k, v in PREPARED.items()) and told["model"]["type"] == "BPE" and told["model"].get("end_of_word_suffix") == "</w>" and not told["model"].get("continuing_subword_prefix")


class WholeTexts:
    """Ids of any tokenizer: whole texts, encoded together."""

    def __init__(self, tokenizer):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer

    def ids(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        return [np.array([*x.ids, end], np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]


class WordCache:
    """Places of words whose ids are known; the ids lie in one flat array.

    The tokenizer's normaliser and pre-tokenizer never look across white space, so a text's ids are those of
    its space-separated parts, in order. They also lower-case and part letters from marks, so a new word of
    Latin letters and perhaps one mark has the ids of its lower-cased letters, then the mark's: only new stems
    are tokenized, many in one string, and parted at the ids that end a word.
    """

    def __init__(self, tokenizer, most: int = CACHED_WORDS):
        self.tokenizer, self.most = tokenizer, most
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {m: np.array(tokenizer.encode(m, add_special_tokens=False).ids, np.uint32) for m in MARKS}
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.size = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of new words whose ids lie one after the other."""
        places = np.arange(self.size, self.size + len(sizes))
        self.size += len(sizes)
        if self.size > len(self.first):
            more = max(self.size, 2 * len(self.first))
            self.first, self.count = np.resize(self.first, more), np.resize(self.count, more)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[places], self.count[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        return places

    def _encode(self, words: list[str]) -> np.ndarray:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        places = self._add(np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))
        self.known.update(zip(words, places.tolist(), strict=True))
        return places

    def _encode_stems(self, stems: list[str]) -> None:
        parts = [stems[at : at + 500] for at in range(0, len(stems), 500)]
        for part, told in zip(parts, self.tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False), strict=True):
            ids = np.array(told.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self.known.update(zip(part, self._add(ids, np.diff(ends, prepend=0)).tolist(), strict=True))
            else:
                self._encode(part)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The places of new words."""
        last = pc.utf8_slice_codeunits(words, -1)
        marked = pc.is_in(last, value_set=pa.array(list(MARKS)))
        body = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        simple = pc.and_(pc.utf8_is_alpha(body), pc.invert(pc.match_substring_regex(body, NOT_LATIN)))
        found, good = np.empty(len(words), np.int64), simple.to_numpy(zero_copy_only=False)
        found[~good] = self._encode(words.filter(pc.invert(simple)).to_pylist())
        own, last = words.filter(simple), last.filter(simple)
        stems = pc.utf8_lower(body.filter(simple)).to_pylist()
        self._encode_stems([s for s in dict.fromkeys(stems) if s not in self.known])
        places = np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))
        for mark, ids in self.marks.items():
            which = np.flatnonzero(pc.equal(last, mark).to_numpy(zero_copy_only=False))
            at = places[which]
            size = self.count[at].astype(np.int64) + len(ids)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            inside = step < np.repeat(size - len(ids), size)
            flat = np.empty(len(step), np.uint32)
            flat[inside] = self.flat[(np.repeat(self.first[at], size) + step)[inside]]
            flat[~inside] = np.tile(ids, len(at))
            places[which] = self._add(flat, size)
        self.known.update(zip(own.to_pylist(), places.tolist(), strict=True))
        found[good] = places
        return found

    def ids(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """uint32 ids of each text, then end. Words are split and made distinct by Arrow, so each distinct one is looked up once."""
        if len(self.known) > self.most:
            self._empty()
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        places = np.array([self.known.get(w, -1) for w in distinct], np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn(words.dictionary.take(pa.array(new)))
        which = places.astype(np.int32)[words.indices.to_numpy()]
        count = self.count[which]
        ends = np.cumsum(count, dtype=np.int64)
        flat = self.flat[np.repeat(self.first[which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [np.append(flat[a:b], np.uint32(end)) for a, b in zip(cuts, cuts[1:], strict=False)]


#: One for each worker and tokenizer: workers serve many tasks, and words come again.
_CACHES: dict[str, WordCache | WholeTexts] = {}


def cache_of(path: str) -> WordCache | WholeTexts:
    """The cache of words where the tokenizer allows it, else whole texts are encoded."""
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = load_tokenizer(path)
        _CACHES[path] = WordCache(tokenizer) if goes_by_words(tokenizer) else WholeTexts(tokenizer)
    return _CACHES[path]


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int = END_ID, text: str = "text") -> DataFrame:
    """A row for each piece of each document: full windows, then what is left of it (1 to window ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            parts = (batch.slice(at, TOGETHER) for at in range(0, batch.num_rows, TOGETHER))
            for doc, ids in ((d, x) for part in parts for d, x in zip(part.column(0).to_pylist(), cache.ids(part.column(1), end), strict=True)):
                raw = memoryview(ids.astype("<u4")).cast("B")
                for at in range(0, len(ids), window):
                    size = min(window, len(ids) - at)
                    for column, value in zip(rows, (doc, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest that room holds."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most, some = min(counts[length], room // length), 1
        while most > 0:
            some = min(some, most)
            steps.append((length, some, reach))
            reach |= (reach << (some * length)) & mask
            most -= some
            some *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + some
            at -= some * length
    return used


def patterns(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a window with their counts, windows of this kind) until no piece is left."""
    left, found = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = best_fill({k: n for k, n in left.items() if n > 0}, window - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        found.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
        left = {k: n for k, n in left.items() if n}
    return found


def spans(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, count in a window, first sequence, offset of the first of them), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in found:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, rank.get(length, 0), used[length], sequence, offset))
            rank[length] = rank.get(length, 0) + used[length] * times
            offset += used[length] * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _before(heads: DataFrame) -> DataFrame:
    """heads (length, _bucket, count) with _before, the rows of a length's earlier buckets, in place of count.

    Prefix sums in two levels, over spans of SPAN buckets and inside each, so that no task has all buckets of a length.
    """
    heads = heads.withColumn("_span", F.floor(F.col("_bucket") / SPAN).cast("int"))
    spans_of = heads.groupBy("length", "_span").agg(F.sum("count").alias("_all"))
    spans_of = spans_of.withColumn("_earlier", F.sum("_all").over(Window.partitionBy("length").orderBy("_span")) - F.col("_all")).drop("_all")
    inside = F.sum("count").over(Window.partitionBy("length", "_span").orderBy("_bucket")) - F.col("count")
    summed = heads.withColumn("_inside", inside).join(spans_of, ["length", "_span"])
    return summed.select("length", "_bucket", (F.col("_earlier") + F.col("_inside")).alias("_before"))


def pack(cut: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces; cut must be a table that can be read again.

    Pieces of one length are ranked in two levels (hash buckets, then rows of a bucket), so a length that
    holds any part of all rows is never in one task. Windows are filled from offset 0 without gaps; what is
    over at a window's end is padding. An empty table gives no rows.
    """
    spark = cut.sparkSession
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    heads = stage(keyed.groupBy("length", "_bucket").count(), "pack-counts")
    totals = {r[0]: r[1] for r in heads.groupBy("length").agg(F.sum("count")).collect()}  # at most `window` rows
    told = spark.sparkContext.broadcast(spans(patterns(totals, window)))  # a row for each length of each pattern
    heads = _before(heads)
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.join(heads, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = told.value
        width = int(rows[:, 1].max(initial=0)) + 1
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            first, many, sequence, offset = (rows[at, i] for i in range(1, 5))
            turn, slot = np.divmod(rank - first, many)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence + turn), pa.array(offset + slot * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """Tokenize docs, cut them and pack the pieces.

    A null or empty text is the end id alone; repeated rows are separate documents, and a null id is kept;
    very long texts are cut like others, none is truncated; columns besides id and text are left out; an empty
    table gives no rows. tokenizer is the path of any tokenizer file: one that does not go by words is slower.
    """
    return pack(stage(pieces(docs, tokenizer, window=window, end=end), "pieces"), window=window)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir):
    """Every document's pieces and their places; odd rows are as in pack_documents."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())


QUERIES = {"op10_packing": op10_packing}
