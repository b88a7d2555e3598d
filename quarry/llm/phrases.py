"""Phrase collocations by hierarchical pair naming: frequent neighbours of k - 1 words get the name of their pair, and pairs point back to their parts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, parts_for, stage, table

#: Bytes of text that are named together; a longer text is a block of its own.
BLOCK = 16 << 20
#: Rows of one language that one task ranks are at most so many times the number asked for.
FAN = 32
#: Blocks of one task are fewer.
MOST = 4096
_GAP = b"\xff"  # no byte of UTF-8
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))




def _held(codes: np.ndarray) -> list[pa.Array]:
    """The columns size and codes: so many bytes of places, packed."""
    return [pa.array([codes.nbytes], pa.int64()), pa.array([pa.compress(codes.tobytes(), "zstd", asbytes=True)], pa.binary())]


def _words(text: bytes) -> list[bytes]:
    """Words in small letters (A-Z only), and _GAP where a piece ends."""
    return text.translate(_FOLD).replace(_GAP, b" \xff ").split()


def blocks(docs: DataFrame, bytes_each: int = BLOCK) -> DataFrame:
    """(block, size, codes, entries) of docs (lang, text): a block's words as places in its entries (lang, word, n), -1 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = blocks_done = 0
        fresh = count()
        tables: dict[str, dict[bytes, int]] = {}

        def made() -> pa.RecordBatch:
            codes = np.concatenate([np.asarray(h, np.int32) for h in held])
            words = [(lang, w, c) for lang, own in tables.items() for w, c in own.items() if c >= 0]
            order = np.argsort(np.array([c for *_, c in words], np.int64))
            times = np.bincount(codes[codes >= 0], minlength=len(words))
            columns = [pa.array([words[i][0] for i in order], pa.string()), pa.array([words[i][1] for i in order], pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
            entries = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.StructArray.from_arrays(columns, names=["lang", "word", "n"]))
            return pa.RecordBatch.from_arrays([pa.array([part * MOST + blocks_done], pa.int64()), *_held(codes), entries], names=["block", "size", "codes", "entries"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, lang in enumerate(langs):
                raw = texts[i].as_buffer()
                if not raw or not raw.size:
                    continue
                if lang not in tables:
                    tables[lang] = defaultdict(fresh.__next__, {_GAP: -1})
                words = _words(raw.to_pybytes())
                held += [np.fromiter(map(tables[lang].__getitem__, words), np.int32, len(words)), np.array([-1], np.int32)]
                size += raw.size
                if size >= bytes_each:
                    yield made()
                    held, size, blocks_done, fresh, tables = [], 0, blocks_done + 1, count(), {}
        if held:
            yield made()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "block long, size long, codes binary, entries array<struct<lang:string,word:string,n:long>>")


def _pairing(parts: int):
    """The function that makes a block's next state: neighbours that both have names become pairs, and pairs are dealt to `parts` buckets by a hash of their names."""

    def paired(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "pairs": pa.array([], _PIECES)})
        codes = np.frombuffer(pa.decompress(state.column("codes")[0].as_buffer(), state.column("size")[0].as_py(), "zstd"), np.int32)
        many = int(codes.max(initial=-1)) + 1
        names = np.full(many + 1, -1, np.int64)  # the last one is for the gaps' -1
        for code, name in _told(found):
            names[code] = name
        at = np.flatnonzero((names[codes[:-1]] >= 0) & (names[codes[1:]] >= 0))
        pairs, place, times = np.unique(codes[at].astype(np.int64) * many + codes[at + 1], return_inverse=True, return_counts=True)
        after = np.full(len(codes), -1, np.int32)
        after[at] = place
        left, right = names[pairs // max(many, 1)], names[pairs % max(many, 1)]
        mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = [np.stack([left[i], right[i], times[i], i]) for i in np.split(order, cuts[1:])] if len(pairs) else []
        pieces = [{"bucket": int(bucket[r[3, 0]]), "size": r.nbytes, "packed": pa.compress(r.tobytes(), "zstd", asbytes=True)} for r in rows]
        return pa.table([state.column("block").combine_chunks(), *_held(after), pa.array([pieces], _PIECES)], names=["block", "size", "codes", "pairs"])

    return paired


def _told(found: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a block's entries and their names, from rows or packed."""
    if "packed" not in found.column_names:
        yield found.column("code").to_numpy(), found.column("id").to_numpy()
        return
    for packed, size in zip(found.column("packed"), found.column("size").to_pylist(), strict=True):
        yield from [tuple(np.frombuffer(pa.decompress(packed.as_buffer(), size, "zstd"), np.int64).reshape(2, -1))]


_PIECES = pa.list_(pa.struct([("bucket", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())]))
_STATE = "block long, size long, codes binary, pairs array<struct<bucket:long,size:long,packed:binary>>"


_PHRASES = pa.list_(pa.struct([("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64()), ("id", pa.int64())]))
_FOUND = "of long, size long, packed binary, phrases array<struct<left:long,right:long,a:long,id:long>>"


def _counting(least: int):
    """The function that adds up a bucket's pairs over all blocks, and names those that occur often enough by the first block's place.

    It gives the phrases in one row, and for each block `of` one with the block's own places of them and their names, packed.
    """

    def counted(pieces: pa.Table) -> pa.Table:
        parts = [np.frombuffer(pa.decompress(p.as_buffer(), n, "zstd"), np.int64).reshape(4, -1) for p, n in zip(pieces.column("packed"), pieces.column("size").to_pylist(), strict=True)]
        left, right, times, code = np.concatenate(parts, axis=1)
        of = np.repeat(pieces.column("of").to_numpy(), [p.shape[1] for p in parts])
        order = np.lexsort((right, left))
        left, right, times, code, of = (x[order] for x in (left, right, times, code, of))
        first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        total, name = np.add.reduceat(times, first), np.minimum.reduceat((of << 32) + code, first)
        often = np.repeat(total >= least, np.diff(np.r_[first, len(left)]))
        own = np.repeat(name, np.diff(np.r_[first, len(left)]))[often]
        code, of = code[often], of[often]
        by = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[by], prepend=-1))
        blocks = [np.stack([code[i], own[i]]) for i in np.split(by, cuts[1:])] if len(by) else []
        kept = first[total >= least]
        phrases = pa.StructArray.from_arrays([pa.array(x) for x in (left[kept], right[kept], total[total >= least], name[total >= least])], names=["left", "right", "a", "id"])
        rows = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), phrases), pa.nulls(len(blocks), _PHRASES)]
        columns = [[None, *of[by][cuts].tolist()], [None, *[b.nbytes for b in blocks]], [None, *[pa.compress(b.tobytes(), "zstd", asbytes=True) for b in blocks]]]
        return pa.table([*[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], pa.chunked_array(rows, _PHRASES)], names=["of", "size", "packed", "phrases"])

    return counted


def _often(state: DataFrame, least: int, parts: int) -> DataFrame:
    """What _counting gives of all buckets' pairs.

    A block sends a bucket one row, its pairs packed; the number of buckets grows with the input, and a pair is in a
    bucket at most once for each block.
    """
    pieces = state.select(F.col("block").alias("of"), F.explode("pairs").alias("p")).select("of", "p.bucket", "p.size", "p.packed")
    return stage(pieces.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_counting(least), _FOUND), "phrases")


def _often_words(state: DataFrame, least: int, parts: int) -> DataFrame:
    """The same of words: (of, code, lang, word, a, id). A word's rows, one of a block, are sorted next to each other and spill."""
    entries = state.select(F.col("block").alias("of"), F.posexplode("entries").alias("code", "e")).select("of", "code", "e.lang", "e.word", "e.n")
    same = Window.partitionBy("lang", "word")
    rows = entries.repartition(parts, "lang", "word").withColumn("a", F.sum("n").over(same)).withColumn("id", F.min(F.shiftleft("of", 32) + F.col("code")).over(same))
    return stage(rows.filter(F.col("a") >= least).drop("n"), "phrases")


def named_phrases(docs: DataFrame, *, least: int = 100, longest: int = 5, bytes_each: int = BLOCK) -> list[DataFrame]:
    """For each length from 1 on, the phrases of docs (lang, text) that occur `least` times: id, lang, phrase, last, a, n, prefix, suffix, left, right.

    prefix and suffix are the counts of a phrase's first and last 1, 2, ... words short of all; left and right are the
    names of its first and last k - 1 words. A phrase of k words occurs often only if both these do, so no other pair
    of names is looked at. Every block counts its own pairs before anything is shuffled: a key has at most one row of a
    block. What follows the blocks are dictionaries and arrays of places, never rows for words.
    """
    parts = parts_for(docs, BLOCK)
    state = stage(blocks(docs, bytes_each), "blocks")
    sizes = stage(state.select(F.explode("entries").alias("e")).groupBy("e.lang").agg(F.sum("e.n").alias("n")), "sizes")
    found = _often_words(state, least, parts)
    once = F.col("id") == F.shiftleft("of", 32) + F.col("code")  # of a phrase's rows, that of the first block
    first = found.filter(once).join(sizes, "lang").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", "n", *[F.array().cast("array<long>").alias(x) for x in ("prefix", "suffix")], *[F.lit(None).cast("long").alias(x) for x in ("left", "right")])
    levels = [stage(first, "names")]
    discard(sizes)
    places = found.select("of", "code", "id")
    for _ in range(longest - 1):
        after = stage(state.select("block", "size", "codes").groupBy("block").cogroup(places.groupBy("of")).applyInArrow(_pairing(parts), _STATE), "blocks")
        discard(state, found)
        state = after
        found = _often(state, least, parts)
        places = found.filter("of is not null").select("of", "size", "packed")
        named = found.filter("of is null").select(F.explode("phrases").alias("p")).select("p.*")
        parent = levels[-1]
        side = lambda s, keep: parent.select(F.col("id").alias(s), *[F.col(c).alias(f"_{s}_{c}") for c in keep])
        both = named.join(side("left", ["lang", "phrase", "a", "n", "prefix"]), "left").join(side("right", ["last", "a", "suffix"]), "right")
        grown = lambda s, x: F.concat(f"_{s}_{x}", F.array(f"_{s}_a")).alias(x)
        levels.append(stage(both.select("id", F.col("_left_lang").alias("lang"), F.concat("_left_phrase", F.lit(" "), "_right_last").alias("phrase"), F.col("_right_last").alias("last"), "a", F.col("_left_n").alias("n"),
                                        grown("left", "prefix"), grown("right", "suffix"), "left", "right"), "names"))
    discard(state, found)
    return levels


def best(rows: DataFrame, by: str, order: list, most: int, *, parts: int = 1) -> DataFrame:
    """rows with rank, the first `most` of each `by`: groups are dealt apart, and their best meet in fewer and fewer groups, FAN at a time."""
    while True:
        dealt = F.pmod(F.xxhash64(*[c for c in ("phrase", "a") if c in rows.columns]), F.lit(parts)) if parts > 1 else F.lit(0)
        rows = rows.withColumn("_deal", dealt).withColumn("rank", F.row_number().over(Window.partitionBy(by, "_deal").orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("_deal")
        if parts <= 1:
            return rows
        parts //= FAN


def cut() -> Column:
    """A phrase's cut (score, k, l, r) from its columns a, n, prefix and suffix: the least score, the earlier cut of equal ones."""
    r = "get(suffix, size(prefix) - 1 - i)"
    wide = lambda x: f"cast({x} as decimal(19,0))"
    score = f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide(r)})"
    return F.expr(f"array_min(transform(prefix, (l, i) -> struct({score} as score, i + 1 as k, l as l, {r} as r)))")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, most: int = 2000, bytes_each: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to `longest` words.

    A phrase's cut is the one with the least score floor(1000 a n / (l r)), the earlier of equal ones; a phrase inside a
    longer one of the same count is left out, which its two parents' pointers tell, since every phrase between the two
    has that count too. Products are decimals of 38 digits. Null texts are empty and null languages are `und`; empty
    texts add nothing, long texts are read whole, repeated rows each count, ties go by count and phrase, other columns
    are not looked at, and an empty table gives no rows.
    """
    levels = named_phrases(docs, least=least, longest=longest, bytes_each=bytes_each)
    kept = None
    for k in range(1, longest):
        rows = levels[k]
        if k + 1 < longest:
            parents = levels[k + 1].select(F.explode(F.array(F.when(F.col("a") == F.element_at("prefix", -1), F.col("left")), F.when(F.col("a") == F.element_at("suffix", -1), F.col("right")))).alias("id"))
            rows = rows.join(parents.filter("id is not null").distinct(), "id", "left_anti")
        kept = rows if kept is None else kept.unionByName(rows)
    rows = kept.withColumn("_cut", cut()).select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
    ranked = best(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, parts=parts_for(kept, 1 << 20))
    out = stage(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*levels)
    return out


def op13_collocations(spark, sf_dir):
    """Collocations of every document's whole text, for each language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = {
    "op13_collocations": """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS s(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::hugeint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
inner_ AS (SELECT DISTINCT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
x AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c WHERE NOT EXISTS (FROM inner_ i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, n.n, (1000::hugeint * x.a * n.n) // (l.a::hugeint * r.a) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM z
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
}
QUERIES = {"op13_collocations": op13_collocations}
