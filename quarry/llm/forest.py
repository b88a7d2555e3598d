"""Near-duplicate documents by an LSH forest of MinHash signatures.

Each tree of the forest is one sorted order of the documents' signatures, by values of its own. Depth adapts to
the region: from MIN_DEPTH values on, the least common prefix that candidates must share grows until no more than
REGION + 1 documents have it, and all of these are candidates of each other. Where even the whole prefix is shared
by more, and besides everywhere, the neighbours with the longest common prefix, which the sort has put side by
side, are candidates. Orders are range-partitioned and streamed, so no region has to fit a task. Candidates whose
signatures agree well enough are confirmed on the full shingle sets, and confirmed links make components.

In a crowded region a document may have its only link far from its neighbours in every order. So the
documents that have candidates at all, which every linked document is in some tree, take a second, exact
turn: their rarest shingles (as many as a linked pair must share one of) are matched, and pairs that still
run between different components are confirmed too. Documents with equal shingle sets are one node
throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, parts_for, stage, table
from .seed_extend import symbols
from .winnow import mix

#: Words of a shingle, and the least similarity in hundredths.
WORDS, LEAST = 3, 85
#: Sorted orders, the 16-bit values each compares, the least common prefix, neighbours to either side whatever the region, and the others of a region that are all candidates.
TREES, DEPTH, MIN_DEPTH, NEIGHBOURS, REGION = 16, 8, 2, 3, 8
#: The share of values on which candidates must agree to be confirmed in the first turn; the second is exact without it.
LEAST_AGREED = 0.70
#: Cells of the table of shingle frequencies that orders them; any order is exact, a true one prunes most.
CELLS = 1 << 20
#: Ids that are broadcast at most (16 MB); beyond that they are joined by a shuffle.
MOST_BROADCAST = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_XOR = mix(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64)).astype(np.uint32)


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; of fewer words the whole sequence is one, of none there are none."""
    h = symbols(data.translate(_LOWER))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    found = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        found = mix(found + h[k : k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def signature(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of the set under as many orders."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(_ODD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        part = (low[None, at : at + 512] ^ _XOR[:, None]) * _ODD[:, None]
        np.minimum(out, (part ^ (part >> np.uint32(15))).min(axis=1), out=out)
    return out


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


NODE = "doc_id long, n_shingles long, digest binary, sig binary"


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for data in batch.column(1):
                found = shingles(data.as_py() or b"", words)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append((signature(found) & np.uint32(0xFFFF)).astype(">u2").tobytes() if len(found) else None)
            more = {"text_sha256": batch.column(2)} if batch.num_columns > 2 else {}
            yield _table({"doc_id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "sig": pa.array(signatures, pa.binary()), **more})

    return run


def region_depths(common: np.ndarray) -> np.ndarray:
    """For each row of an order, the least depth that at most REGION + 1 rows around it share; DEPTH + 1 where even the whole prefix is shared by more.

    common: the values that each row has in common with the next.
    """
    found = np.full(len(common) + 1, DEPTH + 1)
    for depth in range(DEPTH, MIN_DEPTH - 1, -1):
        run = np.concatenate([[0], np.cumsum(common < depth)])
        found[np.bincount(run)[run] <= REGION + 1] = depth
    return found


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a sorted order, as pairs; then the rows at both ends (a is null)."""
    last, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, doc = batch.column("tree").to_numpy(), batch.column("doc").to_numpy()
        values = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u2").reshape(-1, DEPTH)
        if last is not None:
            tree, doc, values = (np.concatenate(x) for x in zip(last, (tree, doc, values), strict=True))
        fresh = 0 if last is None else len(last[0])
        common = np.where(tree[1:] == tree[:-1], np.logical_and.accumulate(values[1:] == values[:-1], axis=1).sum(axis=1), 0)
        depth, shared, found = region_depths(common), common, []
        for gap in range(1, min(REGION, len(doc) - 1) + 1):
            if gap > 1:
                shared = np.minimum(shared[:-1], common[gap - 1 :])
            hit = (shared >= MIN_DEPTH) & ((gap <= NEIGHBOURS) | (shared >= np.minimum(depth[:-gap], depth[gap:]))) & (doc[gap:] != doc[:-gap]) & (np.arange(gap, len(doc)) >= fresh)
            at = np.flatnonzero(hit)
            found.append((np.minimum(doc[at], doc[at + gap]), np.maximum(doc[at], doc[at + gap])))
        if first is None:
            first = [x[:REGION] for x in (tree, doc, values)]
        last = [x[-2 * REGION :] for x in (tree, doc, values)]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _table({"a": pa.array(a), "b": pa.array(b), "tree": pa.nulls(len(a), pa.int32()), "prefix": pa.nulls(len(a), pa.binary())})
    if first is not None:
        tree, doc, values = (np.concatenate([x, y[-REGION:]]) for x, y in zip(first, last, strict=True))
        yield _table({"a": pa.nulls(len(doc), pa.int64()), "b": pa.array(doc), "tree": pa.array(tree, pa.int32()), "prefix": pa.array([v.tobytes() for v in values], pa.binary())})


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs a < b of documents that are neighbours in some tree; reps: doc, sig."""
    width = 2 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * width + 1, F.lit(width)).alias("prefix")))
    rows = reps.select("doc", F.explode(trees).alias("t")).select("t.tree", "t.prefix", "doc")
    ddl = "a long, b long, tree int, prefix binary"
    near = stage(rows.repartitionByRange(parts_for(reps, 1 << 20), "tree", "prefix", "doc").sortWithinPartitions("tree", "prefix", "doc").mapInArrow(_neighbours, ddl), "neighbours")
    ends = near.filter("a is null").select("tree", "prefix", F.col("b").alias("doc")).distinct()  # 2 * REGION rows of each partition, so 3.2 million at most
    seams = ends.repartition(1).sortWithinPartitions("tree", "prefix", "doc").mapInArrow(_neighbours, ddl)
    found = stage(near.union(seams).filter("a is not null").select("a", "b").distinct(), "pairs")
    discard(near)
    return found


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, TREES * DEPTH) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= LEAST_AGREED))


def _confirm(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    left = rows.select(F.col("doc").alias("a"), F.col(value).alias("sa"))
    right = rows.select(F.col("doc").alias("b"), F.col(value).alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


def confirm(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs that are links by their full sets; sets: doc, shingles."""
    return _with_both(pairs, sets, "shingles").mapInArrow(_confirm(least), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """v and c for the nodes of links (a, b): c is the smallest node that v reaches. The result is a staged table.

    Every node takes its smallest neighbour or itself, chains are shortened by halves, and what still links
    different nodes is solved in the same way. Aggregations combine before they shuffle. Joins are inner, from
    many nodes to the one row of their label, so adaptive execution splits the nodes of a hub over many tasks.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    held = stage(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("c")), "labels")
    while True:
        label = held.select("v", "c")
        up = label.select(F.col("v").alias("c"), F.col("c").alias("top"))
        further = stage(label.join(up, "c").select("v", F.col("top").alias("c"), (F.col("top") != F.col("c")).alias("moved")), "labels")
        discard(held)
        held = further
        if not held.filter("moved").take(1):
            break
    label = held.select("v", "c")
    a, b = label.select(F.col("v").alias("a"), F.col("c").alias("x")), label.select(F.col("v").alias("b"), F.col("c").alias("y"))
    left = stage(links.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not left.take(1):
        discard(left)
        return held
    over = components(left)
    found = stage(label.join(over.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", "left").select("v", F.coalesce("top", "c").alias("c")), "labels")
    discard(held, left, over)
    return found


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Shingles by cell, over all of sets; the driver gets CELLS numbers, whatever the input."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(count, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        for at in range(0, CELLS, 4096):
            if count[at : at + 4096].any():
                yield _table({"at": pa.array([at], pa.int32()), "n": pa.array([count[at : at + 4096].tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in rows.column("n").to_pylist()], axis=0)
        return pa.table({"at": rows.column("at")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    count = np.zeros(CELLS, np.int64)
    for row in sets.select("shingles").mapInArrow(tally, "at int, n binary").groupBy("at").applyInArrow(add, "at int, n binary").collect():
        count[row.at : row.at + 4096] = np.frombuffer(bytes(row.n), np.int64)
    return count


def rare_matches(sets: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles and may be links by size and place.

    A link shares so much that one of the first size - ceil(least size) + 1 shingles of either set, in any
    common order, is in the other's; and what both have after the first shared place bounds what they share.

    A shingle that one component alone has, such as those of a large group of near copies, is set aside before
    anything meets: that takes its least and its greatest component only, which are combined before the shuffle. The
    others meet in joins by shingle and size band (links are of sizes within a band or two that touch), which sort
    on disk and are split where a shingle is frequent; only pairs within the bounds come out.
    """
    told = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = told.value
        for batch in batches:
            parts = [[np.zeros(0, np.int64)] for _ in range(5)]
            for doc, own, x in zip(batch.column("doc").to_pylist(), batch.column("c").to_pylist(), batch.column("shingles"), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(s)
                k = n - -(-least * n // 100) + 1
                order = np.lexsort((s, count[(s % np.uint64(CELLS)).astype(np.int64)]))[:k]
                for part, column in zip(parts, (s[order].view(np.int64), np.full(k, doc), np.full(k, own), np.arange(k), np.full(k, n)), strict=True):
                    part.append(column)
            yield _table({name: pa.array(np.concatenate(part)) for name, part in zip(("shingle", "doc", "c", "place", "size"), parts, strict=True)})

    known = labels.select(F.col("v").alias("doc"), "c")
    rows = sets.join(known, "doc", "left").select("doc", F.coalesce("c", "doc").alias("c"), "shingles")
    entries = stage(rows.mapInArrow(rarest, "shingle long, doc long, c long, place long, size long"), "rarest")
    shared = entries.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("shingle")
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(100 / least))).cast("int")
    met = stage(entries.join(shared, "shingle", "left_semi").withColumn("band", band), "shared")
    small = met.select("shingle", F.col("band"), F.col("doc").alias("u"), F.col("c").alias("uc"), F.col("place").alias("up"), F.col("size").alias("us"))
    large = met.select("shingle", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") - 2)).alias("band"), F.col("doc").alias("v"), F.col("c").alias("vc"), F.col("place").alias("vp"), F.col("size").alias("vs"))
    within = (F.col("uc") != F.col("vc")) & ((F.col("us") < F.col("vs")) | ((F.col("us") == F.col("vs")) & (F.col("u") < F.col("v")))) & (100 * F.col("us") >= least * F.col("vs"))
    bound = (100 + least) * F.least(F.col("us") - F.col("up"), F.col("vs") - F.col("vp")) >= least * (F.col("us") + F.col("vs"))
    pairs = small.join(large, ["shingle", "band"]).filter(within & bound).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    found = stage(pairs.distinct(), "pairs")
    discard(entries, met)
    return found


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table({"doc": batch.column(0), "shingles": pa.array([shingles(x.as_py() or b"", words).tobytes() for x in batch.column(1)], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, *, text: str = "text", words: int = WORDS, least: int = LEAST, with_sha: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept; shingles of so many words, links of least hundredths or more.

    with_sha adds text_sha256, of the whole text (null: empty), by which a caller finds the row that is meant.

    Texts without words, nulls among them, have an empty set and are linked with nothing; texts of any length are
    whole. Rows that repeat an id and a text have the same result, and each is kept if the id is its component's; an
    id with several texts belongs to the component of each. Rows with a null id are linked with nothing, have no
    component and are kept. An empty table gives no rows; columns besides id and text are left out.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_data"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    nodes = stage(base.select(*base.columns if with_sha else ["doc_id", "_data"]).mapInArrow(_nodes(words), NODE + ", text_sha256 string" * with_sha), "nodes")
    known = nodes.filter("doc_id is not null and n_shingles > 0")
    firsts = known.groupBy("digest").agg(F.min(F.struct("doc_id", "sig")).alias("f"))
    reps = stage(firsts.select("digest", F.col("f.doc_id").alias("doc"), F.col("f.sig").alias("sig")), "reps")
    pairs = candidates(reps)
    near = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near")
    some = F.broadcast(near) if near.count() <= MOST_BROADCAST else near
    sets = stage(base.select("doc_id", "_data").join(some, "doc_id", "left_semi").mapInArrow(_sets(words), "doc long, shingles binary").filter(F.octet_length("shingles") > 0), "sets")
    agreeing = _with_both(pairs, reps, "sig").mapInArrow(_agreeing, "a long, b long").distinct()
    links = stage(confirm(agreeing, sets, least), "links")
    labels = components(links)
    rare = rare_matches(sets, labels, least)
    stars = labels.filter("v <> c").select(F.col("c").alias("a"), F.col("v").alias("b"))
    all_links = stage(stars.union(confirm(rare, sets, least)).distinct(), "links")
    final = components(all_links)
    discard(pairs, near, sets, links, labels, rare, all_links)
    classes = reps.select("digest", "doc").join(final.select(F.col("v").alias("doc"), "c"), "doc", "left").select(F.col("digest").alias("_digest"), F.coalesce("c", "doc").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    spread = F.coalesce("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))  # texts without words meet nothing, in many tasks
    more = ["text_sha256"] if with_sha else []
    joined = nodes.select("doc_id", "n_shingles", *more, spread.alias("_digest")).join(classes, "_digest", "left")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *more)


def op8_lsh_forest(spark, sf_dir):
    """Every document's component by three-word shingles and 85 hundredths; odd rows are as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_lsh_forest": op8_lsh_forest}
