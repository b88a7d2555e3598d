"""Lloyd's algorithm with two trees: cover trees over vectors, one over the centroids of a round, and bounds between their nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, table

#: Vectors that one cover tree holds; a block's distances are a square matrix while it is built.
BLOCK = 2048
#: Points that a node need not part further.
LEAF = 16
#: A squared distance of 64 components within this bound fits 64 bits.
BOUND = 1 << 27


@dataclass
class Tree:
    """A cover tree: points in tree order, so that a node is a stretch of them, and its first point is its centre.

    start and end are a node's stretch, radius bounds the distance of its points from its centre, and its children are
    the nodes first ... first + many - 1.
    """

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    many: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    step = a - b
    return np.einsum("ij,ij->i", step, step)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The cover tree of integer points, and their order in it.

    A node whose points lie within 2^i of its centre has the centre itself as first child, and each further child's
    centre is over 2^(i - 1) from those before it; every point goes to the first that lies within that distance.
    """
    real = points.astype(np.float64)
    size = np.einsum("ij,ij->i", real, real)
    apart = np.sqrt(np.maximum(size[:, None] + size[None, :] - 2 * real @ real.T, 0))
    order, nodes, at = np.arange(len(points)), [[0, len(points), 0.0, 0, 0]], 0
    while at < len(nodes):
        begin, end, *_ = nodes[at]
        own = order[begin:end]
        far = apart[own[0], own]
        nodes[at][2] = float(np.sqrt(squared(points[own], points[own[:1]]).max()))  # of exact integers
        if end - begin > leaf and nodes[at][2] > 0:
            cover = 2.0 ** (np.ceil(np.log2(far.max())) - 1) if far.max() > 0 else 0.0
            nodes[at][3], left, place = len(nodes), own, begin
            while len(left):
                near = apart[left[0], left] <= cover
                near[0] = True
                group, left = left[near], left[~near]
                order[place : place + len(group)] = group
                nodes.append([place, place + len(group), 0.0, 0, 0])
                place += len(group)
            nodes[at][4] = len(nodes) - nodes[at][3]
            if nodes[at][4] == 1:  # rounding kept all of them together
                nodes.pop()
                nodes[at][3:] = [0, 0]
        at += 1
    columns = list(zip(*nodes, strict=True))
    whole = lambda i: np.array(columns[i], np.int64)
    return Tree(points[order], whole(0), whole(1), np.array(columns[2]), whole(3), whole(4)), order


@dataclass
class Centres:
    """A tree over a round's different centroids, and the least number of each point in it."""

    tree: Tree
    number: np.ndarray


def centre_tree(centroids: np.ndarray) -> Centres:
    """Equal centroids count once, by their least number; a leaf holds one."""
    _, own = np.unique(centroids, axis=0, return_index=True)
    own.sort()
    tree, order = cover_tree(centroids[own], leaf=1)
    return Centres(tree, own[order])


def assigned(vectors: Tree, centres: Centres) -> np.ndarray:
    """The nearest centroid of every point of a tree, the smaller number on ties.

    Pairs of a node of vectors and a node of centroids go down both trees together. A pair stays only if the node's
    nearest point may be as near to it as its farthest is to some centroid. A node left with one centroid is settled
    whole; points of leaves left with several are compared exactly.
    """
    v, c, own = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(len(vectors.points), np.int64)
    tree = centres.tree
    middle_v, middle_c = vectors.points[vectors.start], tree.points[tree.start]
    limit = np.full(len(vectors.start), np.inf)
    while len(v):
        distance = np.sqrt(squared(middle_v[v], middle_c[c]))
        slack = 1e-9 * (1 + distance + vectors.radius[v] + tree.radius[c])
        np.minimum.at(limit, v, distance + vectors.radius[v] + slack)
        stays = distance - vectors.radius[v] - tree.radius[c] - slack <= limit[v]
        v, c = v[stays], c[stays]
        open_ = (tree.many[c] > 0) & ((tree.radius[c] > vectors.radius[v]) | (vectors.many[v] == 0))
        if open_.any():
            v, c = np.concatenate([v[~open_], np.repeat(v[open_], tree.many[c[open_]])]), np.concatenate([c[~open_], _children(tree, c[open_])])
            continue
        times = np.bincount(v, minlength=len(vectors.start))
        settled = (times[v] == 1) & (tree.many[c] == 0)
        for node, centre in zip(v[settled], c[settled], strict=True):
            own[vectors.start[node] : vectors.end[node]] = centres.number[tree.start[centre]]
        leaf = ~settled & (vectors.many[v] == 0)
        _compare(vectors, centres, v[leaf], c[leaf], own)
        on = ~settled & ~leaf
        v, c = v[on], c[on]
        down = _children(vectors, v)
        limit[down] = np.repeat(limit[v], vectors.many[v])  # what bounds a node bounds its parts
        v, c = down, np.repeat(c, vectors.many[v])
    return own


def _children(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    many = tree.many[nodes]
    return np.repeat(tree.first[nodes], many) + _within(many)


def _within(many: np.ndarray) -> np.ndarray:
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _compare(vectors: Tree, centres: Centres, v: np.ndarray, c: np.ndarray, own: np.ndarray, most: int = 16384) -> None:
    """Each point of leaves v gets the nearest of its candidates c; rows are compared `most` at a time, a leaf's together."""
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    sizes = vectors.end[v] - vectors.start[v]
    places = np.cumsum(sizes)
    at = 0
    while at < len(v):
        to = int(np.searchsorted(places, (places[at - 1] if at else 0) + most, "right"))
        to = max(to, at + 1)
        to = int(np.searchsorted(v, v[to - 1], "right"))
        point = np.repeat(vectors.start[v[at:to]], sizes[at:to]) + _within(sizes[at:to])
        number = np.repeat(centres.number[centres.tree.start[c[at:to]]], sizes[at:to])
        row = np.repeat(centres.tree.start[c[at:to]], sizes[at:to])
        best = np.lexsort((number, squared(vectors.points[point], centres.tree.points[row]), point))
        first = best[np.r_[True, point[best][1:] != point[best][:-1]]]
        own[point[first]] = number[first]
        at = to


_TREES = "ids array<long>, points binary, nodes binary, radius binary"


def _packed(ids: list, points: np.ndarray) -> pa.RecordBatch:
    tree, order = cover_tree(points)
    nodes = np.stack([tree.start, tree.end, tree.first, tree.many])
    columns = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in (tree.points, nodes, tree.radius)]]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "points", "nodes", "radius"])


def _unpacked(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
        start, end, first, many = raw("nodes", np.int64).reshape(4, -1)
        yield batch.column("ids")[i].values, Tree(raw("points", np.int64).reshape(-1, size), start, end, raw("radius", np.float64), first, many)


def points(table: DataFrame, vector: str = "embedding", size: int = 64) -> DataFrame:
    """table's rows whose vector has exactly `size` components, none of them null or non-finite, with point, each component x as floor(64 x) within BOUND."""
    good = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(64 * x.cast("double")), F.lit(BOUND)), F.lit(-BOUND)))
    return table.filter(F.coalesce(good, F.lit(False))).withColumn("point", whole.cast("array<long>"))


def trees(rows: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """A row for each block of at most `block` vectors (id, point) of one task: its cover tree. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held = np.zeros((0, size), np.int64)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held = np.concatenate([held, batch.column(1).flatten().to_numpy().reshape(-1, size)])
            while len(held) >= block:
                yield _packed(ids[:block], held[:block])
                ids, held = ids[block:], held[block:]
        if len(held):
            yield _packed(ids, held)

    return rows.mapInArrow(run, _TREES)


def _sums(forest: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each cluster; a block adds up its own before the shuffle, and k rows of sums reach the driver."""
    tree, size = centre_tree(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, vectors in _unpacked(batch, size):
                own = assigned(vectors, tree)
                n += np.bincount(own, minlength=len(n))
                for j in np.unique(own):
                    total[j] += vectors.points[own == j].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array([list(total[j]) for j in some], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = forest.mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "total")).alias("place", "x"))
    out: dict[int, list[int]] = {}
    for j, place, x in each.groupBy("cluster", "place").agg(F.sum("x")).collect():
        out.setdefault(j, [0] * (size + 1))[place] = x
    return {j: (x[0], x[1:]) for j, x in out.items()}


def lloyd(forest: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds, each component the floor of its cluster's mean; those of empty clusters stay."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for j, (n, total) in _sums(forest, centroids).items():
            centroids[j] = [s // n for s in total]
    return centroids


def settled(forest: DataFrame, centroids: np.ndarray, id: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    tree, size = centre_tree(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in _unpacked(batch, size):
                own = assigned(vectors, tree)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(squared(vectors.points, centroids[own]))], names=[id, "cluster", "distance"])

    return forest.mapInArrow(run, f"`{id}` long, cluster int, distance long")


def cluster(table: DataFrame, k: int, *, rounds: int = 3, id: str = "vec_id", vector: str = "embedding", size: int = 64, order: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of table's vectors, by `rounds` rounds of Lloyd's algorithm on integers.

    Centroids start as the k first vectors by `order` (a hash of the id, unless given), ties by components; of fewer
    vectors each starts one. k and `size` bound all that the driver and the tasks are sent: centroids, counts and sums.
    The cover trees are built once, block by block of each task, written, and read in every round; a node is settled
    whole where bounds allow, so equal vectors, however many, cost one comparison a block.

    Vectors that are null, of another length, or with a null or non-finite component are left out; components are held
    within 2^27, past which a squared distance needs over 64 bits. Null ids are clustered and never start a centroid
    while others are left; repeated rows each count; ties go to the smaller number; other columns are not looked at, and
    an empty table gives no rows.
    """
    rows = points(table.select(F.col(id), F.col(vector)), vector, size)
    by = F.sha2(F.concat(F.lit("1:"), F.col(id).cast("string")), 256) if order is None else order
    first = rows.orderBy(F.asc_nulls_last(by), "point").limit(k).select("point").collect()
    if not first:
        return rows.select(F.col(id).cast("long").alias(id), *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    forest = stage(trees(rows.select(F.col(id).cast("long"), "point"), size, block), "trees")
    centroids = lloyd(forest, np.array([r[0] for r in first], np.int64), rounds)
    found = stage(settled(forest, centroids, id), "clusters")
    discard(forest)
    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(found.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    total = found.agg(F.sum("distance").alias("inertia"))
    facts = F.broadcast(each.crossJoin(F.broadcast(total)))  # k rows, and one
    return found.join(facts, "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_dual_tree_lloyd(spark, sf_dir):
    """16 clusters of all embeddings after three rounds."""
    return cluster(table(spark, sf_dir, "embeddings"), 16)


def _sql() -> str:
    """Every vector against every centroid, round by round."""
    nearest = lambda name, of: f"""{name} AS MATERIALIZED (SELECT rid, vec_id, q, c AS cluster, d AS distance FROM (SELECT v.rid, v.vec_id, v.q, m.c,
  list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM v, {of} m) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""  # noqa: E731
    moved = lambda name, own, of: f"""{name} AS MATERIALIZED (SELECT m.c, coalesce(x.q, m.q) AS q FROM {of} m LEFT JOIN (SELECT cluster, list(g ORDER BY i) AS q FROM
  (SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS g FROM (SELECT cluster, unnest(q)::hugeint AS x, generate_subscripts(q, 1) AS i FROM {own}) GROUP BY cluster, i) GROUP BY cluster) x ON x.cluster = m.c)"""  # noqa: E731
    steps = ["m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, list_transform(q, lambda x: x::hugeint) AS q FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), q) <= 16)"]
    for r in range(3):
        steps += [nearest(f"a{r}", f"m{r}"), moved(f"m{r + 1}", f"a{r}", f"m{r}")]
    steps.append(nearest("a3", "m3"))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS q FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
{", ".join(steps)}
SELECT vec_id, cluster::int AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::bigint AS cluster_inertia, (sum(distance) OVER ())::bigint AS inertia,
  sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM a3 JOIN m3 m ON m.c = a3.cluster
"""


QUERIES = {"op11_dual_tree_lloyd": op11_dual_tree_lloyd}
SQL = {"op11_dual_tree_lloyd": _sql()}
