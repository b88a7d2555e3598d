"""The router's network against a forward pass of one vector at a time."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import routing
from quarry.sources.chunks import table

from .conftest import DATA


def by_hand(net, v):
    """One vector, component by component."""

    def dense(x, layer):
        return [sum(w * y for w, y in zip(ws, x, strict=True)) + b for ws, b in zip(layer[0].tolist(), layer[1].tolist(), strict=True)]

    def tower(t, x):
        for layer in t.layers:
            x = [max(0.0, y) for y in dense(x, layer)]
        n = t.norm
        return [t.share * ((y - m) / math.sqrt(var + 1e-5) * g + s) for y, m, var, g, s in zip(x, n.mean, n.variance, n.scale, n.shift, strict=True)]

    size = math.sqrt(sum(x * x for x in v))
    alike = [0.0] * len(net.labels) if net.anchors is None else [sum(a * b for a, b in zip(v, c, strict=True)) / size / math.sqrt(sum(b * b for b in c)) for c in net.anchors.tolist()]
    x = [a + b for a, b in zip(tower(net.text, v), tower(net.likeness, alike), strict=True)]
    for layer in net.head:
        x = dense([y if y > 0 else 0.01 * y for y in x], layer)
    return x


def shaken(net, rng):
    """The same network with every array that a trained one would have."""
    tower = lambda t, share: routing.Tower(t.layers, routing.Norm(*[rng.normal(1 if i in (1, 2) else 0, 0.1, len(t.norm.mean)) for i in range(4)]), share)
    last = (rng.normal(0, 0.1, net.head[-1][0].shape), rng.normal(0, 0.1, len(net.labels)))
    return routing.Network(tower(net.text, 0.7), tower(net.likeness, 1.3), (*net.head[:-1], last), net.labels, net.anchors)


def test_forward_pass(spark, tmp_path):
    rng = np.random.default_rng(3)
    for anchors in (None, rng.normal(size=(18, 40))):
        net = shaken(routing.drawn(40, anchors=anchors), rng)
        routing.write(spark, net, str(tmp_path / "net"))
        net = routing.read(spark, str(tmp_path / "net"))
        vectors = rng.normal(size=(30, 40))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, vector array<double>").repartition(3)
        found = {}
        for r in routing.route(rows, net).orderBy("query_id", "pos").collect():
            found.setdefault(r.query_id, []).append((r.label, r.score))
        assert net.labels == routing.SERIES and len(found) == 30
        for i, v in enumerate(vectors.tolist()):
            scores = by_hand(net, v)
            want = sorted(range(18), key=lambda j: (-round(scores[j], 6), j))[:5]
            assert [x for x, _ in found[i]] == [21 + j for j in want]
            assert np.allclose([s for _, s in found[i]], [scores[j] for j in want], atol=2e-6)


def test_sizes_of_the_full_network():
    net = routing.drawn(1024)
    assert [w.shape for w, _ in net.text.layers] == [(768, 1024), (512, 768), (256, 512)]
    assert [w.shape for w, _ in net.likeness.layers] == [(128, 18), (256, 128)] and [w.shape for w, _ in net.head] == [(128, 256), (18, 128)]


def test_fitted_on_groups_and_held_out(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.7) for x in centres[i % 6]], 21 + i % 6) for i in range(900)]
    rows += [(1000, None, 21), (1001, [1.0, None], 21), (1002, [float("nan")] * 16, 22), (1003, [0.5] * 16, None), (1004, [0.5] * 3, 21)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    net = routing.fit(df.filter("id < 600 or id >= 1000"))
    found = routing.route(df.filter("id >= 600").select(F.col("id").alias("query_id"), "vector"), net, 1).join(df.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id").collect()
    assert {r.query_id for r in found} == set(range(600, 900)) | {1003}  # odd vectors have no rows, a vector without a label is routed
    assert sum(r.label == r.own for r in found) / 300 > 0.95
    again = routing.fit(df.filter("id < 600 or id >= 1000").repartition(7))
    assert np.array_equal(net.head[-1][0], again.head[-1][0])


def test_every_given_vector_is_routed(spark):
    from quarry.plans.corpus import QUERIES

    found = QUERIES["route_network"](spark, DATA)
    n = table(spark, DATA, "embeddings").count()
    assert found.select("query_id").distinct().count() == n
    assert {tuple(r) for r in found.groupBy("query_id").agg(F.count(F.lit(1)), F.max("pos"), F.min("pos")).drop("query_id").collect()} == {(5, 5, 1)}
