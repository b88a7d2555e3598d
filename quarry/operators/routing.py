"""Routing questions to series by a network of two towers, applied to batches of vectors as matrix products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The series that are told apart, the width of each layer, and constants of the layers.
SERIES = tuple(range(21, 39))
TEXT_WIDTHS, ANCHOR_WIDTHS, HEAD_WIDTHS = (768, 512, 256), (128, 256), (128,)
LEAK, EPSILON = 0.01, 1e-5

Dense = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Norm:
    """Values scaled by the mean and variance of those the tower was trained on."""

    mean: np.ndarray
    variance: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / np.sqrt(self.variance + EPSILON) * self.scale + self.shift


@dataclass(frozen=True)
class Tower:
    """Layers (weights of outputs by inputs, biases) that each cut off below zero, then a norm; `share` is its weight in the sum."""

    layers: tuple[Dense, ...]
    norm: Norm
    share: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for weights, bias in self.layers:
            x = np.maximum(x @ weights.T + bias, 0)
        return self.share * self.norm(x)


@dataclass(frozen=True)
class Network:
    """A tower over a question's vector and one over its likeness to each label's anchor; their sum goes through a head of leaky layers.

    anchors holds a vector for each label, or is empty: then the second tower sees zeros. labels name the outputs.
    """

    text: Tower
    likeness: Tower
    head: tuple[Dense, ...]
    labels: tuple[int, ...] = SERIES
    anchors: np.ndarray | None = None

    def hidden(self, vectors: np.ndarray) -> np.ndarray:
        """What the last layer sees."""
        likeness = np.zeros((len(vectors), len(self.labels))) if self.anchors is None else _unit(vectors) @ _unit(self.anchors).T
        x = self.text(vectors) + self.likeness(likeness)
        for weights, bias in self.head[:-1]:
            x = _leaky(x) @ weights.T + bias
        return _leaky(x)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        weights, bias = self.head[-1]
        return self.hidden(vectors) @ weights.T + bias


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, LEAK * x)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def drawn(size: int, labels: Sequence[int] = SERIES, *, seed: int = 7, anchors: np.ndarray | None = None) -> Network:
    """A network for vectors of `size` components with drawn weights, the last layer zero."""
    rng = np.random.default_rng(seed)

    def layers(widths: Sequence[int], n: int) -> tuple[Dense, ...]:
        out = []
        for width in widths:
            out.append((rng.normal(0, np.sqrt(2 / n), (width, n)), rng.normal(0, 0.1, width)))
            n = width
        return tuple(out)

    def tower(widths: Sequence[int], n: int) -> Tower:
        width = widths[-1]
        return Tower(layers(widths, n), Norm(np.zeros(width), np.ones(width), np.ones(width), np.zeros(width)), 1.0)

    text, likeness = tower(TEXT_WIDTHS, size), tower(ANCHOR_WIDTHS, len(labels))
    last = (np.zeros((len(labels), HEAD_WIDTHS[-1])), np.zeros(len(labels)))
    return Network(text, likeness, (*layers(HEAD_WIDTHS, TEXT_WIDTHS[-1]), last), tuple(labels), anchors)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows whose vector has `size` finite components."""
    rows = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == size and None not in v]
    places, vectors = np.array([i for i, _ in rows], int), np.array([v for _, v in rows], np.float64).reshape(len(rows), size)
    good = np.isfinite(vectors).all(axis=1)
    return places[good], vectors[good]


def fit(rows: DataFrame, *, label: str = "label", most: int = 20_000, ridge: float = 1.0, seed: int = 7) -> Network:
    """A network whose last layer is fitted on rows (id, vector, label), by ridge regression on one output a label.

    The driver holds at most `most` rows: those of the smallest hash of the id. The layers below are drawn, anchors are the
    labels' mean vectors, and the norms are those of the rows. Labels are integers, those that the rows have, in order. Rows
    with null, non-finite or odd-sized vectors or null labels are left out; no rows are an error.
    """
    good = rows.filter(F.col(label).isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sample = good.select("vector", F.col(label).cast("int").alias("label"), F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(most).select("vector", "label").toArrow()
    if not sample.num_rows:
        raise ValueError("no rows to fit")
    lengths = [len(v) for v in sample["vector"].to_pylist()]
    size = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    places, vectors = _matrix(sample["vector"].combine_chunks(), size)
    owns = sample["label"].to_numpy()[places]
    labels = sorted(set(owns.tolist()))
    one = owns[:, None] == np.array(labels)[None, :]
    net = drawn(size, labels, seed=seed, anchors=(one.T @ vectors) / one.sum(axis=0)[:, None])
    net = Network(_normed(net.text, vectors), _normed(net.likeness, _unit(vectors) @ _unit(net.anchors).T), net.head, net.labels, net.anchors)
    seen = net.hidden(vectors)
    middle, wanted = seen.mean(axis=0), one - one.mean(axis=0)
    weights = np.linalg.solve((seen - middle).T @ (seen - middle) + ridge * np.eye(seen.shape[1]), (seen - middle).T @ wanted).T
    return Network(net.text, net.likeness, (*net.head[:-1], (weights, one.mean(axis=0) - weights @ middle)), net.labels, net.anchors)


def _normed(tower: Tower, inputs: np.ndarray) -> Tower:
    width = len(tower.norm.mean)
    plain = Tower(tower.layers, Norm(np.zeros(width), np.full(width, 1 - EPSILON), np.ones(width), np.zeros(width)), 1.0)(inputs)
    return Tower(tower.layers, Norm(plain.mean(axis=0), plain.var(axis=0), np.ones(width), np.zeros(width)), tower.share)


def route(questions: DataFrame, net: Network, k: int = 5) -> DataFrame:
    """(query_id, label, score, pos): the k likeliest labels of each of questions (query_id, vector), equal scores by label order.

    Each Arrow batch is one block of matrix products; nothing is shuffled. Questions whose vector is null, holds a null
    or a non-finite value, or has another size than the network's have no rows.
    """
    size, kind = net.text.layers[0][0].shape[1], questions.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = _matrix(batch.column("vector"), size)
            if len(places):
                scores = np.round(net.scores(vectors), 6)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                ids = batch.column("query_id").take(pa.array(np.repeat(places, best.shape[1])))
                pos = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(places))
                named = np.array(net.labels, np.int32)[best.ravel()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(named), pa.array(np.take_along_axis(scores, best, axis=1).ravel()), pa.array(pos)], names=["query_id", "label", "score", "pos"])

    return questions.select("query_id", "vector").mapInArrow(run, f"query_id {kind}, label int, score double, pos int")


def _parts(net: Network) -> dict[str, np.ndarray]:
    found = {"labels": np.array(net.labels, float)}
    if net.anchors is not None:
        found["anchors"] = net.anchors
    for name, tower in (("text", net.text), ("likeness", net.likeness)):
        found |= {f"{name}.share": np.array([tower.share]), **{f"{name}.norm.{f}": getattr(tower.norm, f) for f in ("mean", "variance", "scale", "shift")}}
    for name, layers in (("text", net.text.layers), ("likeness", net.likeness.layers), ("head", net.head)):
        for i, (weights, bias) in enumerate(layers):
            found |= {f"{name}.{i}.weights": weights, f"{name}.{i}.bias": bias}
    return found


def write(spark: SparkSession, net: Network, path: str) -> None:
    """Write a network as a table of its arrays: name, shape and values."""
    rows = [(name, list(x.shape), x.ravel().tolist()) for name, x in _parts(net).items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> Network:
    """A written network; its arrays are of a model's size, not of the data's."""
    found = {r.name: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}

    def layers(name: str) -> tuple[Dense, ...]:
        n = sum(x.startswith(f"{name}.") and x.endswith(".bias") for x in found)
        return tuple((found[f"{name}.{i}.weights"], found[f"{name}.{i}.bias"]) for i in range(n))

    def tower(name: str) -> Tower:
        return Tower(layers(name), Norm(*[found[f"{name}.norm.{f}"] for f in ("mean", "variance", "scale", "shift")]), float(found[f"{name}.share"][0]))

    return Network(tower("text"), tower("likeness"), layers("head"), tuple(int(x) for x in found["labels"]), found.get("anchors"))
