"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is a linear function of text features. It is learned from preference pairs, a document
labelled good over one labelled bad, by logistic loss on the difference of their features; a threshold at a
quantile of the training scores then splits good from bad. Features are DataFrame expressions, so scoring
stays inside the scan's stage; only the fit, on a bounded sample of labelled rows, runs on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, table
from .quality_rules import SYMBOLS, line_fails, repeated_words, words_of

#: Labelled rows that a model is fitted on at most, those whose id has the smallest md5; and preference pairs.
MOST_ROWS, MOST_PAIRS = 20_000, 200_000

FEATURES = ("short", "symbols", "capitals", "shouts", "bars", "digits", "distinct", "stutter", "repeated", "dup_lines", "bad_lines", "word_length", "log_words", "unended")


def features(text: Column) -> Column:
    """A struct of FEATURES, doubles from 0 to about 1; null and empty texts have those of no words."""
    body = F.coalesce(text, F.lit(""))
    one = F.lit(1)

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), one)
        size = F.greatest(F.length(body), one)
        lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
        left = lambda s: F.length(body) - F.length(F.translate(body, s, ""))
        most = lambda x, k: F.least(F.lit(1.0), F.lit(float(k)) * x)
        same = F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
        bad = let(lines, lambda x: F.size(F.filter(x, line_fails)) / F.greatest(F.size(x), one))
        dups = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), one))
        values = {
            "short": F.greatest(F.lit(0.0), 1 - F.size(w) / 20.0), "symbols": most(left(SYMBOLS) / n, 5), "capitals": most(F.regexp_count(body, F.lit("[A-Z]{2,}")) / n, 2),
            "shouts": most(F.regexp_count(body, F.lit("[!?]{2,}")) / n, 4), "bars": most(left("|") / n, 4), "digits": most(left("0123456789") / size, 5),
            "distinct": F.size(F.array_distinct(w)) / n, "stutter": most(same / n, 2), "repeated": most(repeated_words(F.transform(w, lambda x: F.xxhash64(x))) / n, 1.5),
            "dup_lines": dups, "bad_lines": bad, "word_length": most(size / n, 0.05), "log_words": F.log1p(F.size(w)) / 12, "unended": F.when(F.rlike(body, F.lit(r"[.!?][\"')\]]*\s*$")), 0.0).otherwise(1.0),
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])

    return let(words_of(body), of)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float
    scale: float

    def score(self, x: Column) -> Column:
        """0 to 1, 0.5 at the threshold; higher where label 1 is likelier."""
        total = sum((F.lit(w) * x[k] for k, w in zip(FEATURES, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-(total - self.threshold) / self.scale))


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = MOST_PAIRS, ridge: float = 1e-3, rounds: int = 30, seed: int = 7) -> Model:
    """Newton steps on the mean pairwise loss over `pairs` pairs, which are drawn from all good-bad pairs with a fixed seed.

    Rows are taken in their order, so equal rows in equal order give equal models; repeated rows count as often as
    they come, ties of features have no preference. Without both labels nothing is learned, and every score is 0.5.
    """
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model((0.0,) * x.shape[1], 0.0, 1.0)
    draw = np.random.default_rng(seed)
    diff = good[draw.integers(len(good), size=pairs)] - bad[draw.integers(len(bad), size=pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), diff.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    scores = x @ w
    return Model(tuple(map(float, w)), float(np.quantile(scores, (y == 0).mean())), float(scores.std() or 1.0))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most_rows: int = MOST_ROWS, pairs: int = MOST_PAIRS) -> Model:
    """A model from docs (doc_id, text) that labels (doc_id, label 0 or 1) cover.

    It is fitted on a bounded sample: the most_rows labelled rows whose id has the smallest md5, and `pairs`
    preference pairs of them. Rows are ordered by their id's md5, label and text, so the model depends neither on
    partitions nor on task order. Null ids and other labels teach nothing; null texts are empty; rows that repeat an
    id each take its label, and an id with both labels counts for both; empty tables teach nothing.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"), F.md5(F.col("doc_id").cast("string")).alias("_key")).orderBy("_key", "_label").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_key", "_label", F.md5(F.coalesce("text", F.lit(""))).alias("_text"), features(F.col("text")).alias("f"))
    found = rows.orderBy("_key", "_label", "_text").limit(most_rows).select(*[F.col(f"f.{k}") for k in FEATURES], "_label").toPandas()
    data = found.to_numpy(dtype=float)
    return fit(data[:, :-1], data[:, -1], pairs=pairs)


def rank(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs' columns with score and predicted (1 if score >= 0.5).

    Null and empty texts have the score of no words; very long texts are scored whole; repeated rows score
    alike; columns of docs that are named like added ones are replaced.
    """
    return docs.withColumn("score", model.score(features(F.col(text)))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_bradley_terry(spark, sf_dir):
    """Every document's score; the model has seen only labelled rows that are not held out.

    A null or empty text has the score of no words, a null id is not held out, repeated rows each have their
    score, and an empty table of documents gives no rows.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return rank(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op1_bradley_terry": op1_bradley_terry}
