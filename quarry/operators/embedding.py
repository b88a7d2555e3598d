"""Embedding with a cache, and routing by nearest centroid. Encoders are callables of a list of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions

Encoder = Callable[[Sequence[str]], list[list[float]]]


def embed(texts: DataFrame, encoder: Encoder, *, batch: int = 32) -> DataFrame:
    """(text_hash, vector) of texts (text_hash, text); a task loads the encoder once and sends it batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts_, out = part["text"].tolist(), []
            for at in range(0, len(texts_), batch):
                out += encoder(texts_[at : at + batch])
            yield pd.DataFrame({"text_hash": part["text_hash"], "vector": out})

    return texts.select("text_hash", "text").mapInPandas(run, "text_hash string, vector array<double>")


def embed_with_cache(chunks: DataFrame, cache: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """chunks (text, ...) with their vectors, and the cache (text_hash, vector) with the new ones; each text is encoded once."""
    keyed = chunks.withColumn("text_hash", F.sha2("text", 256))
    missing = keyed.select("text_hash", "text").dropDuplicates(["text_hash"]).join(cache.select("text_hash"), "text_hash", "left_anti")
    full = cache.select("text_hash", "vector").unionByName(embed(missing, encoder))
    return keyed.join(full, "text_hash", "left").drop("text_hash"), full


def normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, centre): the mean vector of each label, place by place."""
    places = vectors.select(label, F.posexplode("vector").alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p.x).alias("centre"))


def route(queries: DataFrame, centres: DataFrame, k: int = 5, *, most: int = 1000, label: str = "label") -> DataFrame:
    """The k labels whose centres are nearest to each query (query_id, vector) by cosine; labels are few, and checked to be."""
    if centres.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels")
    dot = F.aggregate(F.zip_with(normalised(F.transform("vector", lambda x: x.cast("double"))), normalised(F.col("centre")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = queries.join(F.broadcast(centres)).select("query_id", label, F.round(dot, 6).alias("score"))  # a row for each query and label
    return positions(scored, F.desc("score"), F.asc(label)).filter(F.col("pos") <= k)
