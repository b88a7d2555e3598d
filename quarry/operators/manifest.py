"""Changes of a manifest (spec_number, release, version, sha256, file_path) of what a store holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import version_key

KEYS = ("spec_number", "release")


def key(spec: Column | str = "spec_number", release: Column | str = "release") -> Column:
    return F.concat(spec, F.lit("|"), release)


def checks(manifest: DataFrame, offered: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """offered (keys, version, sha256) with whether its key is known, its content the same, and its version higher; all false for a new key."""
    old = manifest.select(*keys, F.col("version").alias("_version"), F.col("sha256").alias("_sha"), F.lit(True).alias("_known"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = offered.join(old, list(keys), "left")
    higher = F.col("_known") & (version_key(F.col("version")) > version_key(F.col("_version")))
    return rows.select(*offered.columns, sure(F.col("_known")).alias("known"), sure(F.col("_sha") == F.col("sha256")).alias("same_hash"), sure(higher).alias("should_replace"))


def remove(manifest: DataFrame, gone: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The manifest without the keys of gone; keys that it does not have change nothing."""
    return manifest.join(gone.select(*keys), list(keys), "left_anti")


def clear(manifest: DataFrame) -> DataFrame:
    """A manifest of no rows, as before a full rebuild."""
    return manifest.limit(0)


def records_of(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, keys): for each of documents (doc_id), the first record by key whose file_path contains the id; null where there is none.

    Each document is looked for in the manifest as it is given. Paths meet ids by equality, over their parts of the
    lengths that ids have, a few numbers; so a manifest of any size meets any number of documents in one join. Empty
    and null ids are in no path.
    """
    asked = documents.select("doc_id").distinct()
    named = asked.filter(F.length("doc_id") > 0)
    lengths = [r.n for r in named.select(F.length("doc_id").alias("n")).distinct().orderBy("n").collect()]  # an id's length is bounded by the store

    def spans(n: int) -> Column:
        starts = F.when(F.length("file_path") >= n, F.sequence(F.lit(1), F.length("file_path") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.col("file_path"), i, F.lit(n)))

    every = F.flatten(F.array(*map(spans, lengths))) if lengths else F.array().cast("array<string>")
    parts = manifest.select(*KEYS, F.explode(F.array_distinct(every)).alias("doc_id"))
    first = parts.join(named, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*KEYS), F.struct(key(), *KEYS)).alias("r"))
    return asked.join(first, "doc_id", "left").select("doc_id", "r.*")


def delete_documents(chunks: DataFrame, manifest: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks that stay, manifest that stays, (doc_id, deleted_chunks, deleted_key) for each of documents)."""
    found = records_of(manifest, documents)
    counts = chunks.join(found.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    told = found.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("deleted_chunks"), key().alias("deleted_key"))
    return chunks.join(found.select("doc_id"), "doc_id", "left_anti"), remove(manifest, found.filter("spec_number is not null")), told
