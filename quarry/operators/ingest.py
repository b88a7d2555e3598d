"""Manifests, change detection, upserts and caches, as joins and latest-wins windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import once
from quarry.functions.arrow import CUTS
from quarry.functions.text import version_key
from quarry.sources.chunks import BYTE_LIMITS, CHAR_LIMITS

from .ranking import positions


def manifest_diff(manifest: DataFrame, files: DataFrame, keys: Sequence[str] = ("spec_number", "release")) -> DataFrame:
    """(keys, status) of a manifest (keys, version, sha256) against files (keys, version, sha256).

    new, deleted, replaced (a higher version), skipped (same content) or skipped_changed (new content, but no
    higher version).
    """
    old = manifest.select(*keys, F.col("version").alias("old_version"), F.col("sha256").alias("old_sha"), F.lit(True).alias("_old"))
    new = files.select(*keys, "version", "sha256", F.lit(True).alias("_new"))
    higher = version_key(F.col("version")) > version_key(F.col("old_version"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("sha256") == F.col("old_sha"), "skipped").when(higher, "replaced").otherwise("skipped_changed")
    return old.join(new, list(keys), "full").select(*keys, status.alias("status"))


def orphans(manifest: DataFrame, current: DataFrame, keys: Sequence[str] = ("spec_number", "release")) -> DataFrame:
    return manifest.join(current, list(keys), "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], latest: str) -> DataFrame:
    """The latest row of each key; a change wins over a stored row of the same time."""
    both = table.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)))
    return positions(both, F.desc(latest), F.desc("_late"), by=keys, pos="_n").filter("_n = 1").drop("_n", "_late")


def lookup(asked: DataFrame, cache: DataFrame, key: str = "text_hash") -> DataFrame:
    """asked with the cached value and whether it was a hit, in its own order."""
    return asked.join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """What stays: rows for which the condition is not true."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def cut_bytes(text: Column, most: int, mark: str = "…") -> Column:
    """text within so many UTF-8 bytes: cut before the last of the first kind of mark that comes late enough (CUTS), else at a character, and marked."""
    room = most - len(mark.encode())

    def piece(raw: Column) -> Column:
        """The whole characters among the first bytes: back to where the next byte starts a character."""
        starts = lambda n: F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80
        return F.substring(raw, F.lit(1), F.coalesce(*[F.when(starts(n), F.lit(n)) for n in range(room, max(room - 4, -1), -1)], F.lit(0))).cast("string")

    def ended(p: Column) -> Column:
        last = lambda m: F.length(p) - F.locate(m[::-1], F.reverse(p)) - len(m) + 1
        places = [F.when(p.contains(m) & (last(m) >= F.floor(F.length(p) * share)), F.struct(F.lit(-i).alias("rank"), last(m).alias("at"))) for i, (m, share) in enumerate(CUTS)]
        best = F.array_max(F.array(*places))
        return F.concat(F.when(best.isNull(), p).otherwise(F.regexp_replace(F.substring(p, F.lit(1), best["at"]), r"(?U)\s+$", "")), F.lit(mark))

    return F.when(F.octet_length(text) <= most, text).otherwise(once(piece(text.cast("binary")), ended))


def truncated(chunks: DataFrame) -> DataFrame:
    """Columns cut to the store's limits; byte limits by whole characters."""
    cuts = {c: F.substring(c, 1, n) for c, n in CHAR_LIMITS.items() if c in chunks.columns}
    cuts |= {c: cut_bytes(F.col(c), n) for c, n in BYTE_LIMITS.items() if c in chunks.columns}
    return chunks.withColumns(cuts)


def save(chunks: DataFrame, path: str) -> None:
    """Write chunks, cut to their limits, by series."""
    truncated(chunks).write.mode("append").partitionBy("series").parquet(path)


def rebuild(chunks: DataFrame, path: str) -> None:
    """Replace the whole store by chunks, cut to their limits, by series."""
    truncated(chunks).write.mode("overwrite").partitionBy("series").parquet(path)


def copy_with_vectors(chunks: DataFrame, path: str, text: Column, encode: Callable[[Column], Column]) -> None:
    """Write a copy of chunks, ids and all, whose dense_vector is encode(text)."""
    chunks.withColumn("dense_vector", encode(text)).write.mode("overwrite").parquet(path)


def unfinished(chunks: DataFrame, stored: DataFrame, key: Sequence[str] = ("doc_id", "spec_number", "chunk_index")) -> DataFrame:
    """What a resumed job still has to write."""
    return chunks.join(stored.select(*key), list(key), "left_anti")


def apply_changes(stored: DataFrame, incoming: DataFrame, status: DataFrame, keys: Sequence[str] = ("spec_number", "release")) -> DataFrame:
    """The store after a run: rows of deleted and replaced keys go, and new and replaced keys' rows come.

    The manifest is to be marked only after the result is written.
    """
    gone = status.filter(F.col("status").isin("deleted", "replaced")).select(*keys)
    come = status.filter(F.col("status").isin("new", "replaced")).select(*keys)
    return stored.join(gone, list(keys), "left_anti").unionByName(incoming.join(come, list(keys), "left_semi"), allowMissingColumns=True)


def supplement(official: DataFrame, web: DataFrame, most: int = 5) -> DataFrame:
    """Online results: the official source's first, then the web's, at most `most` (a prompt's limit)."""
    both = official.withColumn("_s", F.lit(0)).unionByName(web.withColumn("_s", F.lit(1)))
    return both.orderBy("_s", "rank").limit(most).drop("_s")
