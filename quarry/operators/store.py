"""A store of chunks and its manifest, changed by commits: a change is written aside, takes effect with one file, and is then moved into place.

chunks/key=K holds the rows of one key; manifest has a row for each key. A commit stages the new keys' rows
and the whole new manifest under _staging/<run>, and takes effect when the file _commits/<number> names that run; of
two writers one gets the number. Moving is done afterwards and can be done again: whoever opens the store finishes the
moves of the last commit. A run that is killed before its commit leaves the store as it was, and one that is killed
after it leaves moves that the next reader makes. Only changed keys' files are touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import truncated
from .storage import folder

KEYS = ("spec_number", "release")
MANIFEST = "version string, sha256 string, file_path string, chunk_count long, ingested_at timestamp"
#: Rows of a key in one file.
ROWS = 100_000


class Conflict(RuntimeError):
    """Another writer's commit came first."""


class Store:
    """The store at a path; opening it finishes a commit that was broken off."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = KEYS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)
        done = self.commits()
        if done and not self._at(f"_commits/{done[-1]:010d}.moved").exists():
            self._move(done[-1])

    def _at(self, place: str):
        return folder(self.spark, f"{self.path}/{place}")

    def commits(self) -> list[int]:
        return [int(n) for n in self._at("_commits").names() if n.isdigit()]

    def key(self) -> Column:
        """A key's folder; what no file name may hold is escaped by Spark."""
        return F.concat_ws("~", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys], F.lit(""))

    def chunks(self) -> DataFrame | None:
        """All rows; None before the first commit with any."""
        if not self._at("chunks").names():
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/chunks").drop("key")

    def manifest(self) -> DataFrame:
        if not self._at("manifest").names():
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in self.keys) + f", {MANIFEST}")
        return self.spark.read.parquet(f"{self.path}/manifest")

    def commit(self, rows: DataFrame | None = None, marks: DataFrame | None = None, gone: DataFrame | None = None, *, clear: bool = False) -> int:
        """Put the rows of new and replaced keys, mark them in the manifest (keys, version, sha256, file_path), and drop the keys of gone; one step.

        Rows of a key replace all that it had. With clear, what the store holds is dropped first. The manifest counts
        each marked key's rows.
        """
        run, last = uuid.uuid4().hex, (self.commits() or [0])[-1]
        stage = f"_staging/{run}"
        old = self.manifest()
        if rows is not None:
            cut = truncated(rows).withColumn("key", self.key())
            cut.repartition("key", F.floor(F.coalesce(F.col("chunk_index"), F.lit(0)) / ROWS)).write.partitionBy("key").parquet(f"{self.path}/{stage}/chunks")
        if clear:
            gone = old.select(*self.keys)
        if gone is not None:
            old = old.join(gone.select(*self.keys), list(self.keys), "left_anti")
            left = gone.select(*self.keys).distinct()
            left = left if rows is None else left.join(rows.select(*self.keys).distinct(), list(self.keys), "left_anti")  # a key that comes anew is moved over
            left.select(self.key().alias("key")).write.parquet(f"{self.path}/{stage}/gone")
        if marks is not None:
            fresh = marks.select(*self.keys, "version", "sha256", "file_path")
            fresh = fresh.withColumn("chunk_count", F.lit(0).cast("long")) if rows is None else fresh.join(rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("chunk_count")), list(self.keys), "left").fillna(0, ["chunk_count"])
            old = old.join(marks.select(*self.keys), list(self.keys), "left_anti").unionByName(fresh.withColumn("ingested_at", F.current_timestamp()))
        old.write.parquet(f"{self.path}/{stage}/manifest")
        number = last + 1
        if not self._at(f"_commits/{number:010d}").claim(run):
            self._at(stage).delete()
            raise Conflict(f"commit {number} of {self.path} was made by another writer")
        self._move(number)
        return number

    def _move(self, number: int) -> None:
        """Move what a commit staged into place. Every step can be done again: what is staged still is not yet moved, and what is gone is no staged key."""
        stage = f"_staging/{self.spark.read.text(f'{self.path}/_commits/{number:010d}', wholetext=True).first()[0]}"
        if self._at(f"{stage}/gone").exists():
            for row in self.spark.read.parquet(f"{self.path}/{stage}/gone").toLocalIterator():
                self._at(f"chunks/key={_escaped(self.spark, row['key'])}").delete()
        for name in self._at(f"{stage}/chunks").names():
            if name.startswith("key="):
                self._at(f"chunks/{name}").delete()
                self._at(f"{stage}/chunks/{name}").rename(f"{self.path}/chunks/{name}")
        if self._at(f"{stage}/manifest").exists():
            self._at("manifest").delete()
            self._at(f"{stage}/manifest").rename(f"{self.path}/manifest")
        self._at(f"_commits/{number:010d}.moved").claim("")
        self._at(stage).delete()

    def remove(self, condition: Column) -> int | None:
        """Drop the keys whose manifest row meets a condition, rows and all; None where there is none."""
        gone = self.manifest().filter(F.coalesce(condition, F.lit(False))).select(*self.keys)
        return None if gone.isEmpty() else self.commit(gone=gone)

    def clear(self) -> int:
        return self.commit(clear=True)

    def vacuum(self) -> int:
        """Delete what runs staged that never were committed, and return how many; no other writer may be at work."""
        left = self._at("_staging").names()
        for run in left:
            self._at(f"_staging/{run}").delete()
        return len(left)


def _escaped(spark: SparkSession, key: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)
