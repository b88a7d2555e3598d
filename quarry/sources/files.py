"""File sources: Markdown documents by folder, small JSON state and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_markdown, figure_id, header, path_facts
from quarry.operators.ranking import positions
from quarry.operators.storage import folder as shared_folder
from quarry.sources.chunks import CHUNK_SCHEMA

MANIFEST = "spec_number string, release string, latest_version string, file_path string, sha256 string, chunk_count int, ingested_at string"
SAMPLES = "question string, expected_specs array<string>, expected_sections array<string>, difficulty string, multi_hop boolean, expected map<string,array<string>>"


def empty_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path of the files of no bytes under folder, which Spark's readers pass over."""
    names = shared_folder(spark, folder).empty(pattern)
    return spark.createDataFrame([(n,) for n in names], "path string")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.md under folder: path, cleaned text, and the facts of its path, else of its header."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    rows = rows.unionByName(empty_files(spark, folder, "*.md").withColumn("raw", F.lit("")))
    rows = rows.withColumns({"p": path_facts(F.col("path")), "h": header(F.col("raw"))})
    either = lambda n: F.when(F.col(f"p.{n}") != "", F.col(f"p.{n}")).otherwise(F.col(f"h.{n}"))
    kind = F.when(F.col("p.doc_type") != "", F.col("p.doc_type")).when(F.rlike("raw", F.lit(r"(?i)O-RAN\s+ALLIANCE|O-RAN\s+Working\s+Group")), "oran").otherwise("3gpp")
    return rows.select("path", clean_markdown(F.col("raw")).alias("text"), *[either(n).alias(n) for n in ("spec_number", "release", "version")], kind.alias("doc_type"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines; broken lines are left out."""
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).filter("spec_number is not null")


def eval_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).option("multiLine", "true").json(path)


def log_tail(spark: SparkSession, path: str, *, level: str = "", lines: int = 100) -> DataFrame:
    """The last lines of a log (a tail has a limit) that contain a level."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("place", "line"))
    return rows.filter(F.col("line").contains(level) & (F.col("line") != "")).orderBy(F.desc("place")).limit(lines)


def documents(spark: SparkSession, folder: str, pattern: str = "*.docx", *, series: tuple[int, ...] | None = None) -> DataFrame:
    """path, length and hash of files under folder: of the wanted series' folders and the open-interface ones, without covers."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length", "content")
    none = empty_files(spark, folder, pattern).select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    rows = rows.unionByName(none)
    name = F.lower(F.substring_index("path", "/", -1))
    wanted = F.rlike("path", F.lit(r"(?i)O-RAN")) | F.regexp_extract("path", r"/(\d{2})_series/", 1).try_cast("int").isin(*series) if series else F.lit(True)
    return rows.filter(F.coalesce(wanted, F.lit(False)) & ~name.startswith("cover") & ~name.startswith("~$"))


def converted(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """path, raw Markdown and error of binary documents, by a converter that runs on the executors; a failure is a row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append((path, convert(bytes(content)), None))
                except Exception as e:  # noqa: BLE001  what a converter may raise is not known
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "raw", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, raw string, error string")


def dump_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks as JSON lines, in their own columns, without vectors."""
    kept = [c for c in CHUNK_SCHEMA.names if c in chunks.columns and c != "dense_vector"]
    chunks.select(*kept).write.mode("overwrite").option("compression", "gzip").json(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a dump; columns that it lacks are null, and lines that are no chunks are left out."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def unclassified(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, length and time of the files of a folder, by lower-cased name; contents are not read."""
    rows = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), "path", "length", "modificationTime")
    return rows.orderBy(F.lower("name"), "name")


def image_map(docs: DataFrame) -> DataFrame:
    """(spec_number, figure_id, path) of the images of Markdown documents (spec_number, text); the first of a figure counts."""
    pattern = F.lit(r"!\[([^\]]+)\]\(([^)]+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("title"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("path"))
    rows = docs.select("spec_number", F.posexplode(pairs).alias("place", "p")).select("spec_number", "place", figure_id(F.col("p.title")).alias("figure_id"), "p.path")
    return positions(rows, F.asc("place"), F.asc("path"), by=["spec_number", "figure_id"], pos="_n").filter("_n = 1").select("spec_number", "figure_id", "path")
