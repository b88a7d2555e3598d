"""The ingestion job: from folders of Markdown, Word documents and archives to a store of chunks and its manifest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunking, embedding, ingest
from quarry.operators.embedding import Encoder
from quarry.operators.storage import discard, stage
from quarry.operators.storage import folder as storage_folder
from quarry.operators.store import Store
from quarry.sources import files, office

KEYS = ("spec_number", "release")


SOURCES = {"markdown": files.markdown, "docx": office.docx, "zip": office.zipped}


def read(spark: SparkSession, folder: str, sources: Sequence[str] = ("markdown",)) -> DataFrame:
    """Documents under folder with their facts, the hash of each text, and the error of those that can't be read."""
    parts = [SOURCES[s](spark, folder) for s in sources]
    parts = [p if "error" in p.columns else p.withColumn("error", F.lit(None).cast("string")) for p in parts]
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("path", "text", *KEYS, "version", "doc_type", "error") for p in parts])
    return rows.withColumn("sha256", F.sha2("text", 256))


def chunked(docs: DataFrame, limits: chunking.Limits = chunking.Limits(), mode: str = "dynamic") -> DataFrame:
    """Chunks of documents with their facts and classes: extract, split, classify, version."""
    parts = chunking.chunk(docs.select(F.col("path").alias("doc_id"), "text"), limits, mode)
    facts = docs.select(F.col("path").alias("doc_id"), "spec_number", "release", "version", "doc_type")
    series = F.coalesce(F.split("spec_number", r"\.")[0].try_cast("long"), F.lit(0).cast("long"))
    rows = parts.join(facts, "doc_id").withColumn("series", series)
    return rows.withColumns({"content_type": tx.content_type(F.col("text"), F.col("section_title")), "spec_role": tx.spec_role(F.col("spec_number")), "topic_domain": tx.topic_domain(F.col("spec_number")), "id": F.xxhash64("doc_id", "chunk_index")})


def run(
    spark: SparkSession, folder: str, store: str, *, sources: Sequence[str] = ("markdown",), encode: Callable[[Column], Column] | None = None,
    encoder: Encoder | None = None, cache: str | None = None, rebuild: bool = False, mode: str = "dynamic", skip: Sequence[str] = (), interim: str | None = None,
) -> DataFrame:
    """Bring a store up to a folder's state by one commit, and return what became of each document: keys, status, path, chunks and error.

    new and replaced (a higher version) documents are split and embedded; skipped and skipped_changed ones are left as
    they are, deleted keys go, and of documents that share a key the newest counts and the others are superseded.
    Documents whose specification can't be read, that can't be opened or that give no chunks are failed, each with its
    own row; a failed one leaves what the store has of its key. With rebuild all are split, and what the store held is
    dropped in the same commit.

    encode gives vectors by a column expression; encoder by batches of texts, through the cache at a path if there is
    one. skip may name steps: extract and split take what an earlier run left in the interim folder, embed leaves
    vectors out.
    """
    kept = Store(spark, store, KEYS)
    docs = _step(spark, interim, "docs", "extract" in skip, lambda: read(spark, folder, sources))
    named = docs.filter("spec_number <> '' and error is null")
    order = F.struct(tx.version_key(F.col("version")), "sha256", "path")
    best = named.groupBy(*KEYS).agg(F.max_by(F.struct("version", "sha256", "path"), order).alias("b")).select(*KEYS, "b.*")
    diff = ingest.manifest_diff(kept.manifest().limit(0) if rebuild else kept.manifest(), best)
    broken = docs.join(named.select("path"), "path", "left_anti").select(F.col("path").alias("file_path"))  # files that are there, but not readable now
    unread = kept.manifest().join(broken, "file_path", "left_semi").select(*KEYS)
    diff = stage(diff.join(unread.withColumn("_there", F.lit(True)), list(KEYS), "left").filter("not (status = 'deleted' and _there is not null)").drop("_there"), "ingest-diff")
    wanted = best.join(diff.filter(F.col("status").isin("new", "replaced")).select(*KEYS), list(KEYS), "left_semi")
    parts = _step(spark, interim, "chunks", "split" in skip, lambda: chunked(docs.join(wanted.select("path"), "path", "left_semi"), mode=mode))
    rows = parts
    if encode is not None and "embed" not in skip:
        rows = parts.withColumn("dense_vector", encode(F.col("text")))
    elif encoder is not None and "embed" not in skip:
        rows = stage(_embedded(spark, parts, encoder, cache), "ingest-vectors")
    counts = parts.groupBy(F.col("doc_id").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    come = stage(wanted.join(counts, "path").select(*KEYS, "version", "sha256", F.col("path").alias("file_path"), "chunks"), "ingest-marks")
    gone = diff.filter("status = 'deleted'").select(*KEYS)
    if rebuild or not come.isEmpty() or not gone.isEmpty():
        kept.commit(rows.join(come.select(F.col("file_path").alias("doc_id")), "doc_id", "left_semi"), come, gone, clear=rebuild)
    own = docs.join(best.select("path", F.lit(True).alias("_best")), "path", "left").join(diff, list(KEYS), "left").join(come.select(F.col("file_path").alias("path"), "chunks"), "path", "left")
    empty = F.col("_best") & F.col("status").isin("new", "replaced") & F.col("chunks").isNull()
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("spec_number") == "", "no specification").when(empty, "no chunks")
    told = own.select(*KEYS, F.when(failed.isNotNull(), "failed").when(F.col("_best").isNull(), "superseded").otherwise(F.col("status")).alias("status"), "path", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), failed.alias("error"))
    lost = diff.filter("status = 'deleted'").select(*KEYS, "status", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error"))
    status = stage(told.unionByName(lost), "ingest-status")
    discard(diff, come, *([rows] if rows is not parts else []), *([] if interim else [docs, parts]))
    return status


def counters(status: DataFrame) -> DataFrame:
    """One row of a run's counts: total, skipped, replaced, new, failed, deleted, superseded and chunks."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    names = {"skipped": ("skipped", "skipped_changed"), **{n: (n,) for n in ("replaced", "new", "failed", "deleted", "superseded")}}
    return status.agg(F.count("path").alias("total"), *[count(*of).alias(n) for n, of in names.items()], F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def _step(spark: SparkSession, interim: str | None, name: str, skipped: bool, make: Callable[[], DataFrame]) -> DataFrame:
    """A step's table: made anew, and left in the interim folder where there is one; or what an earlier run left there."""
    if skipped:
        if interim is None:
            raise ValueError(f"no interim folder to take {name} from")
        return spark.read.parquet(f"{interim}/{name}")
    if interim is None:
        return stage(make(), f"ingest-{name}")
    make().write.mode("overwrite").parquet(f"{interim}/{name}")
    return spark.read.parquet(f"{interim}/{name}")


def _embedded(spark: SparkSession, parts: DataFrame, encoder: Encoder, cache: str | None) -> DataFrame:
    """Chunks with the vector of each text, from the cache or the encoder; what is new is added to the cache's files."""
    known = spark.read.schema("text_hash string, vector array<double>").parquet(cache) if cache and storage_folder(spark, cache).names() else spark.createDataFrame([], "text_hash string, vector array<double>")
    rows, full = embedding.embed_with_cache(parts, known, encoder)
    if cache:
        full.join(known.select("text_hash"), "text_hash", "left_anti").write.mode("append").parquet(cache)
        rows, _ = embedding.embed_with_cache(parts, spark.read.parquet(cache), encoder)  # all are hits now
    return rows.withColumnRenamed("vector", "dense_vector")
