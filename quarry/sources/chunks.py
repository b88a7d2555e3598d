"""Readers, and the adapters that give the driver's tables the engine's schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The chunk table's schema; `id` is assigned from the data, never by arrival.
CHUNK_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("id", "series", "chunk_index", "parent_chunk_id")]
    + [T.StructField(n, T.StringType()) for n in ("text", "doc_id", "spec_number", "release", "version", "parent_section_id", "parent_title", "section_number", "section_title", "section_path", "doc_type", "content_type", "spec_role", "topic_domain", "parent_text")]
    + [T.StructField("dense_vector", T.ArrayType(T.FloatType()))]
)
#: Most bytes (text-like columns) or characters of a stored column.
BYTE_LIMITS = {"text": 65000, "parent_text": 4096}
CHAR_LIMITS = {"doc_id": 256, "spec_number": 64, "release": 32, "version": 32, "parent_section_id": 256, "parent_title": 4096, "section_number": 64, "section_title": 512, "section_path": 4096}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


TITLES = ("Definitions and abbreviations", "Table of parameters", "Attach procedure", "Reference operation", "Scope", "Overview of layer")
CONTENT_TYPES = ("parameter_table", "definition", "procedure", "overview")
ROLES = ("authoritative", "supporting", "overview")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as chunks: eight to a document, with specification, release and sections by id."""
    k = F.col("doc_id")
    group = F.floor(k / 8).cast("long")
    series = 21 + group % 18
    parent = F.when(k % 11 == 0, "").otherwise(F.concat((1 + k % 9).cast("string"), F.lit("."), (k % 4).cast("string")))
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat(F.lit("d"), group.cast("string")).alias("doc_id"), "text", series.alias("series"),
        F.format_string("%02d.%03d", series, 200 + group % 40).alias("spec_number"), F.concat(F.lit("R"), (15 + k % 5).cast("string")).alias("release"),
        parent.alias("parent_section_id"), _pick(k, *TITLES).alias("parent_title"), (k % 8).alias("chunk_index"),
        F.concat((1 + k % 9).cast("string"), F.lit("."), (k % 4).cast("string"), F.lit("."), (1 + k % 7).cast("string")).alias("section_number"),
        F.when(F.col("lang") == "en", "3gpp").otherwise("oran").alias("doc_type"), _pick(k, *CONTENT_TYPES).alias("content_type"), _pick(k, *ROLES).alias("spec_role"),
        "lang",
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as ranked results of twenty queries for each thousand of them: query_id, score, rerank_score, source_tag and pos, the place by score."""
    from quarry.operators.ranking import positions

    k = F.col("id")
    rows = chunks(spark, sf_dir).withColumns({"query_id": k % 20 + 20 * F.expr("id div 1000"), "score": (k * 7919 % 1000) / 1000.0, "rerank_score": (k * 104729 % 997) / 997.0, "source_tag": F.when(k % 10 == 0, "multi_hop")})
    return positions(rows.withColumns({"score": F.col("score").cast("double"), "rerank_score": F.col("rerank_score").cast("double")}))


def _cycle(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id AS id, 'd' || (doc_id // 8) AS doc_id, text, 21 + (doc_id // 8) % 18 AS series, printf('%02d.%03d', 21 + (doc_id // 8) % 18, 200 + (doc_id // 8) % 40) AS spec_number,
    'R' || (15 + doc_id % 5) AS release, CASE WHEN doc_id % 11 = 0 THEN '' ELSE (1 + doc_id % 9) || '.' || (doc_id % 4) END AS parent_section_id,
    {_cycle('doc_id', TITLES)} AS parent_title, doc_id % 8 AS chunk_index, (1 + doc_id % 9) || '.' || (doc_id % 4) || '.' || (1 + doc_id % 7) AS section_number,
    CASE WHEN lang = 'en' THEN '3gpp' ELSE 'oran' END AS doc_type, {_cycle('doc_id', CONTENT_TYPES)} AS content_type, {_cycle('doc_id', ROLES)} AS spec_role, lang
  FROM documents)"""
RANKED_SQL = CHUNKS_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM (
    SELECT *, id % 20 + 20 * (id // 1000) AS query_id, (id * 7919 % 1000) / 1000.0::double AS score, (id * 104729 % 997) / 997.0::double AS rerank_score, CASE WHEN id % 10 = 0 THEN 'multi_hop' END AS source_tag FROM chunks))"""
