"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of docs: docs needs doc_id, text and source, and whatever else it
has, under any name, is carried through in one struct. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import curriculum, forest, packing, quality_rules, secrets
from quarry.llm.common import stage, table

#: Some stages can't be said in SQL (near duplicates by components, packing); tests hold the stages against brute force.
ORACLE_SQL = None
#: Words of a shingle, and the least similarity in hundredths, of the near-duplicate stage.
WORDS, LEAST = 5, 80


def _row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _with_text(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """docs' columns from found's row with a new text, and n_chars to match where it is a column and the text has changed."""
    old = found.select("row", text.alias("new"))
    columns = []
    for field in docs.schema.fields:
        own = F.col("row").getField(field.name)
        if field.name == "text":
            own = F.col("new")
        elif field.name == "n_chars":
            own = F.when(F.col("new").eqNullSafe(F.col("row.text")), own).otherwise(F.length("new").cast(field.dataType))
        columns.append(own.alias(field.name))
    return old.select(*columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that fail the base rules or lose too much text go.

    Null and empty texts fail the base rules and go; null ids stay as they are; repeated rows are judged alike.
    """
    judged = quality_rules.judge(docs.select(_row(docs), "text")).filter("kept")
    return _with_text(judged, docs, F.col("clean_text"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays.

    Every row is judged by its own id and text, so of an id with several texts those stay that are their
    component's first. Of rows that repeat both id and text (null: empty) the one whose other columns come first, as JSON, stays.
    Rows with null ids are linked with nothing and all stay, as do texts without words, null ones among them.
    """
    named = docs.filter("doc_id is not null")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    kept = forest.near_duplicates(named, words=WORDS, least=LEAST, with_sha=True).filter("kept").select("doc_id", "text_sha256").distinct()
    others = F.to_json(F.struct(F.col("text").isNull().alias("t"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    rows = named.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256"), _row(docs), others.alias("others"))
    found = rows.join(kept, ["doc_id", "text_sha256"], "left_semi").groupBy("doc_id", "text_sha256").agg(F.min_by("row", "others").alias("row"))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns).unionByName(docs.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark, private keys with their body; no document goes, and null texts stay null."""
    found = secrets.scan(docs.select(_row(docs), "doc_id", "text"), secrets.TO_REDACT)
    return _with_text(found, docs, secrets.redact(F.col("text"), F.col("found")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, whole, range-sorted by training position.

    Documents without words are never drawn; a null source is a source; rows that repeat an id are separate.
    """
    return curriculum.training_order(docs).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a null text is the end id alone, a null id is kept, repeated rows are separate."""
    return packing.pack_documents(docs.select("doc_id", "text"), packing.default_tokenizer())


STAGES = [
    ("quality_rules", clean_lines),
    ("near_duplicates", one_of_each),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
