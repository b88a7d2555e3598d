"""Queries of manifests, cached keys, hits' metadata and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import documents as dx
from quarry.operators import manifest as records
from quarry.operators import search
from quarry.operators.ranking import positions
from quarry.operators.storage import stage as settled
from quarry.plans.corpus import _MAN, _NUM, _files, _manifest
from quarry.plans.retrieval import BM25_SQL, C, R, _index, _questions
from quarry.plans.texts import _lines_sql, cased
from quarry.sources.chunks import CHUNKS_SQL, chunks, ranked, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {_MAN} SELECT f.spec_number, f.release, f.version, f.sha256, m.spec_number IS NOT NULL AS known, coalesce(m.sha256 = f.sha256, false) AS same_hash,
  coalesce(m.spec_number IS NOT NULL AND ({_NUM.format('f.version')} > {_NUM.format('m.version')} OR ({_NUM.format('f.version')} = {_NUM.format('m.version')} AND f.version > m.version)), false) AS should_replace
FROM fil f LEFT JOIN man m ON m.spec_number = f.spec_number AND m.release = f.release""")
def manifest_checks(spark, d):
    """What a manifest says of each offered file: known, the same, to be replaced."""
    return records.checks(_manifest(spark, d), _files(spark, d))


@query(f"WITH {_MAN} SELECT * FROM man WHERE (spec_number, release) NOT IN (SELECT (spec_number, release) FROM fil WHERE version = 'f50')")
def manifest_remove(spark, d):
    """A manifest from which the keys of withdrawn files are taken."""
    return records.remove(_manifest(spark, d), _files(spark, d).filter("version = 'f50'"))


_PATHS = f"""{_MAN}, {CHUNKS_SQL}, paths AS (SELECT spec_number || '|' || release AS key, '/in/d' || (3 * substr(spec_number, 2)::bigint // 8) || '-' || release || '.md' AS file_path FROM man),
del AS (SELECT DISTINCT doc_id FROM chunks WHERE substr(doc_id, 2)::bigint % 3 = 0),
gone AS (SELECT del.doc_id, min(key) AS key FROM del JOIN paths ON contains(file_path, del.doc_id) GROUP BY del.doc_id)"""


def _deleted(spark, d):
    """Every third document goes; a path holds a document's id, or one that starts with it."""
    number = F.substring("spec_number", 2, 20).cast("long")
    path = F.concat(F.lit("/in/d"), F.floor(3 * number / 8).cast("string"), F.lit("-"), "release", F.lit(".md"))
    rows = chunks(spark, d)
    return records.delete_documents(rows, _manifest(spark, d).withColumn("file_path", path), rows.filter(F.substring("doc_id", 2, 20).try_cast("long") % 3 == 0).select("doc_id").distinct())


@query(f"WITH {_PATHS} SELECT del.doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = del.doc_id) AS deleted_chunks, gone.key AS deleted_key FROM del LEFT JOIN gone ON gone.doc_id = del.doc_id")
def document_delete(spark, d):
    """How many chunks went with each deleted document, and which record of the manifest."""
    return _deleted(spark, d)[2]


@query(f"WITH {_PATHS} SELECT key FROM paths WHERE key NOT IN (SELECT key FROM gone)")
def manifest_sync(spark, d):
    """The records that stay when documents are deleted."""
    return _deleted(spark, d)[1].select(records.key().alias("key"))


@query(f"{R} SELECT query_id, id, pos FROM ranked WHERE pos <= 10 AND upper(release) = 'R18' AND series IN (22, 30, 31)")
def client_filter(spark, d):
    """Filters that come after a search's ten results, so fewer are left."""
    return ranked(spark, d).filter("pos <= 10").filter((F.upper("release") == "r18".upper()) & F.col("series").cast("string").isin("22", "30", "31")).select("query_id", "id", "pos")


@query(f"""{C}, s AS (SELECT *, CASE WHEN id % 5 <> 0 THEN id END AS stored FROM chunks)
SELECT doc_id, chunk_index, coalesce(stored, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, id) - 1) AS chunk_id, left(text, 500) AS text FROM s""")
def chunk_items(spark, d):
    """The chunks of every document; one without an id has its place in the document."""
    rows = positions(chunks(spark, d), F.asc("chunk_index"), F.asc("id"), by=["doc_id"])
    stored = F.when(F.col("id") % 5 != 0, F.col("id"))
    return rows.select("doc_id", "chunk_index", F.coalesce(stored, F.col("pos").cast("long") - 1).alias("chunk_id"), F.substring("text", 1, 500).alias("text"))


@query(f"""WITH {BM25_SQL}, {CHUNKS_SQL}, meta AS (SELECT id // 2 * 2 AS doc_key, arg_max(release, id) AS release, arg_max(series, id) AS series FROM chunks GROUP BY 1)
SELECT query_id, bm.id, pos, release, series FROM bm LEFT JOIN meta ON doc_key = bm.id WHERE pos <= 10""")
def hit_metadata(spark, d):
    """Hits with the metadata of their key: of a key that comes twice the last counts, and a key without any has none."""
    hits = settled(search.bm25_search(_index(spark, d), _questions(spark, d), 10))
    of_hits = chunks(spark, d).select(F.expr("id div 2 * 2").alias("key"), "id", "release", "series").join(hits.select(F.col("id").alias("key")), "key", "left_semi")
    last = of_hits.groupBy(F.col("key").alias("id")).agg(F.max_by(F.struct("release", "series"), "id").alias("m"))
    return hits.join(last, "id", "left").select("query_id", "id", "pos", "m.release", "m.series")


_TITLES = ("cover %s\n  3rd Generation Project  \n\nTechnical Specification\n  Group Services\nRelease 18\nmore", "Technical Report %s\n\nsecond", "![logo](a.png)\n\n## Heading %s ##\ntext", "![logo](a.png)\n\nfirst %s\n  ! second\n#a\nfourth", "\n \n")


@query(f"""WITH {_lines_sql(*_TITLES)}, l AS (SELECT id, string_split(x, chr(10))[1:20] AS l FROM c),
p AS (SELECT *, list_position(list_transform(l, lambda y: contains(lower(y), 'specification') OR contains(lower(y), 'technical')), true) AS place, list_transform(l, lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')) AS s FROM l),
h AS (SELECT *, list_filter(s, lambda y: starts_with(y, '#') AND length(y) > 3) AS heads, list_transform(list_filter(l, lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(y, '!')), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')) AS plain FROM p)
SELECT id, CASE WHEN place > 0 THEN array_to_string(list_filter(s[greatest(place - 1, 1):place + 2], lambda y: y <> ''), ' — ') WHEN len(heads) > 0 THEN regexp_replace(ltrim(heads[1], '#'), '^\\s+|\\s+$', '', 'g') ELSE array_to_string(plain[1:3], ' — ') END AS title FROM h""")
def converted_title(spark, d):
    return cased(spark, d, *_TITLES).select("id", dx.converted_title(F.col("x")).alias("title"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations),
h AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS past FROM n WHERE k > 1 GROUP BY conv_id)
SELECT n.conv_id, sha256(trim(lower(n.text)) || '|' || CASE WHEN n.conv_id % 2 = 0 THEN 'R18' ELSE '' END || '|' || (n.conv_id % 3) || '||' || CASE WHEN n.conv_id % 5 = 0 THEN 'False' ELSE 'True' END || coalesce('|' || past, '')) AS key FROM n LEFT JOIN h ON h.conv_id = n.conv_id WHERE k = 1""")
def answer_keys(spark, d):
    """The key of each conversation's last question, under what was said before and the filters that are set."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", F.concat("role", F.lit(":"), "text").alias("said"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    past = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x: x.said)
    k = F.col("conv_id")
    return rows.select("conv_id", dx.answer_key(F.element_at("t", -1)["text"], F.when(k % 2 == 0, "R18"), k % 3, F.lit(None), k % 5 != 0, past).alias("key"))
