"""Jobs over stores: dumps, copies, rebuilds, resumed and compared evaluations, and the section tree, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunking, evaluation, graph, ingest, ranking, references, search
from quarry.operators.storage import staged_path
from quarry.plans import answers
from quarry.plans.corpus import _EV, _HITS, _RECALL, _expected, _results
from quarry.plans.documents import _markdown
from quarry.plans.retrieval import BM25_SQL, C, R, _index, _questions
from quarry.plans.retrieval import SQL as RETRIEVAL_SQL
from quarry.plans.texts import SQL as TEXT_SQL
from quarry.plans.texts import _INDEX as TEXT_INDEX
from quarry.plans.texts import _edges, cased, cased_sql
from quarry.sources import files
from quarry.sources.chunks import chunks, ranked

QUERIES: dict = {}
SQL: dict[str, str] = {}
EXPAND_SQL = RETRIEVAL_SQL["graph_expand"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{C} SELECT id, doc_id, spec_number, release, chunk_index, parent_section_id, doc_type, md5(text) AS md5 FROM chunks")
def chunk_dump(spark, d):
    """Chunks written as JSON lines, without vectors, and loaded again by their schema."""
    path = staged_path(spark, "chunks-json")
    files.dump_chunks(chunks(spark, d), path)
    return files.load_chunks(spark, path).select("id", "doc_id", "spec_number", "release", "chunk_index", "parent_section_id", "doc_type", F.md5("text").alias("md5"))


@query(f"{C} SELECT id, [length(i)::double, len(string_split(i, ' '))::double] AS vector FROM (SELECT id, CASE WHEN parent_title <> '' THEN parent_title || chr(10) || text ELSE text END AS i FROM chunks)")
def reindex_copy(spark, d):
    """A copy of the store with the same ids and fresh vectors, by a stand-in encoder."""
    path = staged_path(spark, "reindex")
    encode = lambda text: F.array(F.length(text).cast("double"), F.size(F.split(text, " ", -1)).cast("double"))
    given = F.when(F.col("parent_title") != "", F.concat("parent_title", F.lit("\n"), "text")).otherwise(F.col("text"))
    ingest.copy_with_vectors(chunks(spark, d), path, given, encode)
    return spark.read.parquet(path).select("id", F.col("dense_vector").alias("vector"))


_ALL_EDGES = TEXT_SQL["xref_edges_by_type"].rsplit("SELECT type, count", 1)[0]


@query(_ALL_EDGES + "SELECT src, dst, type, CASE type WHEN 'SIBLING' THEN 0.3::double ELSE 0.5::double END AS weight FROM e")
def graph_dump(spark, d):
    """The reference graph written as nodes and edges, and loaded again."""
    path = staged_path(spark, "graph")
    graph.write_graph(chunks(spark, d).select("id", "spec_number", "section_number"), _edges(spark, d), path)
    return graph.read_graph(spark, path)[1].select("src", "dst", "type", "weight")


@query(f"{C} SELECT series, count(*) AS n, min(id) AS first_id FROM chunks GROUP BY series")
def full_rebuild(spark, d):
    """A store that holds older rows is replaced as a whole."""
    path = staged_path(spark, "store")
    rows = chunks(spark, d)
    ingest.rebuild(rows.filter("series < 25").withColumn("text", F.lit("old")), path)
    ingest.rebuild(rows, path)
    return spark.read.parquet(path).groupBy(F.col("series").cast("long").alias("series")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {BM25_SQL} SELECT query_id, id, pos FROM bm WHERE pos <= 3")
def eval_resume(spark, d):
    """An evaluation that broke off half-way and goes on with the samples that have no result yet."""
    path, samples = staged_path(spark, "eval"), _questions(spark, d)
    index = _index(spark, d)
    answer = lambda part: search.bm25_search(index, part.select("query_id", "text"), 3).select("query_id", "id", "pos")
    evaluation.run_resumable(samples.filter("substring(sha2(text, 256), 1, 1) < '8'"), answer, path)
    return evaluation.run_resumable(samples, answer, path)


@query(f"""{_EV.replace('res AS (', 'res_a AS (', 1)}, res_b AS (SELECT query_id AS sample, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank, spec_number AS spec, section_number AS section, id % 4 AS relevance FROM ranked),
res AS (SELECT sample * 2 AS sample, rank, spec, section, relevance FROM res_a UNION ALL SELECT sample * 2 + 1, rank, spec, section, relevance FROM res_b WHERE rank <= 20),
ex2 AS (SELECT sample * 2 AS sample, spec, section FROM ex UNION ALL SELECT sample * 2 + 1, spec, section FROM ex), {_RECALL.replace('FROM ex)', 'FROM ex2)').replace('FROM ex ', 'FROM ex2 ')},
mr AS (SELECT sample, coalesce(1.0::double / (SELECT min(rank) FROM hits h WHERE h.sample = s.sample), 0) AS mrr FROM (SELECT DISTINCT sample FROM res) s)
SELECT CASE sample % 2 WHEN 0 THEN 'score' ELSE 'rerank_score' END AS model, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(round(mrr, 6)), 6) AS mrr FROM rec JOIN mr USING (sample) WHERE k = 5 GROUP BY 1""")
def model_eval(spark, d):
    """Two models over one test set: mean recall and reciprocal rank of each."""
    other = ranking.positions(ranked(spark, d), F.desc("rerank_score"), F.asc("id"), pos="pos2").filter("pos2 <= 20")
    second = other.select(F.col("query_id").alias("sample"), F.col("pos2").alias("rank"), F.col("spec_number").alias("spec"), F.col("section_number").alias("section"), (F.col("id") % 4).alias("relevance"))
    return evaluation.compare({"score": _results(spark, d), "rerank_score": second}, _expected(spark, d), 5)


_CLAIMS = ("Clause 9.2.%d of TS 38.214 and [6, TS 38.%n], see clause 5.1.", "TS 38.331 as in section 4.2\nclause 7.%s alone", "clause 3.1 of [7, 3GPP TS 38.213]", "none %s",
           "[1, TS 38.211][2, TS 38.212][3, TS 38.213]TS 38.%nTS 38.215-1", "subsection 4.%d\nsub-clause 5 of  TR 38.901 clause 6.%d.", "  clause A.%s of TS 21.905clause 7 ")


def _claims_sql(rows: str) -> str:
    """Claims of rows (id, x): every match with its place, then rank after rank against what is taken."""
    same = references.PATTERNS["same_spec"][0]
    parts = []
    for r, (name, (pattern, groups)) in enumerate(references.PATTERNS.items()):
        g = [f"regexp_extract_all(x, '{pattern}', {n})" for n in groups] + ["NULL::varchar[]"] * (3 - len(groups))
        parts.append(f"SELECT id, {r} AS rank, '{name}' AS pattern, unnest(regexp_extract_all(x, '{pattern}')) AS hit, unnest(string_split_regex(x, '{pattern}')[1:len(regexp_extract_all(x, '{pattern}'))]) AS gap, generate_subscripts(regexp_extract_all(x, '{pattern}'), 1) AS i, unnest({g[0]}) AS g1, unnest({g[1]}) AS g2, unnest({g[2]}) AS g3 FROM {rows} WHERE regexp_matches(x, '{pattern}')")
    steps = []
    for r in range(len(parts)):
        taken = " UNION ALL ".join(f"FROM t{q}" for q in range(r))
        free = f"SELECT * FROM at_ a WHERE rank = {r}" + (f" AND NOT EXISTS (FROM ({taken}) t WHERE t.id = a.id AND (a.s BETWEEN t.s AND t.e OR a.e BETWEEN t.s AND t.e))" if r else "")
        steps.append(f"""f{r} AS ({free}), n{r} AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN 0 ELSE 1 END AS new FROM f{r} WINDOW w AS (PARTITION BY id ORDER BY s)), r{r} AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s) AS run FROM n{r}),
t{r} AS (SELECT * EXCLUDE (new, run) FROM r{r} QUALIFY row_number() OVER (PARTITION BY id, run ORDER BY s) % 2 = 1)""")
    return f"""m AS ({" UNION ALL ".join(parts)}), ends AS (SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY id, rank ORDER BY i))::bigint AS e FROM m),
at_ AS (SELECT ends.* EXCLUDE (gap, i), e - length(hit) AS s, x FROM ends JOIN {rows} USING (id)), {", ".join(steps)},
claims AS (SELECT id, rank, pattern, CASE WHEN rank = 4 THEN '' ELSE g1 || '.' || g2 END AS spec_number, rtrim(CASE WHEN rank = 4 THEN g1 WHEN rank = 3 THEN regexp_extract(substr(x, greatest(s - 80, 0) + 1, e + 80 - greatest(s - 80, 0)), '{same}', 1) ELSE coalesce(g3, '') END, '.') AS clause, s, e,
  left(trim(substr(x, greatest(s - 40, 0) + 1, e + 40 - greatest(s - 40, 0)), ' ' || chr(9) || chr(10) || chr(13)), 200) AS evidence
  FROM ({" UNION ALL ".join(f"FROM t{q}" for q in range(len(parts)))})
  WHERE rank < 4 OR NOT regexp_matches(regexp_extract(left(x, s), '[^\n]*$') || hit || regexp_extract(substr(x, e + 1), '^[^\n]*'), '{references.SPEC_ON_LINE}'))"""


@query(f"WITH {cased_sql(*_CLAIMS)}, {_claims_sql('c')} SELECT id, pattern, spec_number, clause, s::int AS start, e::int AS \"end\", evidence FROM claims")
def reference_claims(spark, d):
    """References in texts, each stretch claimed by its most precise pattern."""
    rows = references.claims(cased(spark, d, *_CLAIMS).select("id", F.col("x").alias("text")))
    return rows.select("id", "pattern", "spec_number", "clause", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "evidence")


_TELL = """text || chr(10) || 'Clause ' || (1 + doc_id % 9) || '.' || (doc_id % 4) || '.' || (doc_id % 7) || ' of TS ' || printf('%02d.%03d', 21 + (doc_id // 3) % 18, 200 + (doc_id // 3) % 40) || ', as in clause ' || (1 + doc_id % 5) || '.1.' || chr(10)
  || '[6, TS ' || printf('%02d.%03d', 21 + (doc_id // 5) % 18, 200 + (doc_id // 5) % 40) || '][7, TS 38.999] and TS ' || printf('%02d.%03d', 21 + (doc_id // 8) % 18, 200 + (doc_id // 8) % 40) || chr(10) || 'section ' || (1 + doc_id % 9) || '.' || (doc_id % 5)"""
_REFERENCE_SQL = f"""{C}, q AS (SELECT doc_id AS id, {_TELL} AS x FROM documents), gated AS (SELECT q.* FROM q JOIN chunks USING (id) WHERE NOT (id % 50 = 7)), {_claims_sql('gated')}, {TEXT_INDEX},
asked AS (SELECT k.id, k.rank, k.s, c.spec_number AS own, CASE WHEN k.spec_number = '' THEN c.spec_number ELSE k.spec_number END AS spec, k.clause, k.evidence FROM claims k JOIN chunks c USING (id) WHERE k.spec_number = '' OR try_cast(split_part(k.spec_number, '.', 1) AS int) BETWEEN 21 AND 37),
l AS (SELECT *, unnest(list_transform(range(1, len(string_split(clause, '.')) + 1), lambda n: array_to_string(string_split(clause, '.')[1:n], '.'))) AS sec, unnest(range(len(string_split(clause, '.')) - 1, -1, -1)) AS up FROM asked WHERE clause <> ''),
hits AS (SELECT l.*, ix.id AS dst, 2 * up AS level FROM l JOIN ix ON ix.spec_number = l.spec AND ix.section = l.sec WHERE ix.section <> '' UNION ALL SELECT l.*, ix.id, 2 * up + 1 FROM l JOIN ix ON ix.spec_number = l.spec AND starts_with(ix.section, l.sec || '.')),
five AS (SELECT spec_number, id AS dst FROM (SELECT *, min({{'a': id, 'b': place}}) OVER (PARTITION BY spec_number, section) AS key FROM ix) QUALIFY row_number() OVER (PARTITION BY spec_number ORDER BY key, id, place) <= 5),
both_ AS (SELECT id, rank, s, own, spec, clause, evidence, dst FROM hits QUALIFY level = min(level) OVER (PARTITION BY id, rank, s) UNION ALL SELECT asked.*, dst FROM asked JOIN five ON five.spec_number = spec WHERE clause = ''),
edges AS (SELECT id AS src, dst, 'REFERENCES' AS type, CASE WHEN spec <> own THEN 1.0::double ELSE 0.6::double END AS weight, spec AS target_spec, clause AS target_clause, spec <> own AS is_cross_spec, evidence, rank, s FROM both_ QUALIFY row_number() OVER (PARTITION BY id, dst ORDER BY rank, s) = 1)"""


def _telling(spark, d):
    """Chunks whose texts refer to specifications and clauses of the table; one in fifty is a list of references."""
    k = F.col("id")
    spec = lambda n: F.format_string("%02d.%03d", 21 + F.floor(k / n) % 18, 200 + F.floor(k / n) % 40)
    number = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    told = F.concat(F.lit("\nClause "), number(1 + k % 9, k % 4, k % 7), F.lit(" of TS "), spec(3), F.lit(", as in clause "), (1 + k % 5).cast("string"), F.lit(".1.\n[6, TS "), spec(5), F.lit("][7, TS 38.999] and TS "), spec(8), F.lit("\nsection "), number(1 + k % 9, k % 5))
    listed = k % 50 == 7
    rows = chunks(spark, d).withColumns({"text": F.concat("text", told), "section_title": F.when(listed, "References").otherwise("")})
    return rows.withColumns({"own": F.col("section_number"), "section_number": F.when(listed, "2").otherwise(F.col("section_number"))})


def _edges_told(spark, d, *, of=None, most=None):
    """The edges of all texts, or of those with the ids of `of`."""
    nodes = _telling(spark, d)
    index = nodes.withColumn("section_number", F.col("own"))
    return references.edges(index, series=range(21, 38), told=nodes if of is None else nodes.join(of, "id", "left_semi"), most=most)


@query(_REFERENCE_SQL + " SELECT src, dst, type, weight, target_spec, target_clause, is_cross_spec, evidence FROM edges")
def reference_edges(spark, d):
    """The edges that references in whole texts make: gated by series and section, each stretch claimed once, resolved to sections."""
    return _edges_told(spark, d)


@query(_REFERENCE_SQL.replace(C, R, 1) + ", e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM edges),\nh AS (" + EXPAND_SQL.split("h AS (", 1)[1])
def graph_expand_references(spark, d):
    """The first hits' neighbours in the graph of references that texts make, in other specifications, unseen."""
    hits = ranked(spark, d).filter("pos <= 10")
    edges = _edges_told(spark, d, of=hits.select("id").distinct(), most=5)  # an expansion takes five of each hit
    found = ranking.positions(edges, F.asc("dst"), by=["src"], pos="n").select("src", "dst", (F.col("n") - 1).alias("place"))
    return graph.expand(hits, found, chunks(spark, d).select("id", "spec_number"))


def _checked(spark, d):
    """Answers of whole texts, some with citations and terms added, and one or two sources for most of them."""
    k, rows = F.col("id"), chunks(spark, d).select("id", "spec_number", F.coalesce("text", F.lit("")).alias("text"))
    answer = F.when(k % 5 == 0, F.concat("text", F.lit(" As TS 21.200 says [1] and [9]. NR-U PDCP SDAP Section Type 3"))).when(k % 5 == 1, F.concat(F.lit("无法确定 "), "text")).when(k % 5 == 2, F.lit("TS 22.201 and TS 99.100 hold. UE RRC")).when(k % 5 == 3, F.col("text")).otherwise("")
    own = rows.filter(k % 7 != 0).withColumn("text", F.when(k % 2 == 0, F.concat("text", F.lit(" uses NR-U and PDCP"))).otherwise(F.col("text")))
    near = rows.withColumn("id", k - 1).filter(k % 3 == 0)
    return rows.select("id", answer.alias("answer")), own.unionByName(near)


_OTHER_LETTERS = r"[À-ÖØ-öø-\x{24F}\x{370}-\x{1FFF}\x{3040}-\x{9FFF}\x{AC00}-\x{D7A3}]"  # word characters to Spark's boundaries, none to this engine's
_UNSURE = " OR ".join(f"contains(lower(answer), '{w.lower()}')" for w in answers.UNCERTAIN)


@query(f"""{C}, t AS (SELECT id, spec_number, coalesce(text, '') AS text FROM chunks),
an AS (SELECT id, CASE id % 5 WHEN 0 THEN text || ' As TS 21.200 says [1] and [9]. NR-U PDCP SDAP Section Type 3' WHEN 1 THEN '无法确定 ' || text WHEN 2 THEN 'TS 22.201 and TS 99.100 hold. UE RRC' WHEN 3 THEN text ELSE '' END AS answer FROM t),
so AS (SELECT id, spec_number, CASE WHEN id % 2 = 0 THEN text || ' uses NR-U and PDCP' ELSE text END AS text FROM t WHERE id % 7 <> 0 UNION ALL SELECT id - 1, spec_number, text FROM t WHERE (id - 1) % 3 = 0),
ph AS (SELECT *, CASE WHEN length(text) > 50 THEN list_filter(list_transform(string_split_regex(lower(text), '[.\\n]'), lambda x: trim(x)), lambda x: length(x) >= 20)[1:5] END AS phrases FROM so),
g AS (SELECT id, list(spec_number) AS specs, string_agg(text, chr(10)) AS body, count(*) AS n FROM ph GROUP BY id),
ci AS (SELECT ph.id, count(*) AS cited FROM ph JOIN an USING (id) WHERE phrases IS NOT NULL AND len(list_filter(phrases, lambda x: contains(lower(answer), x))) > 0 GROUP BY ph.id),
r AS (SELECT an.id, answer, coalesce(specs, []) AS specs, coalesce(body, '') AS body, coalesce(n, 0) AS n, coalesce(cited, 0) AS cited, list_distinct(regexp_extract_all(answer, '{answers.CITED}', 1)) AS named,
  list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,3}})\\]', 1), lambda x: x::int)) AS numbers,
  list_distinct(list_concat(list_filter(regexp_extract_all(regexp_replace(answer, '{_OTHER_LETTERS}', '_', 'g'), '{answers.TERM}'), lambda x: regexp_matches(x, '^[A-Z]{{2,4}}(?:-[A-Z0-9]{{1,5}})?$')), regexp_extract_all(answer, '(?i)Section Type \\d+'))) AS own,
  len(list_filter(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentences FROM an LEFT JOIN g USING (id) LEFT JOIN ci USING (id)),
v AS (SELECT *, CASE WHEN len(own) = 0 THEN CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END ELSE len(list_filter(own, lambda x: contains(lower(body), lower(x))))::double / len(own) END AS t,
  CASE WHEN len(regexp_extract_all(answer, '[一-鿿]')) / greatest(length(answer), 1)::double < 0.6 THEN CASE WHEN sentences > 0 THEN least(1.0, cited::double / sentences) ELSE 1.0 END ELSE 0.0 END AS p, ({_UNSURE}) AS sure FROM r),
w AS (SELECT *, CASE WHEN sure THEN [] ELSE list_concat(list_transform(list_filter(named, lambda x: NOT list_contains(specs, x)), lambda x: 'unseen TS ' || x),
  CASE WHEN len(list_filter(numbers, lambda x: x > n AND NOT contains(body, '[' || x || ']'))) > 0 THEN ['invalid source number'] ELSE [] END, CASE WHEN len(own) > 0 AND t < 0.3 AND p < 0.3 THEN ['low overlap'] ELSE [] END) END AS warnings FROM v)
SELECT id, len(warnings) = 0 AS verified, round(CASE WHEN sure THEN 1.0 WHEN t < 0.3 THEN greatest(t, p) ELSE t END::double, 6) AS coverage, array_to_string(list_sort(warnings), '; ') AS warnings FROM w""")
def verify_answers(spark, d):
    """All checks of an answer by its sources: uncertainty, cited specifications, source numbers, terms and phrases."""
    found = answers.verify(*_checked(spark, d))
    return found.select("id", "verified", "coverage", F.array_join(F.sort_array("warnings"), "; ").alias("warnings"))


_HALF = "floor(length(text) / 2)::bigint"
_MD_TEXT = f"""'# 1 Scope' || chr(10) || chr(10) || 'This part is short.' || chr(10) || chr(10) || '# 5 Layer ' || doc_id || chr(10) || chr(10) || 'Introduction.' || chr(10) || chr(10) || '## 5.1 First' || chr(10) || chr(10) || substr(text, 1, {_HALF})
  || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || '$$' || chr(10) || 'x = y' || chr(10) || '$$' || chr(10) || chr(10) || '## 5.2 Second' || chr(10) || chr(10)
  || regexp_replace(substr(text, {_HALF} + 1), '\\. ', '.' || chr(10) || chr(10), 'g') || chr(10) || chr(10) || '# Annex A' || chr(10) || chr(10) || 'End.' || chr(10)"""


@query(f"""WITH RECURSIVE md AS (SELECT doc_id, {_MD_TEXT} AS x FROM documents), l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS n FROM md),
h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS place, length(regexp_extract(line, '^(#{{1,8}})\\s+(.+)$', 1)) AS hashes, trim(regexp_extract(line, '^(#{{1,8}})\\s+(.+)$', 2)) AS t FROM l WHERE regexp_matches(line, '^#{{1,8}}\\s+.+$')),
f AS (SELECT doc_id, place, hashes, t, regexp_extract(t, '^(\\d+(?:\\.\\d+)*[a-z]?)\\s+(.*)$', 1) AS number FROM h),
g AS (SELECT doc_id, place, number, CASE WHEN number <> '' THEN trim(regexp_extract(t, '^(\\d+(?:\\.\\d+)*[a-z]?)\\s+(.*)$', 2)) ELSE t END AS title, greatest(CASE WHEN hashes = 8 THEN 1 ELSE hashes END, CASE WHEN number <> '' THEN len(string_split(number, '.')) + 1 ELSE 0 END) AS level FROM f),
u AS (SELECT g.*, (SELECT max(p.place) FROM g p WHERE p.doc_id = g.doc_id AND p.place < g.place AND p.level < g.level) AS up FROM g),
w AS (SELECT doc_id, place, trim(number || ' ' || title) AS section_path FROM u WHERE up IS NULL UNION ALL SELECT u.doc_id, u.place, w.section_path || ' > ' || trim(u.number || ' ' || u.title) FROM u JOIN w ON w.doc_id = u.doc_id AND w.place = u.up)
SELECT doc_id, place, level, number, title, section_path FROM u JOIN w USING (doc_id, place)""")
def section_tree(spark, d):
    """Headings in order, with their level, number, title and path from the top."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, k, n.level, n.number, n.title, " > ".join(f"{x.number} {x.title}".strip(chunking.SPACES) for x in n.line())) for i, t in zip(part["doc_id"], part["text"], strict=True) for k, n in enumerate(chunking.sections(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "level", "number", "title", "section_path"])

    return _markdown(spark, d).mapInPandas(run, "doc_id long, place long, level long, number string, title string, section_path string")


_CUT = "CASE " + " ".join(f"WHEN {p} >= floor(length(piece) * {share}::double) THEN regexp_replace(substr(piece, 1, {p}), '\\s+$', '') || '…'" for p, share in ((f"(length(piece) - strpos(reverse(piece), {mark}) - {n - 1} - CASE WHEN strpos(reverse(piece), {mark}) = 0 THEN 99999 ELSE 0 END)", share) for mark, n, share in (
    ("chr(10) || chr(10)", 2, 0.3), ("chr(10)", 1, 0.4), ("' .'", 2, 0.5), ("'。'", 1, 0.5), ("' ;'", 2, 0.6), ("chr(10)", 1, 0.2), ("' '", 1, 0.7)))) + " ELSE piece || '…' END"
SQL["truncate_bytes"] = f"""WITH t AS (SELECT doc_id AS id, text, CASE WHEN strlen(text) <= 1000 THEN 0 ELSE list_max(list_filter(range(greatest(0, least(length(text), 997) + 997 - strlen(substr(text, 1, 997))), 998), lambda n: strlen(substr(text, 1, n)) <= 997)) END AS n FROM documents),
p AS (SELECT id, text, substr(text, 1, n) AS piece FROM t) SELECT id, CASE WHEN strlen(text) <= 1000 THEN text ELSE {_CUT} END AS cut FROM p"""

SQL["rate_accepted"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts::timestamp) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, t FROM e WHERE n = 1 UNION ALL SELECT user_id, n, t FROM (SELECT e.user_id, e.n, e.t, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.t - r.t >= 3600) WHERE k = 1)
SELECT event_id, e.user_id, r.n IS NOT NULL AS accepted FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.n = e.n"""


def _upload_sql() -> str:
    from quarry.plans.rules import _UPLOADS
    from quarry.plans.texts import _DIGITS, cased_sql

    return f"""WITH {cased_sql(*_UPLOADS)}, h AS (SELECT id, x, CASE id % 3 WHEN 0 THEN '3GPP TS 38.300 V17.4.0' WHEN 1 THEN 'x (Release 16)' ELSE 'text' END AS head FROM c),
k AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)O-RAN\\.') OR regexp_matches(head, '(?i)O-RAN\\s+ALLIANCE|O-RAN\\s+WORKING\\s+GROUP') THEN 'oran'
  WHEN regexp_matches(x, '^\\d{{5}}') OR regexp_matches(x, '(?i)(?:TS|TR)[_\\s]\\d{{2}}\\.\\d{{3}}') OR regexp_matches(head, '(?i)3GPP\\s+(?:TS|TR)\\s+\\d{{2}}\\.\\d{{3}}\\s+V\\d+\\.\\d+\\.\\d+') THEN '3gpp' ELSE 'unknown' END AS kind,
  regexp_matches(x, '(?i)\\.(md|markdown)$') AS md, regexp_replace(x, '\\.[^.]*$', '') AS stem, CASE WHEN length({_DIGITS}) >= 5 THEN left({_DIGITS}, 2) || '.' || substr({_DIGITS}, 3, 3) ELSE '' END AS spec,
  'R' || coalesce(nullif(regexp_extract(head, '\\bV(\\d+)\\.\\d+\\.\\d+', 1), ''), nullif(regexp_extract(head, '{tx.RELEASE_LINE}', 1), ''), '18') AS release FROM h)
SELECT id, CASE WHEN kind = 'unknown' THEN 'other/' || x WHEN kind = 'oran' AND md THEN 'marked/ORAN/' || stem || '/raw.md' WHEN kind = 'oran' THEN 'original/ORAN/' || x
  WHEN spec = '' THEN CASE WHEN md THEN 'marked/' ELSE 'original/' END || x WHEN md THEN 'marked/' || release || '/' || left(spec, 2) || '_series/' || replace(spec, '.', '') || '/raw.md' ELSE 'original/' || release || '/' || left(spec, 2) || '_series/' || x END AS target FROM k"""


SQL["upload_target"] = _upload_sql()
