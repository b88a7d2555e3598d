"""Retrieval queries: ranking, fusion, filters and context, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import filters, ranking, search
from quarry.operators.ranking import positions
from quarry.operators.storage import folder, staged_path
from quarry.sources.chunks import CHUNKS_SQL, RANKED_SQL, chunks, ranked, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


R = f"WITH {RANKED_SQL}"
C = f"WITH {CHUNKS_SQL}"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    """Every benchmark item as a question, with its whole text."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_KEPT: dict[tuple[str, str], tuple[list, search.Bm25]] = {}


def _index(spark, d) -> search.Bm25:
    """The index of a folder's documents, built once in an application and searched from then on; built anew where the documents' files have changed or its own are gone."""
    key, state = (spark.sparkContext.applicationId, d), folder(spark, f"{d}/documents.parquet").state()
    kept = _KEPT.get(key)
    if kept is None or kept[0] != state or not kept[1].is_there():
        _KEPT[key] = kept = (state, search.bm25_build(_docs(spark, d)))
    return kept[1]


_TOKENS = r"regexp_extract_all(lower(text), '\d{2}\.\d{3}|[a-z0-9]+')"
BM25_SQL = f"""t AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
dl AS (SELECT id, len(t) AS dl FROM t), nd AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM t) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, nd GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN stats USING (term) JOIN post USING (term) JOIN dl USING (id), nd GROUP BY query_id, id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM hits WHERE score > 0)"""


@query(f"WITH {BM25_SQL} SELECT query_id, id, score, pos FROM bm WHERE pos <= 10")
def bm25_topk(spark, d):
    return search.bm25_search(_index(spark, d), _questions(spark, d), 10)


@query(f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_SQL} SELECT query_id, id, score, pos FROM bm WHERE pos <= 5")
def bm25_persisted(spark, d):
    """The index written as tables, opened again and searched."""
    path = staged_path(spark, "bm25")
    search.bm25_write(_index(spark, d), path)
    return search.bm25_search(search.bm25_read(spark, path), _questions(spark, d), 5)


@query(f"WITH {BM25_SQL} SELECT query_id, bm.id, score, pos FROM bm JOIN documents ON doc_id = bm.id WHERE pos <= 20 AND lang = 'en'")
def bm25_postfilter(spark, d):
    """The filter comes after the top k, so fewer may be left."""
    found = search.bm25_search(_index(spark, d), _questions(spark, d), 20)
    return found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").filter("lang = 'en'").select("query_id", "id", "score", "pos")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _dense_sql(where: str = "true", k: int = 10) -> str:
    return f"""sims AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(coalesce(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM sims) WHERE pos <= {k})"""


@query(f"WITH {_dense_sql()} SELECT * FROM dense")
def dense_topk(spark, d):
    return search.dense(_vectors(spark, d), _vector_queries(spark, d), 10)


@query(f"WITH {_dense_sql('e.label % 2 = 0')} SELECT * FROM dense")
def dense_topk_filtered(spark, d):
    """The filter comes before the search."""
    return search.dense(_vectors(spark, d).filter("label % 2 = 0"), _vector_queries(spark, d), 10)


_LISTS = """a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS ra FROM ranked WHERE id % 3 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rb FROM ranked WHERE id % 5 <> 0)"""


def _rrf_sql(kd: float, ks: float) -> str:
    return f"""{R}, {_LISTS}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, ra AS rank_dense, rb AS rank_sparse,
  round(coalesce(1.0::double / ({kd}::double + ra), 0) + coalesce(1.0::double / ({ks}::double + rb), 0), 9) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM f) WHERE pos <= 20"""


def _two_lists(spark, d):
    rows = ranked(spark, d)
    return rows.filter("id % 3 <> 0").select("query_id", "id", "score"), rows.filter("id % 5 <> 0").select("query_id", "id", F.col("rerank_score").alias("score"))


@query(_rrf_sql(60, 60))
def rrf_hybrid(spark, d):
    return ranking.reciprocal_rank_fusion(*_two_lists(spark, d), 20)


@query(_rrf_sql(40, 120))
def rrf_weighted(spark, d):
    return ranking.reciprocal_rank_fusion(*_two_lists(spark, d), 20, k_dense=40, k_sparse=120)


@query(f"""WITH {BM25_SQL}, {_dense_sql(k=20)}, s AS (SELECT * FROM bm WHERE pos <= 20), dd AS (SELECT * FROM dense),
f AS (SELECT coalesce(dd.query_id, s.query_id) AS query_id, coalesce(dd.id, s.id) AS id, dd.pos AS rank_dense, s.pos AS rank_sparse,
  round(coalesce(1.0::double / (60.0::double + dd.pos), 0) + coalesce(1.0::double / (60.0::double + s.pos), 0), 9) AS score FROM dd FULL JOIN s ON dd.query_id = s.query_id AND dd.id = s.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM f) WHERE pos <= 10""")
def hybrid_search(spark, d):
    """Vectors and words searched and fused; a query that one side alone has is answered by that side."""
    dense = search.dense(_vectors(spark, d), _vector_queries(spark, d), 20)
    sparse = search.bm25_search(_index(spark, d), _questions(spark, d), 20)
    return ranking.reciprocal_rank_fusion(dense, sparse, 10)


@query(f"""{R}, n AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS sl, max(score) OVER w AS sh, min(rerank_score) OVER w AS rl, max(rerank_score) OVER w AS rh FROM ranked WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, CASE WHEN n > 20 THEN round(0.6 * (CASE WHEN rh > rl THEN (rerank_score - rl) / (rh - rl) ELSE 0.5 END) + 0.4 * (CASE WHEN sh > sl THEN (score - sl) / (sh - sl) ELSE 0.5 END), 9) ELSE score END AS score FROM n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM f) WHERE pos <= 20""")
def rerank_fusion(spark, d):
    return ranking.rerank_fusion(ranked(spark, d), 20).select("query_id", "id", "score", "pos")


@query(f"""{R}, b AS (SELECT query_id, id, pos, round(score * (CASE WHEN spec_role = 'authoritative' THEN 1.3 ELSE 1.0 END)::double * (CASE WHEN content_type IN ('parameter_table', 'definition') THEN 1.2 ELSE 1.0 END)::double, 9) AS score FROM ranked)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS pos FROM b""")
def metadata_boost(spark, d):
    return ranking.metadata_boost(ranked(spark, d)).select("query_id", "id", "score", "pos")


@query(f"""{R}, res AS (SELECT * FROM ranked WHERE pos <= 10), h AS (SELECT DISTINCT query_id, spec_number FROM ranked WHERE pos BETWEEN 9 AND 12),
hn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spec_number) AS h FROM h),
e AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.spec_number ORDER BY score DESC, id) AS e FROM ranked r JOIN hn ON hn.query_id = r.query_id AND hn.spec_number = r.spec_number AND h <= 3),
x AS (SELECT query_id, id, spec_number, score * 2.0 AS score, 'spec_aware' AS source_tag FROM e WHERE e <= 5 AND NOT EXISTS (SELECT 1 FROM res WHERE res.query_id = e.query_id AND res.id = e.id)),
m AS (SELECT res.query_id, id, res.spec_number, CASE WHEN hn.h IS NOT NULL THEN score * 2.0 ELSE score END AS score, source_tag FROM res LEFT JOIN hn ON hn.query_id = res.query_id AND hn.spec_number = res.spec_number)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM (SELECT * FROM m UNION ALL SELECT * FROM x)""")
def spec_aware(spark, d):
    rows = ranked(spark, d)
    return ranking.spec_aware(rows.filter("pos <= 10"), rows, rows.filter("pos between 9 and 12").select("query_id", "spec_number"))


@query(f"""{R}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, spec_number ORDER BY pos) > 2 AS late FROM ranked)
SELECT query_id, id, spec_number, row_number() OVER (PARTITION BY query_id ORDER BY late, pos) AS new_pos FROM n""")
def diversify(spark, d):
    return ranking.diversify(ranked(spark, d)).select("query_id", "id", "spec_number", "new_pos")


_FIT = """o AS (SELECT * FROM ranked WHERE pos <= 10), lim AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM o GROUP BY query_id),
fit AS (SELECT s.query_id, id, s.pos, CASE WHEN max(s.score) OVER w > min(s.score) OVER w THEN round(lo + (s.score - min(s.score) OVER w) / (max(s.score) OVER w - min(s.score) OVER w) * (hi - lo), 9) ELSE round((lo + hi) / 2, 9) END AS score
  FROM (SELECT query_id, id, pos, rerank_score / 30.0::double AS score FROM ranked WHERE pos BETWEEN {0} AND 20) s JOIN lim USING (query_id) {1} WINDOW w AS (PARTITION BY s.query_id))"""


def _supplement(spark, d, first: int):
    return ranked(spark, d).filter(f"pos between {first} and 20").withColumn("score", F.col("rerank_score") / 30.0)


@query(f"{R}, {_FIT.format(11, '')} SELECT query_id, id, score FROM fit")
def supplement_norm(spark, d):
    return ranking.fit_supplement(_supplement(spark, d, 11), ranked(spark, d).filter("pos <= 10")).select("query_id", "id", "score")


@query(f"""{R}, {_FIT.format(6, 'WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = s.query_id AND o.id = s.id)')},
u AS (SELECT query_id, id, score, source_tag, pos, 0 AS late FROM o UNION ALL SELECT query_id, id, score, 'multi_hop', pos, 1 FROM fit)
SELECT query_id, id, score, source_tag, row_number() OVER (PARTITION BY query_id ORDER BY late, pos, id) AS pos FROM u""")
def merge_results(spark, d):
    columns = ["query_id", "id", "score", "source_tag", "pos"]
    return ranking.merge_supplement(ranked(spark, d).filter("pos <= 10").select(*columns), _supplement(spark, d, 6).select(*columns))


@query(f"{R} SELECT query_id, id, pos, round(1.0::double / (60 + pos), 9) AS score FROM ranked WHERE pos <= 10")
def graph_rank_score(spark, d):
    return ranking.rank_score(ranked(spark, d).filter("pos <= 10")).select("query_id", "id", "pos", F.round("score", 9).alias("score"))


_CASES = (("R18", 22, None), ("R16", None, "3gpp"), (None, None, "oran"), (None, 25, None), (None, None, None))


def _case_sql() -> str:
    parts = []
    for i, (r, s, t) in enumerate(_CASES):
        bound = " AND ".join(x for x in (f"release = '{r}'" if r else "", f"series = {s}" if s else "", "doc_type = '3gpp'") if x)
        where = "doc_type = 'oran'" if t == "oran" else bound if t == "3gpp" else f"(({bound}) OR doc_type = 'oran')" if r or s else "true"
        parts.append(f"SELECT {i} AS filter_id, id FROM chunks WHERE {where}")
    return f"{C} " + " UNION ALL ".join(parts)


@query(_case_sql())
def filter_scalar(spark, d):
    rows = chunks(spark, d)
    hits = F.array(*[F.when(filters.user_filter(*c), F.lit(i)) for i, c in enumerate(_CASES)])
    return rows.select("id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("filter_id")).select("filter_id", "id")


def _like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_BODY, _HEAD = "trim(coalesce(text, ''))", "lower(coalesce(parent_title, ''))"
LOW_SQL = f"""(({_like(_HEAD, filters.TITLE_WORDS)} AND NOT {_like(_HEAD, filters.TITLE_EXEMPT)}) OR {" OR ".join(f"starts_with({_BODY}, '{p}')" for p in filters.STRUCTURAL)}
  OR (length({_BODY}) < 50 AND {_like(_BODY, filters.SHORT_WORDS)}) OR (parent_section_id IN ('1', '2', '3') AND {_like(_HEAD, filters.TOP_TITLES)}))"""
_LOW_ROWS = """SELECT * REPLACE (CASE id % 9 WHEN 0 THEN '#  Contents of ' || id WHEN 1 THEN 'Scope ' || id ELSE text END AS text, CASE WHEN id % 7 = 0 THEN cast(1 + id % 4 AS varchar) ELSE parent_section_id END AS parent_section_id)"""


def _low_rows(rows):
    k = F.col("id")
    text = F.when(k % 9 == 0, F.concat(F.lit("#  Contents of "), k.cast("string"))).when(k % 9 == 1, F.concat(F.lit("Scope "), k.cast("string"))).otherwise(F.col("text"))
    return rows.withColumns({"text": text, "parent_section_id": F.when(k % 7 == 0, (1 + k % 4).cast("string")).otherwise(F.col("parent_section_id"))})


@query(f"{C}, x AS ({_LOW_ROWS} FROM chunks) SELECT id, {LOW_SQL} AS is_low FROM x")
def low_quality_flag(spark, d):
    return _low_rows(chunks(spark, d)).select("id", filters.is_low_quality().alias("is_low"))


@query(f"""{R}, x AS ({_LOW_ROWS} FROM ranked), y AS (SELECT query_id, id, pos, {LOW_SQL} AS is_low FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_low, pos) AS new_pos FROM y)
SELECT query_id, id, is_low, new_pos FROM z WHERE new_pos <= 20""")
def low_quality_backfill(spark, d):
    return filters.backfill(_low_rows(ranked(spark, d)), 20).select("query_id", "id", "is_low", "new_pos")


@query(f"""{R}, p AS (SELECT query_id, quantile_cont(score, 0.25) AS least FROM ranked WHERE source_tag IS NULL GROUP BY query_id)
SELECT query_id, id, score FROM ranked LEFT JOIN p USING (query_id) WHERE CASE WHEN source_tag IS NOT NULL THEN score > 0 ELSE score >= coalesce(least, 0) END""")
def noise_filter(spark, d):
    return filters.noise(ranked(spark, d)).select("query_id", "id", "score")


@query(f"""{R}, m AS (SELECT *, max((score >= 0.999)::int) OVER (PARTITION BY query_id) AS any_hit FROM ranked) SELECT query_id, id FROM m WHERE score >= 0.999 OR any_hit = 0""")
def noise_filter_absolute(spark, d):
    return filters.noise_absolute(ranked(spark, d), 0.999).select("query_id", "id")


@query(f"{C} SELECT id, release FROM chunks WHERE upper(release) = 'R18'")
def release_filter(spark, d):
    return filters.by_release(chunks(spark, d), "r18").select("id", "release")


@query(f"""{R}, m AS (SELECT *, CASE upper(release) WHEN 'R17' THEN 0 WHEN 'R18' THEN 1 END AS p FROM ranked WHERE pos <= 30), n AS (SELECT *, count(p) OVER (PARTITION BY query_id) AS n FROM m)
SELECT query_id, id, CASE WHEN p IS NOT NULL THEN release END AS compare_release, row_number() OVER (PARTITION BY query_id ORDER BY p NULLS FIRST, pos) AS new_pos FROM n WHERE p IS NOT NULL OR n = 0""")
def release_compare(spark, d):
    return filters.release_context(ranked(spark, d).filter("pos <= 30"), ["R17", "R18"]).select("query_id", "id", "compare_release", "new_pos")


@query(f"{R}, m AS (SELECT *, max((release = 'R18')::int) OVER (PARTITION BY query_id) AS any_hit FROM ranked WHERE pos <= 5) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS new_pos FROM m WHERE release = 'R18' OR any_hit = 0")
def release_single(spark, d):
    return filters.release_context(ranked(spark, d).filter("pos <= 5"), ["R18"]).select("query_id", "id", "new_pos")


@query(f"{R} SELECT query_id, CASE WHEN id % 13 = 0 THEN 'UNKNOWN' ELSE upper(release) END AS release, count(*) AS n, min(pos) AS first_pos FROM ranked GROUP BY ALL")
def release_groups(spark, d):
    name = F.coalesce(F.nullif(F.upper(F.when(F.col("id") % 13 == 0, "").otherwise(F.col("release"))), F.lit("")), F.lit("UNKNOWN"))
    return ranked(spark, d).groupBy("query_id", name.alias("release")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


_QUALITY = """q AS (SELECT query_id, count(*) AS n, avg(score) AS density, count(DISTINCT nullif(spec_number, '')) / count(*)::double AS diversity,
  count(DISTINCT CASE WHEN parent_section_id <> '' THEN len(string_split(parent_section_id, '.')) END) AS coverage, CASE WHEN avg(score) > 0 THEN arg_min(score, pos) / avg(score) ELSE 0 END AS confidence FROM ranked WHERE pos <= 20 GROUP BY query_id)"""


def _quality(spark, d):
    depth = F.when(F.col("parent_section_id") != "", F.size(F.split("parent_section_id", r"\.")))
    mean = F.avg("score")
    return ranked(spark, d).filter("pos <= 20").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), mean.alias("density"), (F.count_distinct(F.nullif(F.col("spec_number"), F.lit(""))) / F.count(F.lit(1))).alias("diversity"),
        F.count_distinct(depth).alias("coverage"), F.when(mean > 0, F.min_by("score", "pos") / mean).otherwise(0.0).alias("confidence"),
    )


@query(f"{R}, {_QUALITY} SELECT query_id, n, round(density, 6) AS density, round(diversity, 6) AS diversity, coverage, round(confidence, 6) AS confidence FROM q")
def quality_score(spark, d):
    return _quality(spark, d).select("query_id", "n", F.round("density", 6).alias("density"), F.round("diversity", 6).alias("diversity"), "coverage", F.round("confidence", 6).alias("confidence"))


@query(f"""{R}, {_QUALITY} SELECT query_id, density < 0.5 AS should_rewrite, diversity < 0.3 AS should_expand, coverage < 3 AND n >= 3 AS should_suggest,
  (density < 0.5)::int + (diversity < 0.3)::int + (coverage < 3)::int <= 1 AS overall_ok FROM q""")
def quality_action(spark, d):
    low = [F.col("density") < 0.5, F.col("diversity") < 0.3, F.col("coverage") < 3]
    return _quality(spark, d).select("query_id", low[0].alias("should_rewrite"), low[1].alias("should_expand"), (low[2] & (F.col("n") >= 3)).alias("should_suggest"), (sum(x.cast("int") for x in low) <= 1).alias("overall_ok"))


@query(f"{R} SELECT query_id, round(avg(CASE WHEN score < 0.4 THEN 1.0 ELSE 0.0 END::double), 6) AS noise_ratio FROM ranked WHERE pos <= 50 GROUP BY query_id")
def noise_ratio(spark, d):
    return ranked(spark, d).filter("pos <= 50").groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("score") < 0.4, 1.0).otherwise(0.0)), F.lit(1.0)), 6).alias("noise_ratio"))


@query(f"""{R} SELECT query_id, count(*) >= 3 AND count(DISTINCT nullif(spec_number, '')) / count(*)::double <= 0.25 AS trigger FROM ranked WHERE pos <= 40 GROUP BY query_id""")
def multi_hop_trigger(spark, d):
    n = F.count(F.lit(1))
    return ranked(spark, d).filter("pos <= 40").groupBy("query_id").agg(((n >= 3) & (F.count_distinct(F.nullif(F.col("spec_number"), F.lit(""))) / n <= 0.25)).alias("trigger"))


@query(f"{R} SELECT query_id, round(coalesce(max(score), 0), 6) AS best, count(*) AS n, coalesce(max(score), 0) < 0.6 OR count(*) < 5 AS trigger FROM ranked WHERE pos <= 3 + query_id GROUP BY query_id")
def online_trigger(spark, d):
    best, n = F.coalesce(F.max("score"), F.lit(0.0)), F.count(F.lit(1))
    return ranked(spark, d).filter("pos <= 3 + query_id").groupBy("query_id").agg(F.round(best, 6).alias("best"), n.alias("n"), ((n == 0) | (best < 0.6) | (n < 5)).alias("trigger"))


@query(f"{R} SELECT query_id, round(max(score), 6) AS best, round(avg(score), 6) AS mean, sum(length(text)) // 4 AS tokens FROM ranked WHERE pos <= 20 GROUP BY query_id")
def score_stats(spark, d):
    return ranked(spark, d).filter("pos <= 20").groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"), F.floor(F.sum(F.length("text").cast("long")) / 4).cast("long").alias("tokens"))


@query(f"{R} SELECT query_id, id, pos FROM ranked WHERE pos <= 5")
def batch_search(spark, d):
    """All queries in one job: a window by query in the place of a search for each."""
    return ranking.top(ranked(spark, d), 5).select("query_id", "id", "pos")


@query(f"{R} SELECT query_id, count(*) AS n FROM ranked WHERE spec_number = '22.201' GROUP BY query_id")
def search_count(spark, d):
    return ranked(spark, d).filter("spec_number = '22.201'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{R}, s AS (SELECT query_id // 4 AS parent, query_id % 4 AS sub, id, score, pos FROM ranked WHERE pos <= 10), o AS (SELECT parent, id FROM s WHERE sub = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY parent, id ORDER BY sub, pos) AS k FROM (SELECT parent, sub, id % 50 AS id, score, pos FROM s WHERE sub > 0) y WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.parent = y.parent AND o.id = y.id))
SELECT parent, sub, id, row_number() OVER (PARTITION BY parent ORDER BY sub, pos, id) AS new_pos FROM x WHERE k = 1""")
def taxonomy_supplement(spark, d):
    """What sub-queries add to a query's results: the first of each unseen id, in order of sub-query."""
    rows = ranked(spark, d).filter("pos <= 10").select(F.floor(F.col("query_id") / 4).cast("long").alias("parent"), (F.col("query_id") % 4).alias("sub"), "id", "score", "pos")
    own = rows.filter("sub = 0").select("parent", "id")
    extra = rows.filter("sub > 0").withColumn("id", F.col("id") % 50).join(own, ["parent", "id"], "left_anti")
    first = positions(extra, F.asc("sub"), F.asc("pos"), by=["parent", "id"], pos="k").filter("k = 1")
    return positions(first, F.asc("sub"), F.asc("pos"), F.asc("id"), by=["parent"], pos="new_pos").select("parent", "sub", "id", "new_pos")


@query(f"""{R}, h AS (SELECT * FROM ranked WHERE pos <= 5)
SELECT h.query_id, h.id, c.id AS neighbour_id, c.chunk_index - h.chunk_index AS distance FROM h JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2 AND c.chunk_index <> h.chunk_index""")
def adjacent_chunks(spark, d):
    hits = ranked(spark, d).filter("pos <= 5").select("query_id", "id", "doc_id", F.col("chunk_index").alias("at"))
    near = chunks(spark, d).select(F.col("id").alias("neighbour_id"), "doc_id", "chunk_index")
    distance = F.col("chunk_index") - F.col("at")
    return hits.join(near, "doc_id").filter(distance.between(-2, 2) & (distance != 0)).select("query_id", "id", "neighbour_id", distance.alias("distance"))


@query(f"""{R}, h AS (SELECT * FROM ranked WHERE pos <= 5)
SELECT h.query_id, h.id, list(c.id ORDER BY c.chunk_index) AS neighbours FROM h JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2 AND c.chunk_index <> h.chunk_index GROUP BY h.query_id, h.id""")
def adjacent_contexts(spark, d):
    pairs = adjacent_chunks(spark, d)
    return pairs.groupBy("query_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), lambda x: x.neighbour_id).alias("neighbours"))


@query(f"""{R}, p AS (SELECT query_id, id, pos, text, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN left(text, 40) ELSE text || ' and more' END AS parent FROM ranked WHERE pos <= 12)
SELECT query_id, id, CASE WHEN pos <= 10 AND parent <> '' AND NOT contains(text, parent) THEN left(parent, 1500) END AS parent_context FROM p""")
def parent_context(spark, d):
    k = F.col("id") % 3
    parent = F.when(k == 0, "").when(k == 1, F.substring("text", 1, 40)).otherwise(F.concat("text", F.lit(" and more")))
    rows = ranked(spark, d).filter("pos <= 12").withColumn("parent", parent)
    fit = (F.col("pos") <= 10) & (F.col("parent") != "") & ~F.contains(F.col("text"), F.col("parent"))
    return rows.select("query_id", "id", F.when(fit, F.substring("parent", 1, 1500)).alias("parent_context"))


@query(f"{R} SELECT query_id, id, left(text, 500) AS excerpt, round(score, 4) AS score FROM ranked WHERE pos <= 10")
def api_projection(spark, d):
    return ranked(spark, d).filter("pos <= 10").select("query_id", "id", F.substring("text", 1, 500).alias("excerpt"), F.round("score", 4).alias("score"))


@query(f"""{R} SELECT query_id, string_agg('[' || spec_number || ' §' || section_number || ' ' || left(parent_title, 40) || '] ' || trim(replace(left(text, 150), chr(10), ' ')), chr(10) ORDER BY pos) AS summary FROM ranked WHERE pos <= 10 GROUP BY query_id""")
def chunk_summary(spark, d):
    line = F.concat(F.lit("["), "spec_number", F.lit(" §"), "section_number", F.lit(" "), F.substring("parent_title", 1, 40), F.lit("] "), F.trim(F.translate(F.substring("text", 1, 150), "\n", " ")))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return ranked(spark, d).filter("pos <= 10").groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x.line), "\n").alias("summary"))


@query(f"""{R} SELECT query_id, id, '[' || CASE WHEN doc_type = 'oran' THEN 'O-RAN' ELSE '3GPP' END || '] ' || spec_number || ' (' || release || ')' || CASE WHEN parent_section_id <> '' THEN ' §' || parent_section_id ELSE '' END || chr(10) || text AS context FROM ranked WHERE pos <= 3""")
def context_string(spark, d):
    section = F.when(F.col("parent_section_id") != "", F.concat(F.lit(" §"), "parent_section_id")).otherwise("")
    kind = F.when(F.col("doc_type") == "oran", "O-RAN").otherwise("3GPP")
    return ranked(spark, d).filter("pos <= 3").select("query_id", "id", F.concat(F.lit("["), kind, F.lit("] "), "spec_number", F.lit(" ("), "release", F.lit(")"), section, F.lit("\n"), "text").alias("context"))


@query("""SELECT label, count(*) AS n, sum(CASE WHEN list_sum(list_transform(embedding, lambda x: x::double * x::double)) < 1e-16 THEN 1 ELSE 0 END)::bigint AS n_zero, sum(CASE WHEN len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 1 ELSE 0 END)::bigint AS n_nan FROM embeddings GROUP BY label""")
def embedding_qa(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(norm < 1e-8).alias("n_zero"), F.count_if(F.exists("embedding", F.isnan)).alias("n_nan"))


@query(f"""{R}, a AS (SELECT query_id, arg_min(spec_number, pos) AS top_a FROM ranked GROUP BY query_id),
b AS (SELECT query_id, arg_max(spec_number, {{'s': rerank_score, 'i': -id}}) AS top_b FROM ranked GROUP BY query_id)
SELECT query_id, top_a, top_b, top_a = top_b AS agree FROM a JOIN b USING (query_id)""")
def model_compare(spark, d):
    """The best specification by either of two scores."""
    found = ranked(spark, d).groupBy("query_id").agg(F.min_by("spec_number", "pos").alias("top_a"), F.max_by("spec_number", F.struct("rerank_score", -F.col("id"))).alias("top_b"))
    return found.withColumn("agree", F.col("top_a") == F.col("top_b"))


@query(f"""{R}, e AS (SELECT id AS src, (id * 37 + k * 11) % (SELECT max(doc_id) + 1 FROM documents) AS dst, k FROM chunks, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k)),
h AS (SELECT query_id, id, spec_number, pos FROM ranked WHERE pos <= 10), x AS (SELECT h.query_id, h.pos, e.k, e.dst, h.spec_number FROM h JOIN e ON e.src = h.id AND e.k < 5),
y AS (SELECT x.query_id, x.dst AS id, x.pos, x.k FROM x JOIN chunks c ON c.id = x.dst WHERE c.spec_number <> x.spec_number AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = x.query_id AND h.id = x.dst)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pos, k) AS n FROM y), w AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos, k) AS rank FROM z WHERE n = 1)
SELECT query_id, id, rank, round(1.0::double / (60 + rank), 9) AS score FROM w""")
def graph_expand(spark, d):
    """Targets of the first hits' references: five of each, in other specifications, unseen, in order of discovery."""
    from quarry.operators.graph import expand

    top_id = table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("m"))
    nodes = chunks(spark, d).select("id", "spec_number")
    edges = nodes.crossJoin(F.broadcast(top_id)).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("place"), "m").select("src", "place", ((F.col("src") * 37 + F.col("place") * 11) % F.col("m")).alias("dst"))
    return expand(ranked(spark, d).filter("pos <= 10"), edges, nodes)
