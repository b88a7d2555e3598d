"""Queries of corpus analytics, ingestion, caches, feedback, traffic and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import cache, evaluation, filters, ingest, routing
from quarry.operators.embedding import centroids, route
from quarry.operators.numbering import numbered
from quarry.operators.ranking import positions
from quarry.plans.retrieval import C, R
from quarry.sources.chunks import chunks, ranked, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _summary(spark, d):
    """A row for each document: its first chunk's facts, and how many chunks it has."""
    facts = F.min_by(F.struct("spec_number", "release", "series", "doc_type"), "id")
    return chunks(spark, d).groupBy("doc_id").agg(facts.alias("f"), F.count(F.lit(1)).alias("n_chunks")).select("doc_id", "f.*", "n_chunks")


_SUM = """s AS (SELECT doc_id, arg_min(spec_number, id) AS spec_number, arg_min(release, id) AS release, arg_min(series, id) AS series, arg_min(doc_type, id) AS doc_type, count(*) AS n_chunks FROM chunks GROUP BY doc_id)"""


@query(f"{C}, {_SUM} SELECT * FROM s")
def documents_summary(spark, d):
    return _summary(spark, d)


@query(f"{C} SELECT id, chunk_index, text FROM chunks WHERE doc_id = 'd7' ORDER BY chunk_index")
def document_chunks(spark, d):
    return chunks(spark, d).filter("doc_id = 'd7'").select("id", "chunk_index", "text").orderBy("chunk_index").limit(10_000)


@query(f"{C} SELECT id, chunk_index, left(text, 500) AS excerpt FROM chunks WHERE spec_number = '22.201' ORDER BY chunk_index, id LIMIT 20")
def spec_content(spark, d):
    return chunks(spark, d).filter("spec_number = '22.201'").orderBy("chunk_index", "id").limit(20).select("id", "chunk_index", F.substring("text", 1, 500).alias("excerpt"))


@query(f"{C} SELECT c.id, c.spec_number FROM chunks c WHERE c.id IN (SELECT item_id * 3 FROM benchmark)")
def point_lookup(spark, d):
    """All wanted ids in one join, in the place of a lookup for each."""
    wanted = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("id"))
    return chunks(spark, d).select("id", "spec_number").join(wanted, "id", "left_semi")


@query(f"{C} SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM chunks")
def row_count(spark, d):
    return chunks(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"{C}, {_SUM} SELECT doc_id, spec_number, n_chunks, count(*) OVER () AS total FROM s WHERE series = 22 AND lower(release) = 'r15' ORDER BY doc_id LIMIT 10 OFFSET 1")
def documents_page(spark, d):
    rows = _summary(spark, d).filter("series = 22 and lower(release) = 'r15'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.select("doc_id", "spec_number", "n_chunks").orderBy("doc_id").offset(1).limit(10).crossJoin(F.broadcast(total))  # one row of totals


@query(f"{C}, {_SUM} SELECT doc_id, spec_number, release, n_chunks FROM s WHERE doc_id = 'd11'")
def document_detail(spark, d):
    return _summary(spark, d).filter("doc_id = 'd11'").select("doc_id", "spec_number", "release", "n_chunks")


@query(f"{C}, {_SUM} SELECT release, count(*) AS n_docs FROM s WHERE doc_type = '3gpp' GROUP BY release")
def corpus_stats_release(spark, d):
    return _summary(spark, d).filter("doc_type = '3gpp'").groupBy("release").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"{C} SELECT series, count(*) AS n_chunks FROM chunks WHERE series > 0 GROUP BY series")
def corpus_stats_series(spark, d):
    return chunks(spark, d).filter("series > 0").groupBy("series").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"{C}, {_SUM} SELECT doc_type, count(*) AS n_docs FROM s GROUP BY doc_type")
def corpus_stats_doctype(spark, d):
    return _summary(spark, d).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"{C} SELECT release, series, count(*) AS n, max(id) AS last_id FROM chunks GROUP BY GROUPING SETS ((release), (series))")
def admin_stats(spark, d):
    return spark.sql("SELECT release, series, count(*) AS n, max(id) AS last_id FROM {c} GROUP BY GROUPING SETS ((release), (series))", c=chunks(spark, d))


@query(f"{C} SELECT release, count(DISTINCT spec_number) AS n_specs, count(DISTINCT series) AS n_series, count(*) AS n_chunks FROM chunks GROUP BY release")
def list_releases(spark, d):
    return chunks(spark, d).groupBy("release").agg(F.count_distinct("spec_number").alias("n_specs"), F.count_distinct("series").alias("n_series"), F.count(F.lit(1)).alias("n_chunks"))


@query(f"{C} SELECT doc_type, count(*) AS n_left FROM chunks WHERE NOT (release = 'R18' AND doc_type = '3gpp') GROUP BY doc_type")
def delete_by_filter(spark, d):
    left = ingest.delete_where(chunks(spark, d), filters.user_filter("R18", None, "3gpp"))
    return left.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_left"))


_MAN = """man AS (SELECT 's' || (doc_id // 3) AS spec_number, 'R' || (15 + doc_id % 3) AS release, CASE doc_id % 4 WHEN 0 THEN 'i10' WHEN 1 THEN 'f60' WHEN 2 THEN '18.4.0' ELSE 'h30' END AS version, md5('a' || doc_id) AS sha256 FROM documents WHERE doc_id % 5 <> 0),
fil AS (SELECT 's' || (doc_id // 3) AS spec_number, 'R' || (15 + doc_id % 3) AS release, CASE doc_id % 3 WHEN 0 THEN 'i20' WHEN 1 THEN 'f50' ELSE '18.5.0' END AS version, md5(CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END || doc_id) AS sha256 FROM documents WHERE doc_id % 7 <> 0)"""


def _named(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(k, F.concat(F.lit("s"), F.floor(k / 3).cast("string")).alias("spec_number"), F.concat(F.lit("R"), (15 + k % 3).cast("string")).alias("release"))


def _manifest(spark, d):
    k = F.col("doc_id")
    version = F.element_at(F.array(*[F.lit(x) for x in ("i10", "f60", "18.4.0", "h30")]), (k % 4 + 1).cast("int"))
    return _named(spark, d).filter("doc_id % 5 <> 0").select("spec_number", "release", version.alias("version"), F.md5(F.concat(F.lit("a"), k.cast("string"))).alias("sha256"))


def _files(spark, d):
    k = F.col("doc_id")
    version = F.element_at(F.array(*[F.lit(x) for x in ("i20", "f50", "18.5.0")]), (k % 3 + 1).cast("int"))
    return _named(spark, d).filter("doc_id % 7 <> 0").select("spec_number", "release", version.alias("version"), F.md5(F.concat(F.when(k % 2 == 0, "a").otherwise("b"), k.cast("string"))).alias("sha256"))


_NUM = "coalesce(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), '')::bigint, 0)"


@query(f"""WITH {_MAN} SELECT coalesce(m.spec_number, f.spec_number) AS spec_number, coalesce(m.release, f.release) AS release,
  CASE WHEN m.spec_number IS NULL THEN 'new' WHEN f.spec_number IS NULL THEN 'deleted' WHEN m.sha256 = f.sha256 THEN 'skipped'
  WHEN {_NUM.format('f.version')} > {_NUM.format('m.version')} OR ({_NUM.format('f.version')} = {_NUM.format('m.version')} AND f.version > m.version) THEN 'replaced' ELSE 'skipped_changed' END AS status
FROM man m FULL JOIN fil f ON m.spec_number = f.spec_number AND m.release = f.release""")
def manifest_diff(spark, d):
    return ingest.manifest_diff(_manifest(spark, d), _files(spark, d))


@query(f"WITH {_MAN} SELECT spec_number, release FROM man m WHERE NOT EXISTS (SELECT 1 FROM fil f WHERE f.spec_number = m.spec_number AND f.release = m.release)")
def manifest_orphans(spark, d):
    return ingest.orphans(_manifest(spark, d), _files(spark, d)).select("spec_number", "release")


@query(f"WITH {_MAN} SELECT status, count(*) AS n FROM (SELECT CASE WHEN m.spec_number IS NULL THEN 'added' WHEN f.spec_number IS NULL THEN 'removed' ELSE 'both' END AS status FROM man m FULL JOIN fil f ON m.spec_number = f.spec_number AND m.release = f.release) GROUP BY status")
def ingest_counters(spark, d):
    status = F.col("status")
    kind = F.when(status == "new", "added").when(status == "deleted", "removed").otherwise("both")
    return ingest.manifest_diff(_manifest(spark, d), _files(spark, d)).groupBy(kind.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT 'u' || user_id AS k, floor(epoch(ts))::bigint AS moment, event_id AS v, 0 AS late FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'u' || user_id, floor(epoch(ts))::bigint, -event_id, 1 FROM events WHERE event_id % 3 = 0)
SELECT k, moment, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY moment DESC, late DESC, v) AS n FROM u) WHERE n = 1""")
def manifest_upsert(spark, d):
    from quarry.operators.ranking import positions

    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("moment"))
    old, new = rows.filter("event_id % 3 <> 0").withColumn("v", F.col("event_id")), rows.filter("event_id % 3 = 0").withColumn("v", -F.col("event_id"))
    one = lambda x: positions(x, F.desc("moment"), F.asc("v"), by=["k"], pos="_m").filter("_m = 1").drop("_m", "event_id")
    return ingest.upsert(one(old), one(new), ["k"], "moment")


_CACHE = "cache AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE doc_id % 2 = 0)"


@query(f"WITH {_CACHE} SELECT doc_id AS place, sha256(text) AS text_hash, c.text_hash IS NOT NULL AS hit FROM documents d LEFT JOIN cache c ON c.text_hash = sha256(d.text)")
def cache_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.sha2("text", 256).alias("text_hash"))
    return ingest.lookup(docs, docs.filter("place % 2 = 0").select("text_hash").distinct())


@query("""WITH p AS (SELECT sha256(text) AS text_hash, doc_id AS place, doc_id % 3 AS batch FROM documents) SELECT text_hash, max(place) AS created, count(DISTINCT batch) - 1 AS hit_count FROM p GROUP BY text_hash""")
def cache_upsert(spark, d):
    """Latest entry of each text, hit once for each further batch that asks for it."""
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash"), F.col("doc_id").alias("at"), (F.col("doc_id") % 3).alias("batch"))
    return rows.groupBy("text_hash").agg(F.max("at").alias("created"), (F.count_distinct("batch") - 1).alias("hit_count"))


@query("SELECT lang, count(*) AS entries, sum(strlen(text))::bigint AS bytes, round(sum(strlen(text)) / 1048576.0::double, 2) AS mb FROM documents GROUP BY lang")
def cache_stats(spark, d):
    size = F.sum(F.octet_length("text").cast("long"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("entries"), size.alias("bytes"), F.round(size / 1048576.0, 2).alias("mb"))


_FB = """fb AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 4 = 0 THEN 'down' ELSE 'up' END AS rating, ts, '[{"spec":"s' || (event_id % 23) || '","score":0.5},{"spec":"s' || (event_id % 7) || '","score":0.1}]' AS sources FROM events)"""


def _feedback(spark, d):
    k = F.col("event_id")
    sources = F.format_string('[{"spec":"s%d","score":0.5},{"spec":"s%d","score":0.1}]', k % 23, k % 7)
    return table(spark, d, "events").select(k.alias("id"), "user_id", F.when(k % 4 == 0, "down").otherwise("up").alias("rating"), "ts", sources.alias("sources"))


@query(f"WITH {_FB} SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, round(count(*) FILTER (rating = 'up') / count(*)::double, 4) AS up_ratio FROM fb")
def feedback_stats(spark, d):
    up, total = F.count_if(F.col("rating") == "up"), F.count(F.lit(1))
    return _feedback(spark, d).agg(total.alias("total"), up.alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.round(up / total, 4).alias("up_ratio"))


@query(f"WITH {_FB}, s AS (SELECT unnest(json_extract_string(sources, ['$[0].spec', '$[1].spec'])) AS spec FROM fb WHERE rating = 'down') SELECT spec, count(*) AS n FROM s GROUP BY spec ORDER BY n DESC, spec LIMIT 10")
def feedback_report_specs(spark, d):
    """The ten specifications most often cited by answers that were rated down (a report's top ten)."""
    parsed = F.from_json("sources", "array<struct<spec:string,score:double>>")
    return _feedback(spark, d).filter("rating = 'down'").select(F.explode(parsed).alias("s")).groupBy("s.spec").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "spec").limit(10)


@query(f"WITH {_FB} SELECT greatest(date_diff('day', min(ts)::date, max(ts)::date), 1) AS days, round(count(*) / greatest(date_diff('day', min(ts)::date, max(ts)::date), 1)::double, 4) AS per_day FROM fb")
def feedback_span(spark, d):
    days = F.greatest(F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))), F.lit(1))
    return _feedback(spark, d).agg(days.alias("days"), F.round(F.count(F.lit(1)) / days, 4).alias("per_day"))


@query(f"WITH {_FB} SELECT id, rating FROM fb WHERE rating = 'down' ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 20")
def feedback_page(spark, d):
    return _feedback(spark, d).filter("rating = 'down'").orderBy(F.desc("ts"), F.desc("id")).offset(20).limit(20).select("id", "rating")


@query("""SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER w) < 3600, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def ttl_hits(spark, d):
    """Whether a cache of an hour's life would have answered: the same question came less than an hour before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    return table(spark, d, "events").select("event_id", F.coalesce(seconds - F.lag(seconds).over(w) < 3600, F.lit(False)).alias("hit"))


_REQUESTS = """q AS (SELECT event_id AS request_id, user_id // 50 AS shard, event_type || (json_extract_string(props, '$.k')::bigint // 20) AS key, epoch_us(ts) / 1e6::double AS t FROM events)"""


@query(f"""WITH RECURSIVE {_REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY t, request_id) AS i FROM q),
run AS (
  SELECT shard, 0::bigint AS i, NULL::bigint AS request_id, false AS hit, NULL::varchar AS evicted, []::struct(k varchar, e double)[] AS held FROM (SELECT DISTINCT shard FROM q)
  UNION ALL
  SELECT shard, i, request_id, place IS NOT NULL AS hit, CASE WHEN place IS NULL AND len(live) = 4 THEN live[1].k END AS evicted,
    CASE WHEN place IS NOT NULL THEN list_append(list_filter(live, lambda x: x.k <> key), live[place]) ELSE list_append(CASE WHEN len(live) = 4 THEN live[2:] ELSE live END, {{'k': key, 'e': t + 3600}}) END AS held
  FROM (SELECT *, list_position(list_transform(live, lambda x: x.k), key) AS place FROM (SELECT n.shard, n.i, n.request_id, n.key, n.t, list_filter(run.held, lambda x: x.e > n.t) AS live FROM run JOIN n ON n.shard = run.shard AND n.i = run.i + 1)))
SELECT request_id, shard, hit, evicted FROM run WHERE i > 0""")
def bounded_cache(spark, d):
    """Requests through caches of four entries that live an hour, one for each fifty users: what is answered, and what goes to make room."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.floor(F.col("user_id") / 50).alias("shard"), F.concat("event_type", F.floor(k / 20).cast("string")).alias("key"), "ts")
    return cache.replay(rows, size=4)


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59.999999 SECONDS PRECEDING AND CURRENT ROW) AS offered FROM events""")
def rate_offered(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-59_999_999, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("offered"))


_BUCKETS = (1, 5, 10, 25, 50, 100, 250, 1000)


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (abs(value) <= {b}) AS le_{b}" for b in _BUCKETS) + ", count(*) AS n FROM events GROUP BY event_type")
def latency_histogram(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.abs("value") <= b).alias(f"le_{b}") for b in _BUCKETS], F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def traffic_minutes(spark, d):
    """Tumbling windows of a minute; the streaming form is in quarry.streaming."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("minute"), "event_type", "n", "total")


_EV = f"""{R}, res AS (SELECT query_id AS sample, pos AS rank, spec_number AS spec, section_number AS section, id % 4 AS relevance FROM ranked WHERE pos <= 20),
ex AS (SELECT DISTINCT query_id AS sample, spec_number AS spec, '§' || parent_section_id AS section FROM ranked WHERE parent_section_id <> '' AND (pos IN (2, 7) OR (pos BETWEEN 21 AND 22) OR pos = 15) AND query_id <> 3)"""


def _results(spark, d):
    return ranked(spark, d).filter("pos <= 20").select(F.col("query_id").alias("sample"), F.col("pos").alias("rank"), F.col("spec_number").alias("spec"), F.col("section_number").alias("section"), (F.col("id") % 4).alias("relevance"))


def _expected(spark, d):
    rows = ranked(spark, d).filter("parent_section_id <> '' and (pos in (2, 7, 15) or pos between 21 and 22) and query_id <> 3")
    return rows.select(F.col("query_id").alias("sample"), F.col("spec_number").alias("spec"), F.concat(F.lit("§"), "parent_section_id").alias("section")).distinct()


_HITS = "hits AS (SELECT r.sample, lower(r.spec) AS spec, min(rank) AS rank FROM res r JOIN (SELECT DISTINCT sample, lower(spec) AS spec FROM ex) e ON e.sample = r.sample AND e.spec = lower(r.spec) GROUP BY ALL)"
_RECALL = f"""{_HITS}, tot AS (SELECT sample, count(DISTINCT lower(spec)) AS n FROM ex GROUP BY sample),
rec AS (SELECT s.sample, k, round(coalesce((SELECT count(*) FROM hits h WHERE h.sample = s.sample AND h.rank <= k) / n::double, 1.0::double), 6) AS recall FROM (SELECT DISTINCT sample FROM res) s CROSS JOIN (SELECT unnest([5, 10, 20]) AS k) LEFT JOIN tot USING (sample))"""


@query(f"{_EV}, {_HITS} SELECT sample, spec, rank FROM hits")
def eval_ranks(spark, d):
    return evaluation.relevant_ranks(_results(spark, d), _expected(spark, d))


@query(f"{_EV}, {_RECALL} SELECT sample, k, recall FROM rec")
def eval_recall(spark, d):
    return evaluation.recall(_results(spark, d), _expected(spark, d))


_SEC = """sec AS (SELECT sample, round(avg(hit), 6) AS section_recall FROM (SELECT e.sample, e.spec, e.section, max((r.section IS NOT NULL)::int) AS hit FROM ex e LEFT JOIN res r ON r.sample = e.sample AND lower(r.spec) = lower(e.spec) AND rank <= 10 AND starts_with(r.section, replace(e.section, '§', '')) GROUP BY ALL) GROUP BY sample)"""


@query(f"{_EV}, {_SEC} SELECT * FROM sec")
def eval_section_recall(spark, d):
    return evaluation.section_recall(_results(spark, d), _expected(spark, d), 10)


@query(f"{_EV}, {_HITS} SELECT sample, round(coalesce(1.0::double / (SELECT min(rank) FROM hits h WHERE h.sample = s.sample), 0), 6) AS mrr FROM (SELECT DISTINCT sample FROM res) s")
def eval_mrr(spark, d):
    return evaluation.reciprocal_rank(_results(spark, d), _expected(spark, d))


_NDCG = """nd AS (SELECT sample, round(coalesce(sum(CASE WHEN rank <= 10 THEN (pow(2, relevance) - 1) / log2(rank + 1) END) / nullif(sum(CASE WHEN rank <= 10 THEN (pow(2, relevance) - 1) / log2(b + 1) END), 0), 0), 6) AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY sample, rank <= 10 ORDER BY relevance DESC, rank) AS b FROM res) GROUP BY sample)"""


@query(f"{_EV}, {_NDCG} SELECT * FROM nd")
def eval_ndcg(spark, d):
    return evaluation.ndcg(_results(spark, d), 10)


@query(f"""{_EV}, {_RECALL}, {_NDCG}, sc AS (SELECT sample, CASE sample % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, sample % 2 = 0 AS multi_hop, recall, ndcg FROM rec JOIN nd USING (sample) WHERE k = 10)
SELECT difficulty, multi_hop, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM sc GROUP BY GROUPING SETS ((), (difficulty), (multi_hop))""")
def eval_by_group(spark, d):
    rows = evaluation.recall(_results(spark, d), _expected(spark, d)).filter("k = 10").join(evaluation.ndcg(_results(spark, d), 10), "sample")
    kind = F.when(F.col("sample") % 3 == 0, "easy").when(F.col("sample") % 3 == 1, "medium").otherwise("hard")
    return evaluation.by_group(rows.withColumns({"difficulty": kind, "multi_hop": F.col("sample") % 2 == 0}), ["recall", "ndcg"])


_KINDS = "CASE sample % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, sample % 2 = 0 AS multi_hop"
_AT = [(name, k) for name in ("recall", "section", "initial") for k in (5, 10, 20)]
_REPORT = f"""{_EV}, pool AS (SELECT query_id AS sample, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank, spec_number AS spec FROM ranked),
ex3 AS (SELECT sample, lower(spec) AS spec, ltrim(lower(section), '§') AS section FROM ex),
smp AS (SELECT DISTINCT query_id AS sample FROM ranked),
one AS (SELECT e.sample, e.spec, (SELECT min(rank) FROM res r WHERE r.sample = e.sample AND lower(r.spec) = e.spec) AS recall,
    (SELECT min(rank) FROM res r JOIN ex3 x ON x.sample = r.sample AND x.spec = lower(r.spec) AND starts_with(lower(r.section), x.section) WHERE r.sample = e.sample AND x.spec = e.spec) AS section,
    (SELECT min(rank) FROM pool p WHERE p.sample = e.sample AND lower(p.spec) = e.spec) AS initial
  FROM (SELECT DISTINCT sample, spec FROM ex3) e),
gain AS (SELECT r.sample, r.rank, row_number() OVER (PARTITION BY r.sample ORDER BY r.rank) AS best FROM res r WHERE r.rank <= 10 AND lower(r.spec) IN (SELECT spec FROM ex3 x WHERE x.sample = r.sample)),
nd10 AS (SELECT sample, round(sum(1 / log2(rank + 1)) / sum(1 / log2(best + 1)), 6) AS ndcg_10 FROM gain GROUP BY sample),
shr AS (SELECT smp.sample, {", ".join(f"round(CASE WHEN count(spec) = 0 THEN 1.0::double ELSE count(*) FILTER ({n} <= {k}) / count(spec)::double END, 6) AS {n}_{k}" for n, k in _AT)}, round(coalesce(1.0::double / min(recall), 0), 6) AS mrr
  FROM smp LEFT JOIN one ON one.sample = smp.sample GROUP BY smp.sample),
scored AS (SELECT shr.*, coalesce(ndcg_10, 0.0::double) AS ndcg_10, {_KINDS.replace('sample', 'shr.sample')} FROM shr LEFT JOIN nd10 ON nd10.sample = shr.sample)"""


def _scored(spark, d):
    rows = ranked(spark, d)
    kind = F.when(F.col("sample") % 3 == 0, "easy").when(F.col("sample") % 3 == 1, "medium").otherwise("hard")
    samples = rows.select(F.col("query_id").alias("sample")).distinct().withColumns({"difficulty": kind, "multi_hop": F.col("sample") % 2 == 0})
    pool = positions(rows, F.desc("rerank_score"), F.asc("id"), pos="rank").select(F.col("query_id").alias("sample"), "rank", F.col("spec_number").alias("spec"))
    return evaluation.scores(samples, _results(spark, d), _expected(spark, d), pool)


@query(f"{_REPORT} SELECT * FROM scored")
def eval_scores(spark, d):
    """Every metric of each sample: of results, of their sections, and of the candidates before reranking."""
    return _scored(spark, d)


@query(f"""{_REPORT} SELECT CASE grouping(difficulty, multi_hop) WHEN 3 THEN 'all' WHEN 1 THEN 'difficulty' ELSE 'multi_hop' END AS level, difficulty, multi_hop, count(*) AS n, {", ".join(f"round(avg({n}_{k}), 6) AS {n}_{k}" for n, k in _AT)}, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10
FROM scored GROUP BY GROUPING SETS ((), (difficulty), (multi_hop))""")
def eval_report(spark, d):
    """The report of an evaluation: means of all samples, by difficulty and by hops."""
    return evaluation.report(_scored(spark, d))


@query(f"""{_REPORT}, mean AS (SELECT round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10 FROM scored),
lines AS (UNPIVOT mean ON recall_5, recall_10, recall_20, mrr, ndcg_10 INTO NAME metric VALUE value)
SELECT metric, value, target, value >= target AS reached FROM lines JOIN (VALUES ('recall_5', 0.8::double), ('recall_10', 0.85), ('recall_20', 0.9), ('mrr', 0.7), ('ndcg_10', 0.75)) t(metric, target) USING (metric)""")
def eval_targets(spark, d):
    return evaluation.report_lines(evaluation.report(_scored(spark, d)))


@query(f"""{R}, m AS (SELECT id, CASE WHEN contains(lower(text), 'the') THEN 'articles' WHEN contains(lower(text), 'der') THEN 'german' WHEN contains(lower(text), 'que') THEN 'romance' END AS label FROM ranked) SELECT label, count(*) AS n FROM m GROUP BY label""")
def expected_labels(spark, d):
    """Labels by the first keyword that a text contains."""
    low = F.lower("text")
    label = F.when(low.contains("the"), "articles").when(low.contains("der"), "german").when(low.contains("que"), "romance")
    return ranked(spark, d).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) SELECT vec_id, doc_id FROM a JOIN b USING (n)""")
def positional_zip(spark, d):
    """Vectors and texts aligned by place, each in order of id."""
    vectors = numbered(table(spark, d, "embeddings").select("vec_id"), "vec_id")
    return vectors.join(numbered(table(spark, d, "documents").select("doc_id"), "doc_id"), "n").select("vec_id", "doc_id")


@query("""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS centre FROM c GROUP BY label),
s AS (SELECT e.vec_id AS query_id, m.label, round(list_cosine_similarity(e.embedding::double[], m.centre), 6) AS score FROM embeddings e, m WHERE e.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS pos FROM s) WHERE pos <= 3""")
def route_series(spark, d):
    """The labels that a query vector is likeliest to belong to, by nearest centroid."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return route(rows.filter("query_id % 20 = 0").select("query_id", "vector"), centroids(rows), 3)


@query()
def route_network(spark, d):
    """The five labels that a network, fitted on a bounded sample, finds likeliest for each vector."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return routing.route(rows.select(F.col("id").alias("query_id"), "vector"), routing.fit(rows), 5)


@query(f"""WITH {_MAN}, st AS (SELECT coalesce(m.spec_number, f.spec_number) AS spec_number, coalesce(m.release, f.release) AS release, m.spec_number IS NULL AS is_new, f.spec_number IS NULL AS is_gone,
  coalesce(m.sha256 <> f.sha256, true) AND ({_NUM.format('f.version')} > {_NUM.format('m.version')} OR ({_NUM.format('f.version')} = {_NUM.format('m.version')} AND f.version > m.version)) AS is_higher
  FROM man m FULL JOIN fil f ON m.spec_number = f.spec_number AND m.release = f.release)
SELECT spec_number, release, version FROM man JOIN st USING (spec_number, release) WHERE NOT is_gone AND NOT coalesce(is_higher, false) UNION ALL SELECT spec_number, release, version FROM fil JOIN st USING (spec_number, release) WHERE is_new OR coalesce(is_higher, false)""")
def apply_changes(spark, d):
    old, new = _manifest(spark, d), _files(spark, d)
    return ingest.apply_changes(old, new, ingest.manifest_diff(old, new)).select("spec_number", "release", "version")


@query(f"{C} SELECT id FROM chunks WHERE id % 4 > 1 AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = chunks.id AND doc_id % 4 = 3)")
def resume_unfinished(spark, d):
    """What a resumed job has left: chunks whose key is not stored."""
    rows = chunks(spark, d)
    return ingest.unfinished(rows.filter("id % 4 > 1"), rows.filter("id % 4 = 3")).select("id")


@query(f"{C} SELECT spec_number, arg_max(doc_id, release || doc_id) AS latest FROM chunks GROUP BY spec_number")
def latest_per_spec(spark, d):
    return chunks(spark, d).groupBy("spec_number").agg(F.max_by("doc_id", F.concat("release", "doc_id")).alias("latest"))
