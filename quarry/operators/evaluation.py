"""Retrieval metrics by sample, over results (sample, rank, spec, section, relevance) and expectations."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard
from .storage import stage as settled

KS = (5, 10, 20)
# What a report's means are held against.
TARGETS = {"recall_5": 0.80, "recall_10": 0.85, "recall_20": 0.90, "mrr": 0.70, "ndcg_10": 0.75}


def relevant_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """The first rank of each expected specification that was found, in any case."""
    want = expected.select("sample", F.lower("spec").alias("_s")).distinct()
    return results.withColumn("_s", F.lower("spec")).join(want, ["sample", "_s"]).groupBy("sample", F.col("_s").alias("spec")).agg(F.min("rank").alias("rank"))


def recall(results: DataFrame, expected: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(sample, k, recall): distinct hits of distinct expected specifications; 1 where nothing is expected."""
    hits = relevant_ranks(results, expected)
    total = expected.groupBy("sample").agg(F.count_distinct(F.lower("spec")).alias("n"))
    per = total.join(hits, "sample", "left").groupBy("sample").agg(F.first("n").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    rows = results.select("sample").distinct().join(per, "sample", "left")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.coalesce(F.col(f"h{k}") / F.col("n"), F.lit(1.0)), 6).alias("recall")) for k in ks])
    return rows.select("sample", F.explode(each).alias("e")).select("sample", "e.*")


def section_recall(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """The share of expected (sample, spec, section) of which a result has the specification and a section that starts so."""
    want = expected.select("sample", F.lower("spec").alias("_s"), F.ltrim(F.replace("section", F.lit("§"), F.lit(""))).alias("want")).distinct()
    got = results.filter(F.col("rank") <= k).select("sample", F.lower("spec").alias("_s"), "section")
    hit = want.join(got, ["sample", "_s"], "left").groupBy("sample", "_s", "want").agg(F.max(F.coalesce(F.startswith(F.col("section"), F.col("want")), F.lit(False)).cast("int")).alias("hit"))
    return hit.groupBy("sample").agg(F.round(F.avg("hit"), 6).alias("section_recall"))


def reciprocal_rank(results: DataFrame, expected: DataFrame) -> DataFrame:
    best = relevant_ranks(results, expected).groupBy("sample").agg(F.min("rank").alias("best"))
    return results.select("sample").distinct().join(best, "sample", "left").select("sample", F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def ndcg(results: DataFrame, k: int, *, textbook: bool = False) -> DataFrame:
    """NDCG at k of results with relevance; the ideal is the retrieved relevance in its best order, at k (or of all, textbook)."""
    gain = lambda r: F.pow(F.lit(2.0), r) - 1
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "relevance"))), lambda x: x.relevance)
    lists = results.groupBy("sample").agg(rows.alias("rel"))
    best = F.sort_array("rel", asc=False) if textbook else F.sort_array(F.slice("rel", 1, k), asc=False)
    dcg = lambda rel: F.aggregate(F.transform(F.slice(rel, 1, k), lambda r, i: gain(r) / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    return lists.select("sample", F.round(F.coalesce(F.try_divide(dcg(F.col("rel")), dcg(best)), F.lit(0.0)), 6).alias("ndcg"))


def by_group(scores: DataFrame, values: Sequence[str]) -> DataFrame:
    """Means over all samples, by difficulty and by hops, in one pass over grouping sets."""
    means = ", ".join(f"round(avg({v}), 6) AS {v}" for v in values)
    return scores.sparkSession.sql(f"SELECT difficulty, multi_hop, count(*) AS n, {means} FROM {{scores}} GROUP BY GROUPING SETS ((), (difficulty), (multi_hop))", scores=scores)


def scores(samples: DataFrame, results: DataFrame, expected: DataFrame, pool: DataFrame | None = None, ks: Sequence[int] = KS) -> DataFrame:
    """samples (sample, ...) with recall_k, section_k and initial_k for each k, mrr and ndcg_10, all from one pass over what was found.

    results and pool (the candidates before reranking) have (sample, rank, spec, section); expected has (sample, spec,
    section). recall_k is the share of a sample's expected specifications among the first k results, section_k of those
    of which a result also has a section that starts as an expected one does, initial_k the share among the first k of
    pool. A specification without sections counts for section_k only where its sample expects no section at all. Specs
    and sections are compared in lower case, without a leading section sign. ndcg_10 takes hits as relevance 1, repeated
    ones too. Samples of which nothing is expected have recalls of 1 and 0 of the rest; those without results have 0.
    """
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^§+", ""))
    named = expected.filter("spec is not null").select("sample", F.lower("spec").alias("_s"), F.when(F.trim(bare("section")) != "", bare("section")).alias("_w"))
    want = named.groupBy("sample", "_s").agg(F.collect_set("_w").alias("_wants"))
    total = want.groupBy("sample").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_wants")).alias("_any"))
    found = results.select("sample", "rank", F.lower("spec").alias("_s"), bare("section").alias("_got"), F.lit(True).alias("_final"))
    if pool is not None:
        found = found.unionByName(pool.select("sample", "rank", F.lower("spec").alias("_s"), F.lit("").alias("_got"), F.lit(False).alias("_final")))
    hits = found.join(want, ["sample", "_s"]).join(total, "sample")
    inside = F.exists("_wants", lambda w: F.startswith(F.col("_got"), w)) | (F.col("_any") == 0)
    gain = F.when(F.col("_final") & (F.col("rank") <= 10), 1.0 / F.log2(F.col("rank") + 1.0))
    per = hits.groupBy("sample", "_s").agg(
        F.min(F.when(F.col("_final"), F.col("rank"))).alias("_r"), F.min(F.when(F.col("_final") & inside, F.col("rank"))).alias("_i"),
        F.min(F.when(~F.col("_final"), F.col("rank"))).alias("_p"), F.sum(gain).alias("_g"), F.count(gain).alias("_m"),
    )
    kinds = {"recall": "_r", "section": "_i", "initial": "_p"}
    counts = [F.count_if(F.col(c) <= k).alias(f"{name}_{k}") for name, c in kinds.items() for k in ks]
    per = per.groupBy("sample").agg(*counts, F.min("_r").alias("_r"), F.sum("_g").alias("_g"), F.sum("_m").alias("_m"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    shares = [F.round(F.when(F.col("_n").isNull(), 1.0).otherwise(F.coalesce(F.col(f"{name}_{k}") / F.col("_n"), F.lit(0.0))), 6).alias(f"{name}_{k}") for name in kinds for k in ks]
    rows = samples.join(total, "sample", "left").join(per, "sample", "left")
    rank = F.round(F.coalesce(1.0 / F.col("_r"), F.lit(0.0)), 6).alias("mrr")
    return rows.select(*samples.columns, *shares, rank, F.round(F.when(F.col("_m") > 0, F.col("_g") / ideal).otherwise(0.0), 6).alias("ndcg_10"))


def report(scored: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(level, difficulty, multi_hop, n, means) of scores with difficulty and multi_hop: of all samples, by difficulty, by hops, in one pass.

    No samples give no rows.
    """
    values = [f"{name}_{k}" for name in ("recall", "section", "initial") for k in ks] + ["mrr", "ndcg_10"]
    means = ", ".join(f"round(avg({v}), 6) AS {v}" for v in values)
    level = "CASE grouping_id(difficulty, multi_hop) WHEN 3 THEN 'all' WHEN 1 THEN 'difficulty' ELSE 'multi_hop' END AS level"
    return scored.sparkSession.sql(f"SELECT {level}, difficulty, multi_hop, count(*) AS n, {means} FROM {{rows}} GROUP BY GROUPING SETS ((), (difficulty), (multi_hop))", rows=scored)


def report_lines(reported: DataFrame) -> DataFrame:
    """(metric, value, target, reached): the means of all samples that have a target."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target")) for m, t in TARGETS.items()])
    return reported.filter("level = 'all'").select(F.explode(entries).alias("e")).select("e.*", (F.col("e.value") >= F.col("e.target")).alias("reached"))


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def run_resumable(samples: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The results of all samples (query_id, text): those that path holds under the hash of a sample's text, and answer's, which are added to it.

    A run that breaks off is called again with the same path. Its results count once it has noted its samples as done, which
    it does last, so a sample without results is not asked again, and what a broken run left is not read. Of several runs
    that answered a sample at the same time, the first by name counts.
    """
    spark = samples.sparkSession
    keyed = samples.withColumn("sample_key", F.substring(F.sha2("text", 256), 1, 16))
    done = _done(spark, f"{path}/done")
    left = keyed if done is None else keyed.join(done.select("sample_key").distinct(), "sample_key", "left_anti")
    if done is None or not left.isEmpty():
        run = F.lit(uuid.uuid4().hex)
        keys = settled(left.select("sample_key").distinct())
        answer(left).join(keyed.select("query_id", "sample_key"), "query_id").withColumn("run", run).write.mode("append").parquet(f"{path}/results")
        keys.withColumn("run", run).write.mode("append").parquet(f"{path}/done")
        discard(keys)
    counted = spark.read.parquet(f"{path}/done").groupBy("sample_key").agg(F.min("run").alias("run"))
    rows = spark.read.parquet(f"{path}/results").join(counted, ["sample_key", "run"], "left_semi")
    return rows.join(keyed.select("sample_key").distinct(), "sample_key", "left_semi").drop("sample_key", "run")


def compare(results: dict[str, DataFrame], expected: DataFrame, k: int) -> DataFrame:
    """(model, n, recall, mrr): the means of each model's results over one set of expectations."""
    parts = []
    for name, rows in results.items():
        scores = recall(rows, expected, [k]).join(reciprocal_rank(rows, expected), "sample")
        parts.append(scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr")).select(F.lit(name).alias("model"), "n", "recall", "mrr"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
