"""Ranked-result operators. Results carry `pos`, their place in the current order, and are handled by query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("query_id",)


def positions(results: DataFrame, *order: Column, by: Sequence[str] = BY, pos: str = "pos") -> DataFrame:
    """pos by descending score, ties by id, or by the given order."""
    order = order or (F.desc("score"), F.asc("id"))
    return results.withColumn(pos, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(results: DataFrame, k: int, *, by: Sequence[str] = BY) -> DataFrame:
    return positions(results, by=by).filter(F.col("pos") <= k)


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int, *, k_dense: float = 60, k_sparse: float = 60, by: Sequence[str] = BY) -> DataFrame:
    """Full outer fusion of two rankings (by, id, score): 1/(k_dense+rank) + 1/(k_sparse+rank), the best k of each query."""
    d = positions(dense, by=by, pos="rank_dense").select(*by, "id", "rank_dense")
    s = positions(sparse, by=by, pos="rank_sparse").select(*by, "id", "rank_sparse")
    part = lambda r, c: F.coalesce(1.0 / (F.lit(float(c)) + F.col(r)), F.lit(0.0))
    fused = d.join(s, [*by, "id"], "full").withColumn("score", F.round(part("rank_dense", k_dense) + part("rank_sparse", k_sparse), 9))
    return top(fused, k, by=by)


def scaled(value: str, by: Sequence[str] = BY) -> Column:
    """Min-max over the query's results; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.5))


def rerank_fusion(results: DataFrame, k: int, *, alpha: float = 0.6, by: Sequence[str] = BY) -> DataFrame:
    """alpha of the scaled rerank score and the rest of the scaled score, best k; queries with k results or fewer stay as they are."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    fused = results.withColumn("_n", n).withColumn("_f", F.round(alpha * scaled("rerank_score", by) + (1 - alpha) * scaled("score", by), 9))
    fused = fused.withColumn("score", F.when(F.col("_n") > k, F.col("_f")).otherwise(F.col("score"))).drop("_n", "_f")
    return top(fused, k, by=by)


def metadata_boost(results: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """x1.3 for authoritative specifications, x1.2 for tables and definitions; both multiply."""
    boost = F.when(F.col("spec_role") == "authoritative", 1.3).otherwise(1.0) * F.when(F.col("content_type").isin("parameter_table", "definition"), 1.2).otherwise(1.0)
    return positions(results.withColumn("score", F.round(F.col("score") * boost, 9)), F.desc("score"), F.asc("pos"), by=by)


def spec_aware(results: DataFrame, pool: DataFrame, hints: DataFrame, *, boost: float = 2.0, each: int = 5, most: int = 3, by: Sequence[str] = BY) -> DataFrame:
    """Hinted specifications (by, spec_number) count double, and their best chunks of pool join the results; nothing is cut."""
    hints = positions(hints.distinct(), F.asc("spec_number"), by=by, pos="_h").withColumn("_hint", F.lit(True))
    extra = positions(pool.join(hints.filter(F.col("_h") <= most).select(*by, "spec_number"), [*by, "spec_number"]), F.desc("score"), F.asc("id"), by=[*by, "spec_number"], pos="_e")
    extra = extra.filter(F.col("_e") <= each).join(results.select(*by, "id"), [*by, "id"], "left_anti").withColumn("source_tag", F.lit("spec_aware"))
    marked = results.join(hints.select(*by, "spec_number", "_hint"), [*by, "spec_number"], "left").withColumn("score", F.when(F.col("_hint"), F.col("score") * boost).otherwise(F.col("score")))
    columns = [*by, "id", "spec_number", "score", "source_tag"]
    return positions(marked.select(*columns).unionByName(extra.withColumn("score", F.col("score") * boost).select(*columns)), by=by)


def diversify(results: DataFrame, most: int = 2, *, by: Sequence[str] = BY) -> DataFrame:
    """The first `most` of each specification keep their order, the rest follow in theirs."""
    nth = F.row_number().over(Window.partitionBy(*by, "spec_number").orderBy("pos"))
    return positions(results.withColumn("_n", nth), (F.col("_n") > most).asc(), F.asc("pos"), by=by, pos="new_pos").drop("_n")


def fit_supplement(supplement: DataFrame, originals: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Supplement scores scaled into the range of the originals' scores; equal ones go to its middle."""
    main = originals.groupBy(*by).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    fit = F.when(high > low, F.col("_low") + (F.col("score") - low) / (high - low) * (F.col("_high") - F.col("_low"))).otherwise((F.col("_low") + F.col("_high")) / 2)
    return supplement.join(main, list(by), "left").withColumn("score", F.when(F.col("_low").isNull(), F.col("score")).otherwise(F.round(fit, 9))).drop("_low", "_high")


def merge_supplement(originals: DataFrame, supplement: DataFrame, *, tag: str = "multi_hop", fit: bool = True, by: Sequence[str] = BY) -> DataFrame:
    """Originals, then the supplement's unseen rows (the first of each id) with scores in the originals' range, or their own."""
    fresh = supplement.join(originals.select(*by, "id"), [*by, "id"], "left_anti")
    fresh = positions(fresh, F.asc("pos"), by=[*by, "id"], pos="_k").filter("_k = 1").drop("_k")
    fresh = (fit_supplement(fresh, originals, by=by) if fit else fresh).withColumn("source_tag", F.lit(tag))
    both = originals.withColumn("_late", F.lit(0)).unionByName(fresh.withColumn("_late", F.lit(1)))
    return positions(both, F.asc("_late"), F.asc("pos"), F.asc("id"), by=by).drop("_late")


def rank_score(results: DataFrame, k: int = 60, *, by: Sequence[str] = BY) -> DataFrame:
    return results.withColumn("score", 1.0 / (k + F.row_number().over(Window.partitionBy(*by).orderBy("pos"))))
