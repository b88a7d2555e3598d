"""Mixing sources to target weights by a time-varying curriculum.

Every source has a share of the token budget and a weight schedule over training time. The schedule's
integral is the source's cumulative demand; a document's place in its source's token order is inverted
through that demand, which gives the training position (0 to 1) at which the document is due. Range-sorting
by position yields the training order.

Only DataFrame functions are used. Prefix sums over a source are taken in two levels (hash buckets, then
documents of a bucket), so a source that holds any part of all rows is never in one task, and the join that
brings the bucket sums back is keyed by source and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, input_bytes, stage, table

#: Weight schedules, one for each place in the cycle of weights: (time, weight) knots, linear between them.
SCHEDULES = (((0.0, 1.6), (1.0, 0.4)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """sizes: source, source_size. Adds place (0-based, by code point, null last), weight and target.

    Water filling in closed form: with sources ordered by the level at which each reaches its cap, a source
    is capped if the level that the sources from it on would share is at or above its own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "place")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
        .withColumn("level", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
        .withColumn("shared", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("level") <= F.col("shared"))
        .withColumn("water", F.coalesce(F.max(F.when(~F.col("capped"), F.col("shared"))).over(Window.partitionBy()), F.lit(0.0)))
        .withColumn("target", F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("water")))
        .select("source", "source_size", "place", "weight", "target")
    )


def due(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral, scaled to 1, reaches share."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, before = sum(areas), 0.0
    found = F.lit(1.0)
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        rest, slope = share * total - before, (w1 - w0) / (t1 - t0)
        inside = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest)) - w0) / slope
        before += area
        pieces.append((before / total, inside + t0))
    for most, inside in reversed(pieces):
        found = F.when(share <= most, inside).otherwise(found)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))


def mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0, schedules=SCHEDULES, text: str = "text", keep_text: bool = False, whole: bool = False) -> DataFrame:
    """One row per document: its columns (the text if keep_text), size, source_size, target, taken and draws.

    draws is an array of struct(copy, words, position), one for each time that the mix takes the document;
    the last may be part of it, so that a source's taken words are its target, rounded; with whole, it is taken
    whole where that is nearer, else not at all. Order within a source is by md5 of the id.

    Null text counts 0 words and is never drawn; an empty table gives no rows; a null source is a source,
    placed last; rows that repeat an id are separate documents; columns of docs that clash with added ones
    are replaced.
    """
    added = ["size", "source_size", "target", "taken", "draws"]
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text)]
    base = docs.withColumn("size", word_count(F.col(text))).select(*[F.col(c) for c in kept], "size")
    base = base.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_key", 1, 3))
    slim = base.select("source", "_bucket", "size") if keep_text else base
    if not keep_text:
        base = slim = stage(base, "mix")
    by_bucket = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    by_bucket = stage(by_bucket, "mix-buckets")
    plan = targets(by_bucket.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, cap)
    heads = by_bucket.withColumn("_before", F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_words"))
    heads = heads.alias("h").join(plan.alias("p"), F.col("h.source").eqNullSafe(F.col("p.source"))).select(F.col("h.source").alias("_source"), F.col("h._bucket").alias("_b"), "_before", "source_size", "target", "place")
    rows = base.join(heads, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))).drop("_source", "_b")
    order = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    goal = F.round("target").cast("long")
    rows = (
        rows.withColumn("_at", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_goal", goal)
        .withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_goal") - F.col("_full") * F.col("source_size") - F.col("_at"))))
        .withColumn("taken", F.col("_full") * F.col("size") + F.col("_part"))
    )
    if whole:
        rows = rows.withColumn("_part", F.when(2 * F.col("_part") >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))).withColumn("taken", F.col("_full") * F.col("size") + F.col("_part"))
    copies = F.when(F.col("taken") > 0, F.col("_full") + F.when(F.col("_part") > 0, 1).otherwise(0)).otherwise(0)
    words = lambda k: F.when(k < F.col("_full"), F.col("size")).otherwise(F.col("_part"))
    share = lambda k: (k * F.col("source_size") + F.col("_at") + words(k) / 2) / F.col("_goal")

    def position(k: Column) -> Column:
        found = due(share(k), schedules[-1])
        for i in range(len(schedules) - 1):
            found = F.when(F.col("place") % len(schedules) == i, due(share(k), schedules[i])).otherwise(found)
        return found

    draw = lambda k: F.struct(k.alias("copy"), words(k).alias("words"), position(k).alias("position"))
    draws = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1), draw)).otherwise(F.array().cast("array<struct<copy:bigint,words:bigint,position:double>>"))
    return rows.withColumn("draws", draws).select(*kept, *added)


def in_order(mixed: DataFrame, position: Column, parts: int) -> DataFrame:
    """Rows range-partitioned and sorted by position, ties by id."""
    return mixed.withColumn("_position", position).repartitionByRange(parts, "_position", "doc_id").sortWithinPartitions("_position", "doc_id").drop("_position")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """(row, draw), range-sorted by training position: a row for each time that the mix takes a document of docs, whole.

    row is a struct of all of docs' columns, so none of their names matters, and draw has copy, words and position.
    Documents without words, nulls among them, are never drawn; rows that repeat an id are separate documents, and
    ties of position are in order of id; an empty table gives no rows.
    """
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    drawn = mix(slim, keep_text=True, whole=True, **options).select("row", F.explode("draws").alias("draw"))
    parts = max(2, int(input_bytes(docs) // (8 << 20)) + 1)
    return drawn.repartitionByRange(parts, F.col("draw.position"), F.col("row.doc_id")).sortWithinPartitions(F.col("draw.position"), F.col("row.doc_id"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training stream: docs' columns for each draw, in training order, with its _copy, _taken words and _due position, which replace columns of those names."""
    kept = [c for c in docs.columns if c not in ("_copy", "_taken", "_due")]
    draw = [F.col(f"draw.{a}").alias(b) for a, b in (("copy", "_copy"), ("words", "_taken"), ("position", "_due"))]
    return training_order(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in kept], *draw)


def op9_curriculum(spark, sf_dir):
    """Every document's share of the mix, in order of its first draw; odd rows are as in mix."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", "text"))
    rows = mixed.select("doc_id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.words).alias("taken"), F.round(F.array_min(F.transform("draws", lambda d: d.position)), 6).alias("first_position"))
    return in_order(rows, F.coalesce("first_position", F.lit(2.0)), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _due_sql(share: str, knots) -> str:
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, before, cases = sum(areas), 0.0, ""
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        slope, rest = (w1 - w0) / (t1 - t0), f"(({share}) * {total!r}::double - {before!r}::double)"
        inside = f"{rest} / {w0!r}::double" if slope == 0 else f"(sqrt(greatest(0.0::double, {w0 * w0!r}::double + {2 * slope!r}::double * {rest})) - {w0!r}::double) / {slope!r}::double"
        before += area
        cases += f" WHEN ({share}) <= {before / total!r}::double THEN {inside} + {t0!r}::double"
    return f"greatest(0.0::double, least(1.0::double, CASE{cases} ELSE 1.0::double END))"


_SHARE = "(before_words + (CASE WHEN full_copies > 0 THEN size ELSE part END) / 2) / goal"
OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size, md5(coalesce(doc_id::varchar, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, 1 + place % 3 AS weight, 3.0::double * source_size / (1 + place % 3) AS level FROM p),
l AS (SELECT *, ((sum(source_size) OVER ())::double - coalesce(sum(3.0::double * source_size) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double))
  / (sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS shared FROM w),
t AS (SELECT source, source_size, place, CASE WHEN level <= shared THEN 3.0::double * source_size
  ELSE weight * coalesce(max(CASE WHEN level > shared THEN shared END) OVER (), 0.0::double) END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.place, t.target, round(t.target)::bigint AS goal,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::bigint - d.size AS before_words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS full_copies FROM r),
g AS (SELECT *, greatest(0, least(size, goal - full_copies * source_size - before_words)) AS part FROM f)
SELECT doc_id, size, source_size, target, (full_copies * size + part)::bigint AS taken,
  CASE WHEN full_copies * size + part > 0 THEN round(CASE place % 3 WHEN 0 THEN {_due_sql(_SHARE, SCHEDULES[0])} WHEN 1 THEN {_due_sql(_SHARE, SCHEDULES[1])} ELSE {_due_sql(_SHARE, SCHEDULES[2])} END, 6) END AS first_position
FROM g
"""

QUERIES = {"op9_curriculum": op9_curriculum}
SQL = {"op9_curriculum": OP9_SQL}
