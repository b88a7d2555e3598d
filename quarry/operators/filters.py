"""Predicates and filters over chunks and ranked results, as column expressions and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import BY, positions

# What marks a chunk of low information.
TITLE_WORDS = ("abbreviation", "definition", "symbol", "reference")
TITLE_EXEMPT = ("operation", "procedure", "function", "configure", "establish")
STRUCTURAL = ("#  Contents", "#  Foreword", "#  1 Scope", "# 1 Scope", "#  2 References", "# 2 References")
SHORT_WORDS = ("Contents", "Foreword", "Scope")
TOP_SECTIONS = ("1", "2", "3")
TOP_TITLES = ("scope", "reference", "definition", "abbreviation", "symbol")


def any_of(conditions) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def user_filter(release: str | None = None, series: int | None = None, doc_type: str | None = None) -> Column:
    """Release and series bind standards documents only; the open-interface ones pass unless a type is asked for."""
    if doc_type == "oran":
        return F.col("doc_type") == "oran"
    bound = F.lit(True)
    if release:
        bound = bound & (F.col("release") == release)
    if series is not None:
        bound = bound & (F.col("series") == series)
    own = bound & (F.col("doc_type") == "3gpp")
    if doc_type == "3gpp":
        return own
    return own | (F.col("doc_type") == "oran") if release or series is not None else F.lit(True)


def is_low_quality(text: str = "text", title: str = "parent_title", section: str = "parent_section_id") -> Column:
    body, head = F.trim(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit("")))
    by_title = any_of(head.contains(w) for w in TITLE_WORDS) & ~any_of(head.contains(w) for w in TITLE_EXEMPT)
    by_prefix = any_of(body.startswith(p) for p in STRUCTURAL)
    by_size = (F.length(body) < 50) & any_of(body.contains(w) for w in SHORT_WORDS)
    by_section = F.col(section).isin(*TOP_SECTIONS) & any_of(head.contains(w) for w in TOP_TITLES)
    return by_title | by_prefix | by_size | F.coalesce(by_section, F.lit(False))


def backfill(results: DataFrame, k: int, *, by: Sequence[str] = BY) -> DataFrame:
    """The first k good results, then low-quality ones until there are k; k = 0 gives the first good one."""
    marked = results.withColumn("is_low", is_low_quality())
    chosen = positions(marked, F.asc("is_low"), F.asc("pos"), by=by, pos="new_pos")
    return chosen.filter((F.col("new_pos") <= k) | ((F.col("new_pos") == 1) & ~F.col("is_low")))


def noise(results: DataFrame, *, percentile: float = 0.25, by: Sequence[str] = BY) -> DataFrame:
    """Main results at or over a percentile of the main scores; tagged supplements with any score."""
    main = F.when(F.col("source_tag").isNull(), F.col("score"))
    least = F.percentile(main, F.lit(percentile)).over(Window.partitionBy(*by))
    return results.withColumn("_least", least).filter(F.when(F.col("source_tag").isNotNull(), F.col("score") > 0).otherwise(F.col("score") >= F.coalesce("_least", F.lit(0.0)))).drop("_least")


def noise_absolute(results: DataFrame, least: float, *, by: Sequence[str] = BY) -> DataFrame:
    """Results at or over a score; all of a query's if none is."""
    some = F.max((F.col("score") >= least).cast("int")).over(Window.partitionBy(*by))
    return results.withColumn("_some", some).filter((F.col("score") >= least) | (F.col("_some") == 0)).drop("_some")


def by_release(results: DataFrame, release: str) -> DataFrame:
    return results.filter(F.upper("release") == release.upper())


def release_context(results: DataFrame, releases: Sequence[str], *, by: Sequence[str] = BY) -> DataFrame:
    """One release: its results, or all if it has none. Two: the first's, then the second's, or all if neither has any."""
    wanted = [r.upper() for r in releases]
    place = F.coalesce(*[F.when(F.upper("release") == r, F.lit(i)) for i, r in enumerate(wanted)]) if wanted else F.lit(None)
    marked = results.withColumn("_p", place.cast("int")).withColumn("_n", F.count("_p").over(Window.partitionBy(*by)))
    kept = marked.filter(F.col("_p").isNotNull() | (F.col("_n") == 0)).withColumn("compare_release", F.upper(F.when(F.col("_p").isNotNull(), F.col("release"))))
    return positions(kept, F.asc_nulls_first("_p"), F.asc("pos"), by=by, pos="new_pos").drop("_p", "_n")
