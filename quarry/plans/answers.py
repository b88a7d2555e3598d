"""Checking answers against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import cjk_ratio, key_phrases

# What admits that there is no answer.
UNCERTAIN = ("无法确定", "未提及", "无法确认", "未找到相关", "cannot determine", "not mentioned", "cannot confirm")
CITED = r"TS\s*(\d{2}\.\d{3})"
TERM = r"\b[A-Z]{1,4}(?:-[A-Z0-9]{1,5})?\b"


def cited_specs(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, spec_number, unseen) for the specifications that answers (id, answer) cite."""
    cited = answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITED), F.lit(1)))).alias("spec_number"))
    known = sources.select("spec_number").distinct().withColumn("_seen", F.lit(True))
    return cited.join(known, "spec_number", "left").select("id", "spec_number", F.col("_seen").isNull().alias("unseen"))


def is_uncertain(answer: Column) -> Column:
    found = F.lit(False)
    for word in UNCERTAIN:
        found = found | F.lower(answer).contains(word.lower())
    return found


def terms(answer: Column) -> Column:
    """Upper-case terms of two letters or more, and numbered section types."""
    upper = F.filter(F.regexp_extract_all(answer, F.lit(TERM), F.lit(0)), lambda t: F.rlike(t, F.lit(r"^[A-Z]{2,4}(?:-[A-Z0-9]{1,5})?$")))
    return F.array_distinct(F.concat(upper, F.regexp_extract_all(answer, F.lit(r"(?i)Section Type \d+"), F.lit(0))))


def verify(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, verified, coverage, warnings) of answers (id, answer) by sources (id, spec_number, text).

    An answer that admits it is uncertain is verified. Otherwise each unseen specification, invalid source
    number and low overlap of terms is a warning; where little of the answer is Chinese, overlap of the
    sources' phrases with its sentences may make up for its terms.
    """
    grouped = sources.groupBy("id").agg(F.collect_set("spec_number").alias("specs"), F.array_join(F.collect_list("text"), "\n").alias("body"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.length("text") > 50, key_phrases(F.lower("text")))).alias("phrases"))
    rows = answers.join(grouped, "id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "body": F.coalesce("body", F.lit(""))})
    named = F.array_distinct(F.regexp_extract_all("answer", F.lit(CITED), F.lit(1)))
    unseen = F.transform(F.filter(named, lambda s: ~F.coalesce(F.array_contains("specs", s), F.lit(False))), lambda s: F.concat(F.lit("unseen TS "), s))
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    invalid = F.filter(numbers, lambda r: (r > F.col("n")) & ~F.contains(F.col("body"), F.concat(F.lit("["), r.cast("string"), F.lit("]"))))
    own = terms(F.col("answer"))
    matched = F.size(F.filter(own, lambda t: F.contains(F.lower("body"), F.lower(t))))
    by_terms = F.when(F.size(own) == 0, F.when(F.col("n") == 0, 0.0).otherwise(1.0)).otherwise(matched / F.greatest(F.size(own), F.lit(1)))
    sentences = F.size(F.filter(F.split("answer", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""))
    cited = F.size(F.filter(F.coalesce("phrases", F.array().cast("array<array<string>>")), lambda p: F.exists(p, lambda q: F.contains(F.lower("answer"), q))))
    by_phrases = F.when(sentences > 0, F.least(F.lit(1.0), cited / F.greatest(sentences, F.lit(1)))).otherwise(1.0)
    rows = rows.withColumns({"_t": by_terms, "_p": F.when(cjk_ratio(F.col("answer")) < 0.6, by_phrases).otherwise(0.0)})
    low = (F.size(own) > 0) & (F.col("_t") < 0.3) & (F.col("_p") < 0.3)
    warnings = F.concat(unseen, F.when(F.size(invalid) > 0, F.array(F.lit("invalid source number"))).otherwise(F.array().cast("array<string>")), F.when(low, F.array(F.lit("low overlap"))).otherwise(F.array().cast("array<string>")))
    sure = is_uncertain(F.col("answer"))
    coverage = F.when(sure, 1.0).when(F.col("_t") < 0.3, F.greatest("_t", "_p")).otherwise(F.col("_t"))
    rows = rows.withColumn("warnings", F.when(sure, F.array().cast("array<string>")).otherwise(warnings))
    return rows.select("id", (F.size("warnings") == 0).alias("verified"), F.round(coverage, 6).alias("coverage"), "warnings")
