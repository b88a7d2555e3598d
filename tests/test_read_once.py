"""A text that holds nothing of what is looked for is read once, not once for every pattern."""

import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx

ODD = ["", "harq", "HARQ (x) harq\t(y) _HARQ HARQ_ xHARQ", "(RRC) RRC\n", "RRC  (a", "nr-NR nR1 machine mac.", "İMS ıMS IMS", "SIB§SIB", "Kelvin K RLC,RLC", "QoS/qos XNAP", None]
CITED = ["", "as in clause 5", "TS 38.331", "3gpp\ttr 38.901 §7", "Annex A1, figure 3-A2", "tables 5", "Table\n5", "§", "§ B4.2", "sub-clause 7 of the specification, section 8", "aTS 11.222, 5", "TS 38.33", "Subclause", "ſection 5"]


def _expanded(text):
    for short in sorted(tx.ABBREVIATIONS, key=len, reverse=True):
        text = re.sub(rf"(?ia)(?<![A-Za-z0-9_(]){short}(?![A-Za-z0-9_]|\s*\()", f"{short} ({tx.ABBREVIATIONS[short]})", text)
    return text


def test_every_abbreviation_is_still_found(spark):
    texts = ODD + [f"{p}{s}{q}" for s in tx.ABBREVIATIONS for p in ("", "(", "a ", "-", "_") for q in ("", " (", "s", ".", " x")] + [s.lower() for s in tx.ABBREVIATIONS]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", tx.expand_abbreviations(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: None if t is None else _expanded(t) for i, t in enumerate(texts)}


def test_every_reference_is_still_found(spark):
    four = (tx.SPEC_WITH_CLAUSE, tx.CLAUSE_ALONE, tx.TABLE_NUMBER, tx.FIGURE_NUMBER)
    rows = spark.createDataFrame([(t,) for t in CITED], "x string").select("x", F.rlike("x", F.lit(tx.ANY_REFERENCE)).alias("any"), *[F.rlike("x", F.lit(p)).alias(f"p{i}") for i, p in enumerate(four)], F.size(tx.spec_references(F.col("x"))).alias("n")).collect()
    assert all(r["any"] == any(r[f"p{i}"] for i in range(4)) for r in rows)
    assert {r.x for r in rows if r.n} == {"TS 38.331", "3gpp\ttr 38.901 §7", "Annex A1, figure 3-A2", "Table\n5", "sub-clause 7 of the specification, section 8", "aTS 11.222, 5"}


@pytest.mark.parametrize("of", [tx.expand_abbreviations, lambda x: F.size(tx.spec_references(x))])
def test_a_text_without_any_is_read_once(spark, of):
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" what a long text of few words is told in one run of it"), 40)).alias("x")).cache()
    rows.count()

    def seconds(column):
        took = []
        for _ in range(4):
            began = time.time()
            rows.select(column).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    once = seconds(F.regexp_count("x", F.lit(r"(?i)(?<![A-Za-z0-9_(])QoS(?![A-Za-z0-9_]|\s*\()")))
    assert seconds(of(F.col("x"))) < 7 * once + 0.1
