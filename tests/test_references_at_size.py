"""What references reach grows with the square of a section's size; only what is asked and the nodes are dealt out."""

import random
import re
import time

from pyspark.sql import functions as F

from quarry.operators import graph, references


def _dealt(spark) -> int:
    """Rows that shuffles of this session have written so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _nodes(spark, n):
    k = F.col("id")
    return spark.range(n).select("id", F.lit("23.501").alias("spec_number"), F.lit("5.1").alias("parent_section_id"), F.concat(F.lit("5.1."), (k % 3).cast("string")).alias("section_number"), F.lit("see clause 5.1 and clause 5.1.2 and clause 5.1.1.9").alias("text"))


def test_resolved_nodes_are_not_dealt_out(spark):
    nodes, before = _nodes(spark, 300), _dealt(spark)
    asked = spark.range(300).select(F.col("id").alias("ref"), F.lit("23.501").alias("spec_number"), F.lit("5.1.7").alias("clause"))
    found = graph.resolve(asked, nodes).collect()
    assert len(found) == 300 * 300 and {r.level for r in found} == {2} and len({(r.ref, r.id) for r in found}) == 300 * 300
    assert _dealt(spark) - before < 20_000


def test_edges_are_not_dealt_out(spark):
    nodes, before = _nodes(spark, 200), _dealt(spark)
    found = references.edges(nodes).select("src", "dst", "target_clause").collect()
    assert len(found) == 200 * 200 and {r.target_clause for r in found} == {"5.1"}  # its first claim reaches all
    assert _dealt(spark) - before < 20_000


def test_first_edges_of_each_node_are_whole(spark):
    nodes = _nodes(spark, 60).withColumn("text", F.lit("see clause 5.1.2, clause 5.1.1 and clause 5.1.1.9"))
    firsts = lambda rows: {(s, d) for s in range(60) for d in sorted(r.dst for r in rows if r.src == s)[:5]}
    whole, some = references.edges(nodes).collect(), references.edges(nodes, most=5).collect()
    assert firsts(whole) == firsts(some) and len(some) < len(whole)


def test_nodes_held_alike_are_met_as_one(spark):
    """Of 3,000 nodes in three sections, as many rows are met as of three; groups are cut, and none is lost or told twice."""
    few, many = (graph.members(_nodes(spark, n)) for n in (3, 3000))
    assert few.count() == 3 * 4 and many.count() == 3 * 4 and many.agg(F.max(F.size("ids"))).first()[0] == 1000
    nodes = _nodes(spark, 9000)
    groups = graph.alike(nodes).collect()
    assert sorted(i for r in groups for i in r.ids) == list(range(9000)) and max(len(r.ids) for r in groups) == graph.GROUP and all(r.ids == sorted(r.ids) for r in groups)
    asked = spark.range(2).select(F.col("id").alias("ref"), F.lit("23.501").alias("spec_number"), F.lit("5.1.1").alias("clause"))
    found = graph.resolve(asked, nodes).collect()
    assert len(found) == 2 * 3000 and {(r.ref, r.id) for r in found} == {(q, i) for q in (0, 1) for i in range(1, 9000, 3)}


def test_claims_of_usual_texts_are_not_dealt_out(spark):
    nodes, before = _nodes(spark, 200), _dealt(spark)
    assert len(references.claims(nodes.select("id", "text")).collect()) == 600 and _dealt(spark) == before


def _plain(text):
    """All claims of a text, by its patterns over the whole of it and a list of what is taken."""
    held, out = [], set()
    for rank, (name, (pattern, groups)) in enumerate(references.PATTERNS.items()):
        for m in re.finditer(pattern, text, re.A):
            if any(a <= x <= b for a, b in held for x in m.span()):
                continue
            held.append(m.span())
            line = text[: m.start()].rsplit("\n", 1)[-1] + m[0] + text[m.end() :].split("\n", 1)[0]
            near = re.search(references.PATTERNS["same_spec"][0], text[max(0, m.start() - references.NEAR_CLAUSE) : m.end() + references.NEAR_CLAUSE], re.A)
            clause = m[1] if rank in (0, 1, 4) else near[1] if rank == 3 and near else ""
            evidence = re.sub(r"^\s+|\s+$", "", text[max(0, m.start() - references.NEAR) : m.end() + references.NEAR], flags=re.A)[: references.MOST_EVIDENCE]
            if rank < 4 or not re.search(references.SPEC_ON_LINE, line, re.A):
                out.add((name, "" if rank == 4 else f"{m[groups[0]]}.{m[groups[1]]}", clause.rstrip("."), *m.span(), evidence))
    return out


def _claims(spark, texts):
    got = {}
    for r in references.claims(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect():
        got.setdefault(r.id, []).append((r.pattern, r.spec_number, r.clause, r.start, r.end, r.evidence))
    assert all(len(x) == len(set(x)) for x in got.values())
    return {i: set(x) for i, x in got.items()}


BITS = ["clause 5.1", "Section\t6.2.", "subsection  4", "sub-clause\n7.A", "sub-section 3", "subclause 9", "aclause", "clause  of TS 38.213", "of", "OF", "[6,", "3GPP", "3gpp  TR", "TS", "TS 38.213", "(TR 38.901-1)", "xTS 22.101x", "[6, TS 38.214]", "[77,\n3GPP TS 23.501]", "[", "]",
        "38.213", "1.2.3", "section", "clauses 4", "one", "more.", "plain, words", "é中😀", "ts 1", ","]


def test_stretches_hold_all_matches(spark):
    """Random texts in which references are near each other, far apart or cut off, against the patterns over whole texts."""
    draw = random.Random(11)
    texts = ["".join(draw.choice(BITS) + draw.choice([" ", " ", " ", "", "\n", "  ", " words " * draw.randint(1, 9)]) for _ in range(draw.randint(1, 16))) for _ in range(1500)]
    got = _claims(spark, texts)
    for i, text in enumerate(texts):
        assert got.get(i, set()) == _plain(text), text


def test_crowded_stretches_are_settled_alike(spark):
    """Stretches of more matches than are settled at once, beside short ones in the same text."""
    draw = random.Random(12)
    crowd = lambda n: "".join(draw.choice(BITS) + draw.choice([" ", "", "\n"]) for _ in range(n))
    texts = [crowd(n) for n in (60, 90, 150, 400)] + [crowd(150) + " plain words" * 9 + " " + crowd(5), "[1, TS 38.213]" * 200, "[1, TS 38.213]" * 3000, "none"]
    got = _claims(spark, texts)
    for i, text in enumerate(texts[:6]):
        assert got[i] == _plain(text)
    assert len(got[6]) == 3000 and 7 not in got  # of brackets that touch every second one claims its place, of the others the specifications in them


def test_text_before_the_first_reference_is_read_once(spark):
    rows = spark.range(0, 400, 1, 4).select("id", F.concat(F.repeat(F.lit(" what a long text of few words is told in one run of it"), 700), F.lit(" as in clause 5.1 of TS 38.213, and section 4")).alias("text")).cache()
    rows.count()

    def seconds(df):
        took = []
        for _ in range(4):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert seconds(references.candidates(rows)) < 7 * seconds(rows.select(F.regexp_count("text", F.lit(references.PATTERNS["spec"][0])))) + 0.1
