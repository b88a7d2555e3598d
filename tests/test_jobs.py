"""Ingestion, chunking rules, references and folds over arrays, against plain statements."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import arrays, arrow
from quarry.functions import text as tx
from quarry.operators import chunking, ingest
from quarry.operators import references as refs
from quarry.plans import ingestion
from quarry.sources import files


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_ingestion(spark, tmp_path):
    docs, store = tmp_path / "marked", str(tmp_path / "store")
    write(docs, "R18/38_series/38300/raw.md", "3GPP TS 38.300 V18.1.0\n\n# 1 Scope\n\nThe scope is this text, which goes on for a while.\n\n# 2 References\n\nNone.")
    write(docs, "R18/23_series/23501/raw.md", "3GPP TS 23.501 V18.0.0\n\n# 1 Scope\n\nAnother text of another specification.")
    encode = lambda t: F.array(F.length(t).cast("double"))
    status = {r.spec_number: r.status for r in ingestion.run(spark, str(docs), store, encode=encode).collect()}
    assert status == {"38.300": "new", "23.501": "new"}
    first = spark.read.parquet(f"{store}/chunks").collect()
    assert {r.spec_number for r in first} == {"38.300", "23.501"} and all(r.dense_vector == [float(len(r.text))] and r.series in (38, 23) for r in first)
    write(docs, "R18/24_series/24501/raw.md", "3GPP TS 24.501 V18.0.0\n\n# 1 Scope\n\nA third one.")
    (docs / "R18/23_series/23501/raw.md").unlink()
    status = {r.spec_number: r.status for r in ingestion.run(spark, str(docs), store, encode=encode).collect()}
    assert status == {"38.300": "skipped", "23.501": "deleted", "24.501": "new"}
    assert {r.spec_number for r in spark.read.parquet(f"{store}/chunks").collect()} == {"38.300", "24.501"}
    assert {r.spec_number for r in spark.read.parquet(f"{store}/manifest").collect()} == {"38.300", "24.501"}
    assert set(r.status for r in ingestion.run(spark, str(docs), store, rebuild=True).collect()) == {"new"}


def test_unclassified_files(spark, tmp_path):
    for name in ("b.txt", "A.md", "c"):
        write(tmp_path, name, name)
    assert [(r.name, r.length) for r in files.unclassified(spark, str(tmp_path)).collect()] == [("A.md", 4), ("b.txt", 5), ("c", 1)]


def test_safe_cut_by_marks():
    """The first kind of mark that comes late enough; the mark itself goes."""
    cases = {
        "a" * 40 + "\n\n" + "b" * 40 + ". " + "c" * 40: "a" * 40 + "…",
        "a" * 20 + "\n\n" + "b" * 50 + ". " + "c" * 60: "a" * 20 + "\n\n" + "b" * 50 + "…",
        "a" * 70 + "; " + "b" * 60: "a" * 70 + "…",
        "a" * 30 + "\n" + "b" * 90: "a" * 30 + "…",
        "a" * 80 + " " + "b" * 60: "a" * 80 + "…",
        "a" * 120: "a" * 97 + "…",
        "é" * 60: "é" * 48 + "…",
    }
    for text, want in cases.items():
        assert arrow.safe_cut(text, 100) == want


def test_overlap_heads():
    assert chunking.head_of("One two. Three four", 14) == "One two." and chunking.head_of("one;two three", 9) == "one;two" and chunking.head_of("first; two", 8) == "first;"
    assert chunking.head_of("abc", 0) == "" and chunking.head_of("x" * 30, 10) == "x" * 10


def test_windows_cover_the_text():
    draw = random.Random(2)
    for _ in range(50):
        text = "".join(draw.choice("ab .\n;") for _ in range(draw.randint(0, 3000)))
        parts = chunking.windows(text, 700)
        assert all(len(p) <= 700 for p in parts)
        at = 0
        for p in parts:
            found = text.find(p, max(0, at - 110))
            assert 0 <= found <= at
            at = found + len(p)
        assert at == len(text)
        for p in chunking.aligned_windows(text, 600, 100):
            assert p in text


def test_fixed_mode_keeps_blocks_whole():
    limits = chunking.Limits(chunk=60)
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n\n"
    text = "First paragraph of the text.\n\n" + table + "$$\nx = y\n\nz\n$$\n\nSecond paragraph, which is longer than the first one is.\n\nThird."
    hidden, known = chunking.protected(text)
    assert chunking.restored(hidden, known) == text and len(known) == 2
    parts = chunking.split_fixed(text, limits)
    assert any("x = y\n\nz" in p for p in parts) and any("| 1 | 2 |" in p for p in parts) and parts[-1].endswith("Third.")


def test_last_resort():
    limits = chunking.Limits(most_bytes=1000, most=10_000)
    assert all(len(p.encode()) <= 1000 for p in chunking.normalised(["| a |\n|---|\n" + "| " + "é" * 3000 + " |"], limits))


def references(text):
    """The rules of references, stated plainly."""
    out = [(m.start(), 0, m[1].upper(), f"{m[2]}.{m[3]}", m[4] or "", "", "") for m in re.finditer(tx.SPEC_WITH_CLAUSE, text)]
    spans = [(m.start(), m.end()) for m in re.finditer(tx.SPEC_WITH_CLAUSE, text)]
    for m in re.finditer(tx.CLAUSE_ALONE, text):
        near = text[max(0, m.start() - 50) : m.start()].lower()
        if not any(a <= m.start() <= b for a, b in spans) and any(w in near for w in tx.CLAUSE_CONTEXT):
            out.append((m.start(), 1, "?", "?", m[1], "", ""))
    out += [(m.start(), 2, "?", "?", "", m[1], "") for m in re.finditer(tx.TABLE_NUMBER, text)] + [(m.start(), 3, "?", "?", "", "", m[1]) for m in re.finditer(tx.FIGURE_NUMBER, text)]
    return sorted(out)


def test_references(spark):
    draw = random.Random(3)
    words = ["TS 38.413", "TR 38.901,", "clause 5.2", "§8.3.1", "Annex A1", "Table 7.3.1-1", "Figure 4.1-1", "of this specification", "3GPP TS 23.501", "section", "7.1", "words and more words", "x" * 30]
    texts = ["", *(" ".join(draw.choice(words) for _ in range(draw.randint(1, 15))) for _ in range(200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tx.spec_references(F.col("text")).alias("r")).collect()
    assert all([tuple(x) for x in r.r] == references(texts[r.id]) for r in rows)
    pinned = tx.spec_references(F.lit("see 3GPP TS 38.413 clause 8.3.1, Table 9.2-1; and § 5 there"))
    (got,) = spark.range(1).select(pinned.alias("r")).first()
    assert [tuple(x)[2:] for x in got] == [("TS", "38.413", "8.3.1", "", ""), ("?", "?", "", "9.2-1", ""), ("?", "?", "5", "", "")]


def test_folds_over_long_arrays(spark):
    values = np.random.default_rng(1).integers(0, 50, 3000).tolist()
    rows = spark.createDataFrame([(values,), ([],), (values[:256],), (values[:257],)], "v array<int>")
    for r in rows.select("v", arrays.before_each(F.col("v"), lambda a, x: a + x).alias("s"), arrays.before_each(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m")).collect():
        assert r.s == [0, *np.cumsum(r.v).tolist()] and r.m == [0, *np.maximum.accumulate(np.array(r.v, int)).tolist()]


def test_reference_edges(spark):
    nodes = [
        (1, "d", "38.213", "9.2", "9", "See clause 9.2.3 of TS 38.214 and more.", 0), (2, "d", "38.213", "9.3", "9", "As in clause 9.2 here.", 1), (3, "e", "38.214", "9.2.3", "9.2", "Nothing.", 0),
        (4, "e", "38.214", "9.2.4", "9.2", "See TS 38.213.", 1),
    ]
    frame = spark.createDataFrame(nodes, "id long, doc_id string, spec_number string, section_number string, parent_section_id string, text string, chunk_index int")
    got = {(r.src, r.dst): (r.type, r.weight, r.target_clause, r.evidence) for r in refs.edges(frame).collect()}
    assert got[1, 3] == ("REFERENCES", 1.0, "9.2.3", "See clause 9.2.3 of TS 38.214 and more.")
    assert got[2, 1][:3] == ("REFERENCES", 0.6, "9.2") and {d for s, d in got if s == 4} == {1, 2}
    assert got[2, 1][1] == 0.6 and all(r.is_cross_spec == (r.weight == 1.0) for r in refs.edges(frame).collect())
    assert {(r.src, r.dst) for r in refs.edges(frame, series=(38,)).collect()} == set(got) and refs.edges(frame, series=(23,)).filter("is_cross_spec").count() == 0
    listed = frame.withColumns({"section_number": F.lit("2"), "section_title": F.lit("References")})
    assert refs.edges(listed).count() == 0


def test_claims_are_swept(spark):
    """Random texts of references, against the same rules over a list of stretches."""
    draw = random.Random(4)
    bits = ["clause 5.1", "Section 6.2.", " of ", "TS 38.213", "3GPP TR 38.901-1", "[6, TS 38.214]", "[7, 3GPP TS 23.501]", " ", "\n", "and", "sub-clause 7", ", "]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 14))) for _ in range(400)]
    rows = refs.claims(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add((r.pattern, r.spec_number, r.clause, r.start, r.end))
    for i, text in enumerate(texts):
        want, held = set(), []
        for rank, (name, (pattern, groups)) in enumerate(refs.PATTERNS.items()):
            for m in re.finditer(pattern, text):
                span = range(m.start(), m.end() + 1)
                if not any(x in range(a, b + 1) for a, b in held for x in (span[0], span[-1])):
                    held.append(m.span())
                    lines = text[: m.start()].rsplit("\n", 1)[-1] + m[0] + text[m.end() :].split("\n", 1)[0]
                    near = re.search(refs.PATTERNS["same_spec"][0], text[max(0, m.start() - 80) : m.end() + 80])
                    clause = m[1] if rank in (0, 1, 4) else near[1] if rank == 3 and near else ""
                    if rank < 4 or not re.search(refs.SPEC_ON_LINE, lines):
                        want.add((name, "" if rank == 4 else f"{m[groups[0]]}.{m[groups[1]]}", clause.rstrip("."), *m.span()))
        assert got.get(i, set()) == want, text


def test_paragraphs_are_gathered():
    draw = random.Random(7)
    for _ in range(300):
        parts, most, want = ["x" * draw.randint(1, 40) for _ in range(draw.randint(0, 12))], draw.randint(5, 60), []
        for part in parts:
            if want and len("\n\n".join(want[-1])) + len(part) <= most:
                want[-1].append(part)
            else:
                want.append([part])
        assert [parts[a:b] for a, b in chunking.gathered(parts, most)] == want


def test_small_blocks_join_prose():
    """Small tables are fragments; what holds a table, by its text, is never joined to; blank lines of what fits stay."""
    limits = chunking.Limits()
    chunk = lambda t: chunking.Chunk(t)
    join = lambda *ts: [c.text for c in chunking.merge_small([chunk(t) for t in ts], limits)]
    table, prose, big = "| a |\n|---|\n| 1 |", "p" * 400, "| a |\n|---|\n" + "| 1 |\n" * 100
    assert join(prose, table) == [f"{prose}\n\n{table}"] and join(prose, table, "small") == [f"{prose}\n\n{table}", "small"]
    assert join(big, "small", prose) == [big, f"small\n\n{prose}"] and join(big, table) == [big, table] and join(table, prose) == [f"{table}\n\n{prose}"]
    assert join("$$x$$", "$$y$$") == ["$$x$$", "$$y$$"] and join("a" * 7800, "b" * 200) == ["a" * 7800 + "\n\n" + "b" * 200] and join("a" * 7800, "b" * 201) == ["a" * 7800, "b" * 201]
    assert chunking.split_long("first\n\n\n\nsecond", limits) == ["first\n\n\n\nsecond"]


def test_bytes_are_cut_alike(spark):
    """The expression and the plain rule cut at the same places."""
    draw = random.Random(9)
    texts = ["".join(draw.choice(["a", "é", "中", "😀", ". ", "\n", "\n\n", "。", "; ", " "]) for _ in range(draw.randint(0, 120))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.c == arrow.safe_cut(r.t, 60) for r in rows.select("t", ingest.cut_bytes(F.col("t"), 60).alias("c")).collect())
