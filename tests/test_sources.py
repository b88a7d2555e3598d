"""Word documents, archives, written vector indexes and the store of chunks, against plain statements."""

import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search, storage
from quarry.operators.store import Conflict, Store
from quarry.plans import ingestion
from quarry.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
STYLES = f"""<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/><w:basedOn w:val="H1"/></w:style>
<w:style w:styleId="Own"><w:name w:val="My heading"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="Out"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="3"/></w:pPr></w:style><w:style w:styleId="N"><w:name w:val="Normal"/></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>
<w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>"""
LINKS = '<Relationships xmlns="x"><Relationship Id="rId9" Target="media/image1.emf"/><Relationship Id="rId2" Target="styles.xml"/></Relationships>'


def p(text, style="N", more=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def item(text, depth):
    return p(text, "N", f'<w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="3"/></w:numPr>')


def row(*cells):
    return "<w:tr>" + "".join(f"<w:tc>{c if c.startswith('<w:tcPr') else p(c)}</w:tc>" for c in cells) + "</w:tr>"


def word(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/_rels/document.xml.rels": LINKS, **parts}.items():
            if text is not None:
                z.writestr(name, text)
    return out.getvalue()


BODY = (
    p("1 Scope", "H1") + p("1.1 First &amp; second", "H2") + p("") + p("Own level", "Own") + p("Outline", "Out") + "<w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:tab/><w:t>end</w:t></w:r></w:p>"
    + item("one", 0) + item("deep", 1) + "<w:p><m:oMath><m:r><m:t>x=y</m:t></m:r></m:oMath></w:p>"
    + '<w:tbl>' + row("a", "b|c", "d") + row('<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + p("wide") + p("more"), "e") + row('<w:tcPr><w:vMerge/></w:tcPr>' + p("above"), "f") + "</w:tbl>"
    + '<w:p><w:r><w:drawing><a:blip r:embed="rId9"/></w:drawing></w:r></w:p>' + "<w:sdt><w:sdtContent>" + p("Figure 4.2-1: Model") + "</w:sdtContent></w:sdt>"
)
MARKDOWN = """# 1 Scope

## 1.1 First & second

## Own level

#### Outline

kept new end

- one

    1. deep

$x=y$

| a | b\\|c | d |
|---|---|---|
| wide more |  | e |
|  | f |  |

![](media/image1.emf)

Figure 4.2-1: Model"""


def test_word_documents(spark):
    whole = word(BODY)
    broken = bytearray(whole)
    broken[60:200] = bytes(140)
    cases = [("good", whole), ("plain", word(p("only text", "H1"), **{"word/styles.xml": None, "word/numbering.xml": None, "word/_rels/document.xml.rels": None})), ("empty", word("")), ("no body", word(BODY, **{"word/document.xml": None})),
             ("bad xml", word("", **{"word/document.xml": "<w:document"})), ("cut", whole[:300]), ("damaged", bytes(broken)), ("nothing", b""), ("null", None)]
    rows = {r.path: r for r in office.converted(spark.createDataFrame([(n, None if b is None else bytearray(b), "x") for n, b in cases], "path string, content binary, error string")).collect()}
    assert len(rows) == len(cases)
    assert rows["good"].raw == MARKDOWN and rows["good"].error is None
    assert rows["plain"].raw == "only text" and rows["empty"].raw == ""
    assert all(rows[n].raw is None and rows[n].error for n in ("no body", "bad xml", "cut", "damaged", "nothing", "null"))


def test_word_folder(spark, tmp_path):
    folder = tmp_path / "38_series"
    folder.mkdir()
    (folder / "38300-i10.docx").write_bytes(word(p("3GPP TS 38.300 V18.1.0 (2024-03)") + BODY))
    (folder / "Cover.docx").write_bytes(b"x")
    (folder / "38401.docx").write_bytes(b"no zip")
    (folder / "O-RAN.WG4.CUS.0-R003-v11.00.docx").write_bytes(word(p("text")))
    rows = {r.spec_number: r for r in office.docx(spark, str(tmp_path)).collect()}
    assert set(rows) == {"38.300", "38.401", "O-RAN.WG4.CUS.0"}
    good = rows["38.300"]
    assert (good.release, good.version, good.doc_type, good.error) == ("R18", "18.1.0", "3gpp", None) and good.title == "3GPP TS 38.300 V18.1.0 (2024-03)"
    assert "[Figure 4.2-1: Model]" in good.text.replace("图: ", "") and "# 1 Scope" in good.text
    assert rows["38.401"].error and rows["38.401"].text == "" and rows["O-RAN.WG4.CUS.0"].doc_type == "oran"


def archive(**names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in names.items():
            z.writestr(name.replace("__", "."), data)
    return bytearray(out.getvalue())


def test_newest_archives(spark):
    rows = [("/a/38300-h10.zip", archive(old__docx="1")), ("/a/38300-i20.zip", archive(new__docx="2", part__docx="3", readme__txt="4")), ("/a/38401-i00.zip", archive(have__docx="5")), ("/a/23501-i00.zip", bytearray(b"no zip")), ("/a/notes.zip", archive(x__docx="6"))]
    frame = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.spec_number, r.version, r.name, bytes(r.content) if r.content else None, r.error is None) for r in office.newest_members(frame, existing=spark.createDataFrame([("38401-i00",)], "stem string")).collect()}
    assert got == {("38.300", "i20", "new.docx", b"2", True), ("38.300", "i20", "part.docx", b"3", True), ("23.501", "i00", None, None, False)}
    assert office.newest_members(frame.limit(0)).count() == 0


# Vector indexes ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(5)
    middle = draw.normal(size=(40, 32))
    rows = [(i, [float(x) for x in middle[i % 40] + draw.normal(size=32) * 0.3]) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(4).cache()


def test_written_index(spark, vectors, tmp_path):
    path = str(tmp_path / "ivf")
    index = search.ivf_create(vectors, path, lists=64, copies=2)
    queries = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r.query_id, r.id) for r in search.dense(vectors, queries, 10).collect()}
    found = search.ivf_open(spark, path).search(queries, 10, share=0.1).collect()
    got = {(r.query_id, r.id) for r in found}
    assert len(got) == len(found) == 600 and len(got & exact) / len(exact) >= 0.9
    one = search.ivf_search(index.index, index.centres, queries.limit(1), 10, probes=6)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ IN \(", plan) and "PushedFilters: []" in plan
    read = search.probed(index.index, list(range(6))).select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len({r.f.split("list=")[1].split("/")[0] for r in read}) <= 6  # of 64
    with pytest.raises(ValueError):
        search.ivf_create(vectors, path, lists=4)
    assert len(search.ivf_create(vectors, path, lists=4, replace=True).centres) == 4
    assert search.ivf_drop(spark, path) and not search.ivf_drop(spark, path)


def test_many_queries_in_blocks(spark, vectors, tmp_path):
    index = search.ivf_create(vectors, str(tmp_path / "ivf"), lists=16)
    queries = vectors.filter("id < 90").select(F.col("id").alias("query_id"), "vector")
    whole = search.ivf_search(index.index, index.centres, queries, 5, probes=4)
    parts = search.ivf_search(index.index, index.centres, queries, 5, probes=4, block=20)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}
    assert search.ivf_search(index.index, index.centres, queries.limit(0), 5).count() == 0
    everywhere = search.ivf_search(index.index, index.centres, queries, 5, probes=16)
    assert {tuple(r) for r in everywhere.collect()} == {tuple(r) for r in search.dense(vectors, queries, 5).select("query_id", "id", "score", "pos").collect()}


# The store --------------------------------------------------------------------------------------------------------


def rows_of(spark, **texts):
    rows = [(i, k.replace("_", "."), "R18", t, i, 38) for i, (k, t) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "id long, spec_number string, release string, text string, chunk_index long, series long")


def marks_of(rows, version="1"):
    return rows.select("spec_number", "release").distinct().withColumns({"version": F.lit(version), "sha256": F.lit("x"), "file_path": F.lit("f")})


def held(store):
    rows, known = store.chunks(), store.manifest().collect()
    return {(r.spec_number, r.text) for r in (rows.collect() if rows is not None else [])}, {(r.spec_number, r.version, r.chunk_count) for r in known}


def when(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_commits_touch_changed_keys_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert held(store) == (set(), set()) and store.chunks() is None
    first = rows_of(spark, s38_1="a", s38_2="b", s38_3="c")
    store.commit(first, marks_of(first))
    before = when(tmp_path / "chunks")
    second = rows_of(spark, s38_2="new", s38_4="d")
    assert store.commit(second, marks_of(second, "2"), first.filter("spec_number = 's38.3'")) == 2
    after = when(tmp_path / "chunks")
    assert held(store) == ({("s38.1", "a"), ("s38.2", "new"), ("s38.4", "d")}, {("s38.1", "1", 1), ("s38.2", "2", 1), ("s38.4", "2", 1)})
    assert len(set(before.items()) & set(after.items())) == 1  # the file of the key that stayed
    assert store.remove(F.col("spec_number") == "s38.1") == 3 and store.remove(F.col("spec_number") == "none") is None
    assert held(store)[1] == {("s38.2", "2", 1), ("s38.4", "2", 1)}
    store.clear()
    assert held(store) == (set(), set()) and store.vacuum() == 0
    store.commit(first, marks_of(first), clear=True)
    assert len(held(store)[0]) == 3


@pytest.mark.parametrize("step", range(12))
def test_killed_runs(spark, tmp_path, monkeypatch, step):
    """A run that dies at any step leaves the old store or, once committed, the new one."""
    store = Store(spark, str(tmp_path))
    first = rows_of(spark, s38_1="a", s38_2="b", s38_3="c")
    store.commit(first, marks_of(first))
    old, second = held(store), rows_of(spark, s38_2="new", s38_4="d")
    seen = []

    def dies(name):
        real = getattr(storage.Folder, name)

        def run(self, *args):
            seen.append(name)
            if len(seen) == step + 1:
                raise KeyboardInterrupt
            return real(self, *args)

        return run

    with monkeypatch.context() as m:
        for name in ("delete", "rename", "claim"):
            m.setattr(storage.Folder, name, dies(name))
        try:
            store.commit(second, marks_of(second, "2"), first.filter("spec_number = 's38.3'"))
        except KeyboardInterrupt:
            pass
    again = Store(spark, str(tmp_path))
    new = ({("s38.1", "a"), ("s38.2", "new"), ("s38.4", "d")}, {("s38.1", "1", 1), ("s38.2", "2", 1), ("s38.4", "2", 1)})
    assert held(again) == (old if step == 0 else new)
    assert again.vacuum() == (1 if step == 0 else 0) or step > 8
    third = rows_of(spark, s38_9="z")
    again.commit(third, marks_of(third))
    assert ("s38.9", "z") in held(again)[0]


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    rows = rows_of(spark, s38_1="a")
    one.commit(rows, marks_of(rows))
    monkeypatch.setattr(Store, "commits", lambda self: [])
    with pytest.raises(Conflict):
        two.commit(rows_of(spark, s38_1="b"), marks_of(rows))
    assert held(one)[0] == {("s38.1", "a")}


def test_ingestion_of_all_sources(spark, tmp_path):
    docs, store, interim, cache = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "interim"), str(tmp_path / "cache")
    (docs / "38_series").mkdir(parents=True)
    md = lambda place, text: ((docs / place).mkdir(parents=True, exist_ok=True), (docs / place / "raw.md").write_text(text))
    md("R18/23_series/23501", "3GPP TS 23.501 V18.0.0\n\n# 1 Scope\n\nText of a specification.")
    md("x", "no facts at all")
    md("y", "none here either")
    md("R18/24_series/24501", "")
    (docs / "38_series/38300-i10.docx").write_bytes(word(p("3GPP TS 38.300 V18.1.0 (2024-03)") + p("1 Scope", "H1") + p("A Word document.")))
    (docs / "38_series/38400-i10.docx").write_bytes(b"broken")
    (docs / "38401-i00.zip").write_bytes(bytes(archive(**{"38401-i00__docx": word(p("TS 38.401 V18.0.0") + p("1 Scope", "H1") + p("From an archive."))})))
    run = lambda **more: ingestion.run(spark, str(docs), store, sources=("markdown", "docx", "zip"), encoder=lambda ts: [[float(len(t))] for t in ts], cache=cache, interim=interim, **more)
    first = run()
    by = {(r.spec_number, (r.path or "").rsplit("/", 2)[-2]): (r.status, r.chunks > 0, bool(r.error)) for r in first.collect()}
    assert by["38.300", "38_series"] == ("new", True, False) and by["23.501", "23501"][0] == "new" and by["38.400", "38_series"] == ("failed", False, True)
    assert by["", "x"] == by["", "y"] == ("failed", False, True) and by["24.501", "24501"] == ("failed", False, True) and {s for (n, _), (s, *_) in by.items() if n == "38.401"} == {"new"}
    got = ingestion.counters(first).first().asDict()
    assert {k: got[k] for k in ("total", "new", "failed", "skipped", "replaced", "deleted")} == {"total": 7, "new": 3, "failed": 4, "skipped": 0, "replaced": 0, "deleted": 0} and got["chunks"] == Store(spark, store).chunks().count()
    assert all(r.dense_vector == [float(len(r.text))] for r in Store(spark, store).chunks().collect())
    before = when(tmp_path / "store" / "chunks")
    md("R18/23_series/23501", "3GPP TS 23.501 V18.2.0\n\n# 1 Scope\n\nA higher version of it.")
    (docs / "38_series/38300-i10.docx").write_bytes(b"damaged since")
    second = ingestion.counters(run()).first()
    assert (second.replaced, second.skipped, second.failed, second.new, second.deleted) == (1, 1, 5, 0, 0)
    after = when(tmp_path / "store" / "chunks")
    assert len(set(before) - set(after)) == 1 and "A higher version" in " ".join(r.text for r in Store(spark, store).chunks().collect())
    assert "A Word document." in " ".join(r.text for r in Store(spark, store).chunks().collect())  # a file that broke loses nothing
    again = ingestion.run(spark, "/no/such/folder", store, interim=interim, skip=("extract", "split", "embed"), rebuild=True)
    assert ingestion.counters(again).first().new == 1
