"""The whole chain with stand-in models."""

from pyspark.sql import functions as F

from quarry.plans import engine
from quarry.sources.chunks import chunks

from .conftest import DATA


def corpus(spark):
    rows = chunks(spark, DATA)
    encode = F.pandas_udf(lambda x: x.map(lambda t: engine.hashing_encoder([t])[0]), "array<double>")
    rows = rows.withColumn("vector", encode("text")).cache()
    edges = rows.select(F.col("id").alias("src"), F.lit(0).alias("place"), ((F.col("id") * 7 + 3) % 200).alias("dst"))
    return engine.Corpus(rows, edges)


def test_plan(spark):
    c = corpus(spark)
    question = " ".join(c.chunks.filter("id = 5").first().text.split()[:8]) + " 22.201 vs nothing"
    context = engine.plan(spark, c, question)
    rows = context.results.orderBy("pos").collect()
    assert rows and [r.pos for r in rows] == list(range(1, len(rows) + 1)) and 5 in [r.id for r in context.initial.collect()]
    assert len({r.id for r in rows}) == len(rows)


def test_release_binds_results(spark):
    c = corpus(spark)
    context = engine.plan(spark, c, "Release 18 handover in the cell")
    assert context.releases == ["R18"] and {r.release for r in context.results.collect()} == {"R18"}


def test_ask_with_hops(spark):
    said = []

    def llm(messages):
        said.append(messages[-1]["content"])
        if "What is missing?" in said[-1]:
            return "the thing that is missing\nand another query"
        return "MAC and RRC steps, see TS 99.999 [1]." if "\n\n[1]" in said[-1] else ""

    found = engine.ask(spark, corpus(spark), "MAC and RRC steps of the procedure", engine.Models(llm=llm), engine.Settings(top_k=5, pool=20))
    assert any("What is missing?" in s for s in said) and found["verified"] is False and any("99.999" in w for w in found["warnings"])


def test_search_plan(spark):
    rows = engine.search_plan(spark, corpus(spark), "the attach of a cell 22.201 section 5", cfg=engine.Settings(top_k=6, doc_type="oran")).collect()
    assert 0 < len(rows) <= 6 and {r.doc_type for r in rows} == {"oran"}


def spied(monkeypatch):
    """The searches of a chain, as (texts, k), in order."""
    seen, own = [], engine.hybrid

    def record(c, questions, k, cfg):
        seen.append(([r.text for r in questions.orderBy("query_id").collect()], k))
        return own(c, questions, k, cfg)

    monkeypatch.setattr(engine, "hybrid", record)
    return seen


def talker(said):
    def llm(messages):
        said.append(messages[-1]["content"])
        if "Split the question" in said[-1]:
            return "- handover types of cells\n- kinds of bearers"
        return "SUFFICIENT" if "What is missing?" in said[-1] else ""

    return llm


def test_order_of_a_list_question(spark, monkeypatch):
    c, cfg = corpus(spark), engine.Settings(top_k=20, pool=30)
    c.chunks = c.chunks.withColumn("text", F.concat("text", F.lit(" as said in TS 23.501 clause 5.")))
    for edges in (c.edges, None):
        seen, said, c.edges = spied(monkeypatch), [], edges
        context = engine.plan(spark, c, "What are the types of handover", engine.Models(llm=talker(said)), cfg)
        assert [k for _, k in seen[:2]] == [30, 10] and seen[1][0] == ["handover types of cells", "kinds of bearers"] and context.listing
        tags = {r.source_tag for r in context.initial.select("source_tag").distinct().collect()}
        assert tags == {None, "taxonomy"}  # narrower questions widen the candidates, before reranking
        if edges is None:  # without a graph, references are searched for, with the chain's own k
            assert len(seen) == 3 and seen[2][1] == 20 and all("23.501" in t for t in seen[2][0])
        else:
            assert len(seen) == 2 and "graph" in {r.source_tag for r in context.results.collect()}
        monkeypatch.undo()


def test_streamed_answer(spark):
    streams, c = [["", ""], ["The answer of ", "a stream that is long enough for two pieces [1]."]], corpus(spark)
    asked, clock = [], [0.0]

    def stream(messages):
        asked.append(messages)
        yield from streams[min(len(asked), 2) - 1]

    caches = engine.Caches(clock=lambda: clock[0])
    models, cfg = engine.Models(llm=lambda m: "", llm_stream=stream), engine.Settings(top_k=5, pool=10)
    events = list(engine.ask_stream(spark, c, "the attach of a cell", models, cfg, caches=caches))
    kinds = [k for k, _ in events]
    assert kinds[0] == "sources" and kinds[-1] == "done" and set(kinds[1:-1]) == {"chunk"} and len(asked) == 2  # a stream without parts is asked again
    texts = [x for k, x in events if k == "chunk"]
    assert "".join(texts) == "".join(streams[1]) == events[-1][1]["answer"] and all(len(t) == 32 for t in texts[:-1])
    clock[0] = 3599
    again = list(engine.ask_stream(spark, c, " The attach of a CELL", models, cfg, caches=caches))
    assert len(asked) == 2 and [k for k, _ in again] == kinds and again[-1] == events[-1] and again[0][1].count() == events[0][1].count()
    assert engine.ask(spark, c, "the attach of a cell", models, cfg, caches=caches)["answer"] == "".join(streams[1])
    clock[0] = 3601
    assert caches.get(caches.answers, engine._answer_key("the attach of a cell", cfg, ())) is None


def test_blank_streams_and_no_results(spark):
    c, calls = corpus(spark), []
    cfg = engine.Settings(top_k=5, pool=10)

    def llm(messages):
        calls.append(messages)
        return "   "

    caches = engine.Caches()
    events = list(engine.ask_stream(spark, c, "the attach of a cell 22.201 section 5", engine.Models(llm=llm, llm_stream=lambda m: iter([" "])), cfg, caches=caches))
    assert events[-1][1]["answer"] == engine.dx.NO_ANSWERS[0] and len([m for m in calls if "\n\n[1]" in m[-1]["content"]]) == 3 and not caches.answers.entries
    empty = engine.Corpus(c.chunks.filter("false"), None)
    assert [(k, x["answer"] if k == "done" else x.count()) for k, x in engine.ask_stream(spark, empty, "the attach 22.201 section 5", engine.Models(llm=llm), cfg)] == [("sources", 0), ("done", engine.dx.NO_ANSWERS[1])]


def test_translation_and_its_fallback():
    said = []

    def llm(messages):
        said.append(messages[0]["content"])
        if "Two lines" in said[-1]:
            return answers[0]
        return "what is a handover" if said[-1].startswith("Translate") else "handover of a user between cells"

    caches, answers = engine.Caches(), ["TRANSLATED: a handover\nEXPANDED: a handover of cells"]
    models = engine.Models(llm=llm)
    assert engine.translate_question("什么是切换", "zh", models, caches=caches) == ("a handover", "a handover of cells") and len(said) == 1
    assert engine.translate_question("什么是切换", "zh", models, caches=caches) == ("a handover", "a handover of cells") and len(said) == 1
    answers[0] = "no lines"
    assert engine.translate_question("什么是小区切换", "zh", models, caches=caches) == ("what is a handover", "handover of a user between cells") and len(said) == 4

    def broken(messages):
        raise OSError("away")

    assert engine.translate_question("什么是切换", "zh", engine.Models(llm=broken)) == ("什么是切换", "什么是切换")


def test_neighbours_parents_and_written_indexes(spark, tmp_path, monkeypatch):
    c = corpus(spark)
    c.chunks = c.chunks.withColumn("parent_text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("whole: "), "text")).otherwise(F.substring("text", 1, 20)))
    c.write_indexes(str(tmp_path / "index"))
    fresh = engine.Corpus(c.chunks, None).open_indexes(str(tmp_path / "index"))
    monkeypatch.setattr(engine.search, "bm25_build", lambda docs: 1 / 0)  # a written index is not built again
    question = " ".join(c.chunks.filter("id = 5").first().text.split()[:8])
    context = engine._prepared(spark, fresh, question, engine.Models(), engine.Settings(top_k=8, pool=20), (), None)
    rows = context.results.orderBy("pos").collect()
    texts = {(r.doc_id, r.chunk_index): r.text for r in c.chunks.select("doc_id", "chunk_index", "text").collect()}
    for r in rows:
        near = [texts[r.doc_id, i] for i in range(r.chunk_index - 2, r.chunk_index + 3) if i != r.chunk_index and (r.doc_id, i) in texts]
        assert (r.neighbours or []) == (near if r.pos <= 5 else [])
        assert r.parent_context == (f"whole: {r.text}"[:1500] if r.pos <= 10 and r.id % 2 == 0 else None)
    body = engine.prompt(context)[1]["content"]
    assert "  [1.1] " in body and "section: whole: " in body and "  [6.1] " not in body
