"""The retrieval chain and the answer chain, as lazy plans over pluggable models.

Models are Python callables: an encoder of texts, a scorer of (question, text) columns and a language model.
Where the chain branches on a question's words it branches on the driver; where it branches on results
(fallbacks, noise, releases) it does so inside the plan, by windows. What one step found for a question, a few hundred
rows at most by the settings, is held as a local table; the corpus and its indexes stay tables.
"""

from __future__ import annotations

import hashlib
import logging
import re
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import documents as dx
from quarry.functions import text as tx
from quarry.operators import filters, graph, ranking, search
from quarry.operators.cache import ANSWERS, REWRITES, AgingCache
from quarry.plans.answers import verify

BY = ["query_id"]
log = logging.getLogger(__name__)
Messages = list[dict[str, str]]


def hashing_encoder(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: hashed tokens, unit length."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for token in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def overlap_scorer(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross encoder: the share of the question's tokens that the text has."""
    asked = F.array_distinct(search.tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, search.tokens(text))).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Models:
    encoder: Callable[[Sequence[str]], list[list[float]]] = hashing_encoder
    scorer: Callable[[Column, Column], Column] = overlap_scorer
    llm: Callable[[Messages], str] | None = None
    llm_stream: Callable[[Messages], Iterator[str]] | None = None


@dataclass(frozen=True)
class Settings:
    pool: int = 100
    top_k: int = 20
    k_dense: float = 60
    k_sparse: float = 60
    per_spec: int = 2
    hops: int = 2
    sub_queries: int = 3
    retries: int = 2
    release: str | None = None
    series: int | None = None
    doc_type: str | None = None


class Caches:
    """Answers and rewritten questions of one service, shared by its threads."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.answers, self.rewrites, self._clock, self._lock = AgingCache(ANSWERS), AgingCache(REWRITES), clock, threading.Lock()

    def get(self, cache: AgingCache, key: tuple) -> Any:
        with self._lock:
            return cache.get(key, self._clock())

    def put(self, cache: AgingCache, key: tuple, value: Any) -> None:
        with self._lock:
            cache.put(key, value, self._clock())


@dataclass
class Corpus:
    """Chunks (id, text, vector and metadata), reference edges (src, place, dst) if there are any, and indexes of the chunks.

    Without a written index of words one is built at the first search and kept; without one of vectors they are scanned.
    """

    chunks: DataFrame
    edges: DataFrame | None = None
    lexical: search.Bm25 | None = None
    vectors: search.Ivf | None = None

    def __post_init__(self) -> None:
        if "parent_text" not in self.chunks.columns:
            self.chunks = self.chunks.withColumn("parent_text", F.lit(None).cast("string"))

    def words(self) -> search.Bm25:
        if self.lexical is None:
            self.lexical = search.bm25_build(self.chunks.select("id", "text"))
        return self.lexical

    def write_indexes(self, path: str) -> Corpus:
        """Write both indexes below path, and use them from then on."""
        search.bm25_write(self.words(), f"{path}/words")
        search.ivf_create(self.chunks.select("id", F.col("vector").cast("array<float>").alias("vector")), f"{path}/vectors", replace=True)
        return self.open_indexes(path)

    def open_indexes(self, path: str) -> Corpus:
        spark = self.chunks.sparkSession
        self.lexical, self.vectors = search.bm25_read(spark, f"{path}/words"), search.ivf_open(spark, f"{path}/vectors")
        return self


@dataclass
class Context:
    question: str
    language: str
    searched: str
    results: DataFrame
    initial: DataFrame
    releases: list[str] = field(default_factory=list)
    note: str = ""
    asked: str = ""
    listing: bool = False


RESULT = ["query_id", "id", "score", "pos"]
FACTS = ["id", "text", "doc_id", "spec_number", "release", "series", "doc_type", "parent_section_id", "parent_title", "section_number", "chunk_index", "content_type", "spec_role", "parent_text"]
COLUMNS = [*RESULT, *FACTS[1:], "source_tag"]


def held(rows: DataFrame) -> DataFrame:
    """The rows of one question's step as a local table: settings bound them, and nothing has to be found again or deleted."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def _questions(spark: SparkSession, texts: Sequence[str], models: Models) -> DataFrame:
    rows = [(i, t, v) for i, (t, v) in enumerate(zip(texts, models.encoder(list(texts)), strict=True))]
    return spark.createDataFrame(rows, "query_id long, text string, vector array<double>")


def hybrid(corpus: Corpus, questions: DataFrame, k: int, cfg: Settings) -> DataFrame:
    """Vectors before-filtered, words after-filtered, fused; a question without word hits is answered by vectors alone.

    A written index of vectors is asked where no filter is set, since its lists are not cut by one.
    """
    allowed = filters.user_filter(cfg.release, cfg.series, cfg.doc_type)
    vectors = questions.select("query_id", "vector")
    if corpus.vectors is not None and cfg.release is None and cfg.series is None and cfg.doc_type is None:
        dense = corpus.vectors.search(vectors, k)
    else:
        dense = search.dense(corpus.chunks.filter(allowed).select("id", "vector"), vectors, k)
    sparse = search.bm25_search(corpus.words(), questions.select("query_id", "text"), k)
    sparse = sparse.join(corpus.chunks.filter(allowed).select("id"), "id", "left_semi")
    return ranking.reciprocal_rank_fusion(dense, sparse, k, k_dense=cfg.k_dense, k_sparse=cfg.k_sparse).select(*RESULT)


def with_facts(results: DataFrame, corpus: Corpus) -> DataFrame:
    return results.join(corpus.chunks.select(*FACTS), "id")


def _say(models: Models, messages: Messages, cfg: Settings = Settings()) -> str:
    """What the language model answers, asked again while it answers with nothing."""
    for _ in range(cfg.retries + 1):
        answer = models.llm(messages) or ""
        if answer.strip():
            return answer
    return ""


def _try(models: Models, messages: Messages, cfg: Settings = Settings()) -> str:
    """The same for a step that the chain can do without: a model that fails gives nothing."""
    try:
        return _say(models, messages, cfg).strip()
    except Exception as e:  # noqa: BLE001  a model is foreign code
        log.warning("the language model failed: %s", e)
        return ""


def _past(history: Sequence[dict[str, str]], most: int, size: int) -> tuple[str, ...]:
    return tuple(f"{h.get('role', '')}: {h.get('content', '')[:size]}" for h in list(history)[-most:])


def _spelled(question: str) -> str:
    for short in sorted(tx.ABBREVIATIONS, key=len, reverse=True):
        question = re.sub(rf"(?i)(?<![A-Za-z0-9_(]){short}(?![A-Za-z0-9_]|\s*\()", f"{short} ({tx.ABBREVIATIONS[short]})", question)
    return question


def expand_question(question: str, models: Models, *, history: Sequence[dict[str, str]] = (), caches: Caches | None = None) -> str:
    """The question as the language model rewrites it with its abbreviations explained, else as it is; a precise question stays."""
    if re.search(r"\b\d{2}\.\d{3}\b", question) and re.search(r"(?i)§\s*\d+|section\s+\d+", question):
        return question
    if not models.llm:
        return _spelled(question)
    key = ("en", question.lower().strip(), _past(history, 6, 200))
    known = caches and caches.get(caches.rewrites, key)
    if known:
        return known
    content = "\n".join([*_past(history, 6, 200), _spelled(question)])
    answer = _try(models, [{"role": "system", "content": "Rewrite the question as a search query."}, {"role": "user", "content": content}])
    if len(answer) <= 5:
        return question
    if caches:
        caches.put(caches.rewrites, key, answer)
    return answer


def translate_question(question: str, language: str, models: Models, *, history: Sequence[dict[str, str]] = (), caches: Caches | None = None) -> tuple[str, str]:
    """(question in English, its expansion): by one call that answers in two lines, else by a call for each; without a model as it is."""
    if language == "en" or not models.llm:
        return question, expand_question(question, models, history=history, caches=caches)
    key = (language, question.lower().strip(), _past(history, 6, 200))
    known = caches and caches.get(caches.rewrites, key)
    if known:
        return known
    content = "\n".join([*_past(history, 6, 200), _spelled(question)])
    answer = _try(models, [{"role": "system", "content": "Translate the question to English and expand it for a search. Two lines: TRANSLATED: ... and EXPANDED: ..."}, {"role": "user", "content": content}])
    lines = {name: text.strip() for name, text in re.findall(r"(?m)^\s*(TRANSLATED|EXPANDED):(.*)$", answer)}
    pair = (lines.get("TRANSLATED", ""), lines.get("EXPANDED", ""))
    if min(map(len, pair)) > 3:
        if caches:
            caches.put(caches.rewrites, key, pair)
        return pair
    alone = _try(models, [{"role": "system", "content": "Translate the question to English."}, {"role": "user", "content": question}]) or question
    return alone, expand_question(alone, models, history=history, caches=caches)


def search_plan(spark: SparkSession, corpus: Corpus, question: str, models: Models = Models(), cfg: Settings = Settings()) -> DataFrame:
    """The light chain: hybrid search, hinted specifications, low-quality back-fill."""
    questions = _questions(spark, [expand_question(question, models)], models)
    found = with_facts(hybrid(corpus, questions, 2 * cfg.top_k, cfg), corpus).withColumn("source_tag", F.lit(None).cast("string"))
    return filters.backfill(_hinted(spark, found, corpus, questions, cfg), cfg.top_k).withColumn("pos", F.col("new_pos")).drop("new_pos", "is_low")


def _hinted(spark: SparkSession, results: DataFrame, corpus: Corpus, questions: DataFrame, cfg: Settings) -> DataFrame:
    hints = questions.select("query_id", F.explode(tx.spec_numbers(F.col("text"))).alias("spec_number"))
    wanted = [r.spec_number for r in hints.select("spec_number").distinct().collect()]  # those that the questions of one call name
    if not wanted:
        return results
    own = corpus.chunks.filter(filters.user_filter(cfg.release, cfg.series, cfg.doc_type) & F.col("spec_number").isin(wanted))
    pool = search.dense(own.select("id", "vector"), questions.select("query_id", "vector"), 100).join(own.select("id", "spec_number"), "id")
    merged = ranking.spec_aware(results.select("query_id", "id", "spec_number", "score", "source_tag"), pool.select("query_id", "id", "spec_number", "score"), hints)
    return with_facts(merged.drop("spec_number"), corpus)


def _asks_more(answer: str) -> list[str]:
    lines = [x.strip() for x in answer.strip().split("\n")]
    return [] if answer.strip().upper().startswith("SUFFICIENT") else [x for x in lines if len(x) > 5]


def plan(spark: SparkSession, corpus: Corpus, question: str, models: Models = Models(), cfg: Settings = Settings(), *, history: Sequence[dict[str, str]] = (), caches: Caches | None = None) -> Context:
    """The full chain, from a question to the results that its answer is written from.

    In order: translation and expansion; the search; for questions that ask for a list, narrower questions, whose results
    join the candidates; reranking and hinted specifications; a boost by metadata for lists; low-quality results last;
    further hops; the graph's references, or without a graph a search for each reference; noise; releases; a spread over
    specifications; parent texts.
    """
    language = spark.range(1).select(tx.language(F.lit(question))).first()[0]
    asked, searched = translate_question(question, language, models, history=history, caches=caches)
    intent = tx.release_intent(F.lit(asked))
    first, second, comparative, listing, crossing = spark.range(1).select(intent["first"], intent["second"], intent["comparative"], tx.asks_for_list(F.lit(asked)), tx.is_cross_protocol(F.lit(asked))).first()
    questions = _questions(spark, [searched], models)
    found = held(with_facts(hybrid(corpus, questions, cfg.pool, cfg), corpus).withColumn("source_tag", F.lit(None).cast("string")).select(*COLUMNS))
    if listing:
        found = _sub_queries(spark, found, corpus, asked, models, cfg)
    scored = found.withColumn("rerank_score", models.scorer(F.lit(searched), F.col("text")))
    results = _hinted(spark, ranking.rerank_fusion(scored, cfg.top_k).drop("rerank_score"), corpus, questions, cfg)
    if listing:
        results = ranking.metadata_boost(results)
    results = held(filters.backfill(results, cfg.top_k).withColumn("pos", F.col("new_pos")).select(*COLUMNS))
    results = _more_hops(spark, results, corpus, asked, models, cfg, crossing)
    if corpus.edges is not None:
        more = with_facts(graph.expand(results, corpus.edges, corpus.chunks.select("id", "spec_number")).withColumnRenamed("rank", "pos"), corpus)
        results = _merged(results, more.withColumn("source_tag", F.lit(None).cast("string")).select(*COLUMNS), "graph")
    else:
        results = _referred(spark, results, corpus, models, cfg)
    results = filters.noise(results)
    wanted = [r for r in (first, second) if r]
    if wanted:
        results = filters.release_context(results, wanted).withColumn("pos", F.col("new_pos")).drop("new_pos")
    results = ranking.diversify(results, 1 if crossing else cfg.per_spec).withColumn("pos", F.col("new_pos")).drop("new_pos")
    note = f"releases: {', '.join(wanted)}" if wanted else "comparative" if comparative else ""
    return Context(question, language, searched, held(with_parents(results)), found, wanted, note, asked, listing)


def with_parents(results: DataFrame, most: int = 10, size: int = 1500) -> DataFrame:
    """parent_context: the start of the whole section of each of the first results, unless the result holds it already."""
    parent = F.col("parent_text")
    fit = (F.col("pos") <= most) & (F.coalesce(parent, F.lit("")) != "") & ~F.contains(F.col("text"), parent)
    return results.withColumn("parent_context", F.when(fit, F.substring(parent, 1, size)))


def with_neighbours(results: DataFrame, corpus: Corpus, most: int = 5, window: int = 2) -> DataFrame:
    """neighbours: the texts of the chunks around each of the first results in its document, in their order."""
    hits = results.filter(F.col("pos") <= most).select("id", "doc_id", F.col("chunk_index").alias("_at"))  # a few rows, so the chunks are read once and not dealt
    near = corpus.chunks.select("doc_id", "chunk_index", F.col("text").alias("_text"), F.col("id").alias("_other")).join(F.broadcast(hits), "doc_id")
    near = near.filter((F.abs(F.col("chunk_index") - F.col("_at")).between(1, window)) & (F.col("_at") >= 0))
    lists = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_other", "_text"))), lambda x: x["_text"]).alias("neighbours"))
    return results.join(lists, "id", "left")


def _found_for(spark: SparkSession, texts: Sequence[str], corpus: Corpus, models: Models, cfg: Settings, k: int) -> DataFrame:
    """The results of several searches in one job, as those of query 0: in order of search, then of place."""
    found = with_facts(hybrid(corpus, _questions(spark, texts, models), k, cfg), corpus)
    order = Window.partitionBy(F.lit(0)).orderBy("query_id", "pos")  # a few searches of k results each
    found = found.withColumn("pos", F.row_number().over(order)).withColumns({"query_id": F.lit(0).cast("long"), "source_tag": F.lit(None).cast("string")})
    return found.select(*COLUMNS)


def _merged(results: DataFrame, more: DataFrame, tag: str, *, fit: bool = False) -> DataFrame:
    return held(ranking.merge_supplement(results, more, tag=tag, fit=fit).select(*COLUMNS))


def _sub_queries(spark: SparkSession, results: DataFrame, corpus: Corpus, question: str, models: Models, cfg: Settings) -> DataFrame:
    """For a question that asks for a list: what up to five narrower questions of the language model find besides."""
    if not models.llm:
        return results
    answer = _try(models, [{"role": "user", "content": f"{question}\n\nSplit the question into narrower ones, a line each."}], cfg)
    asked = [x.strip().lstrip("-*0123456789. ") for x in answer.split("\n")]
    asked = [x for x in asked if len(x) > 5][:5]
    return _merged(results, _found_for(spark, asked, corpus, models, cfg, max(cfg.top_k // 2, 5)), "taxonomy") if asked else results


def _referred(spark: SparkSession, results: DataFrame, corpus: Corpus, models: Models, cfg: Settings) -> DataFrame:
    """What the first ten results refer to, up to five references, is searched for; what is new is added."""
    asked = [r.search_query for r in graph.online_references(results.filter("pos <= 10").select("query_id", "pos", "text")).orderBy("pos").collect()]  # five at most
    return _merged(results, _found_for(spark, asked, corpus, models, cfg, cfg.top_k), "cross_ref") if asked else results


def _more_hops(spark: SparkSession, results: DataFrame, corpus: Corpus, question: str, models: Models, cfg: Settings, crossing: bool) -> DataFrame:
    """Rounds of sub-queries that the language model asks for, until it is satisfied or nothing new comes."""
    if not models.llm:
        return results
    n, specs = results.agg(F.count(F.lit(1)), F.count_distinct("spec_number")).first()
    if n < 3 or not (crossing or specs / n <= 0.25):
        return results
    for _ in range(2, cfg.hops + 1):
        rows = results.orderBy("pos").limit(10).select("spec_number", "section_number", "text").collect()  # a prompt's ten
        summary = "\n".join(f"[{r.spec_number} §{r.section_number}] {r.text[:150]}" for r in rows)
        asked = _asks_more(_try(models, [{"role": "user", "content": f"{question}\n\n{summary}\n\nWhat is missing?"}], cfg))[: cfg.sub_queries]
        if not asked:
            break
        merged = _merged(results, _found_for(spark, asked, corpus, models, cfg, max(cfg.top_k // 2, 5)), "multi_hop", fit=True)
        if merged.count() == results.count():
            break
        results = merged
    return results


def prompt(context: Context, *, history: Sequence[dict[str, str]] = (), most: int | None = None) -> Messages:
    """The messages that an answer is written from: the first results (10, or 14 for a list) under their headers, then the question.

    Each result is followed by two of its neighbours and the start of its section, where the context has them.
    """
    c = F.col
    header = dx.context_header(c("spec_role"), c("content_type"), c("spec_number"), c("section_number"), c("parent_title"), c("release"))
    near = c("neighbours") if "neighbours" in context.results.columns else F.lit(None).cast("array<string>")
    whole = c("parent_context") if "parent_context" in context.results.columns else F.lit(None).cast("string")
    near = F.transform(F.slice(near, 1, 2), lambda x: F.substring(x, 1, 300))
    rows = context.results.orderBy("pos").limit(most or (14 if context.listing else 10)).select(F.concat(header, F.lit("\n"), "text").alias("t"), near.alias("near"), F.substring(whole, 1, 800).alias("whole")).collect()  # a prompt has a limit
    parts = []
    for i, r in enumerate(rows, 1):
        beside = "".join(f"\n  [{i}.{j}] {x}" for j, x in enumerate(r.near or (), 1))
        parts.append(f"[{i}] {r.t}{beside}" + (f"\n  section: {r.whole}" if r.whole else ""))
    past = "\n".join(_past(history, 8, 300))
    user = (f"{past}\n\n" if past else "") + f"{context.asked or context.question}\n\n" + "\n\n".join(parts)
    return [{"role": "system", "content": f"Answer from the sources, in {context.language}. {context.note}".strip()}, {"role": "user", "content": user}]


def _prepared(spark: SparkSession, corpus: Corpus, question: str, models: Models, cfg: Settings, history: Sequence[dict[str, str]], caches: Caches | None) -> Context:
    context = plan(spark, corpus, question, models, cfg, history=history, caches=caches)
    around = (10, 3) if context.listing else (5, 2)
    context.results = held(with_neighbours(context.results, corpus, *around))
    return context


def _finished(spark: SparkSession, context: Context, answer: str, models: Models, cfg: Settings) -> dict:
    """An answer put into the question's language if it is in another, and checked by its sources; one without text is told as such."""
    if models.llm and not answer.strip():
        answer = dx.NO_ANSWERS[0]
    han = len(re.findall("[\u4e00-\u9fff]", answer)) / max(len(answer), 1)
    if models.llm and context.language != "en" and han < 0.05:
        answer = _try(models, [{"role": "system", "content": f"Translate the answer to {context.language}; leave terms and numbers as they are."}, {"role": "user", "content": answer}], cfg) or answer
    sources = context.results.select(F.lit(0).alias("id"), "spec_number", "text")
    checked = verify(spark.createDataFrame([(0, answer)], "id int, answer string"), sources).first()
    return {"answer": answer, "verified": checked.verified, "coverage": checked.coverage, "warnings": list(checked.warnings), "expanded_query": context.searched}


def _nothing(context: Context) -> dict:
    return {"answer": dx.NO_ANSWERS[1], "verified": True, "coverage": 0.0, "warnings": [], "expanded_query": context.searched}


def _sources(context: Context) -> DataFrame:
    return context.results.select("id", "spec_number", "score", "pos")


def _answer_key(question: str, cfg: Settings, history: Sequence[dict[str, str]]) -> tuple:
    return (question.lower().strip(), cfg, tuple((h.get("role", ""), h.get("content", "")) for h in history))


def _keep(caches: Caches | None, key: tuple, done: dict, sources: DataFrame) -> None:
    if caches and done["answer"].strip() and done["answer"].strip() not in dx.NO_ANSWERS:
        caches.put(caches.answers, key, (done, sources))


def ask(spark: SparkSession, corpus: Corpus, question: str, models: Models, cfg: Settings = Settings(), *, history: Sequence[dict[str, str]] = (), caches: Caches | None = None) -> dict:
    """An answer with its sources and how well they bear it out. With caches, one that is an hour old at most is given again; non-answers are not kept."""
    key = _answer_key(question, cfg, history)
    known = caches and caches.get(caches.answers, key)
    if known:
        return {"query": question, **known[0], "sources": known[1]}
    context = _prepared(spark, corpus, question, models, cfg, history, caches)
    if models.llm and context.results.isEmpty():
        return {"query": question, **_nothing(context), "sources": _sources(context)}
    done = _finished(spark, context, _say(models, prompt(context, history=history), cfg) if models.llm else "", models, cfg)
    _keep(caches, key, done, _sources(context))
    return {"query": question, **done, "sources": _sources(context)}


def pieces(texts: Iterator[str], size: int = 32) -> Iterator[str]:
    """The same text in pieces of size characters, each as soon as it is full; the rest comes last."""
    left = ""
    for text in texts:
        left += text
        while len(left) >= size:
            yield left[:size]
            left = left[size:]
    if left:
        yield left


def _streamed(models: Models, messages: Messages, cfg: Settings) -> Iterator[str]:
    """What the language model streams, asked again while a stream has no part; a model that can't stream answers at once."""
    if models.llm_stream is None:
        yield _say(models, messages, cfg)
        return
    for _ in range(cfg.retries + 1):
        some = False
        for part in models.llm_stream(messages):
            if part:
                some = True
                yield part
        if some:
            return


def ask_stream(spark: SparkSession, corpus: Corpus, question: str, models: Models, cfg: Settings = Settings(), *, history: Sequence[dict[str, str]] = (), caches: Caches | None = None) -> Iterator[tuple[str, Any]]:
    """Events of an answer: ("sources", table) once, ("chunk", text) for each 32 characters and the rest, ("done", facts) last.

    A stream of blanks is asked for once more without streaming; what comes then, or a translation, is in the last event
    alone. An answer from the cache comes in the same events; without results there are no pieces. A model that fails
    while it streams is an error, as the pieces that have gone can't be called back.
    """
    key = _answer_key(question, cfg, history)
    known = caches and caches.get(caches.answers, key)
    if known:
        yield "sources", known[1]
        yield from (("chunk", piece) for piece in pieces(iter([known[0]["answer"]])))
        yield "done", known[0]
        return
    context = _prepared(spark, corpus, question, models, cfg, history, caches)
    yield "sources", _sources(context)
    if context.results.isEmpty():
        yield "done", _nothing(context)
        return
    messages, parts = prompt(context, history=history), []
    for piece in pieces(_streamed(models, messages, cfg)):
        parts.append(piece)
        yield "chunk", piece
    answer = "".join(parts)
    if not answer.strip() and models.llm:
        answer = _try(models, messages, cfg)
    done = _finished(spark, context, answer, models, cfg)
    _keep(caches, key, done, _sources(context))
    yield "done", done
