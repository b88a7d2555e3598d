"""Queries of document, prompt and request rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import documents as dx
from quarry.functions import text as tx
from quarry.plans.retrieval import R
from quarry.plans.texts import _lines_sql, cased, cased_sql
from quarry.sources.chunks import ranked, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def text_column():
    return F.col("x")


_PANDOC = ("[Intro](#i) text {#a .b} more", "Figure 4.2-1: Model\n![](media/image%s.emf)\nend", "![](media/image3.emf){width=1}\n\nFigure 4.2-%d: Model\nend", "body\n\n\n\n\nnext  \nline ![](x.png) z", "text %s\n\n# Annex B (informative): Change history\n\n| a | b |")


def _chain(text: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        text = f"regexp_replace({text}, '{pattern}', {put}, 'g')"
    return text


_POST = _chain("x", (dx.LINK, r"'\1'"), (dx.ATTRIBUTES, "''"), (rf"(?m)^{dx.CAPTION}\n+{dx.IMAGE}", r"'[\1]'"), (rf"{dx.IMAGE}\s*\n+{dx.CAPTION}", r"'[\1]'"), (rf"{dx.IMAGE}\s*", "''"), (r"!\[\]\([^)]*\)\s*", "''"),
               (dx.HISTORY, "''"), (r"\n{4,}", "chr(10) || chr(10) || chr(10)"), (r" +\n", "chr(10)"), (r"^\s+|\s+$", "''"))


@query(f"WITH {_lines_sql(*_PANDOC)} SELECT id, {_POST} AS cleaned FROM c")
def postprocess_markdown(spark, d):
    return cased(spark, d, *_PANDOC).select("id", dx.postprocess(text_column()).alias("cleaned"))


_DOCS = ("# Contents\n\n## 3GPP TS 38.%n V18.1.0 ##\nbody", "# logo here\n# O-RAN Working Group %s\n# A", "# Contents\n# First heading %s\ntext", "no title %s")
_BARE = "trim(ltrim(y, '#'))"


@query(f"""WITH {_lines_sql(*_DOCS)}, l AS (SELECT id, list_transform(string_split(x, chr(10))[1:60], lambda y: trim(y)) AS l FROM c)
SELECT id, coalesce(list_transform(list_filter(l[1:30], lambda y: regexp_matches(y, '(?i)3GPP\\s+(TS|TR)\\s+\\d{{2}}\\.\\d{{3}}\\s+V\\d+')), lambda y: {_BARE})[1],
  list_transform(list_filter(l[1:30], lambda y: starts_with({_BARE}, 'O-RAN Working Group') OR starts_with({_BARE}, 'O-RAN ALLIANCE')), lambda y: {_BARE})[1],
  list_transform(list_filter(l, lambda y: starts_with(y, '#') AND length(y) > 3 AND NOT contains(lower(y), 'contents') AND NOT contains(lower(y), 'logo')), lambda y: {_BARE})[1], '') AS title FROM l""")
def document_title(spark, d):
    return cased(spark, d, *_DOCS).select("id", dx.title(text_column()).alias("title"))


_GAPS = ("SUFFICIENT", " sufficient, all is there", "first query %s\n\nab\nsecond query\nthird query\nfourth query\nfifth query", "tiny")


@query(f"""WITH {_lines_sql(*_GAPS)}, t AS (SELECT id, trim(x) AS t FROM c) SELECT id, starts_with(upper(t), 'SUFFICIENT') AS sufficient,
  CASE WHEN starts_with(upper(t), 'SUFFICIENT') THEN [] ELSE list_filter(list_transform(string_split(t, chr(10)), lambda y: trim(y)), lambda y: length(y) > 5)[1:4] END AS queries FROM t""")
def gap_response(spark, d):
    return cased(spark, d, *_GAPS).select("id", dx.gap_response(text_column()).alias("g")).select("id", "g.*")


_LINES = ("TRANSLATED: beam failure %s\nEXPANDED: beam failure recovery", "EXPANDED: only this", "TRANSLATED: ab\nEXPANDED: abcdef", "  TRANSLATED:  spaced %s \n EXPANDED:  well spaced ")
_TR, _EX = (f"trim(regexp_extract(x, '(?m)^\\s*{n}:(.*)$', 1))" for n in ("TRANSLATED", "EXPANDED"))


@query(f"WITH {_lines_sql(*_LINES)} SELECT id, CASE WHEN length({_TR}) > 3 AND length({_EX}) > 3 THEN {_TR} END AS translated, CASE WHEN length({_TR}) > 3 AND length({_EX}) > 3 THEN {_EX} END AS expanded FROM c")
def translation_lines(spark, d):
    return cased(spark, d, *_LINES).select("id", dx.translation(text_column()).alias("t")).select("id", "t.*")


@query(f"{R} SELECT query_id, id, CASE WHEN id % 3 = 0 THEN text ELSE parent_title || chr(10) || text END AS input FROM ranked WHERE pos <= 5")
def embedding_input(spark, d):
    rows = ranked(spark, d).filter("pos <= 5").withColumn("path", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("parent_title")))
    return rows.select("query_id", "id", dx.embedding_text(F.col("text"), F.col("path"), F.lit(""), True).alias("input"))


_NORMAL = ("38300", "38.300", "%d%n", "O-RAN.WG1")


@query(f"WITH {cased_sql(*_NORMAL)} SELECT id, CASE WHEN regexp_matches(x, '^\\d{{5}}$') THEN left(x, 2) || '.' || substr(x, 3, 3) ELSE x END AS spec_number FROM c")
def spec_normalise(spark, d):
    return cased(spark, d, *_NORMAL).select("id", dx.normal_spec(text_column()).alias("spec_number"))


_ROUTES = ("/api/v1/ask", "/api/v1/documents/%s", "/", "/health/live/", "/metrics")


@query(f"""WITH {cased_sql(*_ROUTES)}, b AS (SELECT id, regexp_replace(x, '^/+|/+$', '', 'g') AS b FROM c)
SELECT id, CASE WHEN regexp_extract(b, '^api/v1/([^/]+)', 1) <> '' THEN regexp_extract(b, '^api/v1/([^/]+)', 1) WHEN b = '' THEN 'root' ELSE replace(b, '/', '_') END AS label FROM b""")
def route_label(spark, d):
    return cased(spark, d, *_ROUTES).select("id", dx.route_label(text_column()).alias("label"))


_INTENTS = ("R17 vs R18 in QoS", "Release 18 handover %s", "what changed in 5G QoS?", "beam failure %s")


@query(f"""WITH {cased_sql(*_INTENTS)}, m AS (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE 'note ' || id END AS note, regexp_extract(x, '{tx.RELEASE_PAIR}', 1) AS a, regexp_extract(x, '{tx.RELEASE_PAIR}', 2) AS b,
  regexp_extract(x, '(?i)(?:Release\\s+|Rel[.-]?\\s*|R\\s*)(\\d{{2}})', 1) AS o, regexp_matches(x, '{tx.COMPARATIVE}') AS comp FROM c)
SELECT id, CASE WHEN note = '' THEN '' ELSE concat_ws(chr(10), '{dx.NOTE_HEAD}', CASE WHEN a <> '' THEN '{dx.NOTE_TWO[0]}R' || a || '{dx.NOTE_TWO[1]}R' || b || '{dx.NOTE_TWO[2]}'
  WHEN o <> '' THEN '{dx.NOTE_ONE[0]}R' || o || '{dx.NOTE_ONE[1]}' WHEN comp THEN '{dx.NOTE_ANY}' END, '- ' || note) END AS paragraph FROM m""")
def release_note(spark, d):
    rows = cased(spark, d, *_INTENTS).withColumns({"i": tx.release_intent(text_column()), "note": F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("note "), F.col("id").cast("string")))})
    return rows.select("id", dx.release_note(F.col("i.kind"), F.col("i.first"), F.col("i.second"), F.col("i.comparative"), F.col("note")).alias("paragraph"))


_WATCHED = ("TS 38.%n_R18.docx", "%d%n-rel18.docx", "notes.docx", "TR23.501 release_17.docx")


@query(f"""WITH {cased_sql(*_WATCHED)}, s AS (SELECT id, regexp_replace(x, '\\.[^.]*$', '') AS s FROM c),
p AS (SELECT id, CASE WHEN regexp_extract(s, '(?i)(?:TS|TR)\\s*(\\d{{2}})\\.(\\d{{3}})', 1) <> '' THEN regexp_extract(s, '(?i)(?:TS|TR)\\s*(\\d{{2}})\\.(\\d{{3}})', 1) || regexp_extract(s, '(?i)(?:TS|TR)\\s*(\\d{{2}})\\.(\\d{{3}})', 2) ELSE regexp_extract(s, '(\\d{{4,5}})', 1) END AS n, regexp_extract(s, '[Rr]el(?:ease)?[._-]?(\\d{{2}})', 1) AS r FROM s)
SELECT id, coalesce(try_cast(left(n, 2) AS int), 0) AS series, n AS spec_number, CASE WHEN r <> '' THEN 'R' || r ELSE '' END AS release FROM p""")
def monitored_name(spark, d):
    return cased(spark, d, *_WATCHED).select("id", dx.monitored_name(text_column()).alias("m")).select("id", "m.*")


_UPLOADS = ("38300-60.docx", "%d%n.md", "O-RAN.WG1.CUS.md", "O-RAN.WG1.CUS.docx", "notes %s.md", "TS_38.300.md")


@query()
def upload_target(spark, d):
    k = F.col("id")
    head = F.when(k % 3 == 0, "3GPP TS 38.300 V17.4.0").when(k % 3 == 1, "x (Release 16)").otherwise("text")
    return cased(spark, d, *_UPLOADS).select("id", dx.upload_target(text_column(), head).alias("target"))


_ANSWERS = ("an answer %s", "   ", "未在规范库中找到相关内容。", "抱歉，模型未能生成回答，请重试或换个问法。")


@query(f"WITH {cased_sql(*_ANSWERS)} SELECT id, trim(x) <> '' AND trim(x) NOT IN {dx.NO_ANSWERS} AS cacheable FROM c")
def cacheable(spark, d):
    return cased(spark, d, *_ANSWERS).select("id", dx.is_cacheable(text_column()).alias("cacheable"))


_TARGETS = ("38.%n", "36.211", "O-RAN.WG1", "x")


@query(f"WITH {cased_sql(*_TARGETS)} SELECT id, coalesce(try_cast(split_part(x, '.', 1) AS int) = 38, false) AS target, id % 4 = 0 AND id % 3 = 0 AS is_references FROM c")
def graph_gates(spark, d):
    k = F.col("id")
    section, own = F.when(k % 4 == 0, "2").otherwise("3"), F.when(k % 3 == 0, "References").otherwise("Scope")
    return cased(spark, d, *_TARGETS).select("id", dx.is_target_series(text_column(), (38,)).alias("target"), dx.is_references_section(section, own, F.lit("")).alias("is_references"))


_TREF = ("see Table 6.3.3.2-1", "Table 4.1 – 2 holds", "table of contents %s", "Table 7-1")


@query(f"WITH {cased_sql(*_TREF)} SELECT id, regexp_matches(x, '{dx.TABLE_REFERENCE}') AS refers FROM c")
def table_reference(spark, d):
    return cased(spark, d, *_TREF).select("id", F.rlike(text_column(), F.lit(dx.TABLE_REFERENCE)).alias("refers"))


def _badges(column: str, names: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(f"{R} SELECT query_id, id, '[' || concat_ws(' | ', {_badges('spec_role', dx.ROLE_BADGES)}, {_badges('content_type', dx.TYPE_BADGES)}, 'TS ' || spec_number, '§' || section_number, parent_title, '(' || release || ')') || ']' AS header FROM ranked WHERE pos <= 5")
def context_header(spark, d):
    c = F.col
    return ranked(spark, d).filter("pos <= 5").select("query_id", "id", dx.context_header(c("spec_role"), c("content_type"), c("spec_number"), c("section_number"), c("parent_title"), c("release")).alias("header"))


@query("""SELECT conv_id, string_agg('### ' || turn || ': ' || role || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def online_context(spark, d):
    """Numbered references, formatted and joined in order."""
    row = F.concat(F.lit("### "), F.col("turn").cast("string"), F.lit(": "), "role", F.lit("\n"), "text", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("turn", row.alias("r"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x.r), "\n").alias("context"))


_IMG = ("![Figure 4.%d: one](a%s.png) text ![logo](b.png)", "![Figure 4.%d: again](c%s.png)", "none %s")
_IMG_RX = r"!\[([^\]]+)\]\(([^)]+)\)"


@query(f"""WITH {cased_sql(*_IMG)}, m AS (SELECT 's' || (id % 5) AS spec_number, unnest(regexp_extract_all(x, '{_IMG_RX}', 1)) AS t, unnest(regexp_extract_all(x, '{_IMG_RX}', 2)) AS path, generate_subscripts(regexp_extract_all(x, '{_IMG_RX}', 1), 1) AS k FROM c),
f AS (SELECT spec_number, CASE WHEN regexp_matches(trim(t), '^Figure\\s+\\S+') THEN regexp_replace(regexp_extract(trim(t), '^(Figure\\s+\\S+)', 1), '[:：]+$', '') ELSE left(trim(t), 80) END AS figure_id, path, k FROM m)
SELECT spec_number, figure_id, path FROM (SELECT *, row_number() OVER (PARTITION BY spec_number, figure_id ORDER BY k, path) AS n FROM f) WHERE n = 1""")
def image_map(spark, d):
    from quarry.sources.files import image_map as images

    return images(cased(spark, d, *_IMG).select(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("spec_number"), text_column().alias("text")))


def ivf_topk(spark, d):
    """Approximate search in a written index of inverted lists, a fifth of them for each query; tests hold its recall against the exact one."""
    from quarry.operators import search
    from quarry.operators.storage import staged_path

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = search.ivf_create(vectors, staged_path(spark, "ivf"))
    return index.search(vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


QUERIES["ivf_topk"] = ivf_topk
