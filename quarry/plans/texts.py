"""Queries of text rules, over texts that both engines compose from ids, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import graph, search
from quarry.operators.numbering import numbered
from quarry.operators.ranking import positions
from quarry.plans.retrieval import C
from quarry.sources.chunks import chunks, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ids(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"))


#: Ids of the documents' own texts and of the pages' addresses, beside those of made texts.
TEXT_IDS, PAGE_IDS = 10**9, 2 * 10**9


def cased(spark, d, *texts: str):
    """id and x: one of texts by id, in which %s is the id, %n a number and %d a two-digit one; then every document's own text and every page's address."""
    k = F.col("id")
    found = F.lit(texts[0])
    for i, t in enumerate(texts):
        found = F.when(k % len(texts) == i, F.lit(t)).otherwise(found)
    found = F.replace(found, F.lit("%s"), k.cast("string"))
    found = F.replace(found, F.lit("%n"), (100 + k % 900).cast("string"))
    made = _ids(spark, d).withColumn("x", F.replace(found, F.lit("%d"), (21 + k % 18).cast("string")))
    texts_ = table(spark, d, "documents").select((TEXT_IDS + F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("x"))
    return made.union(texts_).union(table(spark, d, "pages").select((PAGE_IDS + F.col("page_id")).alias("id"), F.coalesce("url", F.lit("")).alias("x")))


def cased_sql(*texts: str) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(texts))
    return f"""c AS (SELECT doc_id AS id, replace(replace(replace(CASE doc_id % {len(texts)} {cases} END, '%s', doc_id::varchar), '%n', (100 + doc_id % 900)::varchar), '%d', (21 + doc_id % 18)::varchar) AS x FROM documents UNION ALL SELECT {TEXT_IDS} + doc_id, coalesce(text, '') FROM documents UNION ALL SELECT {PAGE_IDS} + page_id, coalesce(url, '') FROM pages)"""


_T = "regexp_extract_all(lower(text), '\\d{2}\\.\\d{3}|[a-z0-9]+')"


@query(f"SELECT doc_id AS id, len({_T}) AS n, len(list_distinct({_T})) AS n_distinct, coalesce({_T}[1], '') AS first FROM documents")
def tokenize(spark, d):
    t = search.tokens(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"))


_LANG = ("how does cell %s attach", "随机接入流程 %s", "랜덤 액세스 절차 %s", "NR 测量 %d.%n report", "중 国 %s")


@query(f"WITH {cased_sql(*_LANG)}, n AS (SELECT id, len(regexp_extract_all(x, '{tx.CJK}')) AS zh, len(regexp_extract_all(x, '{tx.HANGUL}')) AS ko FROM c) SELECT id, CASE WHEN zh > ko THEN 'zh' WHEN ko > zh THEN 'ko' ELSE 'en' END AS lang FROM n")
def detect_language(spark, d):
    return cased(spark, d, *_LANG).select("id", tx.language(F.col("x")).alias("lang"))


_REFS = ("see TS %d.%n clause 5.%s and TR 38.901, Table 7.3.1-1", "as in 3GPP TS %d.%n §6.2.1; TS %d.%n, 7.1 too. See also clause 4.1 and Figure 4.1-1", "nothing %s of § 5 here", "ts 23.501 section 4.2 or TS 23.501 clause 4.2; Annex A1 of that specification, and clause 9 there")


def _found_sql(name: str, pattern: str, *groups: int) -> str:
    """name (id, x, start, fin, g1, ...): a pattern's matches with their places."""
    p = "'" + pattern.replace("'", "''") + "'"
    own = "".join(f", unnest(regexp_extract_all(x, {p}, {g})) AS g{i}" for i, g in enumerate(groups, 1))
    return f"""{name}_u AS (SELECT id, x, unnest(regexp_extract_all(x, {p})) AS h, unnest(string_split_regex(x, {p})[1:len(regexp_extract_all(x, {p}))]) AS gap, generate_subscripts(regexp_extract_all(x, {p}), 1) AS i{own} FROM c WHERE regexp_matches(x, {p})),
{name} AS (SELECT *, fin - length(h) AS start FROM (SELECT *, (sum(length(gap) + length(h)) OVER (PARTITION BY id ORDER BY i))::bigint AS fin FROM {name}_u))"""


def _like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_REF_SQL = f"""{cased_sql(*_REFS)}, {_found_sql('sp', tx.SPEC_WITH_CLAUSE, 1, 2, 3, 4)}, {_found_sql('cl', tx.CLAUSE_ALONE, 1)}, {_found_sql('ta', tx.TABLE_NUMBER, 1)}, {_found_sql('fi', tx.FIGURE_NUMBER, 1)},
parts AS (SELECT id, start, 0 AS rank, upper(g1) AS type, g2 || '.' || g3 AS spec_number, coalesce(g4, '') AS clause, '' AS tab, '' AS fig FROM sp
  UNION ALL SELECT id, start, 1, '?', '?', g1, '', '' FROM cl WHERE {_like("lower(substr(x, greatest(start - 50, 0) + 1, least(start, 50)))", tx.CLAUSE_CONTEXT)} AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.id = cl.id AND cl.start BETWEEN sp.start AND sp.fin)
  UNION ALL SELECT id, start, 2, '?', '?', '', g1, '' FROM ta UNION ALL SELECT id, start, 3, '?', '?', '', '', g1 FROM fi),
everything AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, rank) - 1 AS place FROM parts), refs AS (SELECT * FROM everything WHERE type <> '?')"""


def _all_refs(spark, d):
    return cased(spark, d, *_REFS).select("id", F.posexplode(tx.spec_references(F.col("x"))).alias("place", "r")).select("id", "place", "r.*")


def _refs(spark, d):
    return _all_refs(spark, d).filter("type <> '?'")


@query(f"WITH {_REF_SQL} SELECT id, place, start, type, spec_number, clause, tab AS table_number, fig AS figure_number FROM everything")
def extract_spec_refs(spark, d):
    """Specifications, clauses that stand alone, tables and figures, in order of place."""
    return _all_refs(spark, d).select("id", "place", "start", "type", "spec_number", "clause", F.col("table").alias("table_number"), F.col("figure").alias("figure_number"))


@query(f"WITH {_REF_SQL} SELECT id, place, type || ' ' || spec_number || CASE WHEN clause <> '' THEN ' clause ' || clause ELSE '' END || CASE WHEN tab <> '' THEN ' Table ' || tab ELSE '' END AS search_query FROM (SELECT *, row_number() OVER (PARTITION BY id, type, spec_number, clause ORDER BY place) AS k FROM refs) WHERE k = 1")
def dedup_refs(spark, d):
    first = positions(_refs(spark, d), F.asc("place"), by=["id", "type", "spec_number", "clause"], pos="k").filter("k = 1")
    return first.select("id", "place", tx.reference_query(F.struct("type", "spec_number", "clause", "table")).alias("search_query"))


@query(f"WITH {_REF_SQL} SELECT spec_number, list(DISTINCT CASE WHEN clause = '' THEN type || ' ' || spec_number ELSE clause END ORDER BY CASE WHEN clause = '' THEN type || ' ' || spec_number ELSE clause END) AS labels, count(DISTINCT id) AS n_chunks FROM refs GROUP BY spec_number")
def ref_graph(spark, d):
    label = F.when(F.col("clause") == "", F.concat("type", F.lit(" "), "spec_number")).otherwise(F.col("clause"))
    return _refs(spark, d).groupBy("spec_number").agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count_distinct("id").alias("n_chunks"))


@query(f"WITH {_REF_SQL} SELECT spec_number, coalesce(nullif(string_agg(DISTINCT nullif(clause, ''), ',' ORDER BY nullif(clause, '')), ''), '-') AS clauses FROM refs GROUP BY spec_number")
def ref_summary(spark, d):
    clauses = F.array_join(F.array_sort(F.collect_set(F.nullif("clause", F.lit("")))), ",")
    return _refs(spark, d).groupBy("spec_number").agg(F.coalesce(F.nullif(clauses, F.lit("")), F.lit("-")).alias("clauses"))


@query(f"WITH {_REF_SQL}, k AS (SELECT id % 40 AS query_id, id, place, type || ' ' || spec_number || CASE WHEN clause <> '' THEN ' clause ' || clause ELSE '' END AS search_query, row_number() OVER (PARTITION BY id % 40, type, spec_number, clause ORDER BY id, place) AS n FROM refs), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id, place) AS pos FROM k WHERE n = 1) SELECT query_id, pos, search_query FROM o WHERE pos <= 5")
def online_references(spark, d):
    """What a question's results refer to, to be searched for in turn: each reference once, the first five."""
    hits = cased(spark, d, *_REFS).withColumn("query_id", F.col("id") % 40)
    return graph.online_references(hits.select("query_id", F.col("id").alias("pos"), F.col("x").alias("text")))


@query(f"WITH {cased_sql(*_REFS)} SELECT id, list_sort(list_distinct(regexp_extract_all(x, '\\b(\\d{{2}}\\.\\d{{3}})\\b', 1))) AS specs FROM c")
def spec_numbers(spark, d):
    return cased(spark, d, *_REFS).select("id", tx.spec_numbers(F.col("x")).alias("specs"))


_INTENT = ("R17 vs R18 in QoS", "Release 18 handover %s", "what changed in 5G QoS?", "beam failure %s", "Rel-16 和 R17 的区别", "Rel.17 new features")
_PAIR, _ONE, _COMP = tx.RELEASE_PAIR, r"(?i)(?:Release\s+|Rel[.-]?\s*|R\s*)(\d{2})", tx.COMPARATIVE


@query(f"""WITH {cased_sql(*_INTENT)}, m AS (SELECT id, x, regexp_extract(x, '{_PAIR}', 1) AS a, regexp_extract(x, '{_PAIR}', 2) AS b, regexp_extract(x, '{_ONE}', 1) AS o, regexp_matches(x, '{_COMP}') AS comp FROM c)
SELECT id, CASE WHEN a <> '' THEN 'compare' WHEN o <> '' THEN 'single' ELSE 'none' END AS kind, CASE WHEN a <> '' THEN 'R' || a WHEN o <> '' THEN 'R' || o END AS first,
  CASE WHEN a <> '' THEN 'R' || b END AS second, a <> '' OR comp AS comparative FROM m""")
def release_intent(spark, d):
    return cased(spark, d, *_INTENT).select("id", tx.release_intent(F.col("x")).alias("i")).select("id", "i.*")


_ASK = ("What are the PRACH formats?", "有哪些帧格式", "explain beam failure %s", "information on cell %s", "MAC and RRC steps", "NR versus LTE bearers", "EN-DC setup", "pdcp reordering")


@query(f"WITH {cased_sql(*_ASK)} SELECT id, {_like('x', tx.TAXONOMY_ZH)} OR {_like('lower(x)', tx.TAXONOMY_EN)} AS flag FROM c")
def taxonomy_flag(spark, d):
    return cased(spark, d, *_ASK).select("id", tx.asks_for_list(F.col("x")).alias("flag"))


_LAYER_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_like('lower(x)', w)} THEN '{n}' END" for n, w in tx.LAYERS.items()) + "], lambda y: y IS NOT NULL)"


@query(f"""WITH {cased_sql(*_ASK)} SELECT id, {_LAYER_SQL} AS layers, len({_LAYER_SQL}) >= 2 OR ((contains(lower(x), 'nr') OR contains(lower(x), 'new radio')) AND contains(lower(x), 'lte'))
  OR {_like('lower(x)', ('双连接', 'en-dc', 'endc', 'mcg', 'scg'))} AS cross_protocol FROM c""")
def layers(spark, d):
    return cased(spark, d, *_ASK).select("id", tx.layers(F.col("x")).alias("layers"), tx.is_cross_protocol(F.col("x")).alias("cross_protocol"))


_PRECISE = ("TS %d.%n § 5", "TS %d.%n section 7 of it", "section 3 alone", "%d.%n alone")


@query(f"WITH {cased_sql(*_PRECISE)} SELECT id, regexp_matches(x, '\\b\\d{{2}}\\.\\d{{3}}\\b') AND regexp_matches(x, '(?i)§\\s*\\d+|section\\s+\\d+') AS precise FROM c")
def precise_query(spark, d):
    return cased(spark, d, *_PRECISE).select("id", tx.is_precise(F.col("x")).alias("precise"))


_ABBR = ("RRC setup %s", "the rrc (Radio) and Qos", "RRCR or RRC1 (MAC)", "PDSCH/PUSCH with HARQ", "no such %s")


def _expanded(text: str) -> str:
    """Nested replacements, longest first; without look-around a match takes the marks beside it, so each is made twice."""
    for short in sorted(tx.ABBREVIATIONS, key=len, reverse=True):
        full = tx.ABBREVIATIONS[short].replace("'", "''")
        for _ in range(2):
            text = f"regexp_replace({text}, '(?i)(^|[^A-Za-z0-9_(]){short}($|[^A-Za-z0-9_(\\s]|\\s+$|\\s+[^\\s(])', '\\1{short} ({full})\\2', 'g')"
    return text


@query(f"WITH {cased_sql(*_ABBR)} SELECT id, {_expanded('x')} AS expanded FROM c")
def expand_abbreviations(spark, d):
    return cased(spark, d, *_ABBR).select("id", tx.expand_abbreviations(F.col("x")).alias("expanded"))


_NAMES = ("%d%n-i%s.docx", "cover.docx", "%d%n-2-f60.docx", "TS_%d.%n_R18.docx")
_DIGITS = "regexp_replace(regexp_replace(x, '\\.[^.]*$', ''), '[^0-9]', '', 'g')"


@query(f"WITH {cased_sql(*_NAMES)} SELECT id, CASE WHEN length({_DIGITS}) >= 5 THEN left({_DIGITS}, 2) || '.' || substr({_DIGITS}, 3, 3) ELSE '' END AS spec_number FROM c")
def spec_from_filename(spark, d):
    return cased(spark, d, *_NAMES).select("id", tx.spec_from_name(F.col("x")).alias("spec_number"))


_STEMS = ("%d%n-i10", "%d%n-18-i00", "%d%n-2-i40", "%d%n-id0_s00-07", "cover", "38533-i80_s00-s04", "38133-ie0_sA.1-A.3", "36322")
_BASE = "regexp_replace(x, '_[sS].*$', '')"
_VER = f"lower(regexp_extract({_BASE}, '{tx.NAME_VERSION}', 1))"


@query(f"""WITH {cased_sql(*_STEMS)}, b AS (SELECT id, {_VER} AS v, CASE WHEN {_VER} <> '' THEN regexp_replace({_BASE}, '{tx.NAME_VERSION}', '') ELSE {_BASE} END AS bare FROM c)
SELECT id, CASE WHEN regexp_matches(bare, '^\\d{{2}}\\d{{2,3}}$') OR regexp_matches(bare, '^\\d{{5}}') THEN left(bare, 2) || '.' || substr(bare, 3, 3) ELSE '' END AS spec_number, nullif(v, '') AS version FROM b""")
def stem_parse(spark, d):
    return cased(spark, d, *_STEMS).select("id", tx.spec_from_stem(F.col("x")).alias("s")).select("id", "s.*")


_ORAN = ("O-RAN.WG1.CUS.0-R003-v11.00", "O-RAN.WG%d.MP.%s-R00%d-v07.00", "38300-i10", "o-ran.wg4.TS.CUS.0-r005-V20.00")


@query(f"WITH {cased_sql(*_ORAN)} SELECT id, CASE WHEN regexp_extract(x, '{tx.ORAN_NAME}', 1) <> '' THEN 'O-RAN.WG' || regexp_extract(x, '{tx.ORAN_NAME}', 1) || '.' || regexp_extract(x, '{tx.ORAN_NAME}', 2) ELSE '' END AS spec_number, regexp_extract(x, '{tx.ORAN_NAME}', 4) AS version FROM c")
def oran_parse(spark, d):
    return cased(spark, d, *_ORAN).select("id", tx.oran_name(F.col("x")).alias("o")).select("id", "o.*")


_HEADS = ("3GPP TS %d.%n V18.4.0 (2024-09) Technical Specification", "TR 38.901 V17.%s.0", "Something (Release 16) %s", "plain text %s")
_HV, _HL = f"regexp_extract(left(x, 800), '{tx.HEADER}', 2)", f"regexp_extract(left(x, 800), '{tx.RELEASE_LINE}', 1)"


@query(f"WITH {cased_sql(*_HEADS)} SELECT id, regexp_extract(left(x, 800), '{tx.HEADER}', 1) AS spec_number, {_HV} AS version, CASE WHEN {_HV} <> '' THEN 'R' || split_part({_HV}, '.', 1) WHEN {_HL} <> '' THEN 'R' || {_HL} ELSE '' END AS release FROM c")
def header_parse(spark, d):
    return cased(spark, d, *_HEADS).select("id", tx.header(F.col("x")).alias("h")).select("id", "h.*")


_PATHS = ("marked/R18/38_series/%d%n/raw.md", "marked/ORAN/O-RAN.WG4.TS.CUS.0-R005-v20.00/raw.md", "marked/R17/36_series/38101-2/raw.md", "other/%s.md")


@query(f"""WITH {cased_sql(*_PATHS)}, p AS (SELECT id, string_split(x, '/') AS p FROM c),
f AS (SELECT id, list_filter(p, lambda y: regexp_matches(y, '^\\d{{5}}(-\\d+)?$'))[1] AS s5, list_filter(p, lambda y: regexp_matches(y, '{tx.ORAN_NAME}'))[1] AS o, list_filter(p, lambda y: regexp_matches(y, '(?i)^R\\d+$'))[1] AS r FROM p),
g AS (SELECT *, coalesce(regexp_extract(o, '{tx.ORAN_NAME}', 4), '') AS v FROM f)
SELECT id, CASE WHEN s5 IS NOT NULL THEN left(s5, 2) || '.' || substr(s5, 3, 3) WHEN o IS NOT NULL THEN 'O-RAN.WG' || regexp_extract(o, '{tx.ORAN_NAME}', 1) || '.' || regexp_extract(o, '{tx.ORAN_NAME}', 2) ELSE '' END AS spec_number,
  CASE WHEN r IS NOT NULL THEN 'R' || substr(r, 2) WHEN s5 IS NOT NULL THEN '' ELSE v END AS release, CASE WHEN s5 IS NOT NULL THEN '' ELSE v END AS version, CASE WHEN s5 IS NOT NULL THEN '3gpp' WHEN o IS NOT NULL THEN 'oran' ELSE '' END AS doc_type FROM g""")
def path_parse(spark, d):
    return cased(spark, d, *_PATHS).select("id", tx.path_facts(F.col("x")).alias("p")).select("id", "p.*")


def _lines_sql(*texts: str) -> str:
    """cased_sql of texts with line ends."""
    return f"c AS (SELECT id, replace(x, '~', chr(10)) AS x FROM ({cased_sql(*[t.replace(chr(10), '~') for t in texts])[6:-1]}))"


_MD = ("a ![5G logo](x_%s.jpg) b", "<img src=\"x%s\" />text [go](#a-%s) on", "![](none) end   \n\n\n\n\nnext %s  ", "plain %s")
_MD_SQL = _lines_sql(*_MD)


@query(f"""WITH {_MD_SQL},
a AS (SELECT id, regexp_replace(x, '(?i)<img\\s+[^>]*/?>', '', 'g') AS x FROM c), b AS (SELECT id, regexp_replace(x, '!\\[\\s*([^\\]]*[^\\]\\s])\\s*\\]\\([^)]*\\)\\s*', '[图: \\1]', 'g') AS x FROM a),
e AS (SELECT id, regexp_replace(regexp_replace(x, '!\\[\\s*\\]\\([^)]*\\)\\s*', '', 'g'), '\\[([^\\]]+?)\\]\\(#[^)]+\\)', '\\1', 'g') AS x FROM b),
f AS (SELECT id, regexp_replace(regexp_replace(x, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), ' +\\n', chr(10), 'g') AS x FROM e)
SELECT id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS cleaned FROM f""")
def clean_markdown(spark, d):
    return cased(spark, d, *_MD).select("id", tx.clean_markdown(F.col("x")).alias("cleaned"))


_DIG = "coalesce(ltrim(regexp_replace(x, '[^0-9]', '', 'g'), '0'), '')"
_VERS = ("i10", "f60", "18.%d.0", "", "id0", "i10a")


@query(f"""WITH {cased_sql(*_VERS)}, v AS (SELECT id, nullif(x, '') AS x FROM c)
SELECT id, x AS version, row_number() OVER (ORDER BY x IS NOT NULL, length({_DIG}), {_DIG}, coalesce(x, ''), id) AS place FROM v""")
def version_order(spark, d):
    rows = cased(spark, d, *_VERS).select("id", F.nullif("x", F.lit("")).alias("version"))
    return numbered(rows.withColumn("_k", tx.version_key(F.col("version"))), "_k", "id", name="place").drop("_k")


_FIGS = ("Figure 4.2-%s: Overview", "Figure  6.1.%s：layout", "a plain title that is long enough to be cut somewhere, since it goes on for more than eighty characters", " logo %s ")


@query(f"WITH {cased_sql(*_FIGS)}, f AS (SELECT id, trim(x) AS t, regexp_extract(trim(x), '^(Figure\\s+\\S+)', 1) AS f FROM c) SELECT id, CASE WHEN f <> '' THEN regexp_replace(f, '[:：]+$', '') ELSE left(t, 80) END AS figure_id FROM f")
def figure_id(spark, d):
    return cased(spark, d, *_FIGS).select("id", tx.figure_id(F.col("x")).alias("figure_id"))


_UPS = ("38300-60.docx", "TS_38.300_R18.docx", "O-RAN.WG1.CUS.docx", "notes %s.md", "dir/bad name*?%s.md")


@query(f"""WITH {cased_sql(*_UPS)}, h AS (SELECT id, x, CASE id % 7 WHEN 0 THEN 'O-RAN ALLIANCE text' WHEN 1 THEN '3GPP TS 38.300 V18.4.0' ELSE 'text' END AS head FROM c)
SELECT id, CASE WHEN regexp_matches(x, '(?i)O-RAN\\.') OR regexp_matches(head, '(?i)O-RAN\\s+ALLIANCE|O-RAN\\s+WORKING\\s+GROUP') THEN 'oran'
  WHEN regexp_matches(x, '^\\d{{5}}') OR regexp_matches(x, '(?i)(?:TS|TR)[_\\s]\\d{{2}}\\.\\d{{3}}') OR regexp_matches(head, '(?i)3GPP\\s+(?:TS|TR)\\s+\\d{{2}}\\.\\d{{3}}\\s+V\\d+\\.\\d+\\.\\d+') THEN '3gpp' ELSE 'unknown' END AS kind,
  coalesce(nullif(regexp_replace(string_split(x, '/')[-1], '[^\\p{{L}}\\p{{N}}_.\\-()一-鿿]+', '_', 'g'), ''), 'unnamed') AS safe FROM h""")
def kind_classify(spark, d):
    k = F.col("id")
    head = F.when(k % 7 == 0, "O-RAN ALLIANCE text").when(k % 7 == 1, "3GPP TS 38.300 V18.4.0").otherwise("text")
    return cased(spark, d, *_UPS).select("id", tx.upload_kind(F.col("x"), head).alias("kind"), tx.safe_name(F.col("x")).alias("safe"))


@query("SELECT doc_id AS id, sha256(text) AS sha, md5(text) AS md5, left(sha256(lang || '|' || source), 16) AS short FROM documents")
def text_hash(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), F.substring(F.sha2(F.concat("lang", F.lit("|"), "source"), 256), 1, 16).alias("short"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, string_agg(role || ':' || left(text, 200), '|' ORDER BY turn) AS fingerprint FROM n WHERE k <= 6 GROUP BY conv_id""")
def history_fingerprint(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.substring("text", 1, 200)).alias("t"))))
    last = F.when(F.size("rows") > 6, F.slice("rows", -6, 6)).otherwise(F.col("rows"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.array_join(F.transform(last, lambda x: x.t), "|").alias("fingerprint"))


@query("""WITH s AS (SELECT doc_id AS id, text, unnest(generate_series(0, greatest(ceil(length(text) / 32.0)::bigint, 1) - 1)) AS place FROM documents) SELECT id, place, substr(text, place * 32 + 1, 32) AS piece FROM s""")
def stream_pieces(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(tx.pieces(F.col("text"))).alias("place", "piece"))


@query("SELECT doc_id AS id, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda x: trim(x)), lambda x: length(x) >= 20)[1:5] AS phrases FROM documents")
def key_phrases(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.key_phrases(F.col("text")).alias("phrases"))


@query(f"WITH {cased_sql(*_LANG)} SELECT id, round(len(regexp_extract_all(x, '[一-鿿]')) / greatest(length(x), 1)::double, 6) AS ratio FROM c")
def cjk_ratio(spark, d):
    return cased(spark, d, *_LANG).select("id", F.round(tx.cjk_ratio(F.col("x")), 6).alias("ratio"))


_TABLES = ("a~| x | y |~|---|:-:|~| 1 | 2 |", "+--+--+~| a |~+==+==+", "+ one plus %s", "no table %s", "|   %s   |")
_TABLE_SQL = _lines_sql(*_TABLES) + ", l AS (SELECT id, list_transform(string_split(x, chr(10)), lambda y: trim(y)) AS l FROM c)"
_HAS_TABLE = "len(list_filter(l, lambda y: regexp_matches(y, '^\\|[\\s\\-:|]+\\|$'))) >= 1 OR len(list_filter(l, lambda y: starts_with(y, '+'))) >= 2"


@query(f"WITH {_TABLE_SQL} SELECT id, {_HAS_TABLE} AS has_table FROM l")
def table_flag(spark, d):
    return cased(spark, d, *[t.replace("~", "\n") for t in _TABLES]).select("id", tx.has_table(F.col("x")).alias("has_table"))


_SPECS = ("38.211", "38.300", "38.331", "38.321", "38.413", "23.501", "36.331", "39.100", "32.%n")
_TITLE = ("Table of values", "General definitions", "Attach procedures", "Message contents")


@query(f"""WITH {cased_sql(*_SPECS)}, t AS (SELECT id, x, {"CASE id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLE)) + " END"} AS title FROM c)
SELECT id, CASE WHEN contains(title, 'table') OR contains(title, 'Table') THEN 'parameter_table' WHEN {_like('lower(title)', tx.DEFINITION_WORDS)} THEN 'definition' WHEN {_like('lower(title)', tx.PROCEDURE_WORDS)} THEN 'procedure' ELSE 'overview' END AS content_type,
  CASE WHEN x IN {tx.AUTHORITATIVE} THEN 'authoritative' WHEN x = '38.300' THEN 'overview' ELSE 'supporting' END AS spec_role,
  CASE WHEN left(x, 2) = '38' THEN CASE substr(x, 4, 1) WHEN '2' THEN 'phy_layer' WHEN '3' THEN CASE WHEN contains(x, '321') OR contains(x, '322') OR contains(x, '323') THEN 'mac_layer' ELSE 'rrc_layer' END WHEN '4' THEN 'ran_arch' ELSE '' END
  ELSE CASE split_part(x, '.', 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.SERIES_DOMAINS.items())} ELSE '' END END AS topic_domain FROM t""")
def classify_chunk(spark, d):
    k = F.col("id")
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLE]), (k % 4 + 1).cast("int"))
    spec = F.col("x")
    return cased(spark, d, *_SPECS).select("id", tx.content_type(F.lit(""), title).alias("content_type"), tx.spec_role(spec).alias("spec_role"), tx.topic_domain(spec).alias("topic_domain"))


@query(f"""{C}, l AS (SELECT *, CASE WHEN id % 5 < 3 THEN 'p' || (id // 5) ELSE '' END AS parent_text FROM chunks), m AS (SELECT *, lag(parent_text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev FROM l),
g AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM parent_text THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS run FROM m)
SELECT id, CASE WHEN parent_text <> '' THEN min(chunk_index) OVER (PARTITION BY doc_id, run) ELSE 0 END AS parent_chunk_id FROM g""")
def parent_runs(spark, d):
    """Runs of neighbours with one parent text share the first one's place."""
    from quarry.operators.chunking import parent_runs as runs

    rows = chunks(spark, d).withColumn("parent_text", F.when(F.col("id") % 5 < 3, F.concat(F.lit("p"), F.floor(F.col("id") / 5).cast("string"))).otherwise(""))
    return runs(rows).select("id", "parent_chunk_id")


@query(f"""{C}, m AS (SELECT id, doc_id, chunk_index, CASE WHEN id % 3 = 0 THEN parent_section_id END AS heading FROM chunks) SELECT id, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS heading FROM m""")
def nearest_heading(spark, d):
    """The last heading at or before a place."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks(spark, d).withColumn("h", F.when(F.col("id") % 3 == 0, F.col("parent_section_id"))).select("id", F.last("h", ignorenulls=True).over(w).alias("heading"))


@query("""WITH s AS (SELECT doc_id AS id, text, unnest(generate_series(0, greatest(ceil((length(text) - 100) / 400.0)::bigint, 1) - 1)) AS place FROM documents) SELECT id, place, length(substr(text, place * 400 + 1, 500)) AS size, md5(substr(text, place * 400 + 1, 500)) AS md5 FROM s""")
def fixed_windows(spark, d):
    n = F.greatest(F.ceil((F.length("text") - 100) / 400).cast("int"), F.lit(1))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("place"))
    return rows.select("id", "place", F.substring("text", F.col("place") * 400 + 1, F.lit(500)).alias("p")).select("id", "place", F.length("p").alias("size"), F.md5("p").alias("md5"))


_SIB = """o AS (SELECT *, list_transform(string_split(section_number, '.'), lambda x: x::int) AS o FROM chunks)"""


@query(f"{C}, {_SIB} SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY doc_id, parent_section_id ORDER BY o, id) AS dst, 'SIBLING' AS type, 0.3::double AS weight FROM o) WHERE dst IS NOT NULL")
def xref_siblings(spark, d):
    return graph.sibling_edges(chunks(spark, d))


_TOP = """o AS (SELECT id, 'g' || (id // 40) AS doc_id, 1 + (id * 7) % 40 AS n FROM chunks)"""


@query(f"{C}, {_TOP} SELECT src, dst, 'NEXT_SECTION' AS type, 0.4::double AS weight FROM (SELECT id AS src, n, lead(id) OVER w AS dst, lead(n) OVER w AS m FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n, id)) WHERE m = n + 1")
def xref_next_section(spark, d):
    k = F.col("id")
    rows = chunks(spark, d).select("id", F.concat(F.lit("g"), F.floor(k / 40).cast("string")).alias("doc_id"), (1 + k * 7 % 40).cast("string").alias("section_number"), F.lit("").alias("parent_section_id"), "chunk_index")
    return graph.next_section_edges(rows)


_INDEX = """ix AS (SELECT spec_number, section_number AS section, id, 0 AS place FROM chunks UNION ALL SELECT spec_number, parent_section_id, id, 1 FROM chunks WHERE parent_section_id <> '' AND parent_section_id <> section_number)"""


@query(f"""{C}, {_INDEX}, f AS (SELECT spec_number, section, arg_min(id, {{'a': id, 'b': place}}) AS src FROM ix GROUP BY ALL),
e AS (SELECT src, id AS dst, 'PARENT_CHILD' AS type FROM chunks JOIN f ON f.spec_number = chunks.spec_number AND f.section = chunks.parent_section_id WHERE parent_section_id <> ''
UNION ALL SELECT src, dst, 'SIBLING' FROM ({SQL['xref_siblings'].split('SELECT * FROM (', 1)[1].rsplit(') WHERE', 1)[0].replace(' FROM o', ' FROM (SELECT *, list_transform(string_split(section_number, $$.$$), lambda x: x::int) AS o FROM chunks)')}) WHERE dst IS NOT NULL)
SELECT type, count(*) AS n, min(src) AS first FROM e GROUP BY type""")
def xref_edges_by_type(spark, d):
    edges = _edges(spark, d)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"))


def _edges(spark, d):
    nodes = chunks(spark, d)
    return graph.parent_edges(nodes).unionByName(graph.sibling_edges(nodes))


@query(SQL["xref_edges_by_type"].rsplit("SELECT type, count", 1)[0] + "SELECT src, type, list(dst ORDER BY dst) AS targets FROM e GROUP BY src, type")
def xref_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d))


@query(f"""{C}, {_INDEX}, a AS (SELECT id AS ref, spec_number, (1 + id % 9) || '.' || (id % 6) || CASE WHEN id % 2 = 0 THEN '.' || (id % 12) ELSE '' END AS clause FROM chunks),
l AS (SELECT ref, spec_number, unnest([clause, array_to_string(string_split(clause, '.')[1:len(string_split(clause, '.')) - 1], '.'), array_to_string(string_split(clause, '.')[1:len(string_split(clause, '.')) - 2], '.')]) AS section, unnest([0, 1, 2]) AS up FROM a),
h AS (SELECT ref, id, 2 * up AS level FROM l JOIN ix USING (spec_number, section) WHERE section <> '' UNION SELECT ref, id, 2 * up + 1 FROM l JOIN ix ON ix.spec_number = l.spec_number AND starts_with(ix.section, l.section || '.') WHERE l.section <> '')
SELECT DISTINCT ref, id, level FROM (SELECT *, min(level) OVER (PARTITION BY ref) AS best FROM h) WHERE level = best""")
def xref_resolve(spark, d):
    k = F.col("id")
    clause = F.concat((1 + k % 9).cast("string"), F.lit("."), (k % 6).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("."), (k % 12).cast("string"))).otherwise(""))
    nodes = chunks(spark, d)
    return graph.resolve(nodes.select(k.alias("ref"), "spec_number", clause.alias("clause")), nodes)


_ASN = ("Foo-Bar%s ::= SEQUENCE { a INTEGER }", "ab ::= INTEGER and QosId ::= Integer, QosId ::= CHOICE", "true ::= BOOLEAN", "none %s")


@query(f"""WITH {cased_sql(*_ASN)}, m AS (SELECT id, unnest(regexp_extract_all(x, '{graph.ELEMENT}', 1)) AS name, unnest(regexp_extract_all(x, '{graph.ELEMENT}', 2)) AS kind, generate_subscripts(regexp_extract_all(x, '{graph.ELEMENT}', 1), 1) AS k FROM c)
SELECT id, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY k) AS n FROM m WHERE length(name) >= 3 AND lower(name) NOT IN {graph.GENERIC_NAMES}) WHERE n = 1""")
def ie_defines(spark, d):
    return graph.element_definitions(cased(spark, d, *_ASN).withColumnRenamed("x", "text"))


_ANS = ("As TS %d.%n says [1] and [9]", "无法确定 %s", "TS 22.201 and TS 99.%n hold", "nothing cited %s")


@query(f"""{C}, {cased_sql(*_ANS)}, s AS (SELECT DISTINCT spec_number FROM chunks), r AS (SELECT id, unnest(regexp_extract_all(x, 'TS\\s*(\\d{{2}}\\.\\d{{3}})', 1)) AS spec_number FROM c)
SELECT r.id, r.spec_number, s.spec_number IS NULL AS unseen FROM (SELECT DISTINCT * FROM r) r LEFT JOIN s USING (spec_number)""")
def verify_refs(spark, d):
    """Specifications that an answer cites, and whether its sources lack them."""
    from quarry.plans.answers import cited_specs

    sources = chunks(spark, d).select("spec_number")
    return cited_specs(cased(spark, d, *_ANS).withColumnRenamed("x", "answer"), sources)
