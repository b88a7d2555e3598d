"""Queries of documents, most of which SQL cannot say; tests hold those against plain statements of their rules."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import arrow
from quarry.operators import chunking, ingest
from quarry.plans.texts import cased
from quarry.sources import office
from quarry.sources.chunks import table
from quarry.streaming import traffic

SQL: dict[str, str] = {}
#: What XML can't hold.
NO_XML = r"[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _markdown(spark, d):
    """Documents with headings, a table and a formula."""
    k = F.col("doc_id").cast("string")
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(
        F.lit("# 1 Scope\n\nThis part is short.\n\n# 5 Layer "), k, F.lit("\n\nIntroduction.\n\n## 5.1 First\n\n"), F.substring("text", F.lit(1), half),
        F.lit("\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\nx = y\n$$\n\n## 5.2 Second\n\n"), F.regexp_replace(F.substring("text", half + 1, F.length("text")), r"\. ", ".\n\n"), F.lit("\n\n# Annex A\n\nEnd.\n"),
    )
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def chunk_documents(spark, d):
    return chunking.chunk(_markdown(spark, d))


def truncate_bytes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), ingest.cut_bytes(F.col("text"), 1000).alias("cut"))


def grid_to_pipe(spark, d):
    text = "Before\n+-----+-----+\n| a%s | b   |\n+=====+=====+\n| 1   | two |\n|     | x   |\n+-----+-----+\nAfter"
    return cased(spark, d, text, "no grid %s").select("id", arrow.pipe_tables(F.col("x")).alias("piped"))


def resolve_images(spark, d):
    rows = cased(spark, d, "[图: Figure 4.%d: layers] and [图: other]", "plain %s", "[图: Figure 4.21: a")
    images = F.create_map(F.lit("Figure 4.21"), F.lit("a.png"), F.lit("other"), F.lit("b.png"))
    return rows.select("id", arrow.resolve_images(F.col("x"), images).alias("resolved"))


def _word_file(title: Column, lines: Column, head: Column, row: Column) -> Column:
    """A Word document of a heading, a paragraph for each line, and a table of two rows."""

    @F.pandas_udf("binary")
    def packed(body: pd.Series) -> pd.Series:
        def one(xml: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", xml)
                z.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
            return out.getvalue()

        return body.map(one)

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    safe = lambda t: F.replace(F.replace(F.regexp_replace(t, NO_XML, ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    paragraph = lambda t, style="": F.concat(F.lit(f"<w:p>{style}<w:r><w:t>"), safe(t), F.lit("</w:t></w:r></w:p>"))
    cells = lambda r: F.concat(F.lit("<w:tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<w:tc>"), paragraph(c), F.lit("</w:tc>"))), ""), F.lit("</w:tr>"))
    heading = paragraph(title, '<w:pPr><w:pStyle w:val="H1"/></w:pPr>')
    return packed(F.concat(F.lit(f"<w:document {space}><w:body>"), heading, F.array_join(F.transform(lines, lambda x: paragraph(x)), ""), F.lit("<w:tbl>"), cells(head), cells(row), F.lit("</w:tbl></w:body></w:document>")))


def docx_markdown(spark, d):
    """Every document as a Word file, read back as Markdown."""
    k = F.col("doc_id").cast("string")
    rows = table(spark, d, "documents")
    word = _word_file(F.concat(F.lit("1 Document "), k), F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.lit("lang"), F.lit("n_chars")), F.array(F.coalesce("lang", F.lit("")), F.coalesce(F.col("n_chars").cast("string"), F.lit(""))))
    return office.converted(rows.select(k.alias("path"), word.alias("content"))).select(F.col("path").cast("long").alias("id"), "raw", "error")


SQL["docx_markdown"] = f"""SELECT doc_id AS id, '# 1 Document ' || doc_id || chr(10) || chr(10) || CASE WHEN len(p) > 0 THEN array_to_string(p, chr(10) || chr(10)) || chr(10) || chr(10) ELSE '' END
  || '| lang | n_chars |' || chr(10) || '|---|---|' || chr(10) || '| ' || coalesce(lang, '') || ' | ' || coalesce(n_chars::varchar, '') || ' |' AS raw, NULL::varchar AS error
FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{NO_XML}', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)"""


def rate_accepted(spark, d):
    return traffic.accepted(table(spark, d, "events"), limit=1, seconds=3600)


QUERIES = {f.__name__: f for f in (docx_markdown, chunk_documents, truncate_bytes, grid_to_pipe, resolve_images, rate_accepted)}
