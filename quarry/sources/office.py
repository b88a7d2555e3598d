"""Word documents and archives of them as sources: zip members as rows, and OOXML bodies as Markdown by column expressions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import documents as dx
from quarry.functions.text import header, oran_name, spec_from_name, spec_from_stem, version_key
from quarry.operators.ranking import positions
from quarry.sources.files import documents

# The format's namespaces and parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BODY, STYLES, NUMBERING, LINKS = "word/document.xml", "word/styles.xml", "word/numbering.xml", "word/_rels/document.xml.rels"
#: Bytes that a member may unpack to.
MOST = 1 << 30

_BLOCK = pa.struct([("style", pa.string()), ("list", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])
_BODY = "path string, blocks array<struct<style:string,list:string,depth:int,text:string,rows:array<array<string>>>>, levels map<string,int>, bullets map<string,boolean>, error string"


def members(archives: DataFrame, wanted: str) -> DataFrame:
    """(path, name, size, content, error) of the members of zip archives (path, content) whose name matches a pattern.

    An archive that can't be opened is one row with its error and no name, a member that can't be read one with its
    name; an archive without such members gives no rows, folders are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _members(content.as_buffer().to_pybytes() if content.is_valid else b"", wanted):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, *row), (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["path", "name", "size", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, size long, content binary, error string")


def _members(content: bytes, wanted: str) -> Iterator[tuple[str | None, int | None, bytes | None, str | None]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield None, None, None, str(e)
        return
    for info in archive.infolist():
        if not info.is_dir() and re.search(wanted, info.filename):
            try:
                yield info.filename, info.file_size, _unpacked(archive, info), None
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError, OSError) as e:
                yield info.filename, info.file_size, None, str(e) or type(e).__name__
            except Exception as e:  # noqa: BLE001  decompressors raise errors of their own
                yield info.filename, info.file_size, None, f"{type(e).__name__}: {e}"


def _unpacked(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    if info.file_size > MOST:
        raise ValueError(f"member of {info.file_size} bytes")
    return archive.read(info)


def newest_members(archives: DataFrame, wanted: str = r"(?i)\.docx$", existing: DataFrame | None = None) -> DataFrame:
    """Members (path, name, stem, spec_number, version, content) of archives, for each specification those of its newest version.

    Archives are named by specification and version; the versions are compared by archive, and only the newest ones are
    opened. existing (stem) are those that need not be read again. Archives that can't be opened come back as rows with
    an error.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    named = archives.select("path", "content", stem.alias("stem")).withColumn("_s", spec_from_stem(F.col("stem")))
    named = named.select("path", "content", "stem", F.col("_s.spec_number").alias("spec_number"), F.col("_s.version").alias("version")).filter("spec_number <> ''")
    best = positions(named.select("path", "stem", "spec_number", "version"), F.desc(version_key(F.col("version"))), F.asc("path"), by=["spec_number"], pos="_n").filter("_n = 1").drop("_n")
    if existing is not None:
        best = best.join(existing.select("stem").distinct(), "stem", "left_anti")
    found = members(named.join(best.select("path"), "path", "left_semi"), wanted)
    return best.join(found, "path").select("path", "name", "stem", "spec_number", "version", "size", "content", "error")


def _text(node: ElementTree.Element, links: dict[str, str]) -> str:
    """The text of a paragraph, formulas between dollar signs and images as links; what was deleted is left out."""
    out = []
    for child in node:
        tag = child.tag
        if tag == W + "t":
            out.append(child.text or "")
        elif tag in (W + "tab", W + "br", W + "cr"):
            out.append(" ")
        elif tag == W + "noBreakHyphen":
            out.append("-")
        elif tag in (M + "oMath", M + "oMathPara"):
            said = "".join(t.text or "" for t in child.iter(M + "t"))
            out.append(f"${said}$" if said else "")
        elif tag in (W + "drawing", W + "pict", W + "object"):
            names = [v for x in child.iter() for k, v in x.attrib.items() if k in (R + "embed", R + "id")]
            out += [f"![]({links[n]})" for n in names if n in links and links[n].startswith("media/")]
            out += [_text(x, links) for x in child.iter(W + "txbxContent")]
        elif tag not in (W + "del", W + "pPr", W + "rPr", W + "moveFrom"):
            out.append(_text(child, links))
    return "".join(out)


def _value(node: ElementTree.Element | None, path: str) -> str | None:
    found = node.find(path) if node is not None else None
    return None if found is None else found.get(W + "val")


def _row(row: ElementTree.Element, links: dict[str, str]) -> list[str]:
    """The cells of a table row; one that spans columns is followed by empty ones, one that goes on from above is empty."""
    out: list[str] = []
    for cell in row.findall(W + "tc"):
        merged = cell.find(f"{W}tcPr/{W}vMerge")
        parts = [] if merged is not None and merged.get(W + "val") != "restart" else [_text(p, links).strip() for p in cell.iter(W + "p")]
        out += [" ".join(filter(None, parts)), *[""] * (int(_value(cell, f"{W}tcPr/{W}gridSpan") or 1) - 1)]
    return out


def _blocks(body: ElementTree.Element, links: dict[str, str]) -> Iterator[dict]:
    for node in body:
        if node.tag == W + "tbl":
            yield {"rows": [_row(r, links) for r in node.findall(W + "tr")]}
        elif node.tag == W + "p":
            about = node.find(W + "pPr")
            depth = _value(about, f"{W}numPr/{W}ilvl")
            yield {"style": _value(about, W + "pStyle"), "list": _value(about, f"{W}numPr/{W}numId"), "depth": int(depth or 0), "text": _text(node, links).strip()}
        elif node.tag in (W + "sdt", W + "sdtContent", W + "ins", W + "customXml"):  # wrappers
            yield from _blocks(node, links)


def _levels(styles: bytes | None) -> dict[str, int]:
    """Style to heading level: its outline level, or a name that says so, or that of the style it is based on."""
    found, above = {}, {}
    for s in ElementTree.fromstring(styles).iter(W + "style") if styles else ():
        name = re.fullmatch(r"(?i)heading (\d)", _value(s, W + "name") or "")
        outline = _value(s, f"{W}pPr/{W}outlineLvl")
        if name or outline is not None and int(outline) < 9:
            found[s.get(W + "styleId")] = int(name[1]) if name else int(outline) + 1
        above[s.get(W + "styleId")] = _value(s, W + "basedOn")
    for style in above:
        seen, at = set(), style
        while at and at not in found and at not in seen:
            seen.add(at)
            at = above.get(at)
        if at in found:
            found[style] = found[at]
    return found


def _bullets(numbering: bytes | None) -> dict[str, bool]:
    """`number:depth` to whether its items have bullets rather than numbers."""
    root = ElementTree.fromstring(numbering) if numbering else ElementTree.Element("none")
    kinds = {(a.get(W + "abstractNumId"), x.get(W + "ilvl")): _value(x, W + "numFmt") == "bullet" for a in root.iter(W + "abstractNum") for x in a.iter(W + "lvl")}
    return {f"{n.get(W + 'numId')}:{depth}": bullet for n in root.iter(W + "num") for (abstract, depth), bullet in kinds.items() if abstract == _value(n, W + "abstractNumId")}


def bodies(files: DataFrame) -> DataFrame:
    """(path, blocks, levels, bullets, error) of Word documents (path, content), in order; what can't be read has its error and no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks, levels, bullets, error = [], {}, {}, None
                try:
                    parts = {}
                    for name, _, data, bad in _members(content.as_buffer().to_pybytes() if content.is_valid else b"", f"^({'|'.join(map(re.escape, (BODY, STYLES, NUMBERING, LINKS)))})$"):
                        if bad:
                            raise ValueError(bad)
                        parts[name] = data
                    if BODY not in parts:
                        raise ValueError(f"no {BODY}")
                    links = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(parts[LINKS])} if LINKS in parts else {}
                    body = ElementTree.fromstring(parts[BODY]).find(W + "body")
                    blocks, levels, bullets = list(_blocks(body, links)) if body is not None else [], _levels(parts.get(STYLES)), _bullets(parts.get(NUMBERING))
                except (ValueError, ElementTree.ParseError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
                columns = [pa.array([path]), pa.array([blocks], pa.list_(_BLOCK)), pa.array([list(levels.items())], pa.map_(pa.string(), pa.int32())), pa.array([list(bullets.items())], pa.map_(pa.string(), pa.bool_())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "blocks", "levels", "bullets", "error"])

    return files.select("path", "content").mapInArrow(run, _BODY)


def body_markdown(blocks: Column, levels: Column, bullets: Column) -> Column:
    """Blocks as Markdown: headings by their style's level, list items by depth, tables with their first row as head; empty paragraphs go."""

    def table(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, lambda r: F.size(r)))
        cell = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s*\n\s*", " "), r"\|", r"\\|")
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
        return F.when(width > 0, F.concat_ws("\n", line(F.get(rows, F.lit(0))), rule, F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)))

    def one(b: Column) -> Column:
        level = F.try_element_at(levels, b["style"])
        bullet = F.try_element_at(bullets, F.concat_ws(":", b["list"], b["depth"].cast("string")))
        item = F.concat(F.repeat(F.lit("    "), b["depth"]), F.when(F.coalesce(bullet, F.lit(True)), "- ").otherwise("1. "), b["text"])
        said = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), b["text"])).when(b["list"].isNotNull() & (b["list"] != "0"), item).otherwise(b["text"])
        return F.when(b["rows"].isNotNull(), table(b["rows"])).when(b["text"] != "", said)

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n\n")


def converted(files: DataFrame) -> DataFrame:
    """(path, raw, error) of Word documents (path, content): Markdown, or why there is none."""
    return bodies(files).select("path", F.when(F.col("error").isNull(), body_markdown(F.col("blocks"), F.col("levels"), F.col("bullets"))).alias("raw"), "error")


def docx(spark: SparkSession, folder: str, *, series: tuple[int, ...] | None = None) -> DataFrame:
    """Word documents under folder: path, cleaned text, facts by file name and header, and the error of those that can't be read."""
    return _facts(converted(documents(spark, folder, series=series)))


def zipped(spark: SparkSession, folder: str, *, existing: DataFrame | None = None) -> DataFrame:
    """The same of the newest archives of specifications under folder; a member's path is its archive's and its own."""
    found = newest_members(documents(spark, folder, "*.zip"), existing=existing).withColumn("path", F.concat_ws("!/", "path", "name"))
    good = converted(found.filter("error is null")).unionByName(found.filter("error is not null").select("path", F.lit(None).cast("string").alias("raw"), "error"))
    return _facts(good)


def _facts(rows: DataFrame) -> DataFrame:
    """path, cleaned text, facts by file name and header, title and error of converted documents (path, raw, error)."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rows = rows.withColumns({"raw": F.coalesce("raw", F.lit("")), "o": oran_name(stem), "n": spec_from_name(stem)}).withColumn("h", header(F.col("raw")))
    either = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    oran = F.col("o.spec_number") != ""
    return rows.select(
        "path", dx.postprocess(F.col("raw")).alias("text"), F.when(oran, F.col("o.spec_number")).otherwise(either(F.col("n"), F.col("h.spec_number"))).alias("spec_number"),
        F.when(oran, F.col("o.version")).otherwise(F.col("h.release")).alias("release"), F.when(oran, F.col("o.version")).otherwise(F.col("h.version")).alias("version"),
        F.when(oran, "oran").otherwise("3gpp").alias("doc_type"), dx.title(F.col("raw")).alias("title"), "error",
    )
