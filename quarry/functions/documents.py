"""Text rules of documents, prompts and requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import RELEASE_LINE, spec_from_name, upload_kind

# Answers that are no answers, and badges of roles and types.
NO_ANSWERS = ("抱歉，模型未能生成回答，请重试或换个问法。", "未在规范库中找到相关内容。")
ROLE_BADGES = {"authoritative": "🔴权威定义", "supporting": "🟡补充参考", "overview": "⚪概述"}
TYPE_BADGES = {"parameter_table": "📊参数表", "definition": "📋定义"}
# The lines of a prompt's paragraph on releases.
NOTE_HEAD = "\n## Release 版本说明"
NOTE_ONE = ("- 用户指定了版本范围: ", "\n- 以下上下文已限定为该版本的内容")
NOTE_TWO = ("- 用户要求对比 ", " 与 ", " 的差异\n- 以下上下文按版本分组标注，请以对比表格或逐项对比的方式回答")
NOTE_ANY = "- 用户意图为对比类查询，但未指定具体版本\n- 请关注上下文中的版本差异信息"
# Patterns of converted Markdown.
TABLE_REFERENCE = r"(?i)Table\s+\d+(?:\.\d+)+\s*[-–—]\s*\d+"
IMAGE = r"!\[\]\(media/image[^)]+\)(?:\{[^}]+\})?"
CAPTION = r"(Figure\s+\d[\d.]*-\d+:\s*[^\n]+)"
LINK, ATTRIBUTES, HISTORY = r"\[([^\]]+?)\]\(#[^)]+\)", r"\{[#.][^}]+\}", r"(?ims)^#+\s+Annex\s+\w+(\s*\([^\n]*?\))?:\s*Change\s+history.*\z"


def postprocess(text: Column) -> Column:
    """Converted Markdown without navigation links, attributes, bare images and the change history; captions stay."""
    for pattern, put in (
        (LINK, "$1"),
        (ATTRIBUTES, ""),
        (rf"(?m)^{CAPTION}\n+{IMAGE}", "[$1]"),
        (rf"{IMAGE}\s*\n+{CAPTION}", "[$1]"),
        (rf"{IMAGE}\s*", ""),
        (r"!\[\]\([^)]*\)\s*", ""),
    ):
        text = F.regexp_replace(text, pattern, put)
    text = F.regexp_replace(text, HISTORY, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r" +\n", "\n"), r"^\s+|\s+$", "")


def title(text: Column) -> Column:
    """A dataset document's title: its standard header line, else its body's, else the first heading that is no contents or logo."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 60), lambda x: F.trim(x))
    bare = lambda x: F.trim(F.ltrim(x, F.lit("#")))
    early = F.slice(lines, 1, 30)
    first = lambda rows, test: F.get(F.transform(F.filter(rows, test), bare), F.lit(0))
    by_header = first(early, lambda x: F.rlike(x, F.lit(r"(?i)3GPP\s+(TS|TR)\s+\d{2}\.\d{3}\s+V\d+")))
    by_body = first(early, lambda x: bare(x).startswith("O-RAN Working Group") | bare(x).startswith("O-RAN ALLIANCE"))
    by_heading = first(lines, lambda x: x.startswith("#") & (F.length(x) > 3) & ~F.lower(x).contains("contents") & ~F.lower(x).contains("logo"))
    return F.coalesce(by_header, by_body, by_heading, F.lit(""))


def converted_title(text: Column) -> Column:
    """The title of a converted document, from its first 20 lines: the line that speaks of a technical specification with its neighbours, else the first heading, else the first three lines with text."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    join = lambda rows: F.array_join(rows, " — ")
    lines = F.slice(F.split(text, "\n"), 1, 20)
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).contains("specification") | F.lower(x).contains("technical")), F.lit(True)).cast("int")
    around = F.filter(F.transform(F.slice(lines, F.greatest(at - 1, F.lit(1)), F.when(at == 1, 3).otherwise(4)), strip), lambda x: x != "")
    heads = F.filter(F.transform(lines, strip), lambda x: x.startswith("#") & (F.length(x) > 3))
    plain = F.transform(F.filter(lines, lambda x: (strip(x) != "") & ~x.startswith("!")), strip)
    return F.when(at > 0, join(around)).when(F.size(heads) > 0, strip(F.ltrim(F.get(heads, F.lit(0)), F.lit("#")))).otherwise(F.coalesce(join(F.slice(plain, 1, 3)), F.lit("")))


def answer_key(question: Column, release: Column, series: Column, doc_type: Column, reranked: Column, history: Column) -> Column:
    """The key of a cached answer: a hash of all that the answer depends on; history is an array of role:content."""
    or_empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fixed = [F.trim(F.lower(question)), or_empty(release), or_empty(series), or_empty(doc_type), F.when(reranked, "True").otherwise("False")]
    return F.sha2(F.array_join(F.concat(F.array(*fixed), F.coalesce(history, F.array().cast("array<string>"))), "|"), 256)


def gap_response(answer: Column, most: int = 4) -> Column:
    """struct(sufficient, queries) of an analysis of what is missing."""
    text = F.trim(answer)
    enough = F.upper(text).startswith("SUFFICIENT")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    return F.struct(enough.alias("sufficient"), F.when(enough, F.array().cast("array<string>")).otherwise(F.slice(lines, 1, most)).alias("queries"))


def translation(answer: Column) -> Column:
    """struct(translated, expanded) of the two-line protocol; null where either is missing or short."""
    part = lambda name: F.trim(F.regexp_extract(answer, rf"(?m)^\s*{name}:(.*)$", 1))
    pair = F.struct(part("TRANSLATED").alias("translated"), part("EXPANDED").alias("expanded"))
    return F.when((F.length(part("TRANSLATED")) > 3) & (F.length(part("EXPANDED")) > 3), pair)


def embedding_text(text: Column, path: Column, section_title: Column, with_path: bool = False) -> Column:
    above = F.coalesce(F.nullif(path, F.lit("")), F.nullif(section_title, F.lit("")))
    return F.concat_ws("\n", above, F.nullif(text, F.lit(""))) if with_path else text


def normal_spec(spec: Column) -> Column:
    return F.when(F.rlike(spec, F.lit(r"^\d{5}$")), F.concat(F.substring(spec, 1, 2), F.lit("."), F.substring(spec, 3, 3))).otherwise(spec)


def route_label(path: Column) -> Column:
    bare = F.regexp_replace(path, "^/+|/+$", "")
    api = F.regexp_extract(bare, "^api/v1/([^/]+)", 1)
    return F.when(api != "", api).when(bare == "", "root").otherwise(F.translate(bare, "/", "_"))


def release_note(kind: Column, first: Column, second: Column, comparative: Column, note: Column) -> Column:
    """The prompt's paragraph on releases; empty without a note."""
    body = (
        F.when(kind == "single", F.concat(F.lit(NOTE_ONE[0]), first, F.lit(NOTE_ONE[1])))
        .when(kind == "compare", F.concat(F.lit(NOTE_TWO[0]), first, F.lit(NOTE_TWO[1]), second, F.lit(NOTE_TWO[2])))
        .when(comparative, F.lit(NOTE_ANY))
    )
    return F.when(F.coalesce(note, F.lit("")) == "", "").otherwise(F.concat_ws("\n", F.lit(NOTE_HEAD), body, F.concat(F.lit("- "), note)))


def monitored_name(name: Column) -> Column:
    """struct(series, spec_number, release) of a watched file's name; the number has no dot."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    a, b, bare = F.regexp_extract(stem, r"(?i)(?:TS|TR)\s*(\d{2})\.(\d{3})", 1), F.regexp_extract(stem, r"(?i)(?:TS|TR)\s*(\d{2})\.(\d{3})", 2), F.regexp_extract(stem, r"(\d{4,5})", 1)
    spec, release = F.when(a != "", F.concat(a, b)).otherwise(bare), F.regexp_extract(stem, r"[Rr]el(?:ease)?[._-]?(\d{2})", 1)
    return F.struct(F.coalesce(F.substring(spec, 1, 2).try_cast("int"), F.lit(0)).alias("series"), spec.alias("spec_number"), F.when(release != "", F.concat(F.lit("R"), release)).otherwise("").alias("release"))


def upload_target(name: Column, head: Column) -> Column:
    """Where an uploaded document goes: by kind, format, release and series."""
    kind, markdown = upload_kind(name, head), F.rlike(name, F.lit(r"(?i)\.(md|markdown)$"))
    stem, spec = F.regexp_replace(name, r"\.[^.]*$", ""), spec_from_name(name)
    a, b = F.regexp_extract(head, r"\bV(\d+)\.\d+\.\d+", 1), F.regexp_extract(head, RELEASE_LINE, 1)
    release = F.concat(F.lit("R"), F.when(a != "", a).when(b != "", b).otherwise("18"))
    series = F.concat(F.substring(spec, 1, 2), F.lit("_series"))
    own = F.when(spec == "", F.concat(F.when(markdown, "marked/").otherwise("original/"), name)).when(markdown, F.concat_ws("/", F.lit("marked"), release, series, F.replace(spec, F.lit("."), F.lit("")), F.lit("raw.md"))).otherwise(F.concat_ws("/", F.lit("original"), release, series, name))
    oran = F.when(markdown, F.concat(F.lit("marked/ORAN/"), stem, F.lit("/raw.md"))).otherwise(F.concat(F.lit("original/ORAN/"), name))
    return F.when(kind == "unknown", F.concat(F.lit("other/"), name)).when(kind == "oran", oran).otherwise(own)


def is_cacheable(answer: Column) -> Column:
    text = F.trim(F.coalesce(answer, F.lit("")))
    return (text != "") & ~text.isin(*NO_ANSWERS)


def is_target_series(spec: Column, series: tuple[int, ...] | None = None) -> Column:
    """None means all series."""
    number = F.substring_index(spec, ".", 1).try_cast("int")
    return F.coalesce(number.isin(*series), F.lit(False)) if series else F.lit(True)


def is_references_section(section: Column, own: Column, parent: Column) -> Column:
    return (section == "2") & (F.lower(own).contains("reference") | F.lower(parent).contains("reference"))


def context_header(role: Column, kind: Column, spec: Column, section: Column, parent_title: Column, release: Column) -> Column:
    """A result's header with badges."""
    badge = lambda value, names: F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), value)
    given = lambda x: F.nullif(x, F.lit(""))
    parts = F.array(badge(role, ROLE_BADGES), badge(kind, TYPE_BADGES), F.concat(F.lit("TS "), given(spec)), F.concat(F.lit("§"), given(section)), given(parent_title), F.concat(F.lit("("), given(release), F.lit(")")))
    return F.concat(F.lit("["), F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | "), F.lit("]"))
