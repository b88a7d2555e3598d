"""Text rules as column expressions: languages, references, names, versions, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import found_at, once

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "AMF": "Access and Mobility Management Function",
    "CSI": "Channel State Information",
    "HARQ": "Hybrid Automatic Repeat reQuest",
    "IMS": "IP Multimedia Subsystem",
    "MAC": "Medium Access Control",
    "MIB": "Master Information Block",
    "NGAP": "NG Application Protocol",
    "NR": "New Radio",
    "PDCP": "Packet Data Convergence Protocol",
    "PDU": "Protocol Data Unit",
    "PDSCH": "Physical Downlink Shared Channel",
    "PUSCH": "Physical Uplink Shared Channel",
    "QoS": "Quality of Service",
    "RACH": "Random Access Channel",
    "RLC": "Radio Link Control",
    "RRC": "Radio Resource Control",
    "SIB": "System Information Block",
    "SMF": "Session Management Function",
    "SMS": "Short Message Service",
    "UPF": "User Plane Function",
    "XnAP": "Xn Application Protocol",
}
# Specifications that define, and the domains of series.
AUTHORITATIVE = ("38.211", "38.212", "38.213", "38.214", "38.321", "38.322", "38.323", "38.331", "38.304", "38.305", "38.413", "38.423", "36.211", "36.212", "36.213", "36.214", "36.321", "36.322", "36.323", "36.331", "36.304", "36.305")
SERIES_DOMAINS = {"23": "core_network", "24": "ue_procedures", "36": "lte_ran", "37": "multi_rat", "25": "utran", "21": "requirements", "22": "requirements", "33": "security", "26": "codec", "28": "oam", "29": "core_network", "32": "oam"}
DEFINITION_WORDS = ("definition", "general", "principles", "overview", "architecture")
PROCEDURE_WORDS = ("procedure", "procedures", "call flow", "message sequence")
# Words that ask for a list, and those that name a protocol layer.
TAXONOMY_ZH = ("格式", "分类", "种类", "类型", "有哪些", "全部", "所有", "列出", "列举", "汇总", "清单", "总结", "多少种")
TAXONOMY_EN = ("format", "type", "category", "classification", "list all", "enumerate", "what are", "kinds of", "summarize", "how many")
LAYERS = {
    "phy": ("phy", "物理层", "physical layer", "dci", "pdcch", "prach", "dmrs", "csi-rs", "ssb", "harq-ack", "pucch", "pusch", "pdsch", "srs"),
    "mac": ("mac", "mac ce", "lcp", "drx", "bsr", "phr", "随机接入"),
    "rlc": ("rlc",),
    "pdcp": ("pdcp",),
    "rrc": ("rrc", "测量配置", "系统信息"),
}
# Patterns.
CJK = "[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]"
HANGUL = "[\uac00-\ud7af\u1100-\u11ff\u3130-\u318f]"
SPEC_NUMBER = r"\b(\d{2}\.\d{3})\b"
SPEC_WITH_CLAUSE = r"(?i)(?:3GPP\s+)?(TS|TR)\s+(\d{2})\.(\d{3})(?:\s*(?:§|clause|subclause|section|,)\s*([A-Z]?\d+(?:\.\d+)*))?"
CLAUSE_ALONE = r"(?i)(?:§\s*|clause\s+|subclause\s+|sub-clause\s+|section\s+|Annex\s+)([A-Z]?\d+(?:\.\d+)*)"
TABLE_NUMBER = r"(?i)Table\s+([A-Z]?\d+(?:\.\d+)*(?:-[A-Z]?\d+(?:\.\d+)*)?)"
FIGURE_NUMBER = r"(?i)Figure\s+([A-Z]?\d+(?:\.\d+)*(?:-[A-Z]?\d+(?:\.\d+)*)?)"
#: Holds in a text where one of the four above has a match.
ANY_REFERENCE = "(?i)(?=[3cstaf§])(?:" + "|".join(p.removeprefix("(?i)") for p in (SPEC_WITH_CLAUSE, CLAUSE_ALONE, TABLE_NUMBER, FIGURE_NUMBER)) + ")"
REFERENCE = "start:int,rank:int,type:string,spec_number:string,clause:string,table:string,figure:string"
CLAUSE_CONTEXT = ("ts ", "tr ", "3gpp", "specif", "clause", "section")
RELEASE_PAIR = r"(?i)(?:Release\s+|Rel[.-]?\s*|R\s*)(\d{2})\s*(?:vs\.?|versus|compared?\s*(?:to|with)|和|与|对比|相比|比较|versus)\s*(?:Release\s+|Rel[.-]?\s*|R\s*)?(\d{2})"
RELEASE_ONE = r"(?i)(?:Release\s+|Rel[.-]?\s*|R\s*)(\d{2})(?!\s*(?:vs\.?|versus|compared?|和|对比))"
COMPARATIVE = r"(?i)(?:difference|change|new|update|delta|comparison|更新|新增|变更|区别|不同|变化|差异|修改|演进|增强|add|remove|deprecat)"
HEADER = r"(?i)(?:3GPP\s+)?(?:TS|TR)\s+(\d{2}\.\d{3})\s+V(\d+\.\d+\.\d+)"
RELEASE_LINE = r"(?i)\(Release\s+(\d+)\)"
ORAN_NAME = r"(?i)^O-RAN\.WG(\d+)\.(\w+(?:\.\w+)*)-(R\d+)-(v\d+\.\d+)"
IMAGE_TAG, IMAGE_TITLED, IMAGE_BARE, ANCHOR = r"(?i)<img\s+[^>]*/?>", r"!\[\s*([^\]]*[^\]\s])\s*\]\([^)]*\)\s*", r"!\[\s*\]\([^)]*\)\s*", r"\[([^\]]+?)\]\(#[^)]+\)"
FIGURE = r"^(Figure\s+\S+)"
PRECISE_SECTION = r"(?i)§\s*\d+|section\s+\d+"
TABLE_LINE = r"^\|[\s\-:|]+\|$"
NAME_VERSION = r"(?i)[.-]([a-z]{1,3}\d{1,3}[a-z]?)$"


def any_of(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def expand_abbreviations(text: Column) -> Column:
    """Abbreviations not yet explained get their full names, longest first, in any case; a text without any is read once."""
    given, shorts = text, sorted(ABBREVIATIONS, key=len, reverse=True)
    for short in shorts:
        text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9_(]){short}(?![A-Za-z0-9_]|\s*\()", f"{short} ({ABBREVIATIONS[short]})")
    first = "".join(sorted({short[0] for short in shorts}))
    return F.when(F.rlike(given, F.lit(rf"(?i)(?=[{first}])(?<![A-Za-z0-9_(])(?:{'|'.join(shorts)})(?![A-Za-z0-9_]|\s*\()")), text).otherwise(given)


def language(text: Column) -> Column:
    zh, ko = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(HANGUL))
    return F.when((zh > ko) & (zh > 0), "zh").when((ko > zh) & (ko > 0), "ko").otherwise("en")


def spec_references(text: Column) -> Column:
    """Array of struct(start, rank, type, spec_number, clause, table, figure) by place: specifications with or without a clause, clauses that
    stand alone after words of the field, tables and figures. Type and specification are ? where a text names none. A text without any is read once."""
    empty, unknown = F.lit(""), F.lit("?")

    def row(x: Column, rank: int, kind=unknown, spec=unknown, clause=empty, table=empty, figure=empty) -> Column:
        values = {"start": x["start"], "rank": F.lit(rank), "type": kind, "spec_number": spec, "clause": clause, "table": table, "figure": figure}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def all_kinds(found: Column) -> Column:
        named, clauses, tables, figures = (F.get(found, F.lit(i)) for i in range(4))
        specs = F.transform(named, lambda x: row(x, 0, F.upper(x["g1"]), F.concat(x["g2"], F.lit("."), x["g3"]), x["g4"]))
        before = lambda x: F.lower(F.substring(text, F.greatest(x["start"] - 50, F.lit(0)) + 1, F.least(x["start"], F.lit(50))))
        free = lambda x: ~F.exists(named, lambda s: x["start"].between(s["start"], s["end"]))
        alone = F.filter(clauses, lambda x: free(x) & any_of(before(x), CLAUSE_CONTEXT))
        return F.array_sort(F.concat(specs, F.transform(alone, lambda x: row(x, 1, clause=x["g1"])), F.transform(tables, lambda x: row(x, 2, table=x["g1"])), F.transform(figures, lambda x: row(x, 3, figure=x["g1"]))))

    found = once(found_at(text, (SPEC_WITH_CLAUSE, (1, 2, 3, 4)), (CLAUSE_ALONE, (1,)), (TABLE_NUMBER, (1,)), (FIGURE_NUMBER, (1,))), all_kinds)
    return F.when(F.rlike(text, F.lit(ANY_REFERENCE)), found).otherwise(F.array().cast(f"array<struct<{REFERENCE}>>"))


def reference_query(ref: Column) -> Column:
    """What to search for to find a reference."""
    more = lambda name, x: F.when(x != "", F.concat(F.lit(f" {name} "), x)).otherwise("")
    return F.concat(ref["type"], F.lit(" "), ref["spec_number"], more("clause", ref["clause"]), more("Table", ref["table"]))


def spec_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(SPEC_NUMBER), F.lit(1))))


def release_intent(text: Column) -> Column:
    """struct(kind, first, second, comparative): compare, single or none."""
    a, b, one = F.regexp_extract(text, RELEASE_PAIR, 1), F.regexp_extract(text, RELEASE_PAIR, 2), F.regexp_extract(text, RELEASE_ONE, 1)
    named = lambda x: F.when(x != "", F.concat(F.lit("R"), x))
    pair = a != ""
    return F.struct(
        F.when(pair, "compare").when(one != "", "single").otherwise("none").alias("kind"),
        F.when(pair, named(a)).otherwise(named(one)).alias("first"), F.when(pair, named(b)).alias("second"),
        (pair | F.rlike(text, F.lit(COMPARATIVE))).alias("comparative"),
    )


def asks_for_list(text: Column) -> Column:
    return any_of(text, TAXONOMY_ZH) | any_of(F.lower(text), TAXONOMY_EN)


def layers(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(any_of(low, words), F.lit(name)) for name, words in LAYERS.items()]), lambda x: x.isNotNull())


def is_cross_protocol(text: Column) -> Column:
    low = F.lower(text)
    systems = any_of(low, ("nr", "new radio")) & low.contains("lte")
    return (F.size(layers(text)) >= 2) | systems | any_of(low, ("双连接", "en-dc", "endc", "mcg", "scg"))


def is_precise(text: Column) -> Column:
    return F.rlike(text, F.lit(SPEC_NUMBER)) & F.rlike(text, F.lit(PRECISE_SECTION))


def spec_from_name(name: Column) -> Column:
    """The specification of a file name's digits, or empty."""
    digits = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^0-9]", "")
    return F.when(F.length(digits) >= 5, F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3))).otherwise("")


def name_version(stem: Column) -> Column:
    found = F.lower(F.regexp_extract(stem, NAME_VERSION, 1))
    return F.when(found != "", found)


def oran_name(stem: Column) -> Column:
    """struct(spec_number, version) of an open-interface file stem; empty where it is none."""
    part = lambda g: F.regexp_extract(stem, ORAN_NAME, g)
    spec = F.when(part(1) != "", F.concat(F.lit("O-RAN.WG"), part(1), F.lit("."), part(2))).otherwise("")
    return F.struct(spec.alias("spec_number"), part(4).alias("version"))


def spec_from_stem(stem: Column) -> Column:
    """struct(spec_number, version) of a file stem, with parts and volumes left out."""
    base = F.regexp_replace(stem, "_[sS].*$", "")
    version = name_version(base)
    bare = F.when(version.isNotNull(), F.regexp_replace(base, NAME_VERSION, "")).otherwise(base)
    whole, five = F.rlike(bare, F.lit(r"^\d{2}\d{2,3}$")), F.rlike(bare, F.lit(r"^\d{5}"))
    spec = F.when(whole, F.concat(F.substring(bare, 1, 2), F.lit("."), F.substring(bare, 3, 3))).when(five, F.concat(F.substring(bare, 1, 2), F.lit("."), F.substring(bare, 3, 3))).otherwise("")
    return F.struct(spec.alias("spec_number"), version.alias("version"))


def header(text: Column) -> Column:
    """struct(spec_number, version, release) of a document's first 800 characters."""
    head = F.substring(text, 1, 800)
    spec, version, line = F.regexp_extract(head, HEADER, 1), F.regexp_extract(head, HEADER, 2), F.regexp_extract(head, RELEASE_LINE, 1)
    release = F.when(version != "", F.concat(F.lit("R"), F.substring_index(version, ".", 1))).when(line != "", F.concat(F.lit("R"), line)).otherwise("")
    return F.struct(spec.alias("spec_number"), version.alias("version"), release.alias("release"))


def path_facts(path: Column) -> Column:
    """struct(spec_number, release, version, doc_type) of a dataset path's folders."""
    parts = F.split(path, "/")
    spec5 = F.get(F.filter(parts, lambda p: F.rlike(p, F.lit(r"^\d{5}(-\d+)?$"))), F.lit(0))
    oran = F.get(F.filter(parts, lambda p: F.rlike(p, F.lit(ORAN_NAME))), F.lit(0))
    rel = F.get(F.filter(parts, lambda p: F.rlike(p, F.lit(r"(?i)^R\d+$"))), F.lit(0))
    own = oran_name(F.coalesce(oran, F.lit("")))
    is3 = spec5.isNotNull()
    return F.struct(
        F.when(is3, F.concat(F.substring(spec5, 1, 2), F.lit("."), F.substring(spec5, 3, 3))).otherwise(own.spec_number).alias("spec_number"),
        F.when(rel.isNotNull(), F.concat(F.lit("R"), F.substring(rel, 2, 9))).when(is3, "").otherwise(own.version).alias("release"),
        F.when(is3, "").otherwise(own.version).alias("version"), F.when(is3, "3gpp").when(oran.isNotNull(), "oran").otherwise("").alias("doc_type"),
    )


def clean_markdown(text: Column) -> Column:
    """Images give way to their titles, anchors to their texts; blank runs and line ends are trimmed."""
    for pattern, put in ((IMAGE_TAG, ""), (IMAGE_TITLED, "[图: $1]"), (IMAGE_BARE, ""), (ANCHOR, "$1")):
        text = F.regexp_replace(text, pattern, put)
    text = F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r" +\n", "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def version_key(version: Column) -> Column:
    """Sorts versions by the number that all their digits make, however many, then as text; none is lowest."""
    digits = F.coalesce(F.regexp_replace(version, "^[^1-9]*|[^0-9]", ""), F.lit(""))
    return F.struct(version.isNotNull().alias("some"), F.length(digits).alias("n"), digits.alias("digits"), F.coalesce(version, F.lit("")).alias("text"))


def figure_id(title: Column) -> Column:
    found = F.regexp_extract(F.trim(title), FIGURE, 1)
    return F.when(found != "", F.regexp_replace(found, "[:：]+$", "")).otherwise(F.substring(F.trim(title), 1, 80))


def upload_kind(name: Column, head: Column) -> Column:
    oran = F.rlike(name, F.lit(r"(?i)O-RAN\.")) | F.rlike(head, F.lit(r"(?i)O-RAN\s+ALLIANCE|O-RAN\s+WORKING\s+GROUP"))
    own = F.rlike(name, F.lit(r"^\d{5}")) | F.rlike(name, F.lit(r"(?i)(?:TS|TR)[_\s]\d{2}\.\d{3}")) | F.rlike(head, F.lit(r"(?i)3GPP\s+(?:TS|TR)\s+\d{2}\.\d{3}\s+V\d+\.\d+\.\d+"))
    return F.when(oran, "oran").when(own, "3gpp").otherwise("unknown")


def safe_name(name: Column) -> Column:
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"(?U)[^\w.\-()一-鿿]+", "_")
    return F.when(base != "", base).otherwise("unnamed")


def key_phrases(text: Column, least: int = 20, most: int = 5) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, r"[.\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least), 1, most)


def has_table(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.exists(lines, lambda x: F.rlike(x, F.lit(TABLE_LINE))) | (F.size(F.filter(lines, lambda x: x.startswith("+"))) >= 2)


def content_type(text: Column, title: Column) -> Column:
    low = F.lower(title)
    return F.when(has_table(text) | any_of(title, ("table", "Table")), "parameter_table").when(any_of(low, DEFINITION_WORDS), "definition").when(any_of(low, PROCEDURE_WORDS), "procedure").otherwise("overview")


def spec_role(spec: Column) -> Column:
    return F.when(spec.isin(*AUTHORITATIVE), "authoritative").when(spec == "38.300", "overview").otherwise("supporting")


def topic_domain(spec: Column) -> Column:
    major, minor = F.substring_index(spec, ".", 1), F.substring(F.get(F.split(spec, r"\."), F.lit(1)), 1, 1)
    mac = spec.contains("321") | spec.contains("322") | spec.contains("323")
    own = F.when(minor == "2", "phy_layer").when(minor == "3", F.when(mac, "mac_layer").otherwise("rrc_layer")).when(minor == "4", "ran_arch").otherwise("")
    known = F.create_map(*[F.lit(x) for pair in SERIES_DOMAINS.items() for x in pair])
    return F.when(major == "38", own).otherwise(F.coalesce(F.try_element_at(known, major), F.lit("")))


def cjk_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]")) / F.greatest(F.length(text), F.lit(1))


def pieces(text: Column, size: int = 32) -> Column:
    many = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
