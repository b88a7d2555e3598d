"""Personal data: patterns propose spans, checksums confirm them, and words nearby raise or lower their score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SPANS = "array<struct<kind:int,start:int,end:int,score:double>>"
#: Code points before and after a span in which words are looked for.
NEAR = 60
FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def luhn(number: str) -> bool:
    """Whether the digits of number, every second one from the right doubled, add up to a multiple of ten."""
    values = [int(x) for x in reversed(number)]
    return (sum(values[::2]) + sum(sum(divmod(2 * x, 10)) for x in values[1::2])) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account code, its first four characters moved to its end and letters read as 10 to 35, leaves 1 by 97."""
    code = code.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


@dataclass(frozen=True)
class Rule:
    """What proposes, confirms and scores spans of a kind.

    pattern is for SQL's and Python's engines alike; seek is the same for Python in linear time. mark must be in a text
    for the pattern to be tried. A span that valid accepts scores `score`, more with a word of `likely` near it and less
    with one of `unlikely`; under `least` it is dropped.
    """

    kind: str
    pattern: str
    seek: str
    valid: Callable[[str], bool]
    score: float
    likely: tuple[str, ...]
    unlikely: tuple[str, ...] = ()
    least: float = 0.0
    mark: str = ""


RAISE, LOWER = 0.35, 0.3
_CARD = ("card", "credit", "visa", "mastercard", "payment", "karte", "kreditkarte", "carte", "tarjeta")
_CALL = ("phone", "telephone", "tel", "call", "mobile", "fax", "telefon", "mobil", "portable", "telefono")
_NUMBERING = ("version", "order", "item", "isbn", "invoice", "serial")
# The four kinds that always stay, however they score.
BASE = (
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: True, 0.9, ("email", "mail", "contact", "write"), mark="@"),
    Rule("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         lambda t: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in t.split(".")), 0.6, ("ip", "address", "host", "server", "login"), _NUMBERING),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t)), 0.6, _CARD, _NUMBERING),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15, 0.7, _CALL, _NUMBERING, mark="+"),
)
# What is added to them: these need a checksum, a word nearby, or both.
ADDED = (
    Rule("iban", r"\b(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", "",
         mod97, 0.5, ("iban", "account", "bank", "konto", "compte", "cuenta"), ("checksum", "hash", "serial"), 0.5),
    Rule("shortcard", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", lambda t: 13 <= len(digits(t)) <= 15 and luhn(digits(t)), 0.3, _CARD, _NUMBERING, 0.6),
    Rule("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "", lambda t: t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000", 0.3, ("ssn", "social", "security", "taxpayer"), _NUMBERING, 0.6),
    Rule("national", r"\b[0-9]{2,4}[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}\b", "", lambda t: 9 <= len(digits(t)) <= 12, 0.3, _CALL, _NUMBERING, 0.6),
)
RULES = BASE + ADDED


def proposed(rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    """The leftmost spans of a pattern that don't overlap and that its checks accept; what fails is passed over whole."""
    if rule.mark not in text:
        return
    seek, at = _compiled(rule.seek or rule.pattern), 0
    own = _compiled(rule.pattern) if rule.seek.startswith("(?<!") else None
    while found := (own and at and own.match(text, at)) or seek.search(text, at):  # where the last match ended, a run may go on
        at = found.end()
        if rule.valid(found[0]):
            yield found.start(), at


def _compiled(pattern: str, known: dict[str, re.Pattern] = {}) -> re.Pattern:
    if pattern not in known:
        known[pattern] = re.compile(pattern, re.A)
    return known[pattern]


def nearby(text: str, start: int, end: int) -> str:
    """What stands around a span, in small letters; a word that the window cuts gets a letter more, so that it is no word of a list."""
    before = ("x" if start > NEAR else " ") + text[max(0, start - NEAR) : start]
    after = text[end : end + NEAR] + ("x" if end + NEAR < len(text) else " ")
    return f"{before} {after}".translate(_LOWER)


def _any(words: tuple[str, ...]) -> str:
    return f"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)" if words else "[^\\x00-\\x{10FFFF}]"


def scored(rule: Rule, text: str, start: int, end: int) -> float:
    around = nearby(text, start, end)
    likely, unlikely = (bool(w) and _compiled(_any(w)).search(around) is not None for w in (rule.likely, rule.unlikely))
    return round(min(rule.score + RAISE * likely - LOWER * unlikely, 1.0), 2)


def spans_of(text: str, rules: tuple[Rule, ...] = RULES, stays: int = len(BASE)) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) by kind and start; spans of the first `stays` rules stay, others go under their least score or where they overlap one that stays."""
    out = []
    for kind, rule in enumerate(rules):
        for start, end in proposed(rule, text):
            score = scored(rule, text, start, end)
            if kind < stays or score >= rule.least and not any(s < end and start < e for k, s, e, _ in out if k < stays):
                out.append((kind, start, end, score))
    return out


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stays: int = len(BASE)) -> DataFrame:
    """docs with found, the spans of personal data by kind and start, as code points with the end exclusive.

    Row by row: nothing is shuffled, and repeated rows each have theirs. Null and empty texts have no spans, long texts
    are read whole in time linear in their length (each pattern is tried at most once from any place), a column of the
    name found is replaced, an empty table gives no rows. Ties of two kinds at one place are both told.
    """

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t.as_py() or "", rules, stays)] for t in texts], FOUND)

    return docs.withColumn("found", find(F.coalesce(F.col(text), F.lit(""))))


def told(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, scanned, with text masked: each span becomes its kind in brackets; of overlapping spans the first, then the longer one, names them all."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{rules[s['kind']].kind.upper()}]"]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return scan(docs, text, rules).withColumn(text, mask(F.col(text), F.col("found")))


def op12_personal_data(spark, sf_dir):
    """Counts and spans of personal data in every document; null and empty texts have none, an empty table gives no rows."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in range(len(BASE))], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def _sql() -> str:
    """Every pattern over every text; places come from the lengths of matches and of what lies between them."""
    valid = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(h, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS int), 0) <= 255))",
        "card": "length(d) BETWEEN 16 AND 19 AND luhn = 0", "phone": "length(d) BETWEEN 8 AND 15", "iban": "rest = 1", "shortcard": "length(d) BETWEEN 13 AND 15 AND luhn = 0",
        "ssn": "h[1:3] NOT IN ('000', '666') AND h[1:1] <> '9' AND h[5:6] <> '00' AND h[8:11] <> '0000'", "national": "length(d) BETWEEN 9 AND 12",
    }
    own = [f"SELECT rid, {k} AS kind, '{r.kind}' AS name, regexp_extract_all(text, '{r.pattern}') AS hit, string_split_regex(text, '{r.pattern}') AS gap FROM d WHERE regexp_matches(text, '{r.pattern}')" for k, r in enumerate(RULES)]
    ok = " ".join(f"WHEN '{r.kind}' THEN {valid[r.kind]}" for r in RULES)
    near = lambda words: f"regexp_matches(around, '{_any(words)}')::int" if words else "0"
    marks = " ".join(f"WHEN '{r.kind}' THEN least({r.score} + {RAISE} * {near(r.likely)} - {LOWER} * {near(r.unlikely)}, 1) >= {r.least}" for r in RULES)
    capital, small = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::bigint AS n_{r.kind}" for r in BASE)
    each = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(own)}),
u AS (SELECT rid, kind, name, unnest(hit) AS h, unnest(gap[1:len(hit)]) AS g, generate_subscripts(hit, 1) AS i FROM m),
s AS (SELECT rid, kind, name, h, (sum(length(g) + length(h)) OVER (PARTITION BY rid, kind ORDER BY i))::bigint AS fin FROM u),
p AS (SELECT rid, kind, name, h, fin - length(h) AS start, fin, regexp_replace(h, '[^0-9]', '', 'g') AS d,
  replace(h, ' ', '')[5:] || h[1:4] AS turned FROM s),
c AS (SELECT *, list_sum(list_transform(range(length(d)), lambda j: CASE WHEN j % 2 = 0 THEN d[length(d) - j]::int WHEN d[length(d) - j]::int > 4 THEN 2 * d[length(d) - j]::int - 9 ELSE 2 * d[length(d) - j]::int END)) % 10 AS luhn,
  CASE WHEN name = 'iban' THEN list_reduce(list_prepend(0, list_transform(range(1, length(turned) + 1), lambda j: CASE WHEN turned[j] >= 'A' THEN ascii(turned[j]) - 55 ELSE turned[j]::int END)),
    lambda x, y: (CASE WHEN y > 9 THEN x * 100 + y ELSE x * 10 + y END) % 97) END AS rest FROM p),
v AS (SELECT c.*, (kind < {len(BASE)}) AS stays, translate(CASE WHEN start > {NEAR} THEN 'x' ELSE ' ' END || substr(text, greatest(start - {NEAR}, 0) + 1, least(start, {NEAR})) || ' '
  || substr(text, fin + 1, {NEAR}) || CASE WHEN fin + {NEAR} < length(text) THEN 'x' ELSE ' ' END, '{capital}', '{small}') AS around
  FROM c JOIN d USING (rid) WHERE CASE name {ok} END),
f AS (SELECT rid, kind, start, name || ':' || start || ':' || fin AS span FROM v WHERE stays OR CASE name {marks} END
  AND NOT EXISTS (FROM v AS b WHERE b.rid = v.rid AND b.stays AND b.start < v.fin AND v.start < b.fin)),
a AS (SELECT rid, {each}, string_agg(span, ',' ORDER BY kind, start) FILTER (kind < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY kind, start) AS spans FROM f GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


QUERIES = {"op12_personal_data": op12_personal_data}
SQL = {"op12_personal_data": _sql()}
