"""Secret scanning with a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that any match must contain, in
disjunctive form. The index maps each trigram of these queries to the documents whose lower-cased text has
it, in shards by document key, so that a posting list is bounded by its shard. Posting lists are intersected
and united by the queries; only candidates are verified with the rule's expression on their text. A rule
without mandatory trigrams (hex) scans every text.

Only DataFrame functions are used; the queries are derived on the driver from the rules alone.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_for, let, parts_for, table

#: A query is a set of clauses, any of which must hold; a clause is a set of trigrams that must all be there.
Query = frozenset
ANYTHING: Query = frozenset({frozenset()})
MOST_STRINGS, MOST_CLAUSES, MOST_CLASS = 64, 64, 6


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least characters that a group of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: For redaction: a private key from BEGIN over its body to its END line, which no other mark may precede; where END is
#: missing, to the end of the base64 block. Breaks may be escaped. Possessive, so that long keys need no deep recursion.
_BREAK = r"(?:[\x20\x09-\x0D]|\\[nrt])"
WHOLE_KEY = Rule(
    "pem",
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):\x20*[A-Za-z0-9,-]+)*+"
    rf"(?:(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_BREAK}++[A-Za-z0-9+/]++(?:={{1,2}}|(?=[\x20\x09-\x0D]*(?:[\"'\\\n]|$))))?)?)",
)
TO_REDACT = BASE + tuple(WHOLE_KEY if r.kind == "pem" else r for r in ADDED)


def _trigrams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _absorb(clauses) -> Query:
    """Without clauses that a weaker one covers."""
    found: list[frozenset] = []
    for clause in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(x <= clause for x in found):
            found.append(clause)
    return frozenset(found)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CLAUSES:
        return a if ANYTHING == b or (a != ANYTHING and len(a) <= len(b)) else b
    return _absorb(x | y for x, y in product(a, b))


def _sets(items) -> tuple[frozenset | None, Query]:
    """Of a parsed sequence: its strings, lower-cased, if they are few, and a query that each match satisfies."""
    strings, query = frozenset({""}), ANYTHING

    def close() -> None:
        nonlocal strings, query
        query = _both(query, _absorb(_trigrams(s) for s in strings))
        strings = frozenset({""})

    exact = True
    for item in items:
        own, needs = _one(*item)
        if own is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = frozenset(a + b for a, b in product(strings, own))
            continue
        exact = False
        close()
        if own is not None:
            strings = own
        else:
            query = _both(query, needs)
    if exact:
        return strings, _absorb(_trigrams(s) for s in strings)
    close()
    return None, query


def _one(op, value) -> tuple[frozenset | None, Query]:
    if op is sre.LITERAL:
        return frozenset({chr(value).lower()}), ANYTHING
    if op is sre.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                found.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_CLASS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANYTHING
        return (frozenset(found), ANYTHING) if len(found) <= MOST_CLASS else (None, ANYTHING)
    if op is sre.SUBPATTERN:
        return _sets(value[-1])
    if op is sre.BRANCH:
        parts = [_sets(x) for x in value[1]]
        query = _absorb(c for _, q in parts for c in q)
        if all(s is not None for s, _ in parts) and len(union := frozenset().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return union, query
        return None, query
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sets(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANYTHING
        if least == most and strings is not None and len(strings) ** least <= MOST_STRINGS:
            return frozenset("".join(x) for x in product(strings, repeat=least)), ANYTHING
        return None, query if least else ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Query:
    """What every match of pattern contains, as clauses of lower-case trigrams; ANYTHING if nothing is sure."""
    return _sets(sre_parse.parse(pattern))[1]


#: Items of an array that are folded in one run; runs are joined by a second fold, so a text's time grows with its hits, not with their square.
RUN = 256


def runs_of(items: Column, body) -> Column:
    """body(run, k) for each run k of RUN items, in order."""
    last = F.floor((F.size(items) - 1) / RUN).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: body(F.slice(items, k * RUN + 1, F.lit(RUN)), k))).otherwise(F.array())


def before_each(values: Column, fold) -> Column:
    """For each of an array of ints the fold, from 0, of those before it; the last item is the fold of all."""
    zero = F.lit(0)
    none = F.array().cast("array<int>")

    def folded(v: Column) -> Column:
        tops = runs_of(v, lambda run, k: F.aggregate(run, zero, fold))
        grown = lambda run, first: F.aggregate(run, F.struct(first.alias("now"), none.alias("out")), lambda a, x: F.struct(fold(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")), lambda a: a["out"])
        starts = F.aggregate(tops.cast("array<int>"), F.struct(zero.alias("now"), none.alias("out")), lambda a, x: F.struct(fold(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")))
        return let(starts, lambda s: F.concat(F.flatten(runs_of(v, lambda run, k: grown(run, F.get(s["out"], k)))).cast("array<int>"), F.array(s["now"])))

    return let(values, folded)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def parts_of(text: Column, rule: Rule) -> Column:
    """Array of struct(gap, hit, own): a rule's matches with what lies before each, and the group whose length counts; the last has the text's rest as gap, and no hit."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole).alias("own"))


def spans_of(parts: Column, kind: Column, least: Column) -> Column:
    """Spans (start, kind, end), in code points, of the matches that are long enough."""

    def spans(p: Column) -> Column:
        begins = before_each(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))), lambda a, n: a + n)
        row = lambda at: F.transform(p, lambda x, i: F.struct((F.get(at, i) + F.length(x["gap"])).alias("start"), kind.alias("kind"), (F.get(at, i) + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), F.length(x["own"]).alias("n")))
        good = let(begins, lambda at: F.filter(row(at), lambda s: F.coalesce(s["n"] >= least, F.lit(False))))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return let(parts, spans)


def postings(docs: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """The inverted index of docs (_key, text): shard, trigram, sorted keys of the documents that have it."""
    there = let(F.lower("text"), lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(x)), F.lit(x)) for x in trigrams]), lambda x: x.isNotNull()))
    rows = docs.select("_key", F.explode(there).alias("trigram"))
    return rows.groupBy(F.pmod("_key", F.lit(shards)).alias("shard"), "trigram").agg(F.array_sort(F.collect_set("_key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(_key, _rules): the rules, as bits, whose query the document satisfies."""
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def solve(query: Query) -> Column:
        found = none
        for clause in sorted(query, key=sorted):
            first, *rest = [F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in sorted(clause)]
            for other in rest:
                first = F.array_intersect(first, other)
            found = F.array_union(found, first)
        return found

    solved = F.array(*[F.struct(F.lit(1 << r).cast("long").alias("bit"), solve(q).alias("keys")) for r, q in queries.items()])
    hits = lists.select(F.explode(solved).alias("s")).select("s.bit", F.explode("s.keys").alias("_key"))
    return hits.groupBy("_key").agg(F.bit_or("bit").alias("_rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, *, text: str = "text") -> DataFrame:
    """docs' columns with found: spans struct(start, kind, end) sorted by start, then rule; kind is the rule's place.

    Null texts are empty; repeated rows are searched alike; an empty table gives no rows; a text of any length and
    with any number of hits is searched whole, in time that grows with both. The key of a document is a hash of its
    id and text: documents that share one share candidates, which verification sorts out. Columns of docs that are
    named like added ones are replaced; _given, _key and _rules are left out.

    Texts meet their candidates in partitions that grow in number with the input.
    """
    others = [c for c in docs.columns if c not in ("found", text, "text", "_given", "_key", "_rules")]
    base = docs.select(*others, F.col(text).alias("_given"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("_key", F.xxhash64(*(["doc_id"] if "doc_id" in docs.columns else []), "text"))
    queries = {r: q for r, x in enumerate(rules) if (q := trigram_query(x.pattern)) != ANYTHING}
    trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
    if queries:
        parts = parts_for(docs, 8 << 20)
        asked = candidates(postings(base.select("_key", "text"), trigrams, groups_for(docs, 1 << 20)), queries)
        joined = base.repartition(parts, "_key").join(asked.repartition(parts, "_key"), "_key", "left")
    else:
        joined = base.withColumn("_rules", F.lit(0))
    none = F.array().cast("array<struct<gap:string,hit:string,own:string>>")
    each = []
    for r, rule in enumerate(rules):
        wanted = (F.coalesce("_rules", F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0) if r in queries else F.rlike("text", F.lit(rule.pattern))
        each.append(F.struct(F.when(wanted, parts_of(F.col("text"), rule)).otherwise(none).alias("parts"), F.lit(r).alias("kind"), F.lit(rule.least).alias("least")))
    found = F.flatten(F.transform(F.array(*each), lambda x: spans_of(x["parts"], x["kind"], x["least"]))).cast(SPANS)
    return joined.withColumn("found", F.array_sort(found)).select(*others, F.col("_given").alias(text), "found")


def told(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """text with every span of found, which is sorted, replaced by mark; overlapping and touching spans are one. Null stays null."""

    def cuts(spans: Column) -> Column:
        ends = before_each(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        both = lambda e: F.transform(spans, lambda s, i: F.struct(F.get(e, i).alias("a"), s["start"].alias("b")))
        apart = lambda x: (x["b"] > x["a"]) | ((x["b"] == 0) & (x["a"] == 0))
        return let(ends, lambda e: F.struct(F.filter(both(e), apart).alias("gaps"), F.element_at(e, -1).alias("last")))

    def run(gaps: Column, k: Column) -> Column:
        first = F.get(gaps, F.lit(0))["a"]
        body = F.substring(text, first + 1, F.element_at(gaps, -1)["b"] - first)  # a run's gaps are cut from its own stretch of the text
        return let(body, lambda t: F.array_join(F.transform(gaps, lambda x: F.concat(F.substring(t, x["a"] - first + 1, x["b"] - x["a"]), F.lit(mark))), ""))

    done = let(cuts(found), lambda c: F.concat(F.array_join(runs_of(c["gaps"], run).cast("array<string>"), ""), F.substring(text, c["last"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op5_trigram_secrets(spark, sf_dir):
    """Counts and spans of secrets in every document; null and empty texts have none, repeated rows each have theirs, an empty table gives no rows."""
    rules = BASE + ADDED
    kinds = [r.kind for r in rules]
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).drop("text")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base, kinds), 256).alias("base_sha256"), told(F.col("found"), kinds).alias("spans"))


def _sql() -> str:
    """Every rule on every text, without an index."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rules = BASE + ADDED
    parts = []
    for r, rule in enumerate(rules):
        p = quoted(rule.pattern)
        parts.append(f"""SELECT rid, {r} AS kind, '{rule.kind}' AS name, regexp_extract_all(text, {p}) AS hit, regexp_extract_all(text, {p}, {rule.group}) AS own,
      string_split_regex(text, {p}) AS gap, {rule.least} AS least FROM d WHERE regexp_matches(text, {p})""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
u AS (SELECT rid, kind, name, least, unnest(hit) AS h, unnest(own) AS o, unnest(gap[1:len(hit)]) AS g, generate_subscripts(hit, 1) AS i FROM m),
s AS (SELECT rid, kind, name, least, o, h, (sum(length(g) + length(h)) OVER (PARTITION BY rid, kind ORDER BY i))::bigint AS fin FROM u),
f AS (SELECT rid, kind, fin - length(h) AS start, name || ':' || (fin - length(h)) || ':' || fin AS span FROM s WHERE length(o) >= least),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


QUERIES = {"op5_trigram_secrets": op5_trigram_secrets}
SQL = {"op5_trigram_secrets": _sql()}
