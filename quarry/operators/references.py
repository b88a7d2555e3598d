"""References between specifications: what texts claim, settled by a sweep over intervals, and the edges they make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import found_at, once
from quarry.functions.documents import is_references_section, is_target_series

from . import graph
from .ranking import positions
from .storage import discard, stage

# What refers to a clause or a specification, in order of precision, and the places of clause and specification among its groups.
_SPEC = r"(?:3GPP\s+)?(?:TS|TR)\s+(\d{2})\.(\d{3})"
_CLAUSE = r"([\d\.A-Za-z]*)"
PATTERNS = {
    "clause_of_spec": (rf"(?i)(?:clause|section)\s+{_CLAUSE}\s+of\s+{_SPEC}(?:-\d)?", (2, 3, 1)),
    "clause_of_bracket": (rf"(?i)(?:clause|section)\s+{_CLAUSE}\s+of\s+\[\d+,\s+{_SPEC}\]", (2, 3, 1)),
    "bracket": (rf"(?i)\[\d+,\s+{_SPEC}\]", (1, 2)),
    "spec": (rf"(?i){_SPEC}(?:-\d)?", (1, 2)),
    "same_spec": (rf"(?i)(?:clause|section|subsection|sub-clause)\s+{_CLAUSE}", (1,)),
}
#: Where a match of any pattern begins, told by one letter first; the text from there; and the stretch over what begins further matches, until five words have none.
_CITED = r"t[sr]\s+\d{2}\.\d{3}"
_BEGIN = rf"[cst3\[](?:lause\s|ection\s|ub-?(?:clause|section)\s|[sr]\s+\d{{2}}\.\d{{3}}|gpp\s+{_CITED}|\d+,\s+(?:3gpp\s+)?{_CITED})"
FROM_FIRST = rf"(?is){_BEGIN}.*"
STRETCH = rf"(?i)(?:{_BEGIN}(?:(?!{_BEGIN})\S)*+(?:\s++(?:(?!{_BEGIN})\S)++){{0,5}}+\s*+)++"
#: A stretch of more matches is settled by a sweep over rows.
MOST_SETTLED = 64
SPEC_ON_LINE = r"(?i)TS\s+\d{2}\.\d{3}"
NEAR_CLAUSE, NEAR, MOST_EVIDENCE = 80, 40, 200
WEIGHTS = {"other": 1.0, "own": 0.6}
#: Copies of a specification's first nodes, so that one that is cited everywhere is met by so many tasks at least.
SALTS = 16
_NAMES = tuple(PATTERNS)


def candidates(nodes: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, cid, rank, start, end, spec_number, clause, counts, evidence, taken): matches of all patterns in nodes (id, text, keep), by code points.

    Patterns are looked for in the stretches that STRETCH finds, and a stretch of at most `MOST_SETTLED` matches is
    settled at once: only matches that claim their place are given, and taken is true. Of a longer one all are given,
    and taken is null. An empty specification is the text's own. counts is false for a clause on a line that names a
    specification.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    before = lambda at: F.substring(text, F.lit(1), at)
    begins = lambda z: F.greatest(z["start"] - NEAR_CLAUSE, F.lit(0))

    def stretch(z: Column) -> Column:
        """What a stretch's matches are told from, so that the whole text is gone through once for all of them."""
        wide = F.substring(text, begins(z) + 1, z["end"] + NEAR_CLAUSE - begins(z))
        after = F.substring(text, z["end"] + 1, F.length(text))
        return F.struct(z["start"].alias("at"), F.substring(text, z["start"] + 1, z["end"] - z["start"]).alias("own"), wide.alias("wide"), (z["start"] - begins(z)).alias("shift"),
                        F.substring_index(before(z["start"]), "\n", -1).alias("line"), F.substring_index(after, "\n", 1).alias("rest"))

    def row(w: Column, x: Column, taken: Column) -> Column:
        own, hit = x["rank"] == _NAMES.index("same_spec"), F.substring(w["own"], x["start"] + 1, x["end"] - x["start"])
        group = lambda i: F.coalesce(*[F.when(x["rank"] == r, F.regexp_extract(hit, p, g[i])) for r, (p, g) in enumerate(PATTERNS.values()) if i < len(g)], F.lit(""))
        first = lambda n: F.greatest(w["shift"] + x["start"] - n, F.lit(0))
        around = lambda n: F.substring(w["wide"], first(n) + 1, w["shift"] + x["end"] + n - first(n))
        near = F.regexp_extract(around(NEAR_CLAUSE), PATTERNS["same_spec"][0], 1)
        clause = F.when(own, group(0)).when(x["rank"] == _NAMES.index("spec"), near).otherwise(group(2))
        left, right = F.concat(w["line"], F.substring(w["own"], F.lit(1), x["start"])), F.concat(F.substring(w["own"], x["end"] + 1, F.length(w["own"])), w["rest"])
        line = F.concat(F.substring_index(left, "\n", -1), hit, F.substring_index(right, "\n", 1))
        spec = F.when(own, F.lit("")).otherwise(F.concat(group(0), F.lit("."), group(1)))
        values = {"rank": x["rank"], "start": w["at"] + x["start"], "end": w["at"] + x["end"], "spec_number": spec, "clause": F.regexp_replace(clause, r"\.+$", ""), "counts": ~own | ~F.rlike(line, F.lit(SPEC_ON_LINE)), "evidence": F.substring(F.regexp_replace(around(NEAR), r"^\s+|\s+$", ""), 1, MOST_EVIDENCE), "taken": taken}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def matches(w: Column) -> Column:
        ranked = lambda x, r: F.transform(x, lambda m: F.struct(r.alias("rank"), m["start"].alias("start"), m["end"].alias("end")))
        few = lambda c: F.size(c) <= MOST_SETTLED
        rows = lambda c: F.transform(F.when(few(c), settled_few(c)).otherwise(c), lambda x: row(w, x, F.when(few(c), F.lit(True))))
        return once(F.flatten(F.transform(found_at(w["own"], *[(p, ()) for p, _ in PATTERNS.values()]), ranked)), rows)

    def stretches(rest: Column) -> Column:
        """Those of a text of which rest is what follows its first match's begin; what is before is read once."""
        skipped = F.length(text) - F.length(rest)
        moved = lambda z: F.struct((z["start"] + skipped).alias("start"), (z["end"] + skipped).alias("end"))
        return F.transform(F.get(found_at(rest, (STRETCH, ())), F.lit(0)), lambda z: once(once(moved(z), stretch), matches))

    found = F.flatten(once(F.regexp_extract(text, FROM_FIRST, 0), lambda rest: F.when(rest != "", stretches(rest))))
    return nodes.select("id", *keep, F.posexplode(found).alias("cid", "c")).select("id", *keep, "cid", "c.*")


def settled_few(found: Column) -> Column:
    """Of an array of matches, by rank and start, those that claim their place: neither end lies in a stretch that one before them has claimed, ends included."""
    within = lambda at, t: (at >= t["start"]) & (at <= t["end"])
    taken = lambda a, x: F.exists(a, lambda t: within(x["start"], t) | within(x["end"], t))
    return F.aggregate(found, F.slice(found, F.lit(1), F.lit(0)), lambda a, x: F.when(taken(a, x), a).otherwise(F.concat(a, F.array(x))))


def settled(rows: DataFrame) -> DataFrame:
    """rows (id, cid, rank, start, end, ...) with taken: whether a match claims its stretch of the text.

    Ranks are swept one after the other. A match is out if its start or its end lies in a stretch that a better rank has
    taken, ends included: along the text, the farthest end of the taken stretches that have begun tells. Of matches of
    one rank that follow each other without a gap, every second one is out. Rows meet by text once; every sweep keeps
    that partitioning.
    """
    others = [c for c in rows.columns if c not in ("id", "cid")]
    rows = rows.withColumn("taken", F.lit(False))
    for r in range(len(PATTERNS)):
        own = F.col("rank") == r
        begin, ends = F.struct(F.col("start").alias("at"), F.lit(0).alias("kind")), [F.struct(F.col(c).alias("at"), F.lit(1).alias("kind")) for c in ("start", "end")]
        points = rows.withColumn("p", F.explode(F.when(own, F.array(*ends)).otherwise(F.array(begin))))
        along = Window.partitionBy("id").orderBy("p.at", "p.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = F.coalesce(F.max(F.when(F.col("taken"), F.col("end"))).over(along) >= F.col("p.at"), F.lit(False))
        swept = points.withColumn("hit", hit).groupBy("id", "cid").agg(F.max("hit").alias("hit"), *[F.first(c).alias(c) for c in (*others, "taken")])
        free = own & ~F.col("hit")
        order = Window.partitionBy("id", "free").orderBy("start")
        chain = swept.withColumn("free", free).withColumn("new", ~F.coalesce(F.lag("end").over(order) == F.col("start"), F.lit(False)))
        chain = chain.withColumn("run", F.sum(F.col("new").cast("int")).over(order))
        odd = F.row_number().over(Window.partitionBy("id", "free", "run").orderBy("start")) % 2 == 1
        rows = chain.withColumn("taken", F.col("taken") | (F.col("free") & odd)).select("id", "cid", *others, "taken")
    return rows


def claims(nodes: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, pattern, spec_number, clause, start, end, evidence, rank) of references in nodes (id, text, keep); a stretch is claimed once, by the most precise pattern.

    Null and empty texts claim nothing; ids are taken to be unique.
    """
    found = stage(candidates(nodes, *keep), "candidates")
    claimed = lambda rows: rows.filter("taken and counts").select("id", *keep, F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("rank")).alias("pattern"), "spec_number", "clause", "start", "end", "evidence", "rank")
    crowded = found.filter("taken is null")
    if crowded.isEmpty():
        return claimed(found)
    out = stage(claimed(found).unionByName(claimed(settled(crowded.drop("taken")))), "claims")
    discard(found)
    return out


def edges(nodes: DataFrame, *, series: Sequence[int] | None = None, told: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """REFERENCES edges (src, dst, type, weight, target_spec, target_clause, is_cross_spec, evidence), each once, the first in a text's order of claims.

    nodes: id, text, spec_number, the sections and, for the gate, section_title and parent_title. Sections that list a
    document's references make no edges, nor do references to other series than the wanted ones. A reference without a
    clause reaches the first five nodes of its specification, in the order in which sections come first. What refers to
    itself is kept. told are the nodes whose texts are read, all unless given. With most, a node's first `most` edges by
    dst are whole, and of the others some are left out.
    """
    told = nodes if told is None else told
    title = lambda c: F.coalesce(F.col(c), F.lit("")) if c in told.columns else F.lit("")
    told = told.filter(~F.coalesce(is_references_section(F.col("section_number"), title("section_title"), title("parent_title")), F.lit(False)))
    found = claims(told.select("id", "text", F.col("spec_number").alias("own")), "own").withColumnRenamed("spec_number", "named")
    spec = F.when(F.col("named") == "", F.col("own")).otherwise(F.col("named"))
    asked = found.withColumn("spec_number", spec).filter((F.col("named") == "") | is_target_series(F.col("named"), tuple(series) if series else None))
    asked = asked.select(F.col("id").alias("src"), "rank", "start", "own", "spec_number", "clause", "evidence")
    index = graph.section_index(nodes).withColumn("key", F.min(F.struct("id", "place")).over(Window.partitionBy("spec_number", "section")))
    five = positions(index, F.asc("key"), F.asc("id"), F.asc("place"), by=["spec_number"], pos="_n").filter("_n <= 5").select("spec_number", "id").distinct()
    named = asked.join(graph.best_names(asked, nodes).drop("level"), ["spec_number", "clause"]).withColumn("_salt", F.lit(0))
    alone = asked.filter("clause = ''").withColumns({"section": F.lit(""), "kind": F.lit(graph.FIRST), "_salt": F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int")})
    facts = F.struct("rank", "start", "own", "clause", "evidence")
    once_each = named.unionByName(alone).repartition("src", "spec_number").groupBy("src", "spec_number", "section", "kind", "_salt").agg(F.min_by(facts, F.struct("rank", "start")).alias("f"))
    found = graph.reach(once_each.select("src", "spec_number", "section", "kind", "_salt", "f.*"), graph.members(nodes, first=five, salts=SALTS, most=most), "rank", "start", by="src")
    cross = F.col("spec_number") != F.col("own")
    return found.select("src", F.col("id").alias("dst"), F.lit("REFERENCES").alias("type"), F.when(cross, WEIGHTS["other"]).otherwise(WEIGHTS["own"]).alias("weight"),
                        F.col("spec_number").alias("target_spec"), F.col("clause").alias("target_clause"), cross.alias("is_cross_spec"), "evidence")
