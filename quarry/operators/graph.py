"""The cross-reference graph as two DataFrames, nodes and edges: building, resolving and expanding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import spec_references

from .ranking import BY, positions

# Edge weights, and names that are no information elements.
WEIGHTS = {"PARENT_CHILD": 0.5, "SIBLING": 0.3, "NEXT_SECTION": 0.4, "DEFINES": 0.8}
GENERIC_NAMES = ("true", "false", "null", "integer", "boolean", "string", "choice", "sequence", "enumerated", "bit", "octet")
ELEMENT = r"(?i)(\w[\w-]*)\s*::=\s*(INTEGER|SEQUENCE|ENUMERATED|BIT\s+STRING|OCTET\s+STRING|CHOICE|BOOLEAN)"


def expand(hits: DataFrame, edges: DataFrame, nodes: DataFrame, *, most_hits: int = 10, each: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """Reference targets of hits (by, id, spec_number, pos); edges: src, place, dst. Limits hold before the filters."""
    first = hits.filter(F.col("pos") <= most_hits).select(*by, "id", "spec_number", "pos")
    to = nodes.select(F.col("id").alias("dst"), F.col("spec_number").alias("_spec"))
    reached = first.join(edges.filter(F.col("place") < each).withColumnRenamed("src", "id"), "id").join(to, "dst").filter("_spec <> spec_number")
    fresh = reached.select(*by, F.col("dst").alias("id"), "pos", "place").join(first.select(*by, "id"), [*by, "id"], "left_anti")
    one = positions(fresh, F.asc("pos"), F.asc("place"), by=[*by, "id"], pos="_n").filter("_n = 1")
    return positions(one, F.asc("pos"), F.asc("place"), by=by, pos="rank").select(*by, "id", "rank", F.round(1.0 / (60 + F.col("rank")), 9).alias("score"))


def section_index(nodes: DataFrame) -> DataFrame:
    """(spec_number, section, id, place): every node under its own section, and under its parent's."""
    own = nodes.filter("section_number <> ''")
    both = F.array(F.col("section_number"), F.when((F.col("parent_section_id") != "") & (F.col("parent_section_id") != F.col("section_number")), F.col("parent_section_id")))
    return own.select("spec_number", "id", F.posexplode(both).alias("place", "section")).filter("section is not null")


def section_order(section: Column, fallback: Column) -> Column:
    """A section's numbers as an array; the fallback alone where a part is no number."""
    parts = F.transform(F.split(section, r"\."), lambda x: x.try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array(fallback.cast("int"))).otherwise(parts)


def parent_edges(nodes: DataFrame) -> DataFrame:
    """From the first node indexed under a section to the nodes whose parent it is."""
    first = section_index(nodes).groupBy("spec_number", "section").agg(F.min_by("id", F.struct("id", "place")).alias("src"))
    child = nodes.filter("parent_section_id <> ''").select("spec_number", F.col("parent_section_id").alias("section"), F.col("id").alias("dst"))
    return child.join(first, ["spec_number", "section"]).select("src", "dst", F.lit("PARENT_CHILD").alias("type"), F.lit(WEIGHTS["PARENT_CHILD"]).alias("weight"))


def sibling_edges(nodes: DataFrame) -> DataFrame:
    """Between consecutive nodes of one parent, in section order."""
    w = Window.partitionBy("doc_id", "parent_section_id").orderBy(section_order(F.col("section_number"), F.col("chunk_index")), "id")
    return nodes.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).filter("dst is not null").select("src", "dst", F.lit("SIBLING").alias("type"), F.lit(WEIGHTS["SIBLING"]).alias("weight"))


def next_section_edges(nodes: DataFrame) -> DataFrame:
    """Between top-level sections n and n + 1 of a document that are neighbours in order."""
    order = section_order(F.col("section_number"), F.col("chunk_index"))
    rows = nodes.filter("parent_section_id = '' and section_number <> ''").withColumn("_o", order)
    w = Window.partitionBy("doc_id").orderBy("_o", "id")
    found = rows.select("id", "_o", F.lead("id").over(w).alias("dst"), F.lead("_o").over(w).alias("_p"))
    hit = (F.size("_o") == 1) & (F.size("_p") == 1) & (F.get("_p", F.lit(0)) == F.get("_o", F.lit(0)) + 1)
    return found.filter(hit).select(F.col("id").alias("src"), "dst", F.lit("NEXT_SECTION").alias("type"), F.lit(WEIGHTS["NEXT_SECTION"]).alias("weight"))


#: How a node is reached by a section's name: it stands under it, under one of its subsections, or is one of its specification's first.
EXACT, UNDER, FIRST = 0, 1, 2
#: Most nodes that one row of members holds.
GROUP = 1024


def _above(section: Column) -> Column:
    """The names of the sections that a section lies in."""
    names = F.split(section, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(names)), lambda n: n < F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "."))


def alike(nodes: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(spec_number, held, first, n, ids): nodes of a specification that the same sections hold, each once, by id in groups of at most `GROUP`; first: (spec_number, id) of the nodes that are its first."""
    held = section_index(nodes).groupBy("spec_number", "id").agg(F.sort_array(F.collect_set("section")).alias("held"))
    rows = held.withColumn("first", F.lit(False)) if first is None else held.join(first.withColumn("first", F.lit(True)), ["spec_number", "id"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    placed = positions(rows, F.asc("id"), by=["spec_number", "held", "first"], pos="_n")
    return placed.groupBy("spec_number", "held", "first", F.floor((F.col("_n") - 1) / GROUP).alias("n")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def members(nodes: DataFrame, *, first: DataFrame | None = None, salts: int = 1, most: int | None = None) -> DataFrame:
    """(spec_number, section, kind, _salt, held, first, ids): what alike gives, under every name that reaches it; what comes first in its specification under `salts` copies of no name.

    With most only so many nodes of each name, by id.
    """
    named = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("section"), F.lit(kind).alias("kind"), F.lit(0).alias("_salt")))
    names = F.concat(named(F.col("held"), EXACT), named(F.array_distinct(F.flatten(F.transform("held", _above))), UNDER))
    copies = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda n: F.struct(F.lit("").alias("section"), F.lit(FIRST).alias("kind"), n.alias("_salt")))
    rows = alike(nodes, first).select("spec_number", "held", "first", "ids", F.explode(F.when(F.col("first"), F.concat(names, copies)).otherwise(names)).alias("m"))
    rows = rows.select("spec_number", "m.section", "m.kind", "m._salt", "held", "first", "ids")
    if most is None:
        return rows
    each = positions(rows.withColumn("id", F.explode("ids")), F.asc("id"), by=["spec_number", "section", "kind", "_salt"], pos="_m").filter((F.col("_m") <= most) | (F.col("kind") == FIRST))
    return each.withColumn("ids", F.array("id")).drop("_m", "id")


def best_names(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(spec_number, clause, section, kind, level): the name that settles each different clause of asked (spec_number, clause), by names alone, before any node is looked at."""
    parts, once = F.split("clause", r"\."), asked.filter("clause <> ''").select("spec_number", "clause").distinct()
    levels = once.select("spec_number", "clause", F.posexplode(F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("up", "section"))
    index = section_index(nodes).select("spec_number", "section").distinct()
    known = index.withColumn("kind", F.lit(EXACT)).unionByName(index.select("spec_number", F.explode(_above(F.col("section"))).alias("section"), F.lit(UNDER).alias("kind")).distinct())
    found = levels.join(known, ["spec_number", "section"]).withColumn("level", 2 * F.col("up") + F.col("kind"))
    return found.groupBy("spec_number", "clause").agg(F.min_by(F.struct("section", "kind", "level"), "level").alias("b")).select("spec_number", "clause", "b.*")


def reach(targets: DataFrame, nodes: DataFrame, *order: str, by: str) -> DataFrame:
    """targets (by, spec_number, section, kind, _salt, ...) met with the members that nodes are: each node, as id, once for each of by, at its first target in order.

    Whether an earlier target reaches a node as well is told by the sections that hold it, which is one question for all
    nodes of a group. What is reached, many times the targets, is neither grouped nor dealt out again; it is made by as
    many tasks as shuffles have, since the size of what is dealt out doesn't tell how much that is.
    """
    keys = ["spec_number", "section", "kind", "_salt"]
    dealt = lambda rows: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    along = Window.partitionBy(by, "spec_number").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    asked = targets.withColumn("_before", F.collect_list(F.struct("section", "kind")).over(along))

    def has(t: Column) -> Column:
        under = F.exists("held", lambda h: F.startswith(h, F.concat(t["section"], F.lit("."))))
        return F.when(t["kind"] == EXACT, F.array_contains("held", t["section"])).when(t["kind"] == UNDER, under).otherwise(F.col("first"))

    met = dealt(asked).join(dealt(nodes), keys).filter(~F.exists("_before", has))
    return met.select(*[c for c in targets.columns if c != "_salt"], F.explode("ids").alias("id"))


def resolve(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (ref, spec_number, clause) to node ids: the exact section, else sections under it, else the same of each parent in turn.

    The candidates are equi-joins: a clause's own prefixes against the names of sections, and against their own
    prefixes; the first level that has any wins, and only its nodes are met.
    """
    targets = asked.join(best_names(asked, nodes), ["spec_number", "clause"]).withColumn("_salt", F.lit(0))
    return reach(targets, members(nodes), "section", by="ref").select("ref", "id", "level")


def adjacency(edges: DataFrame) -> DataFrame:
    """src, type and its targets in order of dst."""
    return edges.groupBy("src", "type").agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def first_edges(edges: DataFrame, order: str = "pos") -> DataFrame:
    """The first of each (src, dst, type)."""
    return positions(edges, F.asc(order), by=["src", "dst", "type"], pos="_n").filter("_n = 1").drop("_n")


def element_definitions(nodes: DataFrame) -> DataFrame:
    """(id, name, kind) of information elements that a node's text (id, text) defines, once each."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(ELEMENT), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(ELEMENT), F.lit(2)).alias("kind"))
    rows = nodes.select("id", F.posexplode(pairs).alias("place", "p")).select("id", "place", "p.name", "p.kind")
    good = (F.length("name") >= 3) & ~F.lower("name").isin(*GENERIC_NAMES)
    return positions(rows.filter(good), F.asc("place"), by=["id", "name"], pos="_n").filter("_n = 1").select("id", "name", "kind")


def online_references(hits: DataFrame, *, most: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """(by, pos, search_query): the first `most` different specifications with their clauses that texts of hits (by, pos, text) refer to."""
    rows = hits.select(*by, "pos", F.posexplode(spec_references(F.col("text"))).alias("place", "r")).filter("r.type <> '?'")
    once = positions(rows, F.asc("pos"), F.asc("place"), by=[*by, "r.type", "r.spec_number", "r.clause"], pos="_n").filter("_n = 1")
    asked = F.concat(F.col("r.type"), F.lit(" "), F.col("r.spec_number"), F.when(F.col("r.clause") != "", F.concat(F.lit(" clause "), F.col("r.clause"))).otherwise(""))
    ranked = positions(once.select(*by, F.col("pos").alias("_p"), "place", asked.alias("search_query")), F.asc("_p"), F.asc("place"), by=by)
    return ranked.filter(F.col("pos") <= most).select(*by, "pos", "search_query")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph as two tables; edges lie by type."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a written graph."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
