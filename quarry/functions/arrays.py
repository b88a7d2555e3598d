"""Folds over long arrays as column expressions, in time that grows with their length, and places of matches in texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are folded in one run; runs are joined by a second fold.
RUN = 256
INTS = "array<int>"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(run, k) for each run k of RUN items, in order."""
    last = F.floor((F.size(items) - 1) / RUN).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: body(F.slice(items, k * RUN + 1, F.lit(RUN)), k))).otherwise(F.array())


def before_each(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints the fold, from 0, of those before it; the last item is the fold of all."""

    def grown(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast(INTS).alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(fold(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")))

    def folded(v: Column) -> Column:
        tops = runs_of(v, lambda run, k: F.aggregate(run, F.lit(0), fold)).cast(INTS)
        return once(grown(tops, F.lit(0)), lambda s: F.concat(F.flatten(runs_of(v, lambda run, k: grown(run, F.get(s["out"], k))["out"])).cast(INTS), F.array(s["now"])))

    one_run = lambda v: once(grown(v, F.lit(0)), lambda s: F.concat(s["out"], F.array(s["now"])))
    return once(values, lambda v: F.when(F.size(v) <= RUN, one_run(v)).otherwise(folded(v)))


def found_at(text: Column, *patterns: tuple[str, Sequence[int]]) -> Column:
    """For each of patterns (expression, groups) an array of struct(start, end, g1, g2, ...) of its matches in order, by code points from 0.

    A group that takes no part is empty, as are those that a pattern has fewer of than another. The folds are
    stated once for all patterns, so that plans stay small.
    """
    most = max(len(groups) for _, groups in patterns)
    names = [f"g{i}" for i in range(1, most + 1)]

    def parts(pattern: str, groups: Sequence[int]) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        own = [F.regexp_extract_all(text, F.lit(pattern), F.lit(groups[i])) if i < len(groups) else F.array().cast("array<string>") for i in range(most)]
        return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), *[x.alias(n) for x, n in zip(own, names, strict=True)])

    def spans(p: Column) -> Column:
        begins = before_each(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))), lambda a, n: a + n)
        values = lambda x: [F.coalesce(x[n], F.lit("")).alias(n) for n in names]
        row = lambda at, x, i: F.struct((F.get(at, i) + F.length(x["gap"])).alias("start"), (F.get(at, i) + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), *values(x))
        return once(begins, lambda at: F.filter(F.transform(p, lambda x, i: row(at, x, i)), lambda s: s["end"].isNotNull()))

    return F.transform(F.array(*[parts(*p) for p in patterns]), spans)
