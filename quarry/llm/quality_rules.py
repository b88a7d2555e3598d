"""Line-first cleaning: lines are judged one by one, and a document that loses too much text is rejected.

A line fails by punctuation (no end mark where prose has one, shouting marks, or symbols in place of marks), by
navigation (separators of any usual kind between short items: bars, bullets, arrows, slashes and angles that stand
alone) or as boilerplate (short licence, cookie or policy lines, by a table of phrases for each language).
Failing lines are removed; the document is kept if enough of its words are left. Base rules on whole
documents (length, repeated word windows) come first.

Only DataFrame functions are used, and no shuffle: everything is computed inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, table

SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
#: A line's end mark, perhaps with closing quotes or brackets after it.
END_MARK = r"[.!?:;,…。！？][\"')\]»”’]*[\x20\x09-\x0D]*$"
SHOUT = r"[!?]{2,}"
#: Phrases of boilerplate by language; a phrase starts a line or follows a space or an opening bracket.
PHRASES = {
    "en": (r"licen[sc]e", "copyright", "all rights reserved", r"terms of (?:use|service)", "privacy policy", "cookie", "subscribe", "newsletter", "click here", "read more", "sign in", "log in", "released under", "powered by"),
    "de": ("alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "urheberrecht", "hier klicken", "weiterlesen", "jetzt anmelden", "lizenz"),
    "fr": ("tous droits r[éÉ]serv[éÉ]s", "politique de confidentialit[éÉ]", "mentions l[éÉ]gales", "conditions d['’]utilisation", "cliquez ici", "lire la suite", "se connecter", "droits d['’]auteur"),
    "es": ("todos los derechos reservados", "pol[íÍ]tica de privacidad", "aviso legal", r"t[éÉ]rminos (?:de uso|y condiciones)", "haga clic", "leer m[áÁ]s", "iniciar sesi[óÓ]n", "derechos de autor"),
}


def _by_first_letter(phrases: list[str]) -> str:
    """An alternation of phrases that start with a letter, parted by it, so that few are tried at a place."""
    letters = dict.fromkeys(p[0] for p in phrases)
    return "|".join(f"{x}(?:{'|'.join(p[1:] for p in phrases if p[0] == x)})" for x in letters)


BOILERPLATE = "(?i)(?:^|[\\x20\\x09(\\[])(?:" + _by_first_letter([p for phrases in PHRASES.values() for p in phrases]) + ")"
#: Separators of navigation; slashes and angles only where they stand alone.
SEPARATOR = r"[|»•·›→]|\x20[/>]\x20"
SEPARATOR_MARKS = "|»•·›→/>"
#: Most symbols a word, most shouting marks a word, separators that make a line navigation, most words a separator, most words of a boilerplate line.
MOST_SYMBOLS, MOST_SHOUTS, SEPARATORS, ITEM_WORDS, BOILERPLATE_WORDS = 0.1, 0.2, 3, 8, 25
#: A last line without an end mark is often cut-off prose; lines of so many words pass without one.
PROSE_WORDS = 8
#: The least part of a document's words that kept lines must hold, in hundredths.
LEAST_KEPT = 70
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows of so many words that are found twice or more; hashes are the words' hashes."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def marked(runs: Column) -> Column:
        twice = lambda x, j: (F.get(runs, j - 1)["h"] == x["h"]) | (F.get(runs, j + 1)["h"] == x["h"])
        return covered(F.array_sort(F.transform(F.filter(runs, lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"])))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(window))))

    def count(keys: Column) -> Column:
        runs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(runs, marked))

    return let(hashes, lambda h: F.when(F.size(h) <= window, F.lit(0).cast("long")).otherwise(let(windows(h), count)))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is to be removed. Cheap tests come first: each rule's expression runs only on lines that may fail by it."""
    marks = lambda chars: F.length(line) - F.length(F.translate(line, chars, ""))

    def rules(words: Column) -> Column:
        punctuation = ((words < PROSE_WORDS) & ~F.rlike(line, F.lit(END_MARK))) | (marks(SYMBOLS) > MOST_SYMBOLS * words) | ((marks("!?") > MOST_SHOUTS * words) & (F.regexp_count(line, F.lit(SHOUT)) > MOST_SHOUTS * words))
        navigation = (marks(SEPARATOR_MARKS) >= SEPARATORS) & let(F.regexp_count(line, F.lit(SEPARATOR)), lambda n: (n >= SEPARATORS) & (words <= ITEM_WORDS * n))
        boilerplate = (words <= BOILERPLATE_WORDS) & F.rlike(line, F.lit(BOILERPLATE))
        return punctuation | navigation | boilerplate

    return let(F.regexp_count(line, F.lit(WORD)), rules)


def judge(docs: DataFrame, *, text: str = "text", least_kept: int = LEAST_KEPT) -> DataFrame:
    """docs' columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, base_failed, kept and clean_text.

    clean_text is the text without failing lines. Null and empty texts have no words, fail the base rules and are
    not kept; texts of any length are judged whole; repeated rows are judged alike; nothing depends on other rows,
    so an empty table gives none; columns of docs that are named like added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "base_failed", "kept", "clean_text"]
    others = [c for c in docs.columns if c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    with_word = F.filter(lines, lambda x: F.rlike(x, F.lit(WORD)))
    left = F.filter(lines, lambda x: ~(F.rlike(x, F.lit(WORD)) & line_fails(x)))
    counted = docs.select(
        *others,
        let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(F.transform(w, lambda x: F.xxhash64(x))).alias("r"))).alias("_w"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array_join(left, "\n").alias("clean_text"),
    )
    judged = counted.withColumns({"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.r"), "kept_words": F.regexp_count("clean_text", F.lit(WORD)).cast("long")})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_words") >= least_kept * F.col("n_words")))
    return judged.select(*others, *added)


def op3_line_first(spark, sf_dir):
    """Every document's counts and verdict; odd rows are as in judge."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


_W = "[^\\x20\\x09-\\x0D]+"
OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
judged AS (
  SELECT rid, k, line, len(regexp_extract_all(line, '{_W}')) AS n,
    length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols, len(regexp_extract_all(line, '{SEPARATOR}')) AS separators,
    len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts, regexp_matches(line, '[.!?:;,…。！？]["'')\\]»”’]*[\\x20\\x09-\\x0D]*$') AS ended,
    regexp_matches(line, '{BOILERPLATE.replace("'", "''")}') AS boilerplate FROM lines),
kept_lines AS (
  SELECT rid, sum(CASE WHEN (n < {PROSE_WORDS} AND NOT ended) OR symbols > {MOST_SYMBOLS}::double * n OR shouts > {MOST_SHOUTS}::double * n OR (separators >= {SEPARATORS} AND n <= {ITEM_WORDS} * separators)
    OR (n <= {BOILERPLATE_WORDS} AND boilerplate) THEN 0 ELSE n END) AS kept_words,
    count(*) - count(DISTINCT line) AS n_dup_lines FROM judged WHERE n > 0 GROUP BY rid),
windows AS (
  SELECT rid, unnest(generate_series(1, len(w) - 7)) AS i, w FROM d WHERE len(w) > 8),
keyed AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win FROM windows),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM keyed) WHERE n > 1),
repeated AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::bigint AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(repeated.n, 0)::bigint AS n_repeat_words, coalesce(kept_words, 0)::bigint AS kept_words
  FROM d LEFT JOIN kept_lines USING (rid) LEFT JOIN repeated USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * kept_words >= {LEAST_KEPT} * n_words AS kept FROM b
"""

QUERIES = {"op3_line_first": op3_line_first}
SQL = {"op3_line_first": OP3_SQL}
