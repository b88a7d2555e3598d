"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import packing, quality_rules, secrets
from quarry.llm.common import stage

from .test_exact import WORD, components_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [("documents", docs)]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, DATA), name)
        found.append((name, docs))
    return {name: (df.columns, [tuple(r) for r in df.collect()]) for name, df in found}


def clean(text):
    """The kept lines and whether the document stays."""
    words = WORD.findall(text)
    win = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {p for k in range(len(words) - 7) if win[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    kept = []
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        symbols, bars = sum(c in quality_rules.SYMBOLS for c in line), len(re.findall(quality_rules.SEPARATOR, line))
        ended = re.search(r"[.!?:;,…。！？][\"')\]»”’]*[\x20\x09-\x0D]*$", line)
        fails = n < 8 and not ended or symbols > 0.1 * n or len(re.findall(r"[!?]{2,}", line)) > 0.2 * n or bars >= 3 and n <= 8 * bars or n <= 25 and re.search(quality_rules.BOILERPLATE, line)
        if not (n and fails):
            kept.append(line)
    left = sum(len(WORD.findall(x)) for x in kept)
    return "\n".join(kept), not (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and 100 * left >= 70 * len(words)


def hidden(text):
    """text with its secrets marked."""
    spans = sorted((m.start(), m.end()) for r in secrets.BASE + secrets.ADDED for m in re.finditer(r.pattern, text, re.A) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, b in spans:
        if a > at or at == 0:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "source_mixing", "packing"]
    assert all(stages[n][0] == stages["documents"][0] for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality_rules(stages):
    want = [(i, *clean(t)) for i, t, *_ in stages["documents"][1]]
    assert sorted((i, t) for i, t, *_ in stages["quality_rules"][1]) == sorted((i, t) for i, t, kept in want if kept)
    assert all(n == len(t) for _, t, _, _, n in stages["quality_rules"][1])


def test_near_duplicates(stages):
    rows = stages["quality_rules"][1]
    keep = {i for i, (_, _, _, kept) in components_of([(r[0], r[1]) for r in rows], words=5, least=80).items() if kept}
    assert sorted(stages["near_duplicates"][1]) == sorted(r for r in rows if r[0] in keep) and 0 < len(keep) < len(rows)


def test_secret_scans(stages):
    want = [(i, hidden(t), lang, source) for i, t, lang, source, _ in stages["near_duplicates"][1]]
    assert sorted(r[:4] for r in stages["secret_scans"][1]) == sorted(want)


def test_source_mixing(stages):
    rows = stages["secret_scans"][1]
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t))
    names = sorted(size)
    weight, goal, open_ = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names)
    while open_:
        share = {s: (sum(size.values()) - sum(goal.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        goal |= {s: 3 * size[s] for s in over} if over else share
        open_ = open_ - over if over else set()
    want = Counter()
    for s in names:
        at, total = 0, int(goal[s] + 0.5)
        full = total // size[s]
        for i, t in sorted(((i, t) for i, t, _, x, _ in rows if x == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            w = WORD.findall(t)
            part = max(0, min(len(w), total - full * size[s] - at))
            at += len(w)
            want[(i, t)] += full + (0 < part and 2 * part >= len(w))  # whole, or not at all
    assert Counter((i, t) for i, t, *_ in stages["source_mixing"][1]) == +want


def test_packing(stages, spark):
    tokenizer = packing.load_tokenizer(packing.default_tokenizer())
    want = Counter()
    for i, t, *_ in stages["source_mixing"][1]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))] += 1
    assert Counter(r[:5] for r in stages["packing"][1]) == want
    run = Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, DATA).collect())
    assert run == want
    ends: dict = {}
    for *_, n, _, _, sequence, offset in sorted(stages["packing"][1], key=lambda r: (r[5], r[6])):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + n
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_one_of_each(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(3, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, "other words here now", "en", "s", 1), (None, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each(spark, rows, "").collect()) == ["1", "2", "None"]


PROSE = "This is a clean line of prose that has more than twenty words in it, so that the base rules pass it on, number {}, as they should."
INTERNAL = ["row", "new", "_all", "_new", "_clean", "_text", "_found", "found", "kept", "clean_text", "n_words", "size", "source_size", "target", "taken", "draws", "draw", "_at", "_draw", "_due", "_position", "_goal", "_full", "_part", "_key", "_bucket", "_rules", "_given", "_data", "_digest", "digest", "sig", "component", "component_id", "text_sha256", "others", "place", "weight", "level", "h", "p", "_b", "_source", "_before", "length", "start", "offset", "a.b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty texts, repeats and every name that a stage uses as a column of the user's."""
    text = PROSE.format
    rows = [(1, text(1), "en", "s", 5), (1, text(1), "en", "s", 5), (1, text(1), "de", "t", 5), (1, text("one and many other things, that no other document says or would say"), None, "s", None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text(9), "en", "s", 7), (None, text(9), "de", None, 7), (None, None, None, None, None), (4, text(4), "en", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for c in INTERNAL:
        frame = frame.withColumn(c, F.concat(F.lit(f"own {c} "), F.coalesce("lang", F.lit("-"))))
    return frame


def _plain(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    function = dict(corpus_pipeline.STAGES)[name]
    found, rows = function(spark, odd, ""), odd.collect()
    got = found.collect()
    assert name == "packing" or found.schema.names == odd.schema.names and [f.dataType for f in found.schema] == [f.dataType for f in odd.schema]
    if name == "quality_rules":
        assert _plain(got) == _plain(r for r in rows if r.text)
    elif name == "near_duplicates":
        first = [r for r in rows if r.doc_id == 1 and "one and many" not in r.text and r.lang == "de"]  # comes first as JSON
        assert _plain(got) == _plain([*first, *(r for r in rows if r.doc_id != 1 or "one and many" in r.text)])
    elif name == "secret_scans":
        assert _plain(got) == _plain(rows)
    elif name == "source_mixing":
        assert got and set(_plain(got)) <= set(_plain(r for r in rows if r.text))
    else:
        assert sum(r.start == 0 for r in got) == len(rows) and {r.doc_id for r in got} == {r.doc_id for r in rows}
    none = function(spark, odd.limit(0), "")
    assert none.count() == 0 and none.columns == found.columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_long_texts(spark, name):
    """A text of a million characters stays whole."""
    text = "\n".join(f"Line {i} of this text has words {i * 7} and {i * 13} and ends, as {i * 3} does, with a mark." for i in range(14_000))
    rows = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    found = dict(corpus_pipeline.STAGES)[name](spark, rows, "").collect()
    assert [tuple(r) for r in found] == [(1, text, "s")]


def test_survivors_do_not_depend_on_partitions(spark, odd):
    one = _plain(corpus_pipeline.one_of_each(spark, odd.repartition(1), "").collect())
    assert one == _plain(corpus_pipeline.one_of_each(spark, odd.repartition(6), "").collect())


def test_redaction_hides_whole_private_keys(spark):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = ["MIIE" + "Ab1+/" * 12] * 25 + ["Qz9="]
    texts = {
        "\n".join(["before", begin, *lines, end, "after"]): "before\n[REDACTED]\nafter",
        "k = '" + "\\n".join([begin, *lines, end]) + "' and more": "k = '[REDACTED]' and more",
        " ".join(["before", begin, *lines, "and prose goes on."]): "before [REDACTED] and prose goes on.",
        "\n".join([begin, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", *lines, "prose - with a mark."]): "[REDACTED]\nprose - with a mark.",
        " ".join([begin, *lines, "kept words", begin, *lines, end, "after"]): "[REDACTED] kept words [REDACTED] after",
        f"The line {begin} starts a key.": "The line [REDACTED] starts a key.",
        " ".join([begin, *lines * 2000, "a-b " * 20000, end, "x"]): "[REDACTED] x",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, rows, "").collect()}
    assert found == dict(enumerate(texts.values()))


def test_long_lines_with_separators_are_no_navigation(spark):
    prose = " ".join(f"word{i}" + " |" * (i in (500, 1000, 1500)) for i in range(2000)) + "."
    menu = "Home | News and weather | Sport | About the people who work here | Contact."
    body = " ".join(f"plain{i}" for i in range(60)) + "."
    rows = spark.createDataFrame([(1, prose), (2, menu + "\n" + body)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.clean_lines(spark, rows, "").collect()} == {1: prose, 2: body}
