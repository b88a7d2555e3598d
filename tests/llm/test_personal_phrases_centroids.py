"""Clusters, personal data and phrases against plain statements of the same, on small and odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import centroids, personal, phrases

# Clusters ---------------------------------------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds):
    """(id, cluster, distance) and the centroids, every vector against every centroid."""
    rows = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in rows[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(middle))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(middle)):
            mine = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
            if mine:
                middle[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i if i is not None else -1), *near(v)[::-1]) for i, v in rows), middle


def clustered(spark, rows, k=16, block=64):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(3)
    return centroids.cluster(frame, k, block=block)


@pytest.mark.parametrize("kind", ["random", "grouped", "copies", "few"])
def test_clusters_are_lloyds(spark, kind):
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(7, 64))
    rows = {
        "random": lambda: draw.normal(size=(300, 64)) / 8,
        "grouped": lambda: middle[draw.integers(0, 7, 300)] + draw.normal(size=(300, 64)) / 50,
        "copies": lambda: np.concatenate([np.repeat(middle[:2], 120, axis=0), draw.integers(-2, 2, (60, 64)) / 64]),
        "few": lambda: middle[:5],
    }[kind]()
    found = clustered(spark, [(i, [float(x) for x in v], "own") for i, v in enumerate(rows)]).collect()
    whole = [(i, [int(x) for x in np.floor(64 * v)]) for i, v in enumerate(rows)]
    told, middle = plain_lloyd(whole, 16, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == told
    for r in found:
        assert r.cluster_inertia == sum(d for _, c, d in told if c == r.cluster) and r.inertia == sum(d for *_, d in told)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_odd_vectors(spark):
    one = [0.5] * 64
    rows = [(1, one, None), (1, one, None), (None, [0.25] * 64, "x"), (2, None, "x"), (3, one[:63], "x"), (4, [float("nan")] + one[1:], "x"), (5, [float("inf")] + one[1:], "x"), (6, [None, *one[1:]], "x"), (7, [], "x"), (8, [1e300] * 64, "x")]
    found = {(r.vec_id, r.distance) for r in clustered(spark, rows).collect()}
    assert {i for i, _ in found} == {1, None, 8} and {d for _, d in found} == {0}
    assert clustered(spark, rows[3:9]).count() == 0


def test_bounds_prune(monkeypatch):
    """Of vectors in groups far apart, nodes are settled whole: few points are compared one by one."""
    draw = np.random.default_rng(2)
    middle = draw.normal(size=(16, 64)) * 500
    points = np.floor(middle[draw.integers(0, 16, 2000)] + draw.normal(size=(2000, 64))).astype(np.int64)
    tree, _ = centroids.cover_tree(points)
    compared = []
    monkeypatch.setattr(centroids, "_compare", lambda vectors, centres, v, c, own: compared.append(int((vectors.end[v] - vectors.start[v]).sum())))
    own = centroids.assigned(tree, centroids.centre_tree(np.floor(middle).astype(np.int64)))
    assert sum(compared) < 200
    assert (own == ((tree.points[:, None] - np.floor(middle)[None]) ** 2).sum(2).argmin(1)).mean() > 0.9


def test_cover_tree_invariants():
    points = np.random.default_rng(3).integers(-40, 40, (500, 64))
    tree, order = centroids.cover_tree(points)
    assert sorted(order.tolist()) == list(range(500)) and (tree.points == points[order]).all()
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i] : tree.end[i]]
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
        if tree.many[i]:
            children = range(tree.first[i], tree.first[i] + tree.many[i])
            assert tree.start[children[0]] == tree.start[i] and tree.end[children[-1]] == tree.end[i]  # the centre is the first child's too
            heads = tree.points[tree.start[children]]
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2))
            assert apart[~np.eye(len(heads), dtype=bool)].min() > max(tree.radius[j] for j in children) - 1e-9


# Personal data ----------------------------------------------------------------------------------------------------


def plain_base(text):
    """Base spans by the contract's own patterns."""
    digits = lambda t: re.sub("[^0-9]", "", t)

    def luhn(t):
        total = 0
        for i, x in enumerate(reversed(digits(t))):
            total += int(x) if i % 2 == 0 else int("0246813579"[int(x)])
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(t)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def strange(draw, n):
    bits = ["a@b.co", "x.y+z@mail-1.example.org", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "0", "37", "é", "\n", "a@b.c%d@e.f", "1.1.1.1.1", "(", "ab"]
    return "".join(draw.choice(bits) for _ in range(n))


def test_base_spans_are_the_patterns_own():
    draw = random.Random(6)
    for _ in range(3000):
        text = strange(draw, draw.randint(0, 25))
        found = [(personal.RULES[k].kind, s, e) for k, s, e, _ in personal.spans_of(text) if k < len(personal.BASE)]
        assert found == plain_base(text), text


@pytest.mark.parametrize("text,kind", [
    ("IBAN DE89 3704 0044 0532 0130 00 is ours", "iban"), ("IBAN DE88 3704 0044 0532 0130 00 is ours", None), ("hash GB82WEST12345698765432 of it", None), ("GB82WEST12345698765432", "iban"),
    ("credit card 378282246310005 on file", "shortcard"), ("number 378282246310005 on file", None), ("discard 378282246310005 on file", None),
    ("social security 123-45-6789", "ssn"), ("part 123-45-6789", None), ("social security 000-45-6789", None), ("call 0171 555 0199 now", "national"), ("serial 0171 555 0199 now", None), ("call order 0171 555 0199 now", None),
])
def test_checksums_and_context_decide(text, kind):
    assert [personal.RULES[k].kind for k, *_ in personal.spans_of(text)] == ([kind] if kind else [])


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "A1" * 100_000, "1-" * 100_000, "AB12 " + "ABCD " * 60_000):
        personal.spans_of(text)
    assert time.time() - began < 5


def test_scan_and_mask(spark):
    rows = [(1, "write a@b.co or 1.2.3.4", "z"), (1, "write a@b.co or 1.2.3.4", "z"), (2, None, None), (None, "", "z"), (3, "no data " * 50_000 + "a@b.co", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, found string")
    found = personal.masked(frame).collect()
    assert sorted((str(r.doc_id), r.text if r.text is None else r.text[-30:]) for r in found if r.doc_id != 3) == [("1", "write [EMAIL] or [IP]"), ("1", "write [EMAIL] or [IP]"), ("2", None), ("None", "")]
    assert next(r.found[0].start for r in found if r.doc_id == 3) == 400_000
    assert personal.scan(frame.filter("doc_id = 9")).count() == 0


# Phrases ----------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, most):
    counts, total, out = {}, Counter(), []
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= f[p[i : i + k]]}
        ranked = []
        for p, a in good.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:most])]
    return sorted(out)


@pytest.mark.parametrize("bytes_each", [200, 1 << 20])
def test_phrases_are_counted_whole(spark, bytes_each):
    draw = random.Random(8)
    words = ["Ab", "c", "dÉ", "e-f", "g\x00", "é", "ÿ", "h"]
    sure = ["the state of the art", "one two three", "c c c c c c"]
    texts = [" ".join(draw.choice(words + sure) + draw.choice(["", "", "", ".", ", ", "\n", "\r\n", "\t"]) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    rows = [(draw.choice(["en", "de", None, "und"]), t, "own") for t in texts] + [("en", None, None), ("xx", "", ""), (None, texts[0], "own"), ("en", "a " * 3000, "")]
    found = phrases.collocations(spark.createDataFrame(rows, "lang string, text string, id string").repartition(3), least=20, most=40, bytes_each=bytes_each)
    assert sorted(map(tuple, found.collect())) == plain_phrases([r[:2] for r in rows], 20, 40)


def test_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    few = spark.createDataFrame([("en", "only a few words")], "lang string, text string")
    assert phrases.collocations(few).count() == 0


def test_scores_pass_64_bits(spark):
    """Counts of a very large corpus: 1000 a n is over 2^64, and the quotient is exact."""
    a, n, x, y = 3_000_000_019, 9_000_000_000_000_037, 5_000_000_000_039, 7_000_000_000_003
    row = spark.createDataFrame([(a, n, [x], [y])], "a long, n long, prefix array<long>, suffix array<long>")
    assert row.select(phrases.cut().alias("c")).first().c.score == 1000 * a * n // (x * y)


def test_best_in_turns(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.col("id").cast("string").alias("phrase"), (F.col("id") * 7919 % 5000).alias("a"))
    once = {tuple(r) for r in phrases.best(rows, "lang", [F.desc("a")], 50).collect()}
    assert {tuple(r) for r in phrases.best(rows, "lang", [F.desc("a")], 50, parts=2000).collect()} == once and len(once) == 100
