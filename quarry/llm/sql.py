"""SQL of operators whose result SQL can say, for small tables: by brute force, without their methods."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Of 100-byte windows in order of (doc_id, start), all but the first of equal ones; texts as hexadecimal.
OP4 = """
WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prior FROM s),
p AS (SELECT doc_id, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS n FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(n, 0)::bigint AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""

#: All windows of 35 words that occur twice or more.
OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM x) WHERE n > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 35 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 35 AS b FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = o.doc_id AND o.i >= s.a AND o.i < s.b) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_BIT = " + ".join(f"{1 << (4 - j)} * substr(bits, 5 * i + {j + 1}, 1)::int" for j in range(5))

#: Digests of all pages; the smallest page of a payload is its response.
OP7 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
b AS (SELECT page_id, payload, unhex(sha1(payload))::bit::varchar AS bits FROM p),
f AS (SELECT page_id, octet_length(payload)::bigint AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY payload) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

#: Links by shared shingles, components by reachability.
OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT sides.y, reach.c FROM reach JOIN sides ON sides.x = reach.v),
top AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, c AS component_id, doc_id = c AS kept FROM d JOIN top ON v = doc_id LEFT JOIN n USING (doc_id)
"""

SQL = {"op4_run_index": OP4, "op6_seed_extend": OP6, "op7_warc": OP7, "op8_lsh_forest": OP8}
