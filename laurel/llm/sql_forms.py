"""Plain SQL forms of queries whose operators work quite differently; for comparison on small tables."""


def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in SQL: 0 to 255 is a byte to take in, -1 one of the eight shifts after it."""
    steps = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ord(c)], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
    return f"xor(list_reduce({steps}, lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"


NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
h AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common
  FROM h x JOIN h y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id FROM s JOIN r ON id = doc_id GROUP BY doc_id
"""

SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, w FROM w),
k AS (
  SELECT doc_id, word, i, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i+19], ' ') END AS win FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM k),
m AS (
  SELECT doc_id, word, i, coalesce(max(CASE WHEN win IS NOT NULL AND nth > 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 19, false) AS gone FROM o)
SELECT w.doc_id, CAST(any_value(len(w.w)) AS BIGINT) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN m ON m.doc_id = w.doc_id GROUP BY w.doc_id
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PLACES = "[list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) FOR i IN range(1, len(hits) + 1)]"


def _found(kind: int, pattern: str) -> str:
    return f"""SELECT doc_id, {kind} AS kind, unnest(hits) AS hit, unnest({_PLACES}) AS start FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}'))"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  {_found(0, _ASSIGN)} UNION ALL {_found(1, "AKIA[A-Z0-9]+")} UNION ALL {_found(2, "[0-9a-f]+")} UNION ALL {_found(3, "[A-Za-z0-9+/_=-]{20,}")}),
base AS (
  SELECT doc_id, kind, CAST(start AS BIGINT) AS a, CAST(start + length(hit) AS BIGINT) AS b FROM m
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 8 WHEN 1 THEN length(hit) >= 16 WHEN 2 THEN length(hit) >= 32 ELSE false END),
cand AS (
  SELECT doc_id, hit, start, CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 3 WHEN regexp_full_match(hit, '[0-9a-z]+|[0-9A-Z]+') THEN 5 ELSE 4 END AS kind FROM m
  WHERE kind = 3 AND regexp_matches(hit, '[0-9]')
    AND CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN regexp_matches(hit, '[A-Fa-f]')
             WHEN regexp_full_match(hit, '[0-9a-z]+|[0-9A-Z]+') THEN true
             ELSE regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') END
    AND NOT regexp_matches(hit, '(?i)example|sample|placeholder|dummy|changeme|your[_-]|abcdefghij')
    AND NOT regexp_matches(hit, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$|^sha(256|384|512)-|0123456789')),
w AS (SELECT *, unnest(range(0, length(hit) - 19)) AS j FROM cand),
c AS (SELECT doc_id, hit, start, kind, j, unnest(string_split(substr(hit, j + 1, 20), '')) AS ch FROM w),
n AS (SELECT doc_id, hit, start, kind, j, ch, count(*) AS n FROM c GROUP BY ALL),
h AS (SELECT doc_id, hit, start, kind, j, sum(round(n * log2(n) * 1048576)) AS s FROM n GROUP BY ALL),
hot AS (
  SELECT doc_id, kind, CAST(start + min(j) AS BIGINT) AS a, CAST(start + max(j) + 20 AS BIGINT) AS b FROM h
  WHERE s <= floor((log2(20) - CASE kind WHEN 3 THEN 3.0 ELSE 3.7 END) * 20 * 1048576) GROUP BY doc_id, hit, start, kind),
more AS (
  SELECT * FROM hot WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = hot.doc_id AND base.a <= hot.a AND hot.b <= base.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64', 'entropy_base36'][kind + 1] || ':' || a || ':' || b AS name FROM every)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id
"""
