"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from rangeweave.llm import secrets

OP6 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.*, r.verdict, r.rhost || r.rpath AS rule
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n FROM fits)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM best WHERE n = 1
"""


_CLEAN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CLEAN} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_CLEAN} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS p, x
  FROM (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda k: w[k:k + 12])) AS x FROM i WHERE len(w) > 0)),
runs AS (
  SELECT rid, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: {{'s': k, 'p': array_to_string(w[k:k + n - 1], ' ')}})) AS x
  FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
hits AS (SELECT r.rid, r.x.s AS s, r.n, v.item FROM runs r JOIN wins v ON v.n = r.n AND v.p = r.x.p),
places AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS at FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid),
tok AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
terms AS (SELECT p, unnest(x) AS term, unnest(range(len(x))) AS place FROM (SELECT DISTINCT p, x FROM wins)),
rk AS (SELECT p, term, row_number() OVER (PARTITION BY p ORDER BY n, place) AS r, count(n) OVER (PARTITION BY p) AS there, count(*) OVER (PARTITION BY p) AS size FROM terms LEFT JOIN cnt ON word = term),
lead AS (SELECT p, max(term) FILTER (r = 1) AS t1, max(term) FILTER (r = 2) AS t2, max(term) FILTER (r = 3) AS t3 FROM rk WHERE there = size GROUP BY p),
one AS (SELECT DISTINCT p, t2, t3, rid, pos FROM lead JOIN tok ON word = t1),
two AS (SELECT DISTINCT o.* FROM one o JOIN tok b ON b.rid = o.rid AND b.word = o.t2 AND abs(b.pos - o.pos) <= 26 UNION SELECT * FROM one WHERE t2 IS NULL),
three AS (SELECT DISTINCT o.rid, o.p FROM two o JOIN tok b ON b.rid = o.rid AND b.word = o.t3 AND abs(b.pos - o.pos) <= 26 UNION SELECT rid, p FROM two WHERE t3 IS NULL),
near AS (SELECT rid, count(DISTINCT item) AS n_near FROM three JOIN wins USING (p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
"""

_quoted = lambda p: "'" + p.replace("'", "''") + "'"
_FOUND = " UNION ALL ".join(
    f"SELECT rid, doc_id, source, {k} AS kind, string_split_regex(t, {_quoted(p)}) AS ps, regexp_extract_all(t, {_quoted(p)}) AS ms FROM d"
    for k, p in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.LIVE))
)
OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (
  SELECT rid, doc_id, source, kind, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{
    's': list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0), 'm': ms[k]}})) AS x
  FROM found WHERE len(ms) > 0),
cand AS (
  SELECT rid, doc_id, source, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s AS BIGINT) + length(x.m) AS e,
         CASE WHEN kind = 0 THEN regexp_extract(x.m, {_quoted(secrets.ASSIGN)}, 2) ELSE x.m END AS v
  FROM each),
good AS (
  SELECT * FROM cand
  WHERE CASE kind WHEN 0 THEN length(v) >= 8 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') ELSE true END),
owned AS (
  SELECT v, count(*) AS n_repositories, count(DISTINCT o) AS n_owners
  FROM (SELECT DISTINCT v, coalesce(source, '') AS o, coalesce(CAST(doc_id AS VARCHAR), '') AS r FROM good) GROUP BY v),
known AS (
  SELECT g.*, n_owners <= {secrets.MAX_OWNERS} AND n_repositories <= {secrets.MAX_REPOSITORIES} AS own,
         ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e AS label
  FROM good g JOIN owned USING (v)),
spans AS (
  SELECT * FROM known k
  WHERE kind < 3 OR (own AND NOT EXISTS (SELECT 1 FROM good b WHERE b.rid = k.rid AND b.kind < 3 AND b.s < k.e AND k.s < b.e))),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(label, ',' ORDER BY s, kind) AS spans,
         count(*) FILTER (own) AS n_owner_specific, count(*) FILTER (NOT own) AS n_copied
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (rid)
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT rid, doc_id, unnest(list_transform(range(1, len(w) - 48), lambda k: {'s': k, 'p': sha256(array_to_string(w[k:k + 49], ' '))})) AS x
  FROM d WHERE len(w) >= 50),
firsts AS (SELECT x.p AS p, min(doc_id) AS first FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(x.s, x.s + 50)) AS pos FROM runs JOIN firsts ON p = x.p WHERE first < doc_id),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CLEAN} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_CLEAN} AS w FROM benchmark),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
norm AS (SELECT rid, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
post AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
want AS (SELECT iid, item_id, term, count(*) AS times FROM (SELECT iid, item_id, unnest(w) AS term FROM i) GROUP BY iid, item_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
scored AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM want JOIN weight USING (term) JOIN post USING (term) JOIN norm USING (rid) GROUP BY iid, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op4_secrets": OP4, "op6_url_filter": OP6, "op7_substrings": OP7, "op12_search": OP12}
