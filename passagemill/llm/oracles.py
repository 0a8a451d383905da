"""DuckDB SQL of the registered queries that SQL can say."""

#: Shingles as lists of words, all pairs that share one, and components by recursion.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words),
reps AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2),
items AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM reps),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT rep AS x, rep AS y FROM reps UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
found AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(f.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(f.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN reps r ON r.s = list_sort(d.s) LEFT JOIN found f ON f.rep = r.rep
"""


#: Rules by their length; reputation level by level, as the operator has it.
OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
rows AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(h, p, allow) AS (VALUES ('org', '/', true), ('example.org', '/es/', false), ('example.org', '/en/1', false), ('com', '/fr/', true), ('com', '/de/', false)),
names AS (SELECT DISTINCT host, path FROM rows),
fits AS (
  SELECT n.host, n.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.allow, length(r.h || r.p)) AS allow
  FROM names n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p) GROUP BY 1, 2),
good AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY 1),
seen AS (SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k FROM (SELECT page_id, min(host) AS host FROM rows GROUP BY 1) JOIN good USING (page_id) GROUP BY 1),
two AS (
  SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS last2, array_to_string(string_split(host, '.')[-3:], '.') AS last3, string_split(host, '.')[-1] AS last1 FROM rows),
named AS (
  SELECT *, last2 IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.jp','com.br','co.in','co.nz','com.cn','com.mx','co.za') AND host <> last2 AS is_two FROM two),
h AS (
  SELECT host, CASE WHEN is_two THEN last3 ELSE last2 END AS domain, CASE WHEN is_two THEN last2 ELSE last1 END AS suffix, coalesce(n, 0.0) AS n, coalesce(k, 0.0) AS k
  FROM named LEFT JOIN seen USING (host)),
top AS (SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS m0 FROM h),
sg AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS m FROM h, top GROUP BY 1),
ss AS (SELECT 1 / least(greatest(coalesce((sum(n * (k/n - m) * (k/n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01), 0.001), 0.9) - 1 AS s FROM sg WHERE n > 0),
s1 AS (SELECT suffix, (k + s * m) / (n + s) AS m1 FROM sg, ss),
dg AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(m1) AS m FROM h JOIN s1 USING (suffix) GROUP BY 1, 2),
ds AS (SELECT 1 / least(greatest(coalesce((sum(n * (k/n - m) * (k/n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01), 0.001), 0.9) - 1 AS s FROM dg WHERE n > 0),
d1 AS (SELECT domain, (k + s * m) / (n + s) AS m2 FROM dg, ds),
hg AS (SELECT host, n, k, m2 AS m FROM h JOIN d1 USING (domain)),
hs AS (SELECT 1 / least(greatest(coalesce((sum(n * (k/n - m) * (k/n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01), 0.001), 0.9) - 1 AS s FROM hg WHERE n > 0),
ab AS (SELECT host, n, k + s * m AS a, n - k + s * (1 - m) AS b FROM hg, hs),
known AS (SELECT host, n::BIGINT AS n_labelled, round(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bound FROM ab)
SELECT r.page_id, r.host, r.path, f.rule, CASE WHEN f.rule IS NOT NULL THEN CASE WHEN f.allow THEN 'allow' ELSE 'block' END
  WHEN k.bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, k.n_labelled, k.bound
FROM rows r JOIN known k USING (host) LEFT JOIN fits f ON f.host = r.host AND f.path = r.path
"""

ORACLE_SQL = {"op1_url_reputation": OP1_SQL, "op6_minhash_near_dedup": OP6_SQL}
