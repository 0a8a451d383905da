"""DuckDB SQL of `formats`."""

from __future__ import annotations

from passagemill.plans import inputs as I
from passagemill.plans.oracles import BASE, GRADES, RUN, metric_ctes, terms, values

SECTIONS = """sec AS (SELECT (n_nationkey + 1)::INT AS major, n_name AS name_en, lower(n_name) AS name_tr, CASE WHEN n_regionkey % 2 = 0 THEN 'Meccan' ELSE 'Medinan' END AS kind, units::INT AS units
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, count(*) AS units FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""

DATASET = f"""{SECTIONS},
off AS (SELECT major, coalesce(sum(units) OVER (ORDER BY major ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM sec),
c AS (SELECT (c_nationkey + 1)::INT AS major, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS minor, c_custkey AS k, c_name AS text FROM customer),
d AS (SELECT *, major || ':' || minor AS key, CASE WHEN k % 5 > 0 THEN 'en ' || k END AS en, CASE WHEN k % 7 > 0 THEN 'ur ' || k END AS ur,
  CASE WHEN k % 3 > 0 THEN 'tr' || (k % 2) END AS tren, CASE WHEN k % 3 > 0 THEN 't ' || text END AS ten, CASE WHEN k % 4 = 0 THEN 'u ' || text END AS tur, offs + minor AS loc
  FROM c JOIN sec USING (major) JOIN off USING (major)),
ds AS (SELECT key AS id, key AS verse_key, major AS surah, minor AS ayah, '' AS surah_name_arabic, name_en AS surah_name_english, name_tr AS surah_name_transliteration, kind AS revelation_type, text AS arabic,
  lower(text) AS transliteration, '' AS transliteration_alt, coalesce(en, '') AS translation_en_builtin, coalesce(ur, '') AS translation_ur_builtin, coalesce('u1=' || tur, '') AS translations_urdu,
  coalesce(tren || '=' || ten, '') AS translations_english, CASE WHEN loc <= 40 THEN 1 WHEN loc <= 400 THEN 2 ELSE 3 END AS juz, k::INT AS hasanat,
  concat_ws(' ', text, lower(text), en, ur, name_en, tur, CASE WHEN tren = 'tr1' THEN ten END) AS searchable_text, loc, tren, ten, tur, en, ur FROM d)"""

SQUEEZE = "trim(regexp_replace({c}, '[\\s\\x0B]+', ' ', 'g'))"


def packed(size: str, more: str, extra: str) -> str:
    """A recursive fold of greedy packing over (file, page_id, size)."""
    full = f"k.used > 0 AND k.used + {more} + {extra} > 100000"
    return f"""pg AS (SELECT page_id % 4 AS file, page_id, {size} AS size, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS i FROM pages),
pk AS (SELECT file, page_id, size, i, 0::BIGINT AS chunk, size AS used FROM pg WHERE i = 1
  UNION ALL SELECT p.file, p.page_id, p.size, p.i, k.chunk + ({full})::BIGINT, CASE WHEN {full} THEN p.size ELSE k.used + {more} END FROM pk k JOIN pg p ON p.file = k.file AND p.i = k.i + 1)"""


ORACLE_SQL = {
    "format_json_array": "SELECT form, item_id, sha256(text) AS sha FROM benchmark, (VALUES ('pretty'), ('compact')) v(form)",
    "format_ndjson": "SELECT doc_id, sha256(text) AS sha, lang, source, n_chars FROM documents",
    "format_dirty_jsonl": "SELECT conv_id, turn, role FROM conversations",
    "format_translation_files": "SELECT 'xx' AS lang, r_name AS translator, '1:' || n_nationkey AS key, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey",
    "format_metadata": f"""WITH {SECTIONS} SELECT 'section' AS what, major AS n, name_en AS a, kind AS b, units FROM sec
UNION ALL SELECT 'range', x::INT, (5 * x - 4) || ':1', (5 * x) || ':1', NULL FROM range(1, 6) r(x)
UNION ALL SELECT w, major, NULL, NULL, units FROM sec, (VALUES ('objects'), ('map'), ('list'), ('bare')) v(w)""",
    "format_first_array": "SELECT 'rows' AS key, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name AS name FROM region",
    "format_key_list": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, '1:' || item_id AS key FROM benchmark",
    "format_npy": "SELECT vec_id, row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS row, len(embedding) AS dim, true AS near FROM embeddings",
    "format_half_matrix": "SELECT vec_id, row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS row, true AS near FROM embeddings",
    "format_yaml": "SELECT form, r_regionkey, r_name, 'é ' || r_name AS name FROM region, (VALUES ('ascii'), ('unicode')) v(form)",
    "format_localized_triggers": f"WITH {values('t', 'topic, lang, token', I.TRIGGERS)} SELECT * FROM t",
    "format_files": """SELECT r_name || '.txt' AS name, 3 * length(r_name) AS bytes, sha256(repeat(r_name, 3)) AS sha256, true AS line_ok, 3 * length(r_name) AS v3_bytes, 7 AS rows, 1337 AS seed, 1600 AS most,
  CASE WHEN r_name = 'ASIA' THEN 'float16' END AS dtype, CASE WHEN r_name = 'ASIA' THEN '7x4' END AS shape, CASE WHEN r_name = 'ASIA' THEN true END AS row_major FROM region""",
    "format_keyed_object": "SELECT form, '1:' || n_nationkey AS key, n_nationkey, n_name FROM nation, (VALUES ('whole.json'), ('chunks')) v(form)",
    "chunk_forms": f"""WITH RECURSIVE {packed('strlen(html)::BIGINT', 'p.size + 1', '5002')} SELECT 'wrapped' AS form, file, page_id, chunk FROM pk
UNION ALL SELECT 'lines', file, page_id, chunk FROM (WITH RECURSIVE {packed('strlen(html)::BIGINT + 1', 'p.size', '0')} SELECT * FROM pk)""",
    "evaluation_report": f"""{BASE}, {RUN}, {GRADES}, {metric_ctes('run', 10)}, r AS (SELECT qid, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM per)
SELECT 'query' AS what, qid, rr, ndcg FROM r UNION ALL SELECT 'all', count(*)::VARCHAR, round(avg(rr), 6), round(avg(ndcg), 6) FROM r""",
    "stored_index": f"""WITH t AS (SELECT doc_id, {terms('text')} AS w FROM documents), x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM t)
SELECT 'text' AS field, token, doc_id, count(*) AS f, any_value(dl) AS dl FROM x GROUP BY doc_id, token""",
    "dataset_build": f"WITH {DATASET} SELECT * EXCLUDE (loc, tren, ten, tur, en, ur) FROM ds",
    "dataset_checks": f"""WITH {DATASET} SELECT 'rows' AS what, count(*) AS n FROM ds UNION ALL SELECT 'duplicate keys', count(*) - count(DISTINCT verse_key) FROM ds
UNION ALL SELECT 'sections with gaps', count(*) FROM (SELECT surah FROM ds GROUP BY 1 HAVING min(ayah) <> 1 OR max(ayah) <> count(*)) UNION ALL SELECT 'empty texts', count(*) FROM ds WHERE searchable_text = ''
UNION ALL SELECT 'without range', count(*) FROM ds WHERE juz IS NULL UNION ALL SELECT 'sections', count(DISTINCT surah) FROM ds UNION ALL SELECT 'total', count(*) FROM ds
UNION ALL SELECT 'count warnings', (count(*) <> 6236)::BIGINT FROM ds""",
    "positions": f"WITH {DATASET} SELECT verse_key, loc AS place, surah AS major, ayah::BIGINT AS minor FROM ds",
    "mobile_pack": f"""WITH {DATASET}, p AS (SELECT *, CASE WHEN tren = 'tr1' OR tren = 'tr0' THEN ten ELSE nullif(en, '') END AS e, coalesce(tur, ur) AS u FROM ds)
SELECT verse_key AS k, surah AS s, ayah AS a, juz AS j, arabic AS ar, coalesce(e, '') AS en, coalesce(u, '') AS ur, CASE WHEN tur IS NOT NULL THEN 'u1' END AS ut, tren AS et, transliteration AS tr,
  sha256(rtrim(left({SQUEEZE.format(c="lower(concat_ws(' ', verse_key, surah_name_english, arabic, e, u, transliteration))")}, 1600))) AS st FROM p""",
    "vector_checks": """SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, 1.0::DOUBLE AS unit, true AS cosine_ok, true AS difference_ok, true AS pooled FROM embeddings""",
    "encode_texts": """WITH c AS (SELECT doc_id, lower('query: ' || CASE WHEN length(text) > 1200 THEN left(text, 900) || ' … ' || right(text, 300) ELSE text END) AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^a-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^e]', '', 'g')) AS e, length(regexp_replace(t, '[^z]', '', 'g')) AS z FROM c""",
}
