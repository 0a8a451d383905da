"""DuckDB SQL with the rows of each registered query."""

from __future__ import annotations

from passagemill.plans import inputs as I


# Fixed values, given here again so that the library's own lists are checked.
LATIN_STOPWORDS = "the a an and or of in on at for from by with is are was were be been being to that this these those as it".split()
QUERY_STOPWORDS = (
    "the a an and or of to in on for with about what does do did is are was were be been being say says said tell me please show find explain this that these those it its as at from by "
    "quran koran"
).split()


def quote(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(quote, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


def terms(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 OR regexp_matches(t, '[0-9]'))"


def words(stop) -> str:
    return "(" + ", ".join(map(quote, stop)) + ")"


NORM = "trim(regexp_replace(lower({c}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
norm = lambda c: NORM.format(c=c)


def bm25(fields: dict[str, str], q: str) -> str:
    """CTEs up to sc(qid, field, doc, score); `q` is a query of (qid, field, token) rows."""
    lists = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id AS doc, {e} AS toks FROM documents" for f, e in fields.items())
    return f"""
lists AS ({lists}),
tf AS (SELECT field, doc, token, count(*) AS f FROM (SELECT field, doc, unnest(toks) AS token FROM lists) GROUP BY ALL),
dl AS (SELECT field, doc, len(toks) AS dl FROM lists),
st AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY 1),
raw AS (SELECT field, token, count(*) AS n, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (field) GROUP BY 1, 2),
mn AS (SELECT field, avg(raw) AS m FROM raw GROUP BY 1),
idf AS (SELECT field, token, n, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw JOIN mn USING (field)),
q AS (SELECT qid, field, token, count(*) AS times FROM ({q}) GROUP BY ALL),
sc AS (SELECT qid, field, doc, sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN idf USING (field, token) JOIN q USING (field, token) JOIN dl USING (field, doc) JOIN st USING (field) GROUP BY 1, 2, 3)"""


TEXT = {"text": terms("text")}
FIXED = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', 'text', '{t}')" for q, ts in I.TERMS.items() for t in ts) + ") v(qid, field, token)"
BASE = "WITH " + bm25(TEXT, FIXED)


def top(source: str, k: int, score: str = "score") -> str:
    return f"SELECT qid, doc, {score}, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, doc) AS rank FROM ({source}) QUALIFY rank <= {k}"


LEX = "SELECT qid, doc, round(score, 4) AS score FROM sc"
VEC_Q = values("vq", "qid, doc", [(q, i) for i, q in enumerate(I.TERMS)])
DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
BOTH = f"""{BASE}, {VEC_Q},
lx AS ({top(LEX, 80)}),
se AS ({top(f"SELECT vq.qid, b.vec_id AS doc, round({DOT}, 6) AS score FROM vq JOIN embeddings a ON a.vec_id = vq.doc, embeddings b WHERE b.vec_id IN (SELECT doc_id FROM documents)", 1000)}),
merged AS (SELECT coalesce(l.qid, s.qid) AS qid, coalesce(l.doc, s.doc) AS doc, round(l.score, 6) AS bm25, round(s.score, 6) AS semantic FROM lx l FULL JOIN se s ON l.qid = s.qid AND l.doc = s.doc),
rk AS (SELECT *, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC NULLS LAST, doc) END AS rb,
  CASE WHEN semantic IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY semantic DESC NULLS LAST, doc) END AS rs FROM merged)"""


def r6(x: str) -> str:
    """Six digits by the exact binary value, half to even."""
    p, h = "(v * 1e6)", "(v * 134217729::DOUBLE - (v * 134217729::DOUBLE - v))"
    rest, error = f"({p} - floor({p}))", f"(({h} * 1e6 - {p}) + (v - {h}) * 1e6)"
    return f"list_transform([({x})::DOUBLE], lambda v: (floor({p}) + CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND ({error} > 0 OR ({error} = 0 AND floor({p}) % 2 = 1))) THEN 1 ELSE 0 END) / 1e6)[1]"


def rrf(source: str = "rk", a: float = 0.7, b: float = 0.3) -> str:
    return f"SELECT qid, doc, bm25, semantic, {r6(f"coalesce({a!r}::DOUBLE / (60.0::DOUBLE + rb), 0) + coalesce({b!r}::DOUBLE / (60.0::DOUBLE + rs), 0)")} AS rrf FROM {source}"


RRF = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc) AS rank FROM ({rrf()}) QUALIFY rank <= 300"

REFS = values("refs", "qid, raw", I.REFERENCES)
SEP, CON = r"[:;،,\-–—/\.：]", r"(?:-|–|—|\bto\b)"
U, S = "(?:ayah|aya|aayah|ayat|aayat|verse)", "(?:surah|sura|surat|chapter|ch)"
PATTERNS = [
    ("ref_pair", rf"^\s*(\d{{1,3}})\s*{SEP}\s*(\d{{1,3}})\s*$"),
    ("ref_range_same_surah", rf"^\s*(\d{{1,3}})\s*{SEP}\s*(\d{{1,3}})\s*{CON}\s*(\d{{1,3}})\s*$"),
    ("surah_ayah_words", rf"(?:{S}\s*)?(\d{{1,3}})\s+{U}\s*(?:[:\-]?\s*)?(\d{{1,3}})"),
    ("verse_ref_words", rf"{U}\s+(\d{{1,3}})\s*{SEP}\s*(\d{{1,3}})"),
    ("chapter_verse_words", rf"{S}\s+(\d{{1,3}})\s+{U}\s+(\d{{1,3}})"),
    ("ref_space_pair", r"^\s*(\d{1,3})\s+(\d{1,3})\s*$"),
]


def parse(source: str) -> str:
    """CTEs up to parsed(qid, kind, major, minor, minor_end, confidence)."""
    parts = []
    for i, (kind, p) in enumerate(PATTERNS):
        get = lambda g: f"try_cast(regexp_extract(num, '{p}', {g}) AS INT)"  # noqa: B023, E731
        end = f"greatest({get(2)}, {get(3)})" if "range" in kind else "NULL::INT"
        low = f"least({get(2)}, {get(3)})" if "range" in kind else get(2)
        parts.append(f"SELECT qid, {i} AS ord, '{kind}' AS kind, {get(1)} AS major, {low} AS minor, {end} AS minor_end, 1.0::DOUBLE AS confidence FROM forms WHERE regexp_matches(num, '{p}')")
    parts.append("SELECT qid, 6, 'surah_only_number', num::INT, 1, NULL, 0.85 FROM forms WHERE regexp_matches(num, '^[1-9][0-9]{0,2}$')")
    return f"""forms AS (SELECT qid, lower(trim(raw)) AS num FROM {source}),
hits AS ({" UNION ALL ".join(parts)}),
parsed AS (SELECT qid, kind, major, minor, minor_end, confidence FROM hits WHERE major BETWEEN 1 AND 114 AND minor BETWEEN 1 AND 286 AND coalesce(minor_end, 1) BETWEEN 1 AND 286
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ord) = 1)"""


TURNS = "turns AS (SELECT (conv_id + 1)::INT AS major, (turn + 1)::INT AS minor, role, length(text) AS n_chars FROM conversations)"
TARGETS = values("targets", "alias, target", I.TARGETS) + r""",
tparts AS (SELECT alias, generate_subscripts(string_split(target, ','), 1) - 1 AS ord, trim(unnest(string_split(target, ','))) AS part FROM targets),
tkeys AS (
  SELECT alias, ord, regexp_extract(part, '^(\d+)', 1)::INT AS major, unnest(range(regexp_extract(part, ':(\d+)-', 1)::INT, regexp_extract(part, '-(\d+)$', 1)::INT + 1))::INT AS minor
    FROM tparts WHERE regexp_matches(part, '^\d+:\d+-\d+$')
  UNION ALL SELECT alias, ord, regexp_extract(part, '^(\d+)', 1)::INT, regexp_extract(part, ':(\d+)$', 1)::INT FROM tparts WHERE regexp_matches(part, '^\d+:\d+$')
  UNION ALL SELECT alias, ord, unnest(range(regexp_extract(part, '^(\d+)', 1)::INT, regexp_extract(part, '-(\d+)$', 1)::INT + 1))::INT, 1 FROM tparts WHERE regexp_matches(part, '^\d+-\d+$')
  UNION ALL SELECT alias, ord, part::INT, 1 FROM tparts WHERE regexp_matches(part, '^\d+$'))"""

POST = f"post AS (SELECT DISTINCT lang, doc_id AS doc, unnest({terms('text')}) AS token FROM documents)"
TRIG = values("trig0", "topic, lang, token", I.TRIGGERS) + ", " + values("vars", "canonical, variant", I.VARIANTS) + """,
trig AS (SELECT topic, lang, token FROM trig0 UNION SELECT topic, lang, variant FROM trig0 JOIN vars ON canonical = token), """ + values("neg", "topic, lang, token", I.NEGATIVES)
MATCH = f"WITH {POST}, {TRIG}, found AS (SELECT DISTINCT topic, doc FROM post JOIN trig USING (lang, token)), bad AS (SELECT DISTINCT topic, doc FROM post JOIN neg USING (lang, token))"

GRADES = "grades AS (SELECT qid, doc_id AS doc, (quality + 2 * toxic)::DOUBLE AS grade FROM labels, (VALUES " + ", ".join(f"('{q}')" for q in I.TERMS) + ") v(qid))"


def metric_ctes(run: str, k: int, p: str = "") -> str:
    """CTEs up to {p}per(qid, p1, hit, rr, ap, ndcg, precision, recall, f1) from a run table."""
    return f"""
{p}j AS (SELECT r.qid, r.doc, r.rank, g.grade, (g.grade IS NOT NULL)::INT AS rel FROM {run} r LEFT JOIN (SELECT * FROM grades WHERE grade > 0) g USING (qid, doc) WHERE r.rank <= {k}),
{p}h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM {p}j),
{p}a AS (SELECT qid, max(CASE WHEN rank = 1 AND rel = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS p1, max(rel)::DOUBLE AS hit, min(CASE WHEN rel = 1 THEN rank END) AS fh,
  sum(CASE WHEN rel = 1 THEN hits::DOUBLE / rank ELSE 0 END) AS aps, sum(CASE WHEN rel = 1 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(rel) AS found FROM {p}h GROUP BY 1),
{p}o AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS i FROM grades WHERE grade > 0),
{p}i AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN i <= {k} THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM {p}o GROUP BY 1),
{p}b AS (SELECT g.qid, coalesce(p1, 0) AS p1, coalesce(hit, 0) AS hit, fh, coalesce(aps, 0) AS aps, coalesce(dcg, 0) AS dcg, coalesce(idcg, 0) AS idcg, coalesce(found, 0) AS found, coalesce(relevant, 0) AS relevant
  FROM (SELECT DISTINCT qid FROM grades) g LEFT JOIN {p}i USING (qid) LEFT JOIN {p}a USING (qid)),
{p}c AS (SELECT *, found / {k}.0::DOUBLE AS precision, CASE WHEN relevant > 0 THEN found::DOUBLE / relevant ELSE 0 END AS rc FROM {p}b),
{p}per AS (SELECT qid, p1, hit, coalesce(1.0 / fh, 0.0) AS rr, CASE WHEN least(relevant, {k}) > 0 THEN aps / least(relevant, {k}) ELSE 0 END AS ap, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg,
  precision, hit AS recall, CASE WHEN precision + rc > 0 THEN 2 * precision * rc / (precision + rc) ELSE 0 END AS f1 FROM {p}c)"""


RUN = f"run AS (SELECT qid, doc, rank FROM ({top(LEX, 10)}))"

LETTERS = values("lets", "id, raw", I.LETTER_ROWS)


def folded(extra_from: str = "", extra_to: str = "", drop: str = "") -> str:
    from passagemill.functions import text as T

    c = f"regexp_replace(translate(raw, '{T.INVISIBLE}', ''), '[\\p{{Mn}}\\p{{Me}}]', '', 'g')"
    source = T.TATWEEL + T.ALEF_FROM + T.YEH_FROM + T.WAW_FROM + extra_from + T.LETTERS_FROM
    target = T.ALEF_TO + T.YEH_TO + T.WAW_TO + extra_to + T.LETTERS_TO
    c = f"translate({c}, '{T.TATWEEL}', '')"
    marks = T.PUNCTUATION.replace("'", "''")
    c = f"translate({c}, '{source[1:]}{marks}{T.DIGITS_FROM}{drop}', '{target}{' ' * len(T.PUNCTUATION)}{T.DIGITS_TO}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


ORACLE_SQL = {
    "tokens_latin": f"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda t: trim(t, '''')),
  lambda t: length(t) >= 2 AND t NOT IN {words(LATIN_STOPWORDS)}) AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, w[1] AS first_token FROM w""",
    "tokens_unicode": r"SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) GROUP BY 1",
    "normalize_ws_case": f"SELECT doc_id, length({norm('text')}) AS n, sha256({norm('text')}) AS sha FROM documents",
    "clamp_text": "WITH c AS (SELECT doc_id, CASE WHEN length(text) > 1200 THEN left(text, 900) || ' … ' || right(text, 300) ELSE text END AS t FROM documents) SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM c",
    "searchable_text": r"""WITH c AS (SELECT doc_id, rtrim(left(trim(regexp_replace(lower(concat_ws(' ', doc_id::VARCHAR, nullif(lang, ''), nullif(source, ''), nullif(text, ''))), '[\s\x0B]+', ' ', 'g')), 1600)) AS t FROM documents)
SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM c""",
    "letter_fold": f"WITH {LETTERS} SELECT id, {folded()} AS search, {folded('ةۃ', 'هه', 'ء')} AS aggressive FROM lets",
    "lang_hint": f"""WITH {LETTERS}, r AS (SELECT id::BIGINT AS id, raw FROM lets UNION ALL SELECT doc_id + 1000, text FROM documents),
f AS (SELECT id, regexp_matches(raw, '[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}\\x{{8A0}}-\\x{{8FF}}]') AS ar, regexp_matches(raw, '[A-Za-z]') AS la FROM r)
SELECT id, CASE WHEN ar AND la THEN 'mixed' WHEN ar THEN 'ar' ELSE 'en' END AS hint FROM f""",
    "synonym_expand": f"""WITH t AS (SELECT item_id AS qid, unnest({terms('text')}) AS token FROM benchmark),
{values('syn', 'token, other', [(c, w) for c, ws in I.SYNONYMS.items() for w in ws] + [(w, c) for c, ws in I.SYNONYMS.items() for w in ws])}
SELECT qid, token, count(*) AS n FROM (SELECT qid, token FROM t UNION ALL SELECT qid, other FROM t JOIN syn USING (token)) GROUP BY ALL""",
    "stopword_adaptive": f"""WITH t AS (SELECT item_id, {terms('text')} AS t FROM benchmark)
SELECT item_id, len(t) AS n_before, CASE WHEN len(t) >= 4 THEN len(list_filter(t, lambda x: x NOT IN {words(QUERY_STOPWORDS)})) ELSE len(t) END AS n_after FROM t""",
    "corpus_stats": f"SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sections, sum(len({terms('text')}))::BIGINT AS n_tokens, round(avg(len({terms('text')})), 4) AS avgdl FROM documents",
    "doc_freq": f"SELECT token, count(DISTINCT doc_id) AS n, count(*) AS cf FROM (SELECT doc_id, unnest({terms('text')}) AS token FROM documents) GROUP BY 1",
    "idf_table": f"{BASE} SELECT token, n, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"{BASE} {top(LEX, 20)}",
    "bm25_fielded": "WITH " + bm25(
        {"body": terms("text"), "src": terms("source"), "lng": terms("lang"), "mix": terms("concat_ws(' ', source, lang, text)")},
        "SELECT qid, field, token FROM (VALUES " + ", ".join(f"('{q}', '{t}')" for q, ts in I.FIELD_TERMS.items() for t in ts) + ") a(qid, token), (VALUES ('body'), ('src'), ('lng'), ('mix')) b(field)",
    ) + f""", wt(field, weight) AS (VALUES ('body', 0.65::DOUBLE), ('src', 0.25), ('lng', 0.2), ('mix', 0.9)),
sl AS (SELECT qid, field, doc, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE score END AS s FROM sc WINDOW w AS (PARTITION BY qid, field)),
bs AS (SELECT qid, doc, round(sum(s * weight), 4) AS base FROM sl JOIN wt USING (field) GROUP BY 1, 2) {top('SELECT * FROM bs', 50, 'base')}""",
    "bm25_rerank_boosts": "WITH " + bm25(TEXT, f"SELECT item_id AS qid, 'text' AS field, unnest({terms('text')}) AS token FROM benchmark") + f""",
bs AS (SELECT qid, doc, round(CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE score END, 6) AS base FROM sc),
cd AS ({top('SELECT * FROM bs', 200, 'base')}),
qs AS (SELECT item_id AS qid, {norm('text')} AS qn, list_distinct({terms('text')}) AS qt FROM benchmark),
ds AS (SELECT doc_id AS doc, {norm('text')} AS dn, list_distinct({terms('text')}) AS dt FROM documents),
rr AS (SELECT qid, doc, round(base + 0.18::DOUBLE * (CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt))::DOUBLE / len(qt) ELSE 0 END) + CASE WHEN length(qn) >= 3 AND contains(dn, qn) THEN 0.2::DOUBLE ELSE 0 END, 6) AS score
  FROM cd JOIN qs USING (qid) JOIN ds USING (doc) WHERE base > 0) {top('SELECT * FROM rr', 10)}""",
    "phrase_source_lookup": f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains({norm('d.text')}, {norm('b.text')})",
    "occurrence_count": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({terms('text')}) AS token FROM documents) WHERE token IN {words(I.COUNTED)} GROUP BY 1",
    "occurrence_list": f"SELECT token, doc, pos FROM (SELECT doc_id AS doc, generate_subscripts({terms('text')}, 1)::BIGINT - 1 AS pos, unnest({terms('text')}) AS token FROM documents) WHERE token IN {words(I.LISTED)}",
    "ref_parse_pairs": f"WITH {REFS}, {parse('refs')} SELECT * FROM parsed",
    "ref_range_expand": f"WITH {REFS}, {parse('refs')}, {TURNS} SELECT qid, t.major, t.minor, role, n_chars FROM parsed p JOIN turns t ON t.major = p.major AND t.minor BETWEEN p.minor AND coalesce(p.minor_end, p.minor)",
    "alias_expand": f"WITH {TARGETS}, {TURNS} SELECT alias, ord, major, minor, role FROM tkeys JOIN turns USING (major, minor)",
    "intent_route": f"""WITH refs(qid, raw) AS (SELECT * FROM (VALUES {", ".join(f"({a}, {quote(b)})" for a, b in [*I.REFERENCES, (900, ""), (901, "opening")])}) v UNION ALL SELECT item_id + 1000, text FROM benchmark),
{parse('refs')}, {TURNS}, {TARGETS},
hit AS (SELECT qid FROM parsed p JOIN turns t ON t.major = p.major AND t.minor BETWEEN p.minor AND coalesce(p.minor_end, p.minor)
  UNION SELECT qid FROM refs JOIN tkeys ON alias = {norm('raw')} JOIN turns USING (major, minor))
SELECT qid::INT AS qid, CASE WHEN qid IN (SELECT qid FROM hit) THEN 'structural' WHEN trim(raw) = '' THEN 'lexical' ELSE 'hybrid' END AS intent FROM refs""",
    "cosine_topk": f"WITH {VEC_Q} " + top(f"SELECT vq.qid, b.vec_id AS doc, round({DOT}, 6) AS score FROM vq JOIN embeddings a ON a.vec_id = vq.doc, embeddings b", 10),
    "cosine_candidates": f"{BASE}, {VEC_Q}, lx AS ({top(LEX, 80)}) SELECT qid, lx.doc, round({DOT}, 6) AS score FROM lx JOIN embeddings b ON b.vec_id = lx.doc JOIN vq USING (qid) JOIN embeddings a ON a.vec_id = vq.doc",
    "hybrid_rrf": f"{BOTH} {RRF}",
    "hybrid_minmax": f"""{BOTH}, z AS (SELECT qid, doc, coalesce(bm25, 0) AS b, coalesce(semantic, 0) AS s FROM merged),
m AS (SELECT *, min(b) OVER w AS b0, max(b) OVER w AS b1, min(s) OVER w AS s0, max(s) OVER w AS s1 FROM z WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, doc, {r6("0.7::DOUBLE * ((b - b0) / CASE WHEN b1 - b0 < 1e-9 THEN 1 ELSE b1 - b0 END) + 0.3::DOUBLE * ((s - s0) / CASE WHEN s1 - s0 < 1e-9 THEN 1 ELSE s1 - s0 END)")} AS fused FROM m)
SELECT qid, doc, fused FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc) <= 300""",
    "lexical_mode": f"{BASE}, lx AS ({top(LEX, 80)}) SELECT qid, doc, round(score, 6) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM lx",
    "batch_hybrid": "WITH " + bm25(TEXT, f"SELECT item_id AS qid, 'text' AS field, unnest({terms('text')}) AS token FROM benchmark") + f""",
lx AS ({top(LEX, 80)}),
se AS ({top(f"SELECT i.item_id AS qid, b.vec_id AS doc, round({DOT}, 6) AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b WHERE b.vec_id IN (SELECT doc_id FROM documents)", 1000)}),
merged AS (SELECT coalesce(l.qid, s.qid) AS qid, coalesce(l.doc, s.doc) AS doc, l.score AS bm25, s.score AS semantic FROM lx l FULL JOIN se s ON l.qid = s.qid AND l.doc = s.doc),
rk AS (SELECT *, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC NULLS LAST, doc) END AS rb,
  CASE WHEN semantic IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY semantic DESC NULLS LAST, doc) END AS rs FROM merged)
SELECT qid, doc, rrf, rank FROM ({RRF}) WHERE rank <= 5""",
    "enrich_left_join": "SELECT c_custkey, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "range_bucket_join": f"WITH {values('rg', 'name, lo, hi, ord', I.RANGES)} SELECT doc_id, n_chars, arg_min(name, ord) AS name FROM documents LEFT JOIN rg ON n_chars BETWEEN lo AND hi GROUP BY 1, 2",
    "pivot_to_map": "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS texts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "missing_translations": "SELECT k.user_id AS key, t.event_type AS translator FROM (SELECT DISTINCT user_id FROM events) k, (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = k.user_id AND e.event_type = t.event_type)",
    "missing_keys_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "semi_candidates": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "alignment_full_outer": """SELECT coalesce(doc_id, vec_id) AS key, doc_id AS left_place, place AS right_place FROM documents FULL JOIN
  (SELECT vec_id, vec_id + (vec_id % 97 = 0)::INT AS place FROM embeddings) ON doc_id = vec_id WHERE doc_id IS DISTINCT FROM place""",
    "null_counts": "SELECT 'text' AS column, count(*) FILTER (text IS NULL OR text = '') AS n_null FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR lang = '') FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR source = '') FROM documents",
    "duplicate_texts": "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1",
    "contiguity_check": "SELECT conv_id, turn, before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'assistant') WHERE before IS NOT NULL AND turn <> before + 1",
    "density_check": """SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS distinct_n, min(turn) AS low, max(turn) AS high FROM conversations WHERE length(text) > 300 GROUP BY 1
HAVING low <> 0 OR high <> n - 1 OR distinct_n <> n""",
    "cumulative_offsets": "SELECT c_nationkey, units, coalesce(sum(units) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM (SELECT c_nationkey, count(*) AS units FROM customer GROUP BY 1)",
    "trigger_topics": f"{MATCH} SELECT * FROM found",
    "trigger_topics_negative": f"{MATCH} SELECT * FROM found EXCEPT SELECT * FROM bad",
    "topic_cap": f"{MATCH} SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY doc) AS rank FROM found QUALIFY rank <= 40",
    "topic_build": f"""{MATCH}, {values('anchors', 'topic, major, minor', I.ANCHORS)},
k AS (SELECT DISTINCT topic, (doc // 50)::INT AS major, (doc % 50)::INT AS minor FROM found), n AS (SELECT DISTINCT topic, (doc // 50)::INT AS major, (doc % 50)::INT AS minor FROM bad),
al AS (SELECT topic, major, minor, true AS is_anchor FROM anchors UNION ALL SELECT *, false FROM (SELECT * FROM k EXCEPT SELECT * FROM n EXCEPT SELECT topic, major, minor FROM anchors)),
pl AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY is_anchor DESC, major, minor) AS place FROM al)
SELECT topic, major, minor, is_anchor FROM pl WHERE is_anchor OR place <= 60""",
    "trigger_prune": f"{MATCH} SELECT DISTINCT topic, lang, token FROM trig JOIN post USING (lang, token)",
    "variant_mining": f"""WITH {values('seeds', 'canonical, variant', I.SEEDS)},
sf AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}\\x{{8A0}}-\\x{{8FF}}]+')) AS surface FROM documents),
b AS (SELECT canonical, variant FROM seeds UNION SELECT canonical, surface FROM (SELECT DISTINCT canonical FROM seeds) JOIN sf ON lower(surface) = lower(canonical))
SELECT canonical, variant, row_number() OVER (PARTITION BY canonical ORDER BY lower(variant), variant) AS ord FROM b WHERE variant <> canonical AND trim(variant) <> '' QUALIFY ord <= 12""",
    "phrase_gap_match": f"""WITH {values('ph', 'pid, phrase', I.PHRASES)}, d AS (SELECT doc_id, {terms('text')} AS s FROM documents),
f AS (SELECT pid, doc_id, list_reduce(list_prepend('0', phrase), lambda a, p: CASE WHEN a::INT < 0 THEN '-1' WHEN coalesce(list_position(s[a::INT + 1:], p), 0) = 0 THEN '-1'
  WHEN a::INT > 0 AND list_position(s[a::INT + 1:], p) > 3 THEN '-1' ELSE (a::INT + list_position(s[a::INT + 1:], p))::VARCHAR END) AS r FROM d, ph)
SELECT pid, doc_id FROM f WHERE r::INT > 0""",
    "gap_islands": """WITH k AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE length(text) > 200), r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS isl FROM k)
SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, isl""",
    "passages_mentions": """WITH k AS (SELECT DISTINCT (conv_id % 8)::INT AS topic, conv_id, turn FROM conversations WHERE length(text) > 200),
r AS (SELECT *, turn - row_number() OVER (PARTITION BY topic, conv_id ORDER BY turn) AS isl FROM k), b AS (SELECT topic, conv_id, min(turn) AS first, count(*) AS n FROM r GROUP BY topic, conv_id, isl)
SELECT topic, conv_id, first, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, conv_id, first) AS rank, CASE WHEN rank <= 6 THEN 'passage' ELSE 'mention' END AS kind FROM b""",
    "eval_metrics": f"{BASE}, {RUN}, {GRADES}, {metric_ctes('run', 10)} SELECT qid, round(p1, 6) AS p1, round(hit, 6) AS hit, round(rr, 6) AS rr, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per",
    "eval_by_group": f"""{BASE}, {RUN}, {GRADES}, {metric_ctes('run', 10)} SELECT CASE WHEN qid IN ('q1', 'q2') THEN 'a' ELSE 'b' END AS kind, count(*) AS n, count(*) FILTER (hit > 0) AS n_found,
  round(avg((hit > 0)::INT), 6) AS accuracy, round(avg(p1), 6) AS mean_p1, round(avg(rr), 6) AS mean_rr, round(avg(ap), 6) AS mean_ap, round(avg(ndcg), 6) AS mean_ndcg FROM per GROUP BY 1""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value)),
g AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS low, max(value) AS high,
  max(CASE WHEN r = floor(0.95 * (n + 1)) THEN value END) AS a, max(CASE WHEN r = floor(0.95 * (n + 1)) + 1 THEN value END) AS b FROM r GROUP BY 1)
SELECT event_type, n, round(mean, 6) AS mean, round(median, 6) AS median, round(CASE WHEN n < 20 OR b IS NULL THEN high ELSE a + (b - a) * (0.95 * (n + 1) - floor(0.95 * (n + 1))) END, 6) AS p95, round(low, 6) AS low, round(high, 6) AS high FROM g""",
    "best_config": f"{BOTH}, {GRADES}" + "".join(
        f", run{i} AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc) AS rank FROM ({rrf('rk', 1 - w, w)}) QUALIFY rank <= 300), {metric_ctes(f'run{i}', 10, f'm{i}')}" for i, w in enumerate(I.GRID)
    ) + ", al AS (" + " UNION ALL ".join(f"SELECT {w}::DOUBLE AS run, round(avg((hit > 0)::INT), 6) AS accuracy, round(avg(rr), 6) AS mrr, 0.0::DOUBLE AS latency FROM m{i}per" for i, w in enumerate(I.GRID)) + ") SELECT * FROM al ORDER BY accuracy DESC, mrr DESC, latency, run LIMIT 1",
    "judgment_pool": f"""{BASE}, {VEC_Q}, {RUN}, {GRADES}, cs AS ({top(f"SELECT vq.qid, b.vec_id AS doc, round({DOT}, 6) AS score FROM vq JOIN embeddings a ON a.vec_id = vq.doc, embeddings b", 10)}),
pl AS (SELECT qid, doc FROM run UNION SELECT qid, doc FROM cs)
SELECT qid, doc, left(text, 160) AS preview, grade FROM pl JOIN documents ON doc_id = doc LEFT JOIN grades USING (qid, doc)""",
    "validation_report": """WITH u AS (SELECT c_nationkey AS k, count(*) AS units FROM customer GROUP BY 1), n AS (SELECT n_nationkey + 1 AS number, n_name, n_regionkey, units FROM nation LEFT JOIN u ON k = n_nationkey),
i AS (
  SELECT 'error' AS level, 'E_SURAH_NUMBER_RANGE' AS code FROM n WHERE number NOT BETWEEN 1 AND 30
  UNION ALL SELECT 'error', CASE WHEN units IS NULL THEN 'E_SURAH_VERSECOUNT_TYPE' ELSE 'E_SURAH_VERSECOUNT_RANGE' END FROM n WHERE number BETWEEN 1 AND 30 AND (units IS NULL OR units NOT BETWEEN 1 AND 286)
  UNION ALL SELECT 'error', 'E_SURAH_MISSING' FROM range(1, 31) r(x) WHERE x NOT IN (SELECT number FROM n)
  UNION ALL SELECT 'warning', 'W_SURAH_NAME_AR_EMPTY' FROM n
  UNION ALL SELECT 'warning', 'W_SURAH_REVELATION_TYPE' FROM n WHERE n_regionkey <> 0
  UNION ALL SELECT 'warning', 'W_SURAH_NONSEQUENTIAL' FROM (SELECT number, lag(number) OVER (ORDER BY number) AS b FROM n) WHERE number <> b + 1 AND number <> b
  UNION ALL SELECT 'warning', 'W_TOTAL_VERSE_COUNT' FROM (SELECT coalesce(sum(units), 0) AS t FROM n) WHERE t <> 6236)
SELECT level, code, count(*) AS n FROM i GROUP BY 1, 2""",
    "manifest_hash": "SELECT doc_id::VARCHAR AS name, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents",
    "manifest_verify": "SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id::VARCHAR LIKE '%13' THEN 'unlisted' ELSE 'bytes' END AS problem FROM documents WHERE doc_id::VARCHAR LIKE '%13' OR doc_id::VARCHAR LIKE '%7'",
    "display_pick": """WITH t AS (SELECT doc_id, coalesce(CASE WHEN trim(text) <> '' THEN text END, source) AS d, coalesce(CASE WHEN lang = 'de' AND trim(text) <> '' THEN text END, source) AS p FROM documents)
SELECT doc_id, length(d) AS n_display, sha256(d) AS display, length(p) AS n_preferred, sha256(p) AS preferred FROM t""",
    "translation_select": """WITH o AS (SELECT doc_id, list_filter([{'k': lang, 'v': text}, {'k': 'src', 'v': source}], lambda e: trim(e.v) <> '') AS o FROM documents),
t AS (SELECT doc_id, list_sort(o)[(('0x' || substr(md5('1337:' || doc_id), 1, 12))::BIGINT % len(o)) + 1] AS t FROM o)
SELECT doc_id, t.k AS translator, length(t.v) AS n, sha256(t.v) AS sha FROM t""",
    "response_struct": f"""{BOTH}, fin AS (SELECT * FROM ({RRF}) WHERE rank <= 5),
res AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS place, substr(source, 4, 9) AS sec, doc, text, lang, rrf, bm25, semantic FROM fin JOIN documents ON doc_id = doc),
qs(qid, raw, intent) AS (VALUES {", ".join(f"('{q}', '{' '.join(t)}', 'hybrid')" for q, t in I.TERMS.items())}, ('none', 'nothing', 'lexical')),
n AS (SELECT qs.qid, raw, intent, count(doc)::INT AS n FROM qs LEFT JOIN res USING (qid) GROUP BY ALL)
SELECT n.qid, place, 1 AS version, 'v1' AS packVersion, raw, intent, 'en' AS langHint, 0 AS "offset", n AS "limit", n AS total, NULL::INT AS nextOffset, sec || ':' || doc AS verseKey, sec::INT AS surah, doc::INT AS ayah,
  sha256(text) AS arabic, lang, sha256(text) AS display, CASE WHEN place IS NOT NULL THEN 0 END AS juz, CASE WHEN place IS NOT NULL THEN 'hybrid' END AS mode, rrf, bm25, semantic FROM n LEFT JOIN res USING (qid)""",
    "row_numbers": "SELECT vec_id, row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS row FROM embeddings",
    "split_texts": "SELECT doc_id, part, length(substr(text, (part * 1000 + 1)::BIGINT, 1000)) AS n, sha256(substr(text, (part * 1000 + 1)::BIGINT, 1000)) AS sha FROM (SELECT doc_id, text, unnest(range(greatest(ceil(length(text) / 1000.0), 1)::BIGINT)) AS part FROM documents)",
}

PACKED = """WITH RECURSIVE pg AS (SELECT page_id % 4 AS file, page_id, strlen(html)::BIGINT AS size, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS i FROM pages),
pk AS (
  SELECT file, page_id, size, i, 0::BIGINT AS chunk, size AS used FROM pg WHERE i = 1
  UNION ALL SELECT p.file, p.page_id, p.size, p.i, k.chunk + (k.used + p.size + 1 + 2 > 100000)::BIGINT, CASE WHEN k.used + p.size + 1 + 2 > 100000 THEN p.size ELSE k.used + p.size + 1 END
    FROM pk k JOIN pg p ON p.file = k.file AND p.i = k.i + 1)"""
ORACLE_SQL["size_chunks"] = f"{PACKED} SELECT file, page_id, chunk FROM pk"
ORACLE_SQL["chunk_manifest"] = f"{PACKED}, c AS (SELECT file, chunk, count(*) AS n, sum(size) AS bytes FROM pk GROUP BY 1, 2) SELECT file, count(*) AS chunks, sum(n)::BIGINT AS items, round(sum(bytes) / 1048576.0, 3) AS mb FROM c GROUP BY 1"
