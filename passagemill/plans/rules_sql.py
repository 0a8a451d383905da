"""DuckDB SQL of `rules`; results of hand-made inputs are literals."""

from __future__ import annotations

from passagemill.plans import inputs as I
from passagemill.plans import rules as R
from passagemill.plans.oracles import BASE, GRADES, LEX, MATCH, NORM, POST, QUERY_STOPWORDS, REFS, TARGETS, bm25, folded, metric_ctes, norm, parse, quote, terms, top, values, words


def literal(columns: str, *rows) -> str:
    """`columns` are "name type" pairs."""
    pairs = [c.split(" ", 1) for c in columns.split(", ")]
    typed = ", ".join(f"{n}::{t} AS {n}" for n, t in pairs)
    return f"WITH {values('x', ', '.join(n for n, _ in pairs), rows)} SELECT {typed} FROM x"


FORMS = [
    "بسم الله", "ايمان احمد", "صلاة", "كتاب هے", "123 4", "strasse x", "a.b:c-d!e/f", "", "صلي الله عليه وسلم", "صلاه", "شي", "الصلاه ا", "don't stop o neil x", "ایک دو تین", "don't|xy|xy", "ایک|دو", "الصلاه|صوم",
    "صلاة|prayer|7|ab", "ab|صلاة|12", "كتاب|والكتاب", "Don't|x|y|صلاة", "surah al baqarah 2 255", "ayat ul kursi", "2:3 strasse", "alَ strasse", "A b", "a~1b~0c", "255", "-1", "true", "false", "passage: Text: x y", "ss strasse",
]

# What the gates and the table of weights give for the four queries of SCRIPT_QUERIES.
SCRIPT_ROWS = [
    *(("s1", f, t) for f in ("english", "mix") for t in ("the", "that", "of")), *(("s2", f, t) for f in ("arabic", "english", "urdu", "mix") for t in ("صبر", "der", "und", "the")),
    *(("s3", f, t) for f in ("arabic", "urdu", "mix") for t in ("صبر", "نور")), *(("s4", f, t) for f in ("english", "mix") for t in ("des", "les", "une", "que")),
]
SCRIPT_WEIGHTS = [
    ("s1", "english", "latin", 0.65, 3), ("s1", "mix", "latin", 0.9, 3), ("s2", "arabic", "mixed", 1.0, 4), ("s2", "english", "mixed", 0.65, 4), ("s2", "urdu", "mixed", 0.75, 4), ("s2", "mix", "mixed", 1.0, 4),
    ("s3", "arabic", "arabic", 1.0, 2), ("s3", "urdu", "arabic", 0.75, 2), ("s3", "mix", "arabic", 0.85, 2), ("s4", "english", "latin", 0.65, 4), ("s4", "mix", "latin", 0.9, 4),
]
_own = lambda lang, e: f"CASE WHEN lang = '{lang}' THEN {e} ELSE [] END"
SCRIPT_FIELDS = {
    "arabic": _own("de", terms("text")), "english": _own("en", f"list_filter({terms('text')}, lambda t: t NOT IN {words(QUERY_STOPWORDS)})"), "urdu": _own("fr", terms("text")), "mix": terms("text"),
}

ONTOLOGY = f"""{POST}, {values('trig0', 'topic, lang, token', I.TRIGGERS)}, {values('loc', 'topic, lang, token', R.LOCALIZED)}, {values('vars', 'canonical, variant', I.VARIANTS)}, {values('ent', 'entity, lang, token', R.ENTITIES)},
mg AS (SELECT * FROM trig0 UNION SELECT * FROM loc WHERE topic IN (SELECT topic FROM trig0)), vr AS (SELECT * FROM mg UNION SELECT topic, lang, variant FROM mg JOIN vars ON canonical = token),
ev AS (SELECT topic, 'topic' AS kind, lang, token FROM vr UNION SELECT 'entity_' || entity, 'entity', lang, token FROM ent UNION SELECT 'story_' || entity, 'story', lang, token FROM ent),
ont AS (SELECT DISTINCT topic, kind, lang, token FROM ev JOIN (SELECT DISTINCT lang, token FROM post) USING (lang, token))"""

PHRASE_HITS = f"""{values('ph', 'topic, lang, phrase', R.TOPIC_PHRASES)}, sq AS (SELECT lang, doc_id AS doc, {terms('text')} AS s FROM documents),
ff AS (SELECT topic, lang, doc, phrase, list_reduce(list_prepend('0', phrase), lambda a, p: CASE WHEN a::INT < 0 THEN '-1' WHEN coalesce(list_position(s[a::INT + 1:], p), 0) = 0 THEN '-1'
  WHEN a::INT > 0 AND list_position(s[a::INT + 1:], p) > 3 THEN '-1' ELSE (a::INT + list_position(s[a::INT + 1:], p))::VARCHAR END) AS r FROM sq JOIN ph USING (lang)),
hits AS (SELECT topic, lang, doc, phrase FROM ff WHERE r::INT > 0)"""

GROUP_ROWS = f"""{MATCH}, {values('gr', 'topic, grp, lang, token', R.GROUPS)}, {values('ga', 'topic, grp, major, minor', R.GROUP_ANCHORS)}, {values('an', 'topic, major, minor', I.ANCHORS)},
raw0 AS (SELECT DISTINCT topic, doc FROM post JOIN trig0 USING (lang, token)),
gf AS (SELECT DISTINCT topic, grp, (doc // 50)::INT AS major, (doc % 50)::INT AS minor FROM post JOIN gr USING (lang, token) JOIN raw0 USING (topic, doc)),
gall AS (SELECT DISTINCT topic, grp, major, minor, true AS is_anchor FROM ga UNION ALL SELECT *, false FROM (SELECT * FROM gf EXCEPT SELECT topic, grp, major, minor FROM ga)),
gb AS (SELECT *, row_number() OVER (PARTITION BY topic, grp ORDER BY is_anchor DESC, major, minor) AS place FROM gall),
own AS (SELECT topic, grp, major, minor FROM gf QUALIFY row_number() OVER (PARTITION BY topic, grp ORDER BY major, minor) <= 3),
bare AS (SELECT DISTINCT topic, grp FROM gr EXCEPT SELECT topic, grp FROM own),
lent AS (SELECT topic, grp, major, minor FROM bare JOIN an USING (topic) QUALIFY row_number() OVER (PARTITION BY topic, grp ORDER BY major, minor) <= 3),
fill AS (SELECT * FROM own UNION ALL SELECT * FROM lent)"""

SURFACES = "regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[\\x{600}-\\x{6FF}\\x{750}-\\x{77F}\\x{8A0}-\\x{8FF}]+')"
RULES = [("aa", "a"), ("ee", "i"), ("oo", "u"), ("q", "k"), ("dh", "z"), ("-", " "), ("'", "")]
SEEDS = [*I.SEEDS, ("queen-dhoo", "queen"), ("aa'ee", "x")]

QREL = f"rel AS (SELECT item_id AS qid, doc_id AS doc FROM documents d, benchmark b WHERE contains({norm('d.text')}, {norm('b.text')}))"

ORACLE_SQL = {
    "text_forms": literal("id INT, form VARCHAR, out VARCHAR", *((i, f, out) for i, ((f, _), out) in enumerate(zip(R.TEXT_CASES, FORMS)))),
    "value_forms": literal("id INT, items VARCHAR, limit_ INT, filled VARCHAR, rounded DOUBLE, clock BOOLEAN", (1, "A|b|c", 7, "other", 0.123456, True), (2, "", 0, "x", None, True), (3, "É", 300, "other", 2.0, True)).replace("::INT AS limit_", '::INT AS "limit"'),
    "script_weights": literal("qid VARCHAR, field VARCHAR, script VARCHAR, weight DOUBLE, n_tokens BIGINT", *SCRIPT_WEIGHTS),
    "script_search": "WITH " + bm25(SCRIPT_FIELDS, "SELECT qid, field, token FROM (VALUES " + ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in SCRIPT_ROWS) + ") v(qid, field, token)") + f""",
{values('wt', 'qid, field, weight', [(q, f, w) for q, f, _, w, _ in SCRIPT_WEIGHTS])}, {values('qq', 'qid, qn', R.SCRIPT_QUERIES)},
sl AS (SELECT qid, field, doc, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE score END AS s FROM sc WINDOW w AS (PARTITION BY qid, field)),
bs AS (SELECT qid, doc, round(sum(s * weight::DOUBLE), 6) AS base FROM sl JOIN wt USING (qid, field) GROUP BY 1, 2), cd AS ({top('SELECT * FROM bs', 200, 'base')}),
ds AS (SELECT doc_id AS doc, {norm('text')} AS dn, list_distinct({terms('text')}) AS dt FROM documents),
rr AS (SELECT qid, doc, round(base + 0.18::DOUBLE * (len(list_intersect(string_split(qn, ' '), dt))::DOUBLE / len(string_split(qn, ' '))) + CASE WHEN contains(dn, qn) THEN 0.2::DOUBLE ELSE 0 END, 6) AS score
  FROM cd JOIN qq USING (qid) JOIN ds USING (doc) WHERE base > 0) {top('SELECT * FROM rr', 20)}""",
    "alias_order": f"""WITH {TARGETS}, q(qid, raw) AS (VALUES (1, 'Opening'), (2, ' MIXED '), (3, 'nothing'), (4, 'opening'), (4, 'mixed')),
k AS (SELECT DISTINCT qid, major, minor FROM q JOIN tkeys ON alias = {NORM.format(c='raw')}) SELECT qid, major, minor, (row_number() OVER (PARTITION BY qid ORDER BY major, minor))::INT AS ord FROM k""",
    "ontology": f"WITH {ONTOLOGY} SELECT * FROM ont",
    "phrase_prune": f"WITH {PHRASE_HITS} SELECT DISTINCT topic, lang, array_to_string(phrase, ' ') AS phrase FROM hits",
    "topic_compile": f"""WITH {ONTOLOGY}, {PHRASE_HITS}, {values('neg', 'topic, lang, token', I.NEGATIVES)}, wide AS (SELECT * FROM ont WHERE kind = 'topic' OR lang IN ('de', 'es')),
al AS (SELECT topic, doc FROM post JOIN wide USING (lang, token) UNION SELECT topic, doc FROM hits JOIN (SELECT DISTINCT topic, kind FROM ont) USING (topic) WHERE kind = 'topic' OR lang IN ('de', 'es'))
SELECT * FROM al EXCEPT SELECT topic, doc FROM post JOIN neg USING (lang, token)""",
    "group_build": f"""{GROUP_ROWS} SELECT 'build' AS what, topic, grp AS "group", major, minor, is_anchor FROM gb WHERE is_anchor OR place <= 40 UNION ALL SELECT 'fill', topic, grp, major, minor, NULL FROM fill""",
    "topic_templates": f"""{GROUP_ROWS}, s AS (SELECT topic, grp, string_agg(major || ':' || minor, ',' ORDER BY major, minor) AS k FROM fill WHERE topic = 'insult' GROUP BY 1, 2)
SELECT topic, string_agg(grp || '=' || k, ';' ORDER BY grp) AS sections FROM s GROUP BY 1""",
    "variant_forms": f"""WITH {values('seeds', 'canonical, variant', SEEDS)}, sf AS (SELECT DISTINCT unnest({SURFACES}) AS surface FROM documents), nm AS (SELECT DISTINCT canonical FROM seeds),
m AS (SELECT canonical, surface AS variant FROM nm JOIN sf ON lower(surface) = lower(canonical)),
a AS (SELECT * FROM seeds UNION SELECT * FROM m {' '.join(f"UNION SELECT canonical, replace(canonical, {quote(x)}, {quote(y)}) FROM nm" for x, y in RULES)}),
b AS (SELECT canonical, lower(variant) AS low, min(variant) AS variant FROM (SELECT * FROM seeds WHERE lower(variant) IN (SELECT lower(surface) FROM sf) UNION SELECT * FROM m) WHERE variant <> canonical GROUP BY 1, 2)
SELECT 'rules' AS form, canonical, variant, row_number() OVER (PARTITION BY canonical ORDER BY lower(variant), variant) AS ord FROM a WHERE variant <> canonical AND trim(variant) <> '' QUALIFY ord <= 12
UNION ALL SELECT 'corpus', canonical, variant, row_number() OVER (PARTITION BY canonical ORDER BY low) AS ord FROM b QUALIFY ord <= 16""",
    "grade_coercion": literal("qid VARCHAR, doc VARCHAR, grade DOUBLE", ("1", "2:1", 1.0), ("2", "2:1", 1.0), ("2", "2:2", 1.0), ("3", "2:1", 3.0), ("3", "2:2", 1.0), ("5", "9:9", 0.0)),
    "metric_variants": f"{BASE}, run AS (SELECT qid, doc, rank FROM ({top(LEX, 10)})), {GRADES}" + "".join(f", {metric_ctes('run', k, f'k{k}')}" for k in (1, 3, 5, 10)) + " " + " UNION ALL ".join(
        f"SELECT {k}::INT AS k, qid, round(CASE WHEN relevant > 0 THEN aps / relevant ELSE 0 END, 6) AS ap, round(precision, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN precision + rc > 0 THEN 2 * precision * rc / (precision + rc) ELSE 0 END, 6) AS f1 FROM k{k}c"
        for k in (1, 3, 5, 10)
    ),
    "recall_grid": "WITH " + bm25({"text": terms("text")}, f"SELECT item_id AS qid, 'text' AS field, unnest({terms('text')}) AS token FROM benchmark") + f""", rn AS ({top(LEX, 10)}), {QREL},
f AS (SELECT qid, min(rank) AS first FROM rel LEFT JOIN rn USING (qid, doc) GROUP BY 1)
SELECT count(*) AS n, {", ".join(f"round(avg(coalesce((first <= {k})::INT::DOUBLE, 0)), 6) AS recall_{k}" for k in (1, 3, 5, 10))}, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr FROM f""",
    "metric_getter": literal("id INT, value DOUBLE", (1, 0.5), (2, 0.25), (3, 2.0), (4, 0.0), (5, 0.0)),
    "pack_rules": literal(
        "what VARCHAR, level VARCHAR, code VARCHAR, path VARCHAR", ("compiled", "error", "E_TOPIC_DUP", "t"), ("compiled", "error", "E_TOPIC_ORDER", "t"), ("compiled", "error", "E_TOPIC_UNKNOWN", "u"),
        ("counts", "error", "E_ONLINE_SURAH_VERSECOUNT_MISMATCH", "2"), ("counts", "error", "E_ONLINE_SURAH_VERSECOUNT_MISMATCH", "3"), ("groups", "error", "E_GROUP_EMPTY", "z"), ("pack", "error", "E_PACK_ALIGNMENT", "1"),
        ("pack", "error", "E_PACK_LINES", "rows"), ("pack", "error", "E_PACK_MATRIX_BYTES", "matrix"), ("ranges", "error", "E_ONLINE_JUZ_BOUNDARY_MISMATCH", "2"), ("ranges", "warning", "W_ONLINE_JUZ_MISSING", "3"),
        ("templates", "error", "E_TEMPLATE_DUP", "t/a"), ("templates", "error", "E_TEMPLATE_SECTION_EMPTY", "t/b"), ("topics", "error", "E_TOPIC_DUP", "b"), ("topics", "error", "E_TOPIC_EMPTY", "d"),
        ("topics", "error", "E_TOPIC_TOO_MANY", "a"), ("topics", "error", "E_TOPIC_UNKNOWN", "c"), ("variants", "error", "E_VARIANT_DUP", "x"), ("variants", "error", "E_VARIANT_EMPTY", "w"),
        ("variants", "error", "E_VARIANT_KEY_EMPTY", ""), ("variants", "error", "E_VARIANT_TOO_MANY", "many"),
    ),
    "exit_statuses": literal("what VARCHAR, strict BOOLEAN, status INT", ("clean", False, 0), ("clean", True, 0), ("failed", False, 2), ("failed", True, 2), ("warned", False, 0), ("warned", True, 2)),
    "root_rules": literal("file VARCHAR, level VARCHAR, code VARCHAR", ("list", "error", "E_JSON_ROOT"), ("missing", "error", "E_FILE_NOT_FOUND"), ("no-ranges", "error", "E_MISSING_JUZ"), ("text", "error", "E_JSON_PARSE"), ("types", "error", "E_SURAHS_TYPE")),
    "schema_validation": literal(
        "id INT, code VARCHAR, rule VARCHAR, path VARCHAR", (1, "E_SCHEMA", "minItems", "/topics"), (1, "E_SCHEMA", "minLength", "/schema"), (1, "E_SCHEMA", "minimum", "/version"), (2, "E_SCHEMA", "additionalProperties", "/topics/0"),
        (2, "E_SCHEMA", "pattern", "/topics/0/id"), (2, "E_SCHEMA", "required", "/"), (2, "E_SCHEMA", "type", "/topics/0/keys/2"), (2, "E_SCHEMA", "type", "/topics/1"), (2, "E_SCHEMA", "type", "/version"),
        (2, "E_SCHEMA", "uniqueItems", "/topics/0/keys"), (3, "E_SCHEMA", "type", "/"), (8, "E_JSON_PARSE", "not JSON", "/"),
    ),
    "flat_results": f"""WITH {REFS}, {parse('refs')}, t AS (SELECT (conv_id + 1)::INT AS major, (turn + 1)::INT AS minor, text, role FROM conversations),
h AS (SELECT t.*, confidence FROM parsed p JOIN t ON t.major = p.major AND t.minor BETWEEN p.minor AND coalesce(p.minor_end, p.minor))
SELECT major || ':' || minor AS verse_key, major AS surah, minor AS ayah, '' AS surah_name_arabic, 'S' || major AS surah_name_english, sha256(text) AS arabic, sha256(lower(text)) AS transliteration,
  sha256(CASE WHEN role = 'assistant' AND trim(text) <> '' THEN text ELSE 'own' END) AS translation_en, sha256(CASE WHEN role = 'user' AND trim(text) <> '' THEN text END) AS translation_ur, confidence AS relevance_score, 'structural' AS match_type FROM h""",
    # Queries of other modules whose results are hand-made or need functions that are given here.
    "ref_parse_aliases": literal(
        "qid INT, raw VARCHAR, type VARCHAR, major INT, minor INT, minor_end INT, confidence DOUBLE",
        *(
            (q, raw, *found) for (q, raw), found in zip(I.REFERENCES, [
                ("ref_pair", 2, 3, None, 1.0), ("ref_range_same_surah", 3, 1, 4, 1.0), ("ref_pair", 4, 2, None, 1.0), ("surah_ayah_words", 5, 3, None, 1.0), ("verse_ref_words", 6, 2, None, 1.0),
                ("surah_ayah_words", 7, 1, None, 1.0), ("ref_space_pair", 8, 2, None, 1.0), ("surah_only_number", 9, 1, None, 0.85), (None,) * 5, (None,) * 5, ("ref_range_same_surah", 10, 2, 4, 1.0),
                ("verse_ref_words", 2, 2, None, 1.0), (None,) * 5, (None,) * 5, ("ref_pair", 11, 1, None, 1.0), ("surah_only_number", 114, 1, None, 0.85), (None,) * 5, ("ref_range_same_surah", 12, 3, 5, 1.0),
                ("nickname", 2, 255, None, 1.0), ("surah_name", 1, 1, None, 0.75), ("surah_name", 2, 3, None, 0.75), ("surah_name", 24, 1, None, 0.6), ("surah_name", 24, 1, None, 0.75), (None,) * 5,
            ])
        ),
    ),
    "range_validation": literal("code VARCHAR, path VARCHAR", ("E_JUZ_CONTIGUITY", "ranges[3]"), ("E_JUZ_DUP", "2"), ("E_JUZ_NUM_RANGE", "ranges[9]"), ("E_JUZ_NUM_TYPE", "ranges[x]"), ("E_VERSEKEY_AYAH_RANGE_END", "ranges[3]"), ("E_VERSEKEY_START", "ranges[4]")),
    "half_matrix": "SELECT row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS row, vec_id, 2 * len(embedding) AS n, true AS near FROM embeddings",
    # The pages have no compatibility characters, so composing gives their NFKC.
    "nfkc_fold": f"""WITH p AS (SELECT page_id, nfc_normalize(html) AS raw FROM pages), f AS (SELECT page_id, raw, {folded()} AS f FROM p)
SELECT page_id, sha256(replace(lower(f), 'ß', 'ss')) AS sha, length(raw) AS n FROM f""",
}
