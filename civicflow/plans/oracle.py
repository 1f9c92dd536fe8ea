"""Independent DuckDB SQL for each registered query (the correctness oracle).

Only fixed values (keyword lists, patterns, literal dimension rows and
binding rules) are shared with the Spark side; the logic is written again
in plain SQL. Tables are the pre-registered test views.
"""

from __future__ import annotations

from civicflow.functions.text import (CATEGORY_CIVIL, CATEGORY_CRIMINAL, CRIMINAL_MARK, DEVANAGARI_PATTERN,
                                      HINGLISH_WORDS, LANGUAGES, LAW_RULES, SEVERITY_WORDS, STRIP_PATTERN,
                                      TAMIL_PATTERN, TANGLISH_WORDS, TOKEN_PATTERN, WORD_PATTERN)
from civicflow.plans import inputs
from civicflow.sources.literals import ARTICLES, KB_DESCRIPTION_TEMPLATE, LAW_TEXT, PRACTICE_MAP


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def alt(words: list[str]) -> str:
    return q("|".join(words))


def tag(t: str) -> str:
    return (f"(CASE WHEN regexp_matches({t}, {q(TAMIL_PATTERN)}) THEN 'tamil' "
            f"WHEN regexp_matches({t}, {q(DEVANAGARI_PATTERN)}) THEN 'hindi' "
            f"WHEN regexp_matches(lower({t}), {alt(TANGLISH_WORDS)}) THEN 'tanglish' "
            f"WHEN regexp_matches(lower({t}), {alt(HINGLISH_WORDS)}) THEN 'hinglish' ELSE 'english' END)")


def lawkey(x: str) -> str:
    arms = " ".join(f"WHEN regexp_matches(lower({x}), {alt(subs)}) THEN {q(k)}" for k, subs in LAW_RULES)
    return f"(CASE {arms} ELSE 'general' END)"


def category(x: str) -> str:
    return f"(CASE WHEN contains({x}, {q(CRIMINAL_MARK)}) THEN {q(CATEGORY_CRIMINAL)} ELSE {q(CATEGORY_CIVIL)} END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_PATTERN)}, '', 'g')"


def practice(lk: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PRACTICE_MAP)
    return f"(CASE {lk} {arms} ELSE 'Civil' END)"


def act(p_type: str) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {q(a)}" for t, a in inputs.ACT_BY_PART_TYPE)
    return f"(CASE {p_type} {arms} ELSE {q(inputs.DEFAULT_ACT)} END)"


def md5_bucket(x: str, n: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % {n})"


USER_TURNS = (f"ut AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' "
              f"AND coalesce({strip('text')} <> '', false))")
PART_LAWS = f"laws AS (SELECT p_partkey, {act('p_type')} || ' ' || CAST(p_partkey AS VARCHAR) AS law FROM part)"
_PR = inputs.PRACTICE_BY_SUPPKEY_MOD3
DIRECTORY = (f"dir AS (SELECT s.s_suppkey AS lawyer_id, s.s_name AS name, "
             f"'98' || lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0') AS mobile, n.n_name AS location, "
             f"CASE s.s_suppkey % 3 WHEN 0 THEN {q(_PR[0])} WHEN 1 THEN {q(_PR[1])} ELSE {q(_PR[2])} END "
             f"AS practice_area, CASE WHEN s.s_acctbal < 0 THEN NULL "
             f"ELSE CAST(floor(s.s_acctbal / {inputs.EXPERIENCE_UNIT}) AS DOUBLE) END AS experience_years "
             f"FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey)")
CORPUS = ("cd AS (SELECT doc_id, text, lang, source FROM documents "
          "WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL), "
          "corpus AS (SELECT cd.doc_id, cd.text, cd.lang, cd.source, 'IPC ' || CAST(cd.doc_id AS VARCHAR) AS law "
          "FROM cd JOIN (SELECT min(doc_id) AS doc_id FROM cd GROUP BY sha256(text)) k USING (doc_id))")
PLACES = ("places AS (SELECT lower(location) AS place, min(lawyer_id) AS place_rank FROM dir "
          "WHERE location IS NOT NULL AND location <> '' GROUP BY location)")
BEST = ("best AS (SELECT lower(location) AS place, lawyer_id, experience_years FROM ("
        "SELECT *, row_number() OVER (PARTITION BY lower(location) ORDER BY experience_years DESC NULLS LAST, "
        "lawyer_id) AS rn FROM dir WHERE location IS NOT NULL) WHERE rn = 1)")


def tfidf(p: str, docs: str, doc_id: str, doc_text: str, queries: str, q_id: str, q_text: str) -> str:
    """CTEs {p}ranked(query_id, doc_id, score, rank) for TF-IDF cosine."""
    tok = q(TOKEN_PATTERN)
    return f"""
{p}dtok AS (SELECT {doc_id} AS doc_id, unnest(regexp_extract_all(lower({doc_text}), {tok})) AS term FROM {docs}),
{p}dtf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM {p}dtok GROUP BY doc_id, term),
{p}ndocs AS (SELECT count(*)::DOUBLE AS n FROM {docs}),
{p}vocab AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM {p}dtf, {p}ndocs GROUP BY term, n),
{p}dw AS (SELECT doc_id, term, tf * idf AS w FROM {p}dtf JOIN {p}vocab USING (term)),
{p}dn AS (SELECT dw.doc_id, dw.term, dw.w / nn.nrm AS w FROM {p}dw dw
          JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM {p}dw GROUP BY doc_id) nn USING (doc_id)),
{p}qtok AS (SELECT {q_id} AS query_id, unnest(regexp_extract_all(lower({q_text}), {tok})) AS term FROM {queries}),
{p}qtf AS (SELECT query_id, term, count(*)::DOUBLE AS tf FROM {p}qtok GROUP BY query_id, term),
{p}qw AS (SELECT query_id, term, tf * idf AS w FROM {p}qtf JOIN {p}vocab USING (term)),
{p}qn AS (SELECT qw.query_id, qw.term, qw.w / nn.nrm AS w FROM {p}qw qw
          JOIN (SELECT query_id, sqrt(sum(w * w)) AS nrm FROM {p}qw GROUP BY query_id) nn USING (query_id)),
{p}scores AS (SELECT a.query_id, b.doc_id, sum(a.w * b.w) AS score FROM {p}qn a JOIN {p}dn b USING (term)
              GROUP BY a.query_id, b.doc_id),
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
              FROM {p}scores)"""


def _values(rows: list[tuple], cols: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({cols})"


CASE_TURNS = ("pc AS (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand) AS text FROM part), "
              "cs AS (SELECT c.c_custkey AS k, n.n_name, coalesce(pc.text, 'zzqx yyqx wwqx nothing known') AS example FROM customer c "
              "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN pc ON pc.p_partkey = c.c_custkey), "
              "ut AS (SELECT k AS conv_id, 0 AS turn, 'good morning to you' AS text FROM cs "
              "UNION ALL SELECT k, 1, CASE WHEN k % 5 = 0 THEN 'zzqx yyqx wwqx nothing known' ELSE example END FROM cs "
              "UNION ALL SELECT k, 2, CASE WHEN k % 3 = 0 THEN 'what may I do now' ELSE 'they hurt me please send the police' END FROM cs "
              "UNION ALL SELECT k, 3, CASE WHEN k % 7 = 0 THEN 'I would rather not tell' ELSE 'I live in ' || "
              "coalesce(n_name, 'nowhere') || ' at the moment' END FROM cs UNION ALL SELECT k, 4, 'ok thanks' FROM cs "
              "UNION ALL SELECT k, 5, example FROM cs)")


REPORT = (
    "bl AS (SELECT l AS cls, sum(n) AS support, sum(CASE WHEN l = p THEN n ELSE 0 END) AS tp FROM conf "
    "GROUP BY l), bp AS (SELECT p AS cls, sum(n) AS predicted FROM conf GROUP BY p), "
    "c AS (SELECT coalesce(bl.cls, bp.cls) AS cls, coalesce(support, 0)::DOUBLE AS support, "
    "coalesce(tp, 0)::DOUBLE AS tp, coalesce(predicted, 0)::DOUBLE AS predicted FROM bl "
    "FULL OUTER JOIN bp ON bl.cls = bp.cls), "
    "per AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr, "
    "CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM c), "
    "per2 AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f FROM per), "
    "tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(pr) AS mp, avg(rc) AS mr, avg(f) AS mf, "
    "sum(pr * support) AS wp, sum(rc * support) AS wr, sum(f * support) AS wf FROM per2) "
    "SELECT CAST(cls AS VARCHAR) AS class_name, round(pr, 6) AS precision, round(rc, 6) AS recall, "
    "round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM per2 "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, 6), CAST(n AS BIGINT) FROM tot "
    "UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM tot "
    "UNION ALL SELECT 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), "
    "CAST(n AS BIGINT) FROM tot")


def _dialogue_sql(turns: str = USER_TURNS, corpus: str = "", law: str = "'IPC ' || CAST(t.hit_doc AS VARCHAR)") -> str:
    w_short = f"len(regexp_extract_all(f.text, {q(WORD_PATTERN)})) <= 2"
    nxt_stage = ("(CASE WHEN s = 3 OR short THEN 0 WHEN s = 0 THEN (CASE WHEN legal THEN 1 ELSE 0 END) "
                 "WHEN s = 1 THEN (CASE WHEN severe THEN 2 ELSE 0 END) ELSE 0 END)")
    sets_law = "(NOT (s = 3 OR short) AND s = 0 AND legal)"
    names = "['investigating', 'followup', 'location', 'start']"
    blocks = " ".join(f"WHEN {q(b)} THEN {q(blk)}" for b, blk in
                      [("greet", "greeting"), ("emotional", "empathy_pure"), ("legal", "empathy_legal"),
                       ("ask_location", "ask_location"), ("actions", "actions"), ("lawyer", "lawyer_title"),
                       ("no_lawyer", "no_lawyer_found"), ("no_corpus", "share_more")])
    return f"""WITH RECURSIVE {turns}, {corpus or CORPUS}, {DIRECTORY}, {PLACES}, {BEST},
uq AS (SELECT conv_id * 1000003 + turn AS qid, text FROM ut),
{tfidf('i_', 'corpus', 'doc_id', 'text', 'uq', 'qid', 'text')},
top1 AS (SELECT query_id, doc_id AS hit_doc, score FROM i_ranked WHERE rank = 1),
sess AS (SELECT conv_id, {tag('arg_min(text, turn)')} AS lang FROM ut GROUP BY conv_id),
feat AS (SELECT f.conv_id, f.turn, f.text, round(coalesce(t.score, 0.0), 6) AS score, t.hit_doc,
         CASE WHEN t.hit_doc IS NULL THEN NULL ELSE {lawkey(law)} END AS hit_law,
         {w_short} AS short, round(coalesce(t.score, 0.0), 6) > 0.45 AS legal,
         coalesce(regexp_matches(lower(f.text), {alt(SEVERITY_WORDS)}), false) AS severe,
         row_number() OVER (PARTITION BY f.conv_id ORDER BY f.turn) AS rn
         FROM ut f LEFT JOIN top1 t ON t.query_id = f.conv_id * 1000003 + f.turn),
fsm(conv_id, rn, s, law_in) AS (
  SELECT conv_id, rn, 3, NULL::VARCHAR FROM feat WHERE rn = 1
  UNION ALL
  SELECT f.conv_id, f.rn,
         (SELECT {nxt_stage} FROM (SELECT p.s AS s, prev.short AS short, prev.legal AS legal, prev.severe AS severe)),
         CASE WHEN NOT (p.s = 3 OR prev.short) AND p.s = 0 AND prev.legal THEN prev.hit_law ELSE p.law_in END
  FROM fsm p JOIN feat prev ON prev.conv_id = p.conv_id AND prev.rn = p.rn
             JOIN feat f ON f.conv_id = p.conv_id AND f.rn = p.rn + 1),
rep AS (SELECT f.*, x.s, x.law_in, sess.lang,
        CASE WHEN x.s = 3 OR f.short THEN 'greet'
             WHEN x.s = 0 THEN (CASE WHEN f.legal THEN 'legal' ELSE 'emotional' END)
             WHEN x.s = 1 THEN (CASE WHEN f.severe THEN 'ask_location' ELSE 'actions' END)
             ELSE 'location' END AS branch0
        FROM feat f JOIN fsm x ON x.conv_id = f.conv_id AND x.rn = f.rn JOIN sess ON sess.conv_id = f.conv_id),
rep2 AS (SELECT *, (SELECT {nxt_stage} FROM (SELECT rep.s AS s, rep.short AS short, rep.legal AS legal,
                                                   rep.severe AS severe)) AS s_out,
         (SELECT {sets_law} FROM (SELECT rep.s AS s, rep.short AS short, rep.legal AS legal)) AS sets
         FROM rep),
loc AS (SELECT r.conv_id, r.turn, r.text, r.law_in,
        (SELECT arg_min(p.place, p.place_rank) FROM places p WHERE contains(lower(r.text), p.place)) AS place
        FROM rep2 r WHERE r.branch0 = 'location'),
locq AS (SELECT loc.*, conv_id * 1000003 + turn AS qid,
         coalesce(place, {strip('text')}) || ' ' || {practice("coalesce(law_in, 'general')")} AS qtext FROM loc),
prof AS (SELECT lawyer_id, coalesce(location, '') || ' ' || coalesce(practice_area, '') AS profile FROM dir),
{tfidf('r_', 'prof', 'lawyer_id', 'profile', 'locq', 'qid', 'qtext')},
res AS (SELECT l.conv_id, l.turn, l.place, coalesce(rk.doc_id, b.lawyer_id) AS lawyer_id,
        CASE WHEN rk.doc_id IS NOT NULL THEN 'recommender' WHEN b.lawyer_id IS NOT NULL THEN 'location_filter' END
          AS match_kind
        FROM locq l LEFT JOIN r_ranked rk ON rk.query_id = l.qid AND rk.rank = 1
        LEFT JOIN best b ON b.place = l.place),
fin AS (SELECT r.conv_id, r.turn, r.lang, list_extract({names}, r.s + 1) AS stage_in,
        CASE WHEN r.branch0 <> 'location' THEN r.branch0 WHEN res.lawyer_id IS NOT NULL THEN 'lawyer'
             ELSE 'no_lawyer' END AS branch,
        list_extract({names}, r.s_out + 1) AS stage_out,
        CASE WHEN r.sets THEN r.hit_law ELSE coalesce(r.law_in, 'general') END AS law_key,
        r.score, r.hit_doc, res.place, res.lawyer_id, res.match_kind,
        {md5_bucket("CAST(r.conv_id AS VARCHAR) || ':' || CAST(r.turn AS VARCHAR)", 1 << 30)} AS variant_key
        FROM rep2 r LEFT JOIN res ON res.conv_id = r.conv_id AND res.turn = r.turn)
"""


def _dialogue_select() -> str:
    blocks = " ".join(f"WHEN {q(b)} THEN {q(blk)}" for b, blk in
                      [("greet", "greeting"), ("emotional", "empathy_pure"), ("legal", "empathy_legal"),
                       ("ask_location", "ask_location"), ("actions", "actions"), ("lawyer", "lawyer_title"),
                       ("no_lawyer", "no_lawyer_found"), ("no_corpus", "share_more")])
    return (f"SELECT conv_id, turn, lang, stage_in, branch, stage_out, law_key, score, hit_doc, place, lawyer_id, "
            f"match_kind, CASE branch {blocks} END AS reply_block, variant_key FROM fin")


def oracle_sql() -> dict[str, str]:
    lt_values = _values(LAW_TEXT, "law_key, lang, law_text")
    articles = [(-(i + 1), c, t, d, t.lower()) for i, (c, t, d) in enumerate(ARTICLES)]
    langs = "[" + ", ".join(q(x) for x in LANGUAGES) + "]"
    search_terms = ", ".join(f"({q(x)})" for x in inputs.SEARCH_TERMS)
    k_json = "json_extract_string(props, '$.k')"
    n_brands = inputs.QUIZ_ANSWER_BRANDS
    feedback = (f"subs AS (SELECT event_id AS submission_id, user_id, {k_json} AS k, value FROM events "
                f"WHERE event_type = 'purchase'), "
                f"ans AS (SELECT submission_id, user_id, k AS qid, chr(9) || 'brand#' || "
                f"CAST(((CAST(floor(value) AS BIGINT) % {n_brands}) + {n_brands}) % {n_brands} + 1 AS VARCHAR) "
                f"|| ' ' AS answer FROM subs UNION ALL SELECT submission_id, user_id, 'bonus', 'x' FROM subs), "
                f"fb AS (SELECT a.submission_id, a.user_id, p.p_partkey AS question_id, "
                f"coalesce(lower({strip('p.p_brand')}) = lower({strip('a.answer')}), false) AS correct "
                f"FROM ans a JOIN part p ON TRY_CAST(a.qid AS BIGINT) = p.p_partkey)")
    tfr = tfidf("t_", "prof", "lawyer_id", "profile", "cq", "c_custkey", "qtext")
    cust_law = lawkey("'IPC ' || CAST(c.c_custkey AS VARCHAR)")
    gov = "lpad(CAST(c_custkey * 7919 % 1000000000000 AS VARCHAR), 12, '0')"
    reg = (f"r AS (SELECT event_id, user_id, '9' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS mobile, "
           f"CASE WHEN value >= {inputs.MISSING_PASSWORD_VALUE} THEN NULL ELSE 'pw' || CAST(user_id AS VARCHAR) END "
           f"AS password, CASE WHEN value < {inputs.SHORT_ID_VALUE} THEN lpad(CAST(event_id AS VARCHAR), 11, '0') "
           f"ELSE ' ' || lpad(CAST(event_id AS VARCHAR), 12, '0') || ' ' END AS gov_id "
           f"FROM events WHERE event_type = 'signup')")
    blank = lambda c: f"coalesce({strip(c)} = '', true)"
    quiz = (f"quiz AS (SELECT p_partkey AS id, 'Which brand makes the ' || p_name || ' (part ' || "
            f"CAST(p_partkey AS VARCHAR) || ')?' AS question, CASE WHEN p_size < 3 THEN NULL WHEN p_size < 5 "
            f"THEN '' ELSE '[\"' || p_brand || '\", \"' || p_type || '\"]' END AS options, p_type AS category, "
            f"CASE WHEN p_size % 2 = 0 THEN 'MCQ' ELSE 'True/False' END AS type FROM part)")
    emb = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
    pairs = ("p AS (SELECT a.vec_id, b.vec_id AS hit_id, list_cosine_similarity(a.v, b.v) AS score, "
             "b.label AS hit_label FROM e a JOIN e b ON a.vec_id <> b.vec_id), "
             "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, hit_id) AS rk "
             "FROM p)")
    sql = {
        "language_tag_counts": f"SELECT {tag('text')} AS language_tag, lang, CAST(count(*) AS BIGINT) AS n_docs "
                               f"FROM documents GROUP BY 1, 2",
        "session_language": f"WITH {USER_TURNS}, f AS (SELECT conv_id, arg_min(text, turn) AS ft FROM ut "
                            f"GROUP BY conv_id) SELECT ut.conv_id, ut.turn, {tag('ut.text')} AS turn_language, "
                            f"{tag('f.ft')} AS session_language FROM ut JOIN f USING (conv_id)",
        "clean_corpus": f"WITH {CORPUS} SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM corpus",
        "directory_fill": f"WITH {DIRECTORY} SELECT lawyer_id, coalesce(name, '') AS name, "
                          f"coalesce(mobile, '') AS mobile, coalesce(location, '') AS location, "
                          f"coalesce(practice_area, '') AS practice_area, experience_years, "
                          f"coalesce(location, '') || ' ' || coalesce(practice_area, '') AS profile_text FROM dir",
        "label_index": "SELECT source AS label, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) "
                       "AS label_id, min(doc_id) AS first_doc_id, CAST(count(*) AS BIGINT) AS n_docs "
                       "FROM documents WHERE source IS NOT NULL GROUP BY source",
        "law_mapping_counts": f"WITH {PART_LAWS} SELECT {lawkey('law')} AS law_key, {category('law')} AS category, "
                              f"CAST(count(*) AS BIGINT) AS n_laws FROM laws GROUP BY 1, 2",
        "knowledge_base_build": (
            f"WITH {PART_LAWS}, f AS (SELECT law, min(p_partkey) AS kb_id FROM laws WHERE law IS NOT NULL "
            f"GROUP BY law) SELECT CAST(kb_id AS BIGINT) AS kb_id, {category('law')} AS category, law AS title, "
            f"{q(KB_DESCRIPTION_TEMPLATE.split('%s')[0])} || law || {q(KB_DESCRIPTION_TEMPLATE.split('%s')[1])} "
            f"AS description, lower(law) AS keywords FROM f UNION ALL "
            f"SELECT CAST(kb_id AS BIGINT), category, title, description, keywords FROM "
            f"{_values(articles, 'kb_id, category, title, description, keywords')}"),
        "knowledge_search": (
            f"WITH qs AS (SELECT DISTINCT lower(x) AS query FROM (VALUES {search_terms}) AS v(x) "
            f"WHERE lower(x) <> '') SELECT qs.query, p.p_partkey AS kb_id, p.p_name AS title FROM part p JOIN qs ON "
            f"(coalesce(p.p_name ILIKE '%' || qs.query || '%', false) OR "
            f"coalesce(p.p_type ILIKE '%' || qs.query || '%', false) OR "
            f"coalesce(lower(p.p_brand) ILIKE '%' || qs.query || '%', false))"),
        "law_text_lookup": (
            f"WITH {PART_LAWS}, k AS (SELECT p_partkey AS law_id, {lawkey('law')} AS law_key, "
            f"list_extract({langs}, CAST(p_partkey % 5 AS INTEGER) + 1) AS lang FROM laws), "
            f"lt AS (SELECT * FROM {lt_values}) "
            f"SELECT k.law_id, k.law_key, k.lang, coalesce(a.law_text, b.law_text, c.law_text, d.law_text) "
            f"AS law_text, {practice('k.law_key')} AS practice_area FROM k "
            f"LEFT JOIN lt a ON a.law_key = k.law_key AND a.lang = k.lang "
            f"LEFT JOIN lt b ON b.law_key = k.law_key AND b.lang = 'english' "
            f"LEFT JOIN lt c ON c.law_key = 'general' AND c.lang = k.lang "
            f"LEFT JOIN lt d ON d.law_key = 'general' AND d.lang = 'english'"),
        "location_detect": (
            f"WITH {DIRECTORY}, {PLACES}, texts AS (SELECT c.c_custkey, lower(concat_ws(' ', c.c_name, 'lives in', "
            f"n.n_name, 'and works in', c.c_mktsegment)) AS t FROM customer c LEFT JOIN nation n "
            f"ON c.c_nationkey = n.n_nationkey), hits AS (SELECT c_custkey, arg_min(place, place_rank) AS place, "
            f"min(place_rank) AS place_rank FROM texts JOIN places ON contains(t, place) GROUP BY c_custkey) "
            f"SELECT texts.c_custkey, hits.place, hits.place_rank FROM texts LEFT JOIN hits USING (c_custkey)"),
        "best_in_location": (
            f"WITH {DIRECTORY}, {BEST} SELECT c.c_custkey, b.lawyer_id, b.experience_years FROM customer c "
            f"LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN best b ON b.place = lower(n.n_name)"),
        "tfidf_recommend": (
            f"WITH {DIRECTORY}, prof AS (SELECT lawyer_id, coalesce(location, '') || ' ' || "
            f"coalesce(practice_area, '') AS profile FROM dir), cq AS (SELECT c.c_custkey, coalesce(n.n_name, '') "
            f"|| ' ' || {practice(cust_law)} AS qtext FROM customer c LEFT JOIN nation n "
            f"ON c.c_nationkey = n.n_nationkey), {tfr} SELECT query_id AS c_custkey, CAST(rank AS BIGINT) AS rank, "
            f"doc_id AS lawyer_id, round(score, 6) AS score FROM t_ranked WHERE rank <= 5"),
        "semantic_top1": (
            f"WITH {emb}, {pairs} SELECT r.vec_id, r.hit_id, round(r.score, 6) AS score, "
            f"round(r.score, 6) > 0.45 AS is_legal, r.hit_label, d.lang AS hit_lang FROM r "
            f"LEFT JOIN documents d ON d.doc_id = r.hit_id WHERE r.rk = 1"),
        "semantic_topk_label_vote": (
            f"WITH {emb}, {pairs}, v AS (SELECT vec_id, hit_label, count(*) AS votes, min(rk) AS best FROM r "
            f"WHERE rk <= 5 GROUP BY vec_id, hit_label), w AS (SELECT *, row_number() OVER (PARTITION BY vec_id "
            f"ORDER BY votes DESC, best) AS o FROM v) SELECT w.vec_id, w.hit_label AS predicted_label, "
            f"CAST(w.votes AS BIGINT) AS votes, e.label, w.hit_label = e.label AS correct FROM w "
            f"JOIN e ON e.vec_id = w.vec_id WHERE o = 1"),
        "embedding_cache_delta": (
            "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), cached AS (SELECT DISTINCT "
            "sha256(d.text) AS h FROM embeddings e JOIN d ON e.vec_id = d.doc_id) SELECT sha256(text) AS "
            "text_sha256, min(doc_id) AS doc_id FROM d WHERE sha256(text) NOT IN (SELECT h FROM cached) GROUP BY 1"),
        "severity_keyword": (
            f"WITH {USER_TURNS} SELECT conv_id, turn, coalesce(regexp_matches(lower(text), {alt(SEVERITY_WORDS)}), "
            f"false) AS is_severe FROM ut"),
        "holdout_split": (
            f"SELECT doc_id, {md5_bucket('CAST(doc_id AS VARCHAR)', 10)} AS bucket, CASE WHEN "
            f"{md5_bucket('CAST(doc_id AS VARCHAR)', 10)} = 0 THEN 'validation' ELSE 'train' END AS split "
            f"FROM documents"),
        "quiz_grade": (f"WITH {feedback} SELECT submission_id, user_id, question_id, correct, "
                       f"CAST(CASE WHEN correct THEN 10 ELSE 0 END AS BIGINT) AS points FROM fb"),
        "quiz_sample": (
            f"WITH {quiz}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY "
            f"md5(CAST(id AS VARCHAR) || ':' || {q(inputs.QUIZ_SEED_TEXT)}), id) AS rank FROM quiz) "
            f"SELECT category, id, question, CAST(CASE WHEN options IS NULL OR options = '' THEN 0 ELSE "
            f"json_array_length(options) END AS INTEGER) AS n_options, type, CAST(rank AS BIGINT) AS rank "
            f"FROM r WHERE rank <= 2"),
        "progress_counters": (
            f"WITH {feedback}, cnt AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS av, "
            f"sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS tc, "
            f"sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS cu FROM events GROUP BY user_id), "
            f"pts AS (SELECT user_id, sum(CASE WHEN correct THEN 10 ELSE 0 END) AS qs FROM fb GROUP BY user_id) "
            f"SELECT c.c_custkey AS user_id, CAST(coalesce(cnt.av, 0) AS BIGINT) AS articles_viewed, "
            f"CAST(coalesce(cnt.tc, 0) AS BIGINT) AS topics_completed, "
            f"CAST(coalesce(cnt.cu, 0) AS BIGINT) AS chatbot_usage_count, "
            f"CAST(coalesce(pts.qs, 0) AS BIGINT) AS quiz_score FROM customer c "
            f"LEFT JOIN cnt ON cnt.user_id = c.c_custkey LEFT JOIN pts ON pts.user_id = c.c_custkey"),
        "user_upsert": (
            f"WITH {reg}, pre AS (SELECT *, CASE WHEN {blank('mobile')} OR {blank('password')} OR {blank('gov_id')} "
            f"THEN 'missing_field' WHEN NOT coalesce(regexp_matches({strip('gov_id')}, '^\\p{{Nd}}{{12}}$'), false) "
            f"THEN 'invalid_id' END AS pre FROM r), known AS (SELECT DISTINCT '9' || lpad(CAST(c_custkey AS VARCHAR), "
            f"9, '0') AS mobile FROM customer WHERE c_mktsegment = {q(inputs.EXISTING_USER_SEGMENT)}), "
            f"firsts AS (SELECT mobile, min(event_id) AS fe FROM pre WHERE pre IS NULL GROUP BY mobile) "
            f"SELECT p.event_id, p.user_id, p.mobile, CASE WHEN p.pre IS NOT NULL THEN p.pre "
            f"WHEN k.mobile IS NOT NULL THEN 'already_exists' WHEN p.event_id = f.fe THEN 'inserted' "
            f"ELSE 'already_exists' END AS status FROM pre p LEFT JOIN known k ON k.mobile = p.mobile "
            f"LEFT JOIN firsts f ON f.mobile = p.mobile"),
        "protect_identifiers": (
            f"SELECT c_custkey, sha256(c_name) AS name_sha256, coalesce(regexp_matches({strip(gov)}, "
            f"'^\\p{{Nd}}{{12}}$'), false) AS gov_id_valid, true AS roundtrip_ok, true AS tamper_rejected "
            f"FROM customer"),
        "chat_history_join": (
            "SELECT e.event_id, e.user_id, c.c_name AS user_name, CAST(e.ts AS DATE) AS dt FROM events e "
            "LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'click'"),
        "classification_report": "WITH conf AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), " + REPORT,
        "prediction_report": (
            f"WITH {emb}, {pairs}, v AS (SELECT vec_id, hit_label, count(*) AS votes FROM r WHERE rk <= 5 GROUP BY vec_id, hit_label), "
            f"w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, hit_label) AS o, "
            f"sum(votes) OVER (PARTITION BY vec_id) AS total FROM v), "
            f"pr AS (SELECT e.vec_id, e.label, w.hit_label AS p, coalesce(o.votes, 0) / w.total AS share FROM e JOIN w ON w.vec_id = e.vec_id "
            f"AND w.o = 1 LEFT JOIN v o ON o.vec_id = e.vec_id AND o.hit_label = e.label WHERE e.label IS NOT NULL), "
            f"conf AS (SELECT label AS l, p, count(*) AS n FROM pr GROUP BY ALL), " + REPORT + " UNION ALL SELECT 'log loss', NULL, NULL, "
            f"round(avg(-ln(greatest(share, 1e-15))), 6), CAST(count(*) AS BIGINT) FROM pr"),
        "vector_cache_growth": (
            "WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) SELECT sha256(text) AS text_sha256, "
            f"1::BIGINT AS n_rows, CASE WHEN len(regexp_extract_all(lower(text), {q(TOKEN_PATTERN)})) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE "
            "AS norm FROM t"),
        "saved_index_growth": (
            f"WITH {CORPUS}, nq AS (SELECT 0 AS qid, '' AS text), {tfidf('t_', 'corpus', 'doc_id', 'text', 'nq', 'qid', 'text')} "
            f"SELECT term, CAST(count(*) AS BIGINT) AS n_docs, round(any_value(idf), 9) AS idf, round(sum(w), 4) AS weight "
            f"FROM t_dw JOIN t_vocab USING (term) GROUP BY term"),
        "stream_triage": _dialogue_sql() + _dialogue_select(),
        "registered_users": (
            f"WITH {reg}, ok AS (SELECT * FROM r WHERE NOT ({blank('mobile')} OR {blank('password')} OR {blank('gov_id')}) "
            f"AND coalesce(regexp_matches({strip('gov_id')}, '^\\p{{Nd}}{{12}}$'), false)), known AS (SELECT DISTINCT '9' || "
            f"lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS mobile FROM customer WHERE c_mktsegment = {q(inputs.EXISTING_USER_SEGMENT)}), "
            f"firsts AS (SELECT mobile, min(event_id) AS event_id FROM ok WHERE mobile NOT IN (SELECT mobile FROM known) GROUP BY mobile) "
            f"SELECT ok.user_id, ok.mobile, ok.event_id, sha256(password) AS password_hash, {strip('gov_id')} AS gov_id, 3 AS key_version, "
            f"'Street ' || CAST(ok.user_id AS VARCHAR) AS address, CAST(ok.user_id % 60 + 18 AS INTEGER) AS age, "
            f"strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS created_at, 0::BIGINT AS articles_viewed, 0::BIGINT AS topics_completed, "
            f"0::BIGINT AS chatbot_usage_count, 0::BIGINT AS quiz_score FROM ok JOIN firsts USING (event_id) "
            f"JOIN events e ON e.event_id = ok.event_id"),
        "dialogue_cases": _dialogue_sql(
            CASE_TURNS, f"corpus AS (SELECT p_partkey AS doc_id, text FROM pc), laws AS (SELECT p_partkey, {act('p_type')} || ' ' || "
            f"CAST(p_partkey AS VARCHAR) AS law FROM part)", "(SELECT law FROM laws WHERE p_partkey = t.hit_doc)") + _dialogue_select(),
        "dialogue_replay": _dialogue_sql() + _dialogue_select(),
        "dialogue_branch_counts": (_dialogue_sql() + "SELECT branch, lang, CAST(count(*) AS BIGINT) AS n_turns "
                                   "FROM fin GROUP BY branch, lang"),
    }
    sql["stream_progress"] = sql["progress_counters"]  # the same counters, whichever way they are kept
    sql["knowledge_seed"] = sql["knowledge_base_build"]
    return sql
