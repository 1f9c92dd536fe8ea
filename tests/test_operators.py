"""Operators vs brute force / hand-computed expectations."""
import math
import os
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F

from civicflow.operators import containment, engagement, knowledge, registry, report, tfidf
from civicflow.operators.common import keep_first, top_k_per_group
from civicflow.operators.lookup import with_law_text, with_practice_area, with_reply_variants
from civicflow.operators.vectors import cache_delta, knn_top_k
from civicflow.sources import readers


def test_keep_first_hot_key(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(7)
    got = sorted(r.row_id for r in keep_first(df, F.col("text"), "row_id").collect())
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == sorted(first.values())


def test_top_k_per_group_ties_by_id(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("b", 4, 1.0)], "g string, id long, v double")
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id").asc()], 2)
    assert sorted((r.g, r.id, r["rank"]) for r in got.collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 4, 1)]


PLACES = [(0, "nation_1"), (1, "nation_12"), (2, "delhi"), (3, "new-delhi")]
TEXTS = ["i live in nation_12", "moved from new-delhi", "nowhere", None, "delhi and nation_1"]


def _first_contained_python(t):
    if t is None:
        return None
    for rank, p in PLACES:
        if p in t:
            return p
    return None


def test_first_contained_broadcast_and_chunked_agree(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    places = spark.createDataFrame(PLACES, "rank long, place string")
    want = {i: _first_contained_python(t) for i, t in enumerate(TEXTS)}
    for max_b in (100, 1):  # 1 forces the path by q-gram index
        out = containment.first_contained(texts, F.col("t"), places, "place", "rank", "place", "place_rank",
                                          ["id"], max_broadcast=max_b, salt=3)
        assert {r.id: r.place for r in out.collect()} == want


def test_search_wildcards_nulls_and_chunks(spark):
    kb = spark.createDataFrame([(1, "Article 14", "Equality before the law.", None),
                                (2, "IPC 354", "Assault 100%", "ipc 354"),
                                (3, "Back\\slash", "x_y", "k")],
                               "kb_id long, title string, description string, keywords string")
    qs = spark.createDataFrame([("ARTICLE",), ("ipc 3_4",), ("100%",), ("back\\s",), ("",), ("zzz",)], "query string")
    want = {("article", 1), ("ipc 3_4", 2), ("100%", 2), ("back\\s", 3)}
    for max_b in (100, 1):
        got = knowledge.search(kb.where("true"), qs) if max_b == 100 else \
            containment.search_hits(kb, ["title", "description", "keywords"], qs, "query", salt=2)
        assert {(r.query, r.kb_id) for r in got.collect()} == want


def test_containment_matches_brute_force_on_random_texts(spark):
    import random
    rng = random.Random(3)
    letters = "abAB é\U0001f600_%\\."
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    texts = [(i, None if i % 17 == 0 else word(30), None if i % 5 else word(12)) for i in range(150)]
    pats = sorted({word(4) for _ in range(60)} | {"", "a", "%", "_", "%%", "a%b", "é", "\U0001f600"})
    df = spark.createDataFrame(texts, "id long, t string, u string")
    ranks = spark.createDataFrame([(k * 7 % 61, p) for k, p in enumerate(pats)], "rank int, place string")
    for chosen in (pats, [p for p in pats if len(p) > 1]):
        some = ranks.where(F.col("place").isin(chosen))
        known = [(r["rank"], r["place"]) for r in some.collect()]
        want = {i: min(((r, p) for r, p in known if t is not None and p in t), default=(None, None)) for i, t, _ in texts}
        for bound in (1000, 1):
            out = containment.first_contained(df, F.col("t"), some, "place", "rank", "p", "r", ["id"], max_broadcast=bound, salt=2)
            assert {x["id"]: (x["r"], x["p"]) for x in out.collect()} == want
            assert out.schema["r"].dataType == some.schema["rank"].dataType
    qs = spark.createDataFrame([(p,) for p in pats], "q string")
    like = lambda q: re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in q.lower()), re.S)
    got = containment.search_hits(df, ["t", "u"], qs, "q", salt=3)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    want = {(q.lower(), i) for q in pats if q for i, t, u in texts if any(x is not None and like(q).search(x.lower()) for x in (t, u))}
    assert {(x["query"], x["id"]) for x in got.collect()} == want
    assert containment.search_hits(df, ["t"], qs.limit(0), "q").count() == 0 and containment.search_hits(df.limit(0), ["t"], qs, "q").count() == 0


def _sk_like_tfidf(docs, queries):
    tok = lambda s: re.findall(r"(?u)\b\w\w+\b", s.lower())
    vocab = sorted({t for d in docs for t in tok(d)})
    ix = {t: i for i, t in enumerate(vocab)}
    n = len(docs)
    df = np.zeros(len(vocab))
    for d in docs:
        for t in set(tok(d)):
            df[ix[t]] += 1
    idf = np.log((1 + n) / (1 + df)) + 1

    def vec(s):
        v = np.zeros(len(vocab))
        for t in tok(s):
            if t in ix:
                v[ix[t]] += 1
        v *= idf
        nrm = np.linalg.norm(v)
        return v / nrm if nrm else v
    D = np.array([vec(d) for d in docs])
    return np.array([vec(q) for q in queries]) @ D.T


def test_tfidf_blocked_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30
    docs = [" ".join(rng.choice(words, size=rng.integers(3, 40))) for _ in range(60)]
    queries = [" ".join(rng.choice(words, size=rng.integers(1, 8))) for _ in range(25)] + ["nothing shared"]
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    qdf = spark.createDataFrame(list(enumerate(queries)), "qid long, text string")
    idx = tfidf.build_index(ddf, "doc_id", "text")
    S = _sk_like_tfidf(docs, queries)
    saved = (tfidf.MAX_DOC_BLOCK, tfidf.MAX_QUERY_BLOCK, tfidf.SLICE_ENTRIES)
    for blocks in (None, 5):
        if blocks:  # many blocks, and several slices per block
            tfidf.MAX_DOC_BLOCK, tfidf.MAX_QUERY_BLOCK, tfidf.SLICE_ENTRIES = 13, 7, 20
        try:
            got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in tfidf.search(idx, qdf, "qid", "text", k=3).collect()}
        finally:
            tfidf.MAX_DOC_BLOCK, tfidf.MAX_QUERY_BLOCK, tfidf.SLICE_ENTRIES = saved
        for q in range(len(queries)):
            order = sorted([d for d in range(len(docs)) if S[q, d] > 0], key=lambda d: (-round(S[q, d], 9), d))[:3]
            for r, d in enumerate(order, start=1):
                assert got[(q, r)][0] == d and math.isclose(got[(q, r)][1], S[q, d], abs_tol=1e-9)
            assert (q, len(order) + 1) not in got
    # the plain join form agrees too
    pairs = {(r.query_id, r.doc_id): r.score for r in
             tfidf.cosine_scores(idx, tfidf.transform_queries(idx, qdf, "qid", "text")).collect()}
    for (q, d), s in pairs.items():
        assert math.isclose(s, S[q, d], abs_tol=1e-9)


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(50, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, v array<float>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in
           knn_top_k(df, "id", "v", df, "id", "v", k=3, exclude_self=True, q_blocks=3, c_blocks=2).collect()}
    m = vecs.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    for q in range(50):
        order = sorted(range(50), key=lambda d: (-round(s[q, d], 9), d))[:3]
        assert [got[(q, r)] for r in (1, 2, 3)] == order


def test_cache_delta_idempotent(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, text string")
    cached = spark.createDataFrame([("b",)], "t string").select(F.sha2("t", 256).alias("text_sha256"))
    delta = cache_delta(corpus, "id", "text", cached)
    assert sorted(r.id for r in delta.collect()) == [1, 4]
    again = cache_delta(corpus, "id", "text", cached.unionByName(delta.select("text_sha256")))
    assert again.count() == 0


def test_registration_status(spark):
    reqs = spark.createDataFrame([
        (1, 1, "900", "pw", "123456789012"), (2, 2, "901", "pw", " 123456789012 "), (3, 2, "901", "pw", "123456789012"),
        (4, 3, "902", None, "123456789012"), (5, 4, "903", "pw", "12345"), (6, 5, "904", "pw", "१२३४५६७८९०१२")],
        "event_id long, user_id long, mobile string, password string, gov_id string")
    existing = spark.createDataFrame([(9, "900")], "user_id long, mobile string")
    got = {r.event_id: r.status for r in registry.registration_status(reqs, existing).collect()}
    assert got == {1: "already_exists", 2: "inserted", 3: "already_exists", 4: "missing_field",
                   5: "invalid_id", 6: "inserted"}


def test_protect_roundtrip(spark):
    df = spark.createDataFrame([(1, "alice", "123456789012")], "id long, name string, gov string")
    r = registry.protect(df, spark, "gov", "gov", ["name"]).first()
    assert r.roundtrip_ok and r.tamper_rejected and r.gov_valid
    assert r.name_sha256 == "2bd806c97f0e00af1a1fc3328fa763a9269723c8db8fac4f93af71db186d6e90"


def test_quiz_grading(spark):
    quiz = spark.createDataFrame([(1, "Article 14", "e1"), (2, "POSH Act", None)],
                                 "id long, correct_answer string, explanation string")
    subs = spark.createDataFrame([(10, 7, {"1": "  article 14\t", "2": "posh", "x": "?", "99": "a"}),
                                  (11, 7, {}), (12, 8, {"2": "POSH ACT"})],
                                 "submission_id long, user_id long, answers map<string,string>")
    fb = engagement.grade_submissions(subs, quiz)
    got = sorted((r.submission_id, r.question_id, r.correct, r.points) for r in fb.collect())
    assert got == [(10, 1, True, 10), (10, 2, False, 0), (12, 2, True, 10)]
    scores = {r.submission_id: r.score for r in engagement.submission_scores(subs, fb).collect()}
    assert scores == {10: 10, 11: 0, 12: 10}
    users = spark.createDataFrame([(7,), (8,), (9,)], "user_id long")
    act = spark.createDataFrame([(7, "search"), (7, "quiz"), (7, "quiz"), (8, "chat"), (8, "quiz")],
                                "user_id long, kind string")
    prog = {r.user_id: tuple(r)[1:] for r in engagement.progress_counters(
        users, act, engagement.submission_scores(subs, fb)).collect()}
    assert prog == {7: (1, 2, 0, 10), 8: (0, 1, 1, 10), 9: (0, 0, 0, 0)}


def test_classification_report_zero_division(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]  # class 2 never predicted
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r.class_name: r for r in report.classification_report(df).collect()}
    assert got["2"].precision == 0.0 and got["2"].recall == 0.0 and got["2"].f1 == 0.0
    assert got["1"].precision == round(2 / 4, 6) and got["1"].recall == 1.0
    assert got["accuracy"].f1 == round(3 / 5, 6) and got["accuracy"].support == 5
    f1s = [1 / 1.5, 2 * 0.5 * 1 / 1.5, 0.0]
    assert got["macro avg"].f1 == round(sum(f1s) / 3, 6)
    assert got["weighted avg"].f1 == round((f1s[0] * 2 + f1s[1] * 2) / 5, 6)


def test_lookups_fall_back(spark):
    df = spark.createDataFrame([("posh_act", "tamil"), ("unknown_law", "hindi"), ("it_act_cyber", "hinglish")],
                               "law_key string, lang string")
    out = {(r.law_key, r.lang): r for r in with_practice_area(with_law_text(df, spark), spark).collect()}
    from civicflow.sources.literals import LAW_TEXT
    text = {(k, lg): t for k, lg, t in LAW_TEXT}
    assert out[("posh_act", "tamil")].law_text == text[("posh_act", "english")]
    assert out[("unknown_law", "hindi")].law_text == text[("general", "hindi")]
    assert out[("it_act_cyber", "hinglish")].law_text == text[("it_act_cyber", "hinglish")]
    assert out[("posh_act", "tamil")].practice_area == "Corporate"
    assert out[("unknown_law", "hindi")].practice_area == "Civil"
    blocks = spark.createDataFrame([("tamil", "greeting"), ("tamil", "actions")], "lang string, block string")
    v = {r.block: r.variants for r in with_reply_variants(blocks, spark).collect()}
    assert len(v["actions"]) == 2 and "வணக்கம்" in v["greeting"][0]


def test_csv_corpus_reader(spark):
    d = tempfile.mkdtemp(prefix="civicflow-csv-")
    p = os.path.join(d, "c.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('text,law,abuse_type\n"line one\nline two",IPC 354,physical\nNA,IPC 506,verbal\n'
                'ok,null,x\n"quoted ""word""",POSH,\nplain,IT Act 67,cyber\n')
    df = readers.read_csv_corpus(spark, p)
    rows = df.orderBy("row_id").collect()
    assert [r.text for r in rows] == ["line one\nline two", None, "ok", 'quoted "word"', "plain"]
    assert rows[2].law is None and rows[3].abuse_type is None
    kept = df.dropna(subset=["text", "law", "abuse_type"]).count()
    assert kept == 2
    assert readers.read_csv_corpus(spark, p + ".missing", allow_missing=True).count() == 0


def test_single_pass_classifier_equals_pipeline_fit(spark):
    """fit_text_classifier (texts tokenised once, TF persisted) gives the
    same probabilities as fitting the plain pipeline."""
    from pyspark.ml.functions import vector_to_array
    from civicflow.operators import models
    docs = readers.read_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"], parallel=False)
    labels = readers.read_table(spark, "/root/testdata/sf0.001", "labels", ["doc_id", "toxic"], parallel=False)
    data = docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    train, valid = models.split(data, "doc_id")

    def probs(model):
        out = model.transform(valid).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("p"))
        return sorted(tuple(r) for r in out.collect())
    assert probs(models.fit_text_classifier(train, max_iter=10)) == probs(models.text_classifier(max_iter=10).fit(train))


def test_dense_index_distributed_path_matches_one_task(spark):
    from civicflow.operators.common import dense_index
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("first_row"), F.col("id").alias("v"))
    one = sorted(tuple(r) for r in dense_index(df, "first_row", "ix").collect())
    many = sorted(tuple(r) for r in dense_index(df, "first_row", "ix", one_task_rows=10).collect())
    assert [r[2] for r in one] == list(range(5000))
    assert one == many


def test_model_persist_and_load_roundtrip(spark, tmp_path):
    """K3: a saved pipeline model loads back and scores identically."""
    from pyspark.ml.functions import vector_to_array
    from civicflow.operators import models
    rows = [(i, t, float(lbl)) for i, (t, lbl) in enumerate(
        [("police beat me severe", 1), ("need a lawyer now", 1), ("just a bit sad today", 0),
         ("help me file a case", 1), ("feeling lonely", 0), ("nice weather", 0)] * 3)]
    data = spark.createDataFrame(rows, "doc_id long, text string, label double")
    model = models.fit_text_classifier(data, max_iter=5)
    path = str(tmp_path / "severity_model")
    models.save_model(model, path)
    again = models.load_model(path)

    def probs(m):
        return sorted(tuple(r) for r in m.transform(data).select(
            "doc_id", F.round(vector_to_array("probability")[1], 9)).collect())
    assert probs(again) == probs(model)
