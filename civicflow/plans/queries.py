"""Registered queries: each binds one job to the shared test tables.

Every callable takes (spark, sf_dir) and returns a lazy DataFrame whose
column names equal those of the matching SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.codes import md5_bucket
from civicflow.functions.text import LANGUAGES, LEGAL_GATE, kb_category, language_tag, law_key, severity_keyword
from civicflow.operators import engagement, knowledge, models, registry, report, tfidf
from civicflow.operators.common import (dense_index, drop_null_rows, fill_blank_strings, first_appearance,
                                       top_k_per_group)
from civicflow.operators.containment import first_contained
from civicflow.operators.lookup import with_law_text, with_practice_area
from civicflow.operators.vectors import cache_delta, knn_top_k
from civicflow.plans import inputs, triage
from civicflow.plans.stored import STORED_QUERIES
from civicflow.sources.readers import read_table, table_rows

Query = Callable[[SparkSession, str], DataFrame]
R6 = 6


def language_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["text", "lang"])
    return (docs.select(language_tag("text").alias("language_tag"), "lang")
            .groupBy("language_tag", "lang").agg(F.count(F.lit(1)).alias("n_docs")))


def session_language(spark: SparkSession, sf: str) -> DataFrame:
    turns = inputs.user_turns(spark, sf)
    return (turns.join(triage.session_language(turns).withColumnRenamed("lang", "session_language"), "conv_id")
            .select("conv_id", "turn", language_tag("text").alias("turn_language"), "session_language"))


def clean_corpus(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.complaint_corpus(spark, sf)
    return c.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


def directory_fill(spark: SparkSession, sf: str) -> DataFrame:
    d = fill_blank_strings(inputs.directory(spark, sf), ["name", "mobile", "location", "practice_area"])
    return d.withColumn("profile_text", F.concat(F.col("location"), F.lit(" "), F.col("practice_area")))


def label_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id", "source"])
    firsts = first_appearance(docs, "source", "doc_id", out_rank="first_doc_id", count_col="n_docs")
    return dense_index(firsts, "first_doc_id", "label_id").select(
        F.col("source").alias("label"), "label_id", "first_doc_id", "n_docs")


def law_mapping_counts(spark: SparkSession, sf: str) -> DataFrame:
    laws = inputs.part_laws(spark, sf)
    return (laws.select(law_key("law").alias("law_key"), kb_category("law").alias("category"))
            .groupBy("law_key", "category").agg(F.count(F.lit(1)).alias("n_laws")))


def knowledge_base_build(spark: SparkSession, sf: str) -> DataFrame:
    laws = drop_null_rows(inputs.part_laws(spark, sf), ["law"])
    kb = knowledge.build_knowledge_base(spark, laws, "law", "p_partkey")
    return knowledge.seed_if_absent(kb, None, ["category", "title"])


def knowledge_search(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    kb = part.select(F.col("p_partkey").alias("kb_id"), F.col("p_name").alias("title"),
                     F.col("p_type").alias("description"), F.lower("p_brand").alias("keywords"))
    qs = spark.createDataFrame([(q,) for q in inputs.SEARCH_TERMS], "query string")
    return knowledge.search(kb, qs).select("query", "kb_id", "title")


def law_text_lookup(spark: SparkSession, sf: str) -> DataFrame:
    laws = inputs.part_laws(spark, sf)
    langs = F.array(*[F.lit(x) for x in LANGUAGES])
    keyed = laws.select(F.col("p_partkey").alias("law_id"), law_key("law").alias("law_key"),
                        F.element_at(langs, (F.pmod(F.col("p_partkey"), F.lit(len(LANGUAGES))) + 1).cast("int"))
                        .alias("lang"))
    return with_practice_area(with_law_text(keyed, spark), spark)


def location_detect(spark: SparkSession, sf: str) -> DataFrame:
    cust = inputs.customers_with_nation(spark, sf)
    text = F.lower(F.concat_ws(" ", F.col("c_name"), F.lit("lives in"), F.col("n_name"), F.lit("and works in"),
                               F.col("c_mktsegment")))
    places = triage.directory_places(inputs.directory(spark, sf))
    return first_contained(cust.select("c_custkey", text.alias("t")), F.col("t"), places, "place", "place_rank",
                           "place", "place_rank", ["c_custkey"]).select("c_custkey", "place", "place_rank")


def best_in_location(spark: SparkSession, sf: str) -> DataFrame:
    cust = inputs.customers_with_nation(spark, sf).select("c_custkey", F.lower("n_name").alias("place"))
    best = triage.best_by_location(inputs.directory(spark, sf))
    return cust.join(best, "place", "left").select("c_custkey", "lawyer_id", "experience_years")


def _customer_queries(spark: SparkSession, sf: str) -> DataFrame:
    cust = inputs.customers_with_nation(spark, sf)
    keyed = cust.select("c_custkey", "n_name",
                        law_key(F.concat(F.lit("IPC "), F.col("c_custkey").cast("string"))).alias("law_key"))
    withp = with_practice_area(keyed, spark)
    return withp.select("c_custkey", F.concat(F.coalesce(F.col("n_name"), F.lit("")), F.lit(" "),
                                              F.col("practice_area")).alias("query_text"))


def tfidf_recommend(spark: SparkSession, sf: str) -> DataFrame:
    d = directory_fill(spark, sf)
    idx = tfidf.build_index(d, "lawyer_id", "profile_text")
    top = tfidf.search(idx, _customer_queries(spark, sf), "c_custkey", "query_text", k=5,
                       n_docs=table_rows(spark, sf, "supplier"), n_queries=table_rows(spark, sf, "customer"))
    return top.select(F.col("query_id").alias("c_custkey"), F.col("rank").cast("long").alias("rank"),
                      F.col("doc_id").alias("lawyer_id"), F.round("score", R6).alias("score"))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])


def _self_knn(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Leave-one-out kNN over all stored vectors (block sizes from footers)."""
    from civicflow.operators.tfidf import block_counts
    from civicflow.operators.vectors import MAX_CORPUS_BLOCK, MAX_QUERY_BLOCK
    emb = _embeddings(spark, sf)
    n = table_rows(spark, sf, "embeddings")
    qb, cb = block_counts(n, n, MAX_QUERY_BLOCK, MAX_CORPUS_BLOCK, spark.sparkContext.defaultParallelism)
    return knn_top_k(emb, "vec_id", "embedding", emb, "vec_id", "embedding", k=k, exclude_self=True,
                     q_blocks=qb, c_blocks=cb)


def semantic_top1(spark: SparkSession, sf: str) -> DataFrame:
    emb = _embeddings(spark, sf)
    top = _self_knn(spark, sf, 1)
    docs = read_table(spark, sf, "documents", ["doc_id", "lang"])
    labels = emb.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("hit_label"))
    score = F.round("score", R6)
    return (top.join(labels, "doc_id", "left").join(docs.withColumnRenamed("lang", "hit_lang"), "doc_id", "left")
            .select(F.col("query_id").alias("vec_id"), F.col("doc_id").alias("hit_id"), score.alias("score"),
                    (score > F.lit(LEGAL_GATE)).alias("is_legal"), "hit_label", "hit_lang"))


def semantic_topk_label_vote(spark: SparkSession, sf: str) -> DataFrame:
    emb = _embeddings(spark, sf)
    top = _self_knn(spark, sf, 5)
    labels = emb.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("hit_label"))
    votes = (top.join(labels, "doc_id").groupBy("query_id", "hit_label")
             .agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best_rank")))
    win = top_k_per_group(votes, ["query_id"], [F.col("votes").desc(), F.col("best_rank").asc()], 1)
    truth = emb.select(F.col("vec_id").alias("query_id"), "label")
    return (win.join(truth, "query_id")
            .select(F.col("query_id").alias("vec_id"), F.col("hit_label").alias("predicted_label"), "votes",
                    "label", (F.col("hit_label") == F.col("label")).alias("correct")))


def embedding_cache_delta(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).where(F.col("text").isNotNull())
    emb = read_table(spark, sf, "embeddings", ["vec_id"])
    cached = (emb.join(docs, emb.vec_id == docs.doc_id)
              .select(F.sha2(F.col("text"), 256).alias("text_sha256")))
    return cache_delta(docs, "doc_id", "text", cached)


def severity_keyword_q(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.user_turns(spark, sf)
    return t.select("conv_id", "turn", severity_keyword("text").alias("is_severe"))


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id"])
    b = md5_bucket(F.col("doc_id"), 10)
    return docs.select("doc_id", b.alias("bucket"),
                       F.when(b == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split"))


def _feedback(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    subs = inputs.quiz_submissions(spark, sf)
    return subs, engagement.grade_submissions(subs, inputs.quiz_from_parts(spark, sf))


def quiz_grade(spark: SparkSession, sf: str) -> DataFrame:
    _, fb = _feedback(spark, sf)
    return fb.select("submission_id", "user_id", "question_id", "correct", "points")


def quiz_sample(spark: SparkSession, sf: str) -> DataFrame:
    quiz = inputs.quiz_from_parts(spark, sf)
    return engagement.sample_questions(quiz, "category", 2, inputs.QUIZ_SEED_TEXT)


def progress_counters(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["user_id", "event_type"])
    kind = (F.when(F.col("event_type") == "view", F.lit("search"))
            .when(F.col("event_type") == "click", F.lit("chat"))
            .when(F.col("event_type") == "purchase", F.lit("quiz")))
    activity = ev.select("user_id", kind.alias("kind")).where(F.col("kind").isNotNull())
    subs, fb = _feedback(spark, sf)
    scores = engagement.submission_scores(subs, fb)
    users = read_table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("user_id"))
    return engagement.progress_counters(users, activity, scores)


def user_upsert(spark: SparkSession, sf: str) -> DataFrame:
    st = registry.registration_status(inputs.registrations(spark, sf), inputs.existing_users(spark, sf))
    return st.select("event_id", "user_id", "mobile", "status")


def protect_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    gov = F.lpad((F.col("c_custkey") * F.lit(7919) % F.lit(10 ** 12)).cast("string"), 12, "0")
    out = registry.protect(cust.withColumn("gov_id", gov), spark, "gov_id", "gov_id", ["c_name"])
    return out.select("c_custkey", F.col("c_name_sha256").alias("name_sha256"),
                      F.col("gov_id_valid"), "roundtrip_ok", "tamper_rejected")


def chat_history_join(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    chats = ev.where(F.col("event_type") == "click")
    return (chats.join(cust, chats.user_id == cust.c_custkey, "left")
            .select("event_id", "user_id", F.col("c_name").alias("user_name"), F.to_date("ts").alias("dt")))


def classification_report_q(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "labels", ["quality", "toxic"])
    return report.classification_report(labels, "quality", "toxic")


def _dialogue(spark: SparkSession, sf: str) -> DataFrame:
    return triage.triage(spark, inputs.user_turns(spark, sf), inputs.complaint_corpus(spark, sf, in_place=True),
                         inputs.directory(spark, sf), n_docs=table_rows(spark, sf, "documents"))


def dialogue_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _dialogue(spark, sf).select("conv_id", "turn", "lang", "stage_in", "branch", "stage_out", "law_key",
                                       "score", "hit_doc", "place", "lawyer_id", "match_kind", "reply_block",
                                       "variant_key")


def dialogue_branch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return triage.branch_counts(_dialogue(spark, sf))


def severity_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.severity_job(spark, sf)


def complaint_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return models.complaint_type_job(spark, sf)


def emotion_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return models.emotion_job(spark, sf)


QUERIES: dict[str, Query] = {
    "language_tag_counts": language_tag_counts,
    "session_language": session_language,
    "clean_corpus": clean_corpus,
    "directory_fill": directory_fill,
    "label_index": label_index,
    "law_mapping_counts": law_mapping_counts,
    "knowledge_base_build": knowledge_base_build,
    "knowledge_search": knowledge_search,
    "law_text_lookup": law_text_lookup,
    "location_detect": location_detect,
    "best_in_location": best_in_location,
    "tfidf_recommend": tfidf_recommend,
    "semantic_top1": semantic_top1,
    "semantic_topk_label_vote": semantic_topk_label_vote,
    "embedding_cache_delta": embedding_cache_delta,
    "severity_keyword": severity_keyword_q,
    "holdout_split": holdout_split,
    "quiz_grade": quiz_grade,
    "quiz_sample": quiz_sample,
    "progress_counters": progress_counters,
    "user_upsert": user_upsert,
    "protect_identifiers": protect_identifiers,
    "chat_history_join": chat_history_join,
    "classification_report": classification_report_q,
    "dialogue_replay": dialogue_replay,
    "dialogue_branch_counts": dialogue_branch_counts,
    "severity_model": severity_model,
    "complaint_classifier": complaint_classifier,
    "emotion_classifier": emotion_classifier,
    **STORED_QUERIES,
}
