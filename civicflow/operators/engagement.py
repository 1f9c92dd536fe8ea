"""Quiz grading and sampling (J9, A6, F9, F10, O2) and progress counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions.codes import md5_order_key, parse_options
from civicflow.functions.text import py_strip
from civicflow.operators.common import top_k_per_group

POINTS_PER_CORRECT = 10


def grade_submissions(submissions: DataFrame, quiz: DataFrame) -> DataFrame:
    """One feedback row per answered, known question.

    ``submissions``: submission_id, user_id, answers map<string,string>.
    Keys that are not numbers or not known question ids are ignored (T19).
    """
    answers = submissions.select("submission_id", "user_id",
                                 F.explode(F.col("answers")).alias("qid", "answer"))
    keyed = answers.withColumn("question_id", F.expr("try_cast(qid as bigint)")).where(
        F.col("question_id").isNotNull())
    q = quiz.select(F.col("id").alias("question_id"), "correct_answer", "explanation")
    graded = keyed.join(q, "question_id")
    correct = F.lower(py_strip(F.col("correct_answer"))) == F.lower(py_strip(F.col("answer")))
    return graded.select("submission_id", "user_id", "question_id", F.coalesce(correct, F.lit(False)).alias("correct"),
                         F.when(correct, F.lit(POINTS_PER_CORRECT)).otherwise(F.lit(0)).cast("long").alias("points"),
                         "correct_answer", "explanation")


def submission_scores(submissions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Score per submission, 0 for submissions with no known answers."""
    per = feedback.groupBy("submission_id").agg(F.sum("points").alias("score"))
    return (submissions.select("submission_id", "user_id").join(per, "submission_id", "left")
            .withColumn("score", F.coalesce(F.col("score"), F.lit(0)).cast("long")))


def sample_questions(quiz: DataFrame, group_col: str, n: int, seed: str) -> DataFrame:
    """N questions per group in a seeded hash order (retry-safe)."""
    keyed = quiz.withColumn("_ord", md5_order_key(F.col("id"), seed))
    top = top_k_per_group(keyed, [group_col], [F.col("_ord").asc(), F.col("id").asc()], n)
    return top.select(group_col, "id", "question", F.size(parse_options(F.col("options"))).alias("n_options"),
                      "type", F.col("rank").cast("long").alias("rank"))


def progress_counters(users: DataFrame, activity: DataFrame, scores: DataFrame) -> DataFrame:
    """Counters recomputed from events instead of mutated.

    ``activity``: user_id, kind in {search, chat, quiz}; ``scores``: user_id,
    score per quiz submission. Every user gets a row (zeros when idle).
    """
    counts = activity.groupBy("user_id").agg(
        F.sum(F.when(F.col("kind") == "search", 1).otherwise(0)).cast("long").alias("articles_viewed"),
        F.sum(F.when(F.col("kind") == "quiz", 1).otherwise(0)).cast("long").alias("topics_completed"),
        F.sum(F.when(F.col("kind") == "chat", 1).otherwise(0)).cast("long").alias("chatbot_usage_count"))
    pts = scores.groupBy("user_id").agg(F.sum("score").cast("long").alias("quiz_score"))
    out = users.select("user_id").join(counts, "user_id", "left").join(pts, "user_id", "left")
    return out.select("user_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                   for c in ["articles_viewed", "topics_completed", "chatbot_usage_count",
                                             "quiz_score"]])
