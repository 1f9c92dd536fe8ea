"""Flagship: triage of chat turns = language -> nearest example -> law ->
severity -> dialogue replay -> place -> adviser.

All turns are scored column-wise once (the stage is only known after the
replay), the replay runs as a parallel prefix scan (plans.dialogue), and only
the turns that reach the location stage are matched against the directory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.codes import md5_bucket
from civicflow.functions.text import (LEGAL_GATE, SEVERITY_GATE, is_short_message, language_tag, law_key, location_profile,
                                      py_strip, severity_keyword)
from civicflow.operators import tfidf
from civicflow.operators.calibrated import CalibratedSVC
from civicflow.operators.containment import first_contained
from civicflow.operators.lookup import with_practice_area
from civicflow.plans import dialogue
from civicflow.session import cut_lineage

Matcher = Callable[[DataFrame], DataFrame]
SCORE_DECIMALS = 6
RECOMMENDER_NEIGHBOURS = 5  # the directory needs at least this many rows
# Block whose variant list a branch draws from (None: no variant choice).
BRANCH_BLOCK = {
    "greet": "greeting", "emotional": "empathy_pure", "legal": "empathy_legal",
    "ask_location": "ask_location", "actions": "actions", "lawyer": "lawyer_title",
    "no_lawyer": "no_lawyer_found", "no_corpus": "share_more",
}


def session_language(turns: DataFrame) -> DataFrame:
    """Language of the first turn, per conversation (agg, not window)."""
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("_first_text"))
    return first.select("conv_id", language_tag("_first_text").alias("lang"))


def nearest_example(turns: DataFrame, corpus: DataFrame, index: tfidf.TfidfIndex | None = None,
                    n_docs: int | None = None, n_queries: int | None = None) -> DataFrame:
    """Top-1 corpus row per turn by TF-IDF cosine, and its law.

    Adds score (0.0 when no term is shared, null when the corpus is empty:
    T6), hit_doc, hit_law. Emptiness is a broadcast one-row scalar, not an
    action, so the plan stays lazy.
    """
    idx = tfidf.pack(index or tfidf.build_index(corpus, "doc_id", "text"), n_queries or 1, n_docs)
    keyed = turns.withColumn("_tkey", F.struct("conv_id", "turn"))
    top = tfidf.search(idx, keyed, "_tkey", "text", k=1, n_docs=n_docs, n_queries=n_queries)
    hits = (top.join(corpus.select(F.col("doc_id"), F.col("law").alias("_law")), "doc_id")
            .select(F.col("query_id").alias("_tkey"), F.col("score"), F.col("doc_id").alias("hit_doc"),
                    law_key("_law").alias("hit_law")))
    return (keyed.join(hits, "_tkey", "left").join(F.broadcast(idx.n_docs), how="left")
            .withColumn("score", F.when(F.col("n") > 0, F.coalesce(F.col("score"), F.lit(0.0))))
            .drop("_tkey", "n"))


def turn_features(turns: DataFrame, corpus: DataFrame, n_docs: int | None = None,
                  n_queries: int | None = None, index: tfidf.TfidfIndex | None = None,
                  severity: CalibratedSVC | None = None, matcher: Matcher | None = None) -> DataFrame:
    """Per-turn columns the replay needs: short, legal, severe, hit_law, lang."""
    scored = (nearest_example(turns, corpus, index=index, n_docs=n_docs, n_queries=n_queries) if matcher is None
              else matched(turns, corpus, matcher))
    return gated(scored.join(session_language(turns), "conv_id"), severity)


def matched(turns: DataFrame, corpus: DataFrame, matcher: Matcher) -> DataFrame:
    """``nearest_example`` by another search: ``matcher`` takes (query_id, text) of the distinct texts and gives
    (query_id, doc_id, score), at most one row a text."""
    distinct = turns.select(F.col("text").alias("_qtext")).distinct().withColumn("query_id", F.sha2("_qtext", 256))
    found = matcher(distinct.select("query_id", F.col("_qtext").alias("text")))
    hits = (found.join(corpus.select("doc_id", F.col("law").alias("_law")), "doc_id")
            .select(F.col("query_id").alias("_qkey"), F.col("score").cast("double").alias("score"), F.col("doc_id").alias("hit_doc"),
                    law_key("_law").alias("hit_law")))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    return (turns.withColumn("_qkey", F.sha2("text", 256)).join(hits, "_qkey", "left").join(F.broadcast(n), how="left")
            .withColumn("score", F.when(F.col("n") > 0, F.coalesce(F.col("score"), F.lit(0.0)))).drop("_qkey", "n"))


def gated(scored: DataFrame, severity: CalibratedSVC | None = None) -> DataFrame:
    """Turns with their nearest example (score, hit_doc, hit_law): adds short, legal (null: no corpus) and severe.

    Severe is the model's gate (P6), or without a model the keyword rule (P7)."""
    if severity is None:
        severe = severity_keyword("text")
    else:
        scored = severity.score(scored, "_p_severe")
        severe = F.coalesce(F.col("_p_severe") > F.lit(SEVERITY_GATE), F.lit(False))
    return _with_rules(scored, severe).drop("_p_severe")


def _with_rules(scored: DataFrame, severe: Column) -> DataFrame:
    return (scored.withColumn("score", F.round("score", SCORE_DECIMALS))
            .withColumn("short", is_short_message("text"))
            .withColumn("legal", F.when(F.col("score").isNull(), F.lit(None).cast("boolean"))
                        .otherwise(F.col("score") > F.lit(LEGAL_GATE)))
            .withColumn("severe", severe))


def directory_places(directory: DataFrame) -> DataFrame:
    """A3: distinct places (lowercased), ranked by first directory row; nulls
    and blanks dropped (T7)."""
    return (directory.where(F.col("location").isNotNull() & (F.col("location") != ""))
            .groupBy("location").agg(F.min("lawyer_id").alias("place_rank"))
            .select(F.lower("location").alias("place"), "place_rank"))


def best_by_location(directory: DataFrame) -> DataFrame:
    """Highest experience (nulls last, then lowest id) per place."""
    best = (directory.where(F.col("location").isNotNull())
            .groupBy(F.lower("location").alias("place"))
            .agg(F.max(F.struct(F.col("experience_years").isNotNull().alias("has"),
                                F.col("experience_years").alias("exp"),
                                (-F.col("lawyer_id")).alias("neg_id"))).alias("_b")))
    return best.select("place", (-F.col("_b.neg_id")).alias("lawyer_id"), F.col("_b.exp").alias("experience_years"))


def resolve_location_turns(spark: SparkSession, located: DataFrame, directory: DataFrame,
                           n_queries: int | None = None) -> DataFrame:
    """Rules 6-8 for turns in the location stage.

    ``located``: conv_id, turn, text, law_in. Adds place, lawyer_id, match_kind.
    """
    places = directory_places(directory)
    with_place = first_contained(located, F.lower(F.col("text")), places, "place", "place_rank",
                                 "place", "place_rank", ["conv_id", "turn"]).drop("place_rank")
    q = with_practice_area(with_place.withColumn("_law", F.coalesce(F.col("law_in"), F.lit("general"))),
                           spark, "_law", "practice").drop("_law")
    q = q.withColumn("_qtext", F.concat(F.coalesce(F.col("place"), py_strip(F.col("text"))), F.lit(" "),
                                        F.col("practice")))
    q = q.withColumn("_tkey", F.struct("conv_id", "turn"))
    n_dir = directory.count()
    if n_dir >= RECOMMENDER_NEIGHBOURS:
        profiles = directory.select("lawyer_id", location_profile("location", "practice_area").alias("profile"))
        idx = tfidf.build_index(profiles, "lawyer_id", "profile")
        rec = (tfidf.search(idx, q, "_tkey", "_qtext", k=1, n_docs=n_dir, n_queries=n_queries)
               .select(F.col("query_id").alias("_tkey"), F.col("doc_id").alias("_rec_id")))
        q = q.join(rec, "_tkey", "left")
    else:
        q = q.withColumn("_rec_id", F.lit(None).cast("long"))
    fb = best_by_location(directory).select(F.col("place").alias("_fb_place"), F.col("lawyer_id").alias("_fb_id"))
    q = q.join(fb, F.col("place") == F.col("_fb_place"), "left")
    return (q.withColumn("lawyer_id", F.coalesce(F.col("_rec_id"), F.col("_fb_id")))
            .withColumn("match_kind", F.when(F.col("_rec_id").isNotNull(), F.lit("recommender"))
                        .when(F.col("_fb_id").isNotNull(), F.lit("location_filter")))
            .select("conv_id", "turn", "place", "lawyer_id", "match_kind"))


def triage(spark: SparkSession, turns: DataFrame, corpus: DataFrame, directory: DataFrame,
           block: int = dialogue.DEFAULT_BLOCK, levels: int | None = None,
           n_docs: int | None = None, index: tfidf.TfidfIndex | None = None,
           keep: tuple[str, ...] = (), severity: CalibratedSVC | None = None,
           matcher: Matcher | None = None) -> DataFrame:
    """Flagship: one row per user turn with the branch the service takes.

    Output: conv_id, turn, lang, stage_in, branch, stage_out, law_key, score,
    hit_doc, place, lawyer_id, match_kind, reply_block, variant_key, and the
    columns ``keep`` of the turns (the message and its user, for the chat log).
    ``n_docs`` (an upper bound on the corpus size) only sizes score blocks.
    ``index`` is a loaded index of the corpus; without one it is built here. ``severity`` is a trained model for
    the follow-up stage (without one: keywords), ``matcher`` another search for the nearest example (see ``matched``).
    """
    n_turns, max_turn = turns.agg(F.count(F.lit(1)), F.max("turn")).first()
    if levels is None:
        levels = dialogue.levels_needed(int(max_turn or 0), block)
    # The scored turns (one row per turn, so bounded by the query side) are
    # written once to the shared checkpoint folder. This ends the scoring
    # plan there: AQE re-plans the remaining plan after every stage, and
    # without the cut each of the scoring stages re-optimised the replay's
    # large fold expression as well (seconds of driver time per run).
    feats = cut_lineage(turn_features(turns, corpus, n_docs=n_docs, n_queries=n_turns, index=index,
                                      severity=severity, matcher=matcher))
    payload = list(dict.fromkeys(["text", "lang", "score", "hit_doc", *keep]))
    replayed = dialogue.replay(feats, payload, block=block, levels=levels)
    # Two consumers below (location turns and the final join): materialise the
    # replay once instead of replaying twice.
    return answered(spark, cut_lineage(replayed), directory, n_turns, keep)


def answered(spark: SparkSession, replayed: DataFrame, directory: DataFrame, n_turns: int | None = None,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Replayed turns (cut from their plan: they are read twice) with place and adviser looked up for those in
    the location stage, the final branch, the reply block and the pick key of its variant."""
    loc = replayed.where(F.col("branch") == dialogue.BRANCH_LOCATION).select("conv_id", "turn", "text", "law_in")
    if loc.isEmpty():  # cheap on the checkpoint: skip the directory work
        resolved = spark.createDataFrame([], "conv_id long, turn long, place string, lawyer_id long, "
                                             "match_kind string")
    else:
        resolved = resolve_location_turns(spark, loc, directory, n_queries=n_turns)
    out = replayed.join(resolved, ["conv_id", "turn"], "left")
    branch = (F.when(F.col("branch") != dialogue.BRANCH_LOCATION, F.col("branch"))
              .when(F.col("lawyer_id").isNotNull(), F.lit("lawyer")).otherwise(F.lit("no_lawyer")))
    block_expr = None
    for b, blk in BRANCH_BLOCK.items():
        block_expr = (F.when(F.col("branch") == b, F.lit(blk)) if block_expr is None
                      else block_expr.when(F.col("branch") == b, F.lit(blk)))
    return (out.withColumn("branch", branch)
            .withColumn("reply_block", block_expr)
            # O3: retry-safe "random" pick key; index = variant_key % len(variants)
            .withColumn("variant_key", md5_bucket(F.concat_ws(":", F.col("conv_id").cast("string"),
                                                              F.col("turn").cast("string")), 1 << 30))
            .select("conv_id", "turn", "lang", "stage_in", "branch", "stage_out", "law_key", "score", "hit_doc",
                    "place", "lawyer_id", "match_kind", "reply_block", "variant_key", *keep))


def branch_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("branch", "lang").agg(F.count(F.lit(1)).alias("n_turns"))
