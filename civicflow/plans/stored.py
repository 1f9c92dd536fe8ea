"""Registered queries over tables that the jobs themselves write: the saved index, streamed replies and counters,
inserts into a table that has rows already.

Each writes to a new folder under the session's shared checkpoint folder, from the whole given tables, in several
batches or restarts, and returns what the finished tables hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.operators import knowledge, report
from civicflow.operators.common import drop_null_rows
from civicflow.operators.keys import KeyTable, decrypted, rotated
from civicflow.operators.registry import UserStore
from civicflow.operators.saved_index import SavedIndex
from civicflow.operators.vector_cache import VectorCache
from civicflow.plans import inputs, triage
from civicflow.session import cut_lineage, ensure_checkpoint_dir
from civicflow.sources.batch_table import BatchTable, insert_new
from civicflow.sources.readers import read_table
from civicflow.streaming.dialogue_stream import COUNTERS, ProgressTable
from civicflow.streaming.triage_stream import REPLIES, TURNS, TriageStream

PARTS = 3  # batches, appends or restarts of a query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved_index(spark: SparkSession, corpus: DataFrame) -> SavedIndex:
    """The corpus as an index that was built and appended to twice, with an overlap and a repeated batch."""
    index = SavedIndex(spark, _folder(spark, "index"))
    part = F.pmod(F.col("doc_id"), F.lit(PARTS))
    for i in range(PARTS):
        index.append(corpus.where((part == i) | (part == (i + PARTS - 1) % PARTS) & F.lit(i > 0)), f"part{i}")
    index.append(corpus, "part1")
    return index


def saved_index_growth(spark: SparkSession, sf: str) -> DataFrame:
    """K3/M2: idf, documents and total weight of every term of the grown index."""
    loaded = saved_index(spark, inputs.complaint_corpus(spark, sf)).load()
    by_term = loaded.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("w"), 4).alias("weight"))
    return by_term.join(loaded.vocab, "term").select("term", "n_docs", F.round("idf", 9).alias("idf"), "weight")


def _in_turn_order(turns: DataFrame) -> list[DataFrame]:
    """The turns as ``PARTS`` drops: those with the lowest numbers first."""
    last = turns.agg(F.max("turn")).first()[0] or 0
    width = last // PARTS + 1
    return [turns.where(F.floor(F.col("turn") / F.lit(width)) == i) for i in range(PARTS)]


def stream_triage(spark: SparkSession, sf: str) -> DataFrame:
    """ST-FSM/ST-LOG: the user turns as a stream in several drops, each read by restarted queries, scored against the
    saved index; one reply a turn."""
    corpus = inputs.complaint_corpus(spark, sf, in_place=True)
    turns = inputs.user_turns(spark, sf).select("conv_id", "turn", F.col("conv_id").alias("user_id"), "text",
                                                F.timestamp_seconds(F.col("turn") * 60).alias("ts"))
    index, source, path = saved_index(spark, corpus), _folder(spark, "turns"), _folder(spark, "triage")
    job = TriageStream(spark, path, path.rsplit("/", 1)[1], index, cut_lineage(corpus.select("doc_id", "law")), inputs.directory(spark, sf))
    for drop in _in_turn_order(turns):
        drop.write.mode("append").parquet(source)
        job.run(spark.readStream.schema(TURNS).parquet(source))
    return job.replies.read()


def stream_replies(spark: SparkSession, sf: str) -> DataFrame:
    names = [c.split()[0] for c in REPLIES.split(", ")]
    return stream_triage(spark, sf).select(*[c for c in names if c not in ("user_id", "text", "ts", "reply")])


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """ST-CNT: events as a stream by thirds of their ids, every micro-batch merged twice (the second changes nothing),
    with the quiz points of graded submissions; a row for every user."""
    from civicflow.plans.queries import _feedback
    events = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    kind = (F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "chat")
            .when(F.col("event_type") == "purchase", "quiz"))
    points = _feedback(spark, sf)[1].groupBy(F.col("submission_id").alias("event_id")).agg(F.sum("points").alias("points"))
    activity = (events.select("event_id", "user_id", kind.alias("kind")).where(F.col("kind").isNotNull())
                .join(points, "event_id", "left").select("event_id", "user_id", "kind", "points"))
    source, path = _folder(spark, "activity"), _folder(spark, "progress")
    job = ProgressTable(spark, path)
    for i in range(PARTS):
        activity.where(F.pmod("event_id", F.lit(PARTS)) == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, user_id long, kind string, points long").parquet(source)
        job.start(stream, path.rsplit("/", 1)[1]).awaitTermination()
    job.merge_batch(activity, PARTS - 1)  # a replay of the last batch
    users = read_table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("user_id"))
    return (users.join(job.counters(), "user_id", "left")
            .select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS]))


def knowledge_seed(spark: SparkSession, sf: str) -> DataFrame:
    """The knowledge base seeded into a table that holds the entries of a third of the laws, then again."""
    laws = drop_null_rows(inputs.part_laws(spark, sf), ["law"])
    base = knowledge.build_knowledge_base(spark, laws, "law", "p_partkey")
    table = BatchTable(spark, _folder(spark, "kb"), base.schema)
    table.append(base.where(F.pmod("kb_id", F.lit(PARTS)) == 1), "earlier")
    for batch in ("seed", "seed", "again"):
        insert_new(table, base, ["category", "title"], ["kb_id"], batch)
    return table.read()


def registered_users(spark: SparkSession, sf: str) -> DataFrame:
    """Signups of three periods registered one after another into a table with users, one period twice; the
    users with their zeroed progress."""
    keys = KeyTable(spark, _folder(spark, "keys"))
    keys.add_version(1)
    store = UserStore(spark, _folder(spark, "users"), keys)
    known = inputs.existing_users(spark, sf)
    store.users.append(known.select("user_id", "mobile", *[F.lit(None).alias(c) for c in (
        "password_hash", "gov_id_cipher", "key_version", "address", "age", "created_at", "event_id")]), "earlier")
    events = read_table(spark, sf, "events", ["event_id", "ts"])
    requests = (inputs.registrations(spark, sf).join(events, "event_id")
                .withColumn("address", F.concat(F.lit("Street "), F.col("user_id").cast("string")))
                .withColumn("age", (F.pmod("user_id", F.lit(60)) + 18).cast("int")).withColumnRenamed("ts", "created_at"))
    last = requests.agg(F.max("event_id")).first()[0] or 0
    for i in (0, 1, 1, 2):
        store.register(requests.where(F.floor(F.col("event_id") / F.lit(last // PARTS + 1)) == i), f"period{i}")
        keys.add_version(i + 1)  # later periods' ids stand under newer keys
    users = rotated(store.users.read().where(F.col("event_id").isNotNull()), keys, "gov_id_cipher")
    users = decrypted(users, keys, "gov_id_cipher", "gov_id")
    return (users.join(store.progress.read(), "user_id")
            .select("user_id", "mobile", "event_id", "password_hash", "gov_id", "key_version",
                    "address", "age", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), *COUNTERS))


def dialogue_cases(spark: SparkSession, sf: str) -> DataFrame:
    """ST-FSM rules 1 to 8: a conversation for every customer over a corpus of parts, through follow-up, location and
    short-message reset (see ``inputs.case_turns``)."""
    turns = inputs.case_turns(spark, sf)
    return triage.triage(spark, turns, inputs.part_corpus(spark, sf), inputs.directory(spark, sf))


PREDICTIONS = "vec_id long, label int, probabilities array<double>"


def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Class probabilities of every vector, its five nearest others' shares by class, written and read back."""
    from civicflow.plans.queries import _embeddings, _self_knn
    emb = _embeddings(spark, sf).select("vec_id", "label")
    classes = emb.agg(F.max("label")).first()[0] or 0
    near = _self_knn(spark, sf, 5).join(emb.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("near_label")), "doc_id")
    shares = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.array(*[
        F.sum(F.when(F.col("near_label") == c, 1).otherwise(0)) / F.count(F.lit(1)) for c in range(classes + 1)]).alias("probabilities"))
    table = BatchTable(spark, _folder(spark, "predictions"), PREDICTIONS)
    table.append(shares.join(emb, "vec_id"), "all")
    return table.read()


def prediction_report(spark: SparkSession, sf: str) -> DataFrame:
    """Report and log loss of the stored predictions."""
    return report.evaluation(stored_predictions(spark, sf))


def vector_cache_growth(spark: SparkSession, sf: str) -> DataFrame:
    """K2/M5: a bucketed cache of vectors that holds a third of the texts, then gets what it misses, twice."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).where(F.col("text").isNotNull())
    cache = VectorCache(spark, _folder(spark, "vectors"))
    cache.add(docs.where(F.pmod("doc_id", F.lit(PARTS)) == 1), "text")
    cache.add(docs, "text")
    cache.add(docs, "text")
    unit = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3)
    return cache.rows().groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n_rows"), F.min(unit).alias("norm"))


STORED_QUERIES = {
    "prediction_report": prediction_report,
    "vector_cache_growth": vector_cache_growth,
    "saved_index_growth": saved_index_growth,
    "stream_triage": stream_replies,
    "stream_progress": stream_progress,
    "knowledge_seed": knowledge_seed,
    "registered_users": registered_users,
    "dialogue_cases": dialogue_cases,
}
