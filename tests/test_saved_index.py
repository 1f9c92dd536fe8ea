"""Batch tables, the saved growing index and streaming triage."""
import math
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicflow.functions.text import LEGAL_GATE
from civicflow.operators import tfidf
from civicflow.operators.saved_index import SavedIndex
from civicflow.plans import triage
from civicflow.plans.render import render_replies
from civicflow.sources.batch_table import BatchTable, insert_new
from civicflow.streaming import dialogue_stream as ds
from civicflow.streaming.triage_stream import TriageStream

KV = "k string, v long"


def folder(name):
    return tempfile.mkdtemp(prefix=f"civicflow-{name}-")


def test_batches_count_once(spark):
    t = BatchTable(spark, folder("bt"), KV)
    assert t.read().count() == 0 and t.snapshot() == {}
    assert t.append(spark.createDataFrame([("a", 1)], KV), "1")
    t.stage(spark.createDataFrame([("lost", 9)], KV))           # a write that was stopped before its commit
    before = t.snapshot()
    assert not t.append(spark.createDataFrame([("b", 2)], KV), "1")  # a replay
    assert t.append(spark.createDataFrame([("b", 2)], KV), "2")
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]
    assert t.read(before).collect() == [("a", 1)]              # a reader's snapshot stays
    assert t.commit(t.stage(spark.createDataFrame([("ab", 3)], KV)), "merged", replaces=["1", "2"])
    assert t.read().collect() == [("ab", 3)] and sorted(t.read(before).collect()) == [("a", 1)]


def test_insert_if_absent_survives_retries(spark):
    t = BatchTable(spark, folder("ins"), "mobile string, name string, n long")
    rows = lambda r: spark.createDataFrame(r, "mobile string, name string, n long")
    assert insert_new(t, rows([("1", "x", 5), ("1", "y", 4), (None, "z", 1)]), ["mobile"], ["n"], "day1")
    assert not insert_new(t, rows([("7", "late", 1)]), ["mobile"], ["n"], "day1")
    t.stage(rows([("2", "half", 1)]))                           # killed between write and commit, then run again
    assert insert_new(t, rows([("1", "new", 1), ("2", "b", 2), (None, "q", 0)]), ["mobile"], ["n"], "day2")
    assert sorted(map(str, map(tuple, t.read().collect()))) == sorted(map(str, [("1", "y", 4), (None, "z", 1), ("2", "b", 2)]))
    assert insert_new(t, rows([]), ["mobile"], ["n"], "day3") and t.read().count() == 3


def corpus(spark, n=60):
    words = ["fraud", "theft", "salary", "dowry", "cyber", "harass", "police", "phone", "office", "landlord"]
    rows = [(i, " ".join(words[(i * k + k) % 10] for k in range(1, 4 + i % 5)) + f" case{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index_grows_like_a_rebuild(spark):
    docs = corpus(spark)
    index = SavedIndex(spark, folder("index"))
    assert index.version().n_docs == 0
    assert index.append(docs.where("doc_id < 30"), "build")
    first = index.version()
    assert index.append(docs.where("doc_id between 20 and 44"), "a1")  # 20 to 29 are there already
    assert not index.append(docs, "a1")
    # an append stopped after its postings, before its size
    index.postings.append(spark.createDataFrame([("ghost", 1, 1.0)], "term string, doc_id long, tf double"), "ghost")
    assert index.append(docs.where("doc_id > 40"), "a2")
    whole, grown = tfidf.build_index(docs, "doc_id", "text"), index.load()
    rows = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    assert rows(whole.vocab, "term", "idf") == rows(grown.vocab, "term", "idf")
    assert rows(whole.normalised(), "doc_id", "term", "w") == rows(grown.normalised(), "doc_id", "term", "w")
    assert grown.n_docs.first()["n"] == 60.0 and first.n_docs == 30
    queries = spark.createDataFrame([(1, "cyber fraud case3"), (2, "landlord phone"), (3, "unknown words"), (4, None)], "q long, t string")
    want = rows(tfidf.search(whole, queries, "q", "t", k=3), "query_id", "doc_id", "score", "rank")
    terms = spark.createDataFrame([(x,) for x in ("cyber", "fraud", "case3", "landlord", "phone", "unknown", "words")], "term string")
    part = index.load(terms=terms)
    assert {r["term"] for r in part.postings.select("term").distinct().collect()} <= {"cyber", "fraud", "case3", "landlord", "phone"}
    assert rows(tfidf.search(part, queries, "q", "t", k=3), "query_id", "doc_id", "score", "rank") == want
    assert index.compact("c1") and not index.compact("c2")
    assert len(index.version().live()) == 1
    assert rows(index.load().normalised(), "doc_id", "term", "w") == rows(whole.normalised(), "doc_id", "term", "w")
    assert index.load(first).n_docs.first()["n"] == 30.0 and rows(index.load(first).vocab, "term", "idf") == rows(
        tfidf.build_index(docs.where("doc_id < 30"), "doc_id", "text").vocab, "term", "idf")
    assert index.append(spark.createDataFrame([(99, "a new text"), (99, "a second"), (None, "x"), (98, None)], docs.schema), "a3")
    assert index.version().n_docs == 61


def test_many_query_blocks_send_postings_where_their_terms_are(spark, monkeypatch):
    import random
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.05)), 119)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(1, 14))) for i in range(80)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, text(rng.randrange(1, 7))) for i in range(60)], "q long, t string")
    index = tfidf.build_index(docs, "doc_id", "text")
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 8), r["rank"]) for r in df.collect())
    want = rows(tfidf.search(index, queries, "q", "t", k=4))
    monkeypatch.setattr(tfidf, "MAX_QUERY_BLOCK", 8)
    monkeypatch.setattr(tfidf, "MAX_DOC_BLOCK", 10)
    assert rows(tfidf.search(index, queries, "q", "t", k=4)) == want and len(want) > 100
    brute = tfidf.top_k(tfidf.cosine_scores(index, tfidf.transform_queries(index, queries, "q", "t")), 4)
    assert rows(brute) == want
    q, d, _ = tfidf.block_sides(index, tfidf.transform_queries(index, queries, "q", "t"), 8, 8)
    assert d.count() < 0.7 * 8 * index.postings.count()  # sent to all query blocks before
    assert q.count() < 8 * tfidf.transform_queries(index, queries, "q", "t").count()


def test_one_query_block_sends_only_postings_of_the_queries_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"shared own{i} more{i} words{i}") for i in range(30)] + [(40, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"shared own{i}") for i in range(20)] + [(50, "nothing"), (51, None)], "q long, t string")
    index = tfidf.build_index(docs, "doc_id", "text")
    _, sent, norms = tfidf.block_sides(index, tfidf.transform_queries(index, queries, "q", "t"), 1, 4)
    assert sent.count() == 30 + 20 and norms.count() == 30  # all 120 postings were sent before
    assert tfidf.block_counts(90_000, 350_000, tfidf.MAX_QUERY_BLOCK, tfidf.MAX_DOC_BLOCK, 36)[0] == 1  # 23 copies of them before
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 8), r["rank"]) for r in df.collect())
    want = rows(tfidf.top_k(tfidf.cosine_scores(index, tfidf.transform_queries(index, queries, "q", "t")), 3))
    monkeypatch.setattr(tfidf, "SLICE_QUERIES", 3)
    monkeypatch.setattr(tfidf, "SLICE_ENTRIES", 12)
    assert rows(tfidf.search(index, queries, "q", "t", k=3)) == want and len(want) == 60


def test_few_searches_move_no_rows(spark, monkeypatch):
    from civicflow.operators import containment
    items = spark.createDataFrame([(1, "Red anvil", "x"), (1, "Red anvil", "x"), (2, None, "SM_ALL%"), (3, "back\\slash", None), (4, None, None)],
                                  "id long, a string, b string")
    searches = spark.createDataFrame([(q,) for q in ("red", "RED", "l_", "%", "", None, "\\", "none")], "q string")
    found = lambda: containment.search_hits(items, ["a", "b"], searches, "q")
    rows = lambda df: sorted(map(str, df.select("id", "a", "b", "query").collect()))
    assert "Exchange" not in found()._jdf.queryExecution().sparkPlan().toString() and "Join" not in found()._jdf.queryExecution().sparkPlan().toString()
    few = rows(found())
    monkeypatch.setattr(containment, "FEW_SEARCHES", 0)
    assert rows(found()) == few and len(few) == 2 + 2 + 4 + 1


def test_a_key_is_drawn_by_one_task(spark, tmp_path):
    from civicflow.operators.keys import KeyTable
    sc = spark.sparkContext
    sc.setJobGroup("keys-test", "one key")
    try:
        KeyTable(spark, str(tmp_path / "keys")).add_version(1)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("keys-test") for s in told.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) == 1


def directory(spark):
    rows = [(i, f"N{i}", f"98{i}", ["Chennai", "Madurai", "Delhi"][i % 3], ["Criminal", "Civil"][i % 2], float(i)) for i in range(9)]
    return spark.createDataFrame(rows, "lawyer_id long, name string, mobile string, location string, practice_area string, "
                                       "experience_years double")


def chat(spark):
    """Conversations that reach every rule; texts of legal turns are those of examples."""
    rows = []
    for c in range(8):
        script = ["good morning to you", "fraud theft salary case0" if c % 2 else "nothing of that kind at all",
                  "they will kill me please help" if c % 3 else "what can I do now then", "I live in madurai now please",
                  "ok", "   ", "dowry salary theft office case2 please"]
        rows += [(c, t, 100 + c, x) for t, x in enumerate(script)]
    return (spark.createDataFrame(rows, "conv_id long, turn long, user_id long, text string")
            .withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)))


def test_streamed_turns_answer_like_the_batch(spark):
    docs, places, turns = corpus(spark), directory(spark), chat(spark)
    laws = docs.select("doc_id", F.concat(F.lit("IPC "), F.col("doc_id").cast("string")).alias("law"))
    index = SavedIndex(spark, folder("idx"))
    index.append(docs, "all")
    source, path = folder("turns"), folder("stream")
    name = "t" + path.rsplit("-", 1)[1]
    drops = [turns.where("turn < 2"), turns.where("turn between 2 and 3"), turns.where("turn > 3")]
    for i, drop in enumerate(drops):  # every drop is read by new queries: a restart each time
        drop.repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1 if i == 1 else 10).parquet(source)
        TriageStream(spark, path, name, index, laws, places).run(stream)
    job = TriageStream(spark, path, name, index, laws, places)
    job.answer_batch(spark.createDataFrame([], "conv_id long").withColumn("late", F.lit(False)), 0)  # a replayed batch
    real = turns.where(F.trim("text") != "")
    want = render_replies(triage.triage(spark, real, docs.join(laws, "doc_id"), places, index=index.load(),
                                        keep=("user_id", "text", "ts")), places)
    got = job.replies.read()
    key = lambda df: sorted(map(str, map(tuple, df.select(*sorted(want.columns)).collect())))
    assert key(got) == key(want) and got.count() == 48
    assert {r["branch"] for r in got.select("branch").distinct().collect()} >= {"greet", "emotional", "legal", "ask_location",
                                                                             "actions", "lawyer"}
    log = job.chats.read()
    assert log.count() == 48 and log.where("reply is null or message is null or user_id is null or dt is null").count() == 0


def test_conversations_expire(spark):
    """Event-time gaps start a conversation anew; state goes when the watermark has passed."""
    at = lambda m: 1_700_000_000 + 60 * m
    long_text, source, name = "one two three four", folder("exp"), "exp" + folder("n").rsplit("-", 1)[1]
    rows = [(1, 0, at(0)), (1, 1, at(5)), (1, 2, at(50)), (2, 0, at(1)), (1, 3, at(55)), (3, 0, at(600)), (3, 1, at(601))]
    schema = ("conv_id long, turn long, user_id long, text string, ts timestamp, lang string, score double, hit_doc long, "
              "hit_law string, short boolean, legal boolean, severe boolean")
    full = [(c, t, 7, long_text, s, "english", 0.9, 1, "cyber", False, True, False) for c, t, s in rows]
    out = folder("expout")
    for i, part in enumerate((full[:4], full[4:5], full[5:6], full[6:])):
        (spark.createDataFrame(part, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
         .select(*[f.split()[0] for f in schema.split(", ")]).coalesce(1).write.mode("append").parquet(source))
        q = (ds.dialogue_stream(spark.readStream.schema(schema).parquet(source), ("text",), idle_minutes=30, delay="5 minutes")
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", ds.checkpoint_location(spark, name))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(300)
        states = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else None
    got = {(r.conv_id, r.turn): (r.stage_in, r.branch) for r in spark.read.parquet(out).collect()}
    assert got[(1, 0)] == ("start", "greet") and got[(1, 1)] == ("investigating", "legal")
    assert got[(1, 2)] == ("start", "greet") and got[(1, 3)] == ("investigating", "legal")  # 45 idle minutes
    assert got[(3, 1)] == ("investigating", "legal") and len(got) == 7
    assert states == 1  # conversations 1 and 2 were removed


def test_texts_move_as_packed_blocks(spark, monkeypatch):
    import random
    rng = random.Random(8)
    words = [f"word{i}" for i in range(600)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.01)), 599)] for _ in range(n))
    rows = [(i, text(rng.randrange(40, 200))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, text(60)), (11, "a b"), (400, ""), (401, None)]  # ids with several texts, texts without terms
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(i, text(rng.randrange(1, 9))) for i in range(40)] + [(50, "nothing known"), (51, None)], "q long, t string")
    index = tfidf.build_index(docs, "doc_id", "text")
    packed = tfidf.pack(index, 40, 310)
    assert packed.n_docs.first()["n"] == index.n_docs.first()["n"] == 305.0
    moved = packed.blocks.agg(F.sum(F.octet_length("docs") + F.octet_length("terms") + F.octet_length("posts"))).first()[0]
    assert packed.blocks.count() <= 12 and moved < 6 * index.postings.count()  # a row of numbers and a text each before
    found = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 8), r["rank"]) for r in df.collect())
    scores = tfidf.cosine_scores(index, tfidf.transform_queries(index, queries, "q", "t"))
    for k in (1, 4):
        want = found(tfidf.top_k(scores, k))
        assert found(tfidf.search(packed, queries, "q", "t", k=k)) == want and len(want) > 39 * k
    monkeypatch.setattr(tfidf, "SLICE_QUERIES", 7)
    monkeypatch.setattr(tfidf, "SLICE_ENTRIES", 70)
    monkeypatch.setattr(tfidf, "EXPAND_CHUNK", 5)
    monkeypatch.setattr(tfidf, "MAX_QUERY_BLOCK", 9)
    monkeypatch.setattr(tfidf, "PACK_ROWS", 1)
    assert found(tfidf.search(packed, queries, "q", "t", k=4)) == want


def test_blocks_follow_the_distinct_texts(spark):
    docs = spark.createDataFrame([(i, f"shared own{i}") for i in range(30)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"shared own{i % 4}") for i in range(40)], "q long, t string")
    index = tfidf.build_index(docs, "doc_id", "text")
    found = tfidf.search(index, queries, "q", "t", n_docs=30, n_queries=5_000_000)  # 50 query blocks for four texts before
    sides = re.findall(r"hashpartitioning\(qb#\d+, cb#\d+, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().sparkPlan().toString())
    assert len(sides) == 2 and max(map(int, sides)) <= 12
    assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == [(i, i % 4) for i in range(40)]


def test_packed_version_scores_like_a_rebuild(spark, monkeypatch):
    from civicflow.streaming import triage_stream
    docs = corpus(spark)
    index = SavedIndex(spark, folder("packed"))
    index.append(docs.where("doc_id < 30").repartition(20), "build")
    index.append(docs.where("doc_id >= 20"), "more")  # 20 to 29 are there already
    index.append(spark.createDataFrame([(70, "zz later"), (70, "office fraud office"), (71, ""), (None, "x"), (72, None)], docs.schema), "odd")
    all_docs = docs.union(spark.createDataFrame([(70, "office fraud office"), (71, "")], docs.schema))
    whole, packed = tfidf.build_index(all_docs, "doc_id", "text"), index.packed()
    rows = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    assert index.version().n_docs == 62 and rows(index.load().postings, "doc_id", "term", "w") == rows(whole.postings, "doc_id", "term", "w")
    queries = spark.createDataFrame([(1, "cyber fraud case3"), (2, "office phone office"), (3, "unknown words"), (4, None), (5, "case1")], "q long, t string")
    want = rows(tfidf.top_k(tfidf.cosine_scores(whole, tfidf.transform_queries(whole, queries, "q", "t")), 5), "query_id", "doc_id", "score", "rank")
    assert rows(tfidf.search(packed, queries, "q", "t", k=5), "query_id", "doc_id", "score", "rank") == want and len(want) == 15
    assert packed.weighed.count() > 12  # more blocks than the scorer has groups of them
    again = index.packed()  # kept once a version
    assert again.weighed.inputFiles() == packed.weighed.inputFiles() and len(index.packs.snapshot()) == 1
    # an append packs texts where they are read, and a stream's batch with many terms takes the packed blocks
    plan = tfidf.packed_where_read(docs.selectExpr("doc_id", "split(text, ' ') AS terms"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    turns = spark.createDataFrame([(1, 0, 1, "hello there friend"), (1, 1, 1, "cyber fraud case3"), (2, 0, 2, " ")],
                                  "conv_id long, turn long, user_id long, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    laws = all_docs.select("doc_id", F.lit("IPC 354").alias("law"))
    job = TriageStream(spark, folder("job"), "job", index, laws, directory(spark))
    few = rows(job.scored(turns), "conv_id", "turn", "score", "legal")
    monkeypatch.setattr(triage_stream, "FEW_TERMS", 0)
    monkeypatch.setattr(index, "load", lambda version=None, terms=None, f=index.load: f(version) if terms is None else 1 / 0)
    assert rows(job.scored(turns), "conv_id", "turn", "score", "legal") == few and len(few) == 2


def test_first_copies_are_kept_in_place(spark, monkeypatch):
    from civicflow.operators import common
    data = spark.createDataFrame([(5, "a"), (1, "a"), (1, "a"), (1, "b"), (3, "b"), (2, None), (None, "c"), (None, "a"), (9, "d"), (1, "d")], "id long, k string")
    want = sorted(map(tuple, common.keep_first(data, F.col("k"), "id").collect()))
    kept = common.keep_first_in_place(data, F.col("k"), "id")
    assert sorted(map(tuple, kept.collect())) == want == [(1, "a"), (1, "a"), (1, "b"), (1, "d")]
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "broadcast_checked", lambda df: df)
    assert sorted(map(tuple, common.keep_first_in_place(data, F.col("k"), "id").collect())) == want
