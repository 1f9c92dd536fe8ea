"""Reply rendering, encoder cache, chat-log sinks and streaming counters."""
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from civicflow.operators import encoder
from civicflow.plans.render import render_replies
from civicflow.sources import sinks
from civicflow.sources.literals import LAW_TEXT
from civicflow.streaming import dialogue_stream as ds


def test_render_replies(spark):
    rows = [(1, 0, "tamil", "greet", "general", None), (1, 1, "tamil", "ask_location", "posh_act", None),
            (2, 3, "english", "lawyer", "domestic_violence", 5), (2, 4, "hinglish", "no_lawyer", "general", None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, lang string, branch string, law_key string, "
                                    "lawyer_id long")
    d = spark.createDataFrame([(5, "Asha", "98000", "Chennai", "Criminal", 12.0)],
                              "lawyer_id long, name string, mobile string, location string, practice_area string, "
                              "experience_years double")
    out = {(r.conv_id, r.turn): r.reply for r in render_replies(t, d).collect()}
    assert "வணக்கம்" in out[(1, 0)]
    posh_en = {(k, lg): x for k, lg, x in LAW_TEXT}[("posh_act", "english")]
    assert out[(1, 1)].startswith(posh_en)          # no Tamil POSH text: English fallback
    assert "Asha" in out[(2, 3)] and "12.0 yrs" in out[(2, 3)]
    assert out[(2, 4)] and all(v for v in out.values())


def test_encoder_cache_incremental(spark):
    corpus = spark.createDataFrame([(1, "aa bb cc"), (2, "bb cc dd"), (3, "aa bb cc")], "id long, text string")
    empty = spark.createDataFrame([], "text_sha256 string, embedding array<float>")
    first = encoder.encode_missing(corpus, "id", "text", empty)
    rows = first.collect()
    assert sorted(r.id for r in rows) == [1, 2]
    v = np.array(rows[0].embedding)
    assert abs(np.linalg.norm(v) - 1) < 1e-5
    again = encoder.encode_missing(corpus, "id", "text", first.select("text_sha256", "embedding"))
    assert again.count() == 0


def test_chat_log_append(spark):
    d = tempfile.mkdtemp(prefix="civicflow-log-")
    chats = spark.createDataFrame([(1, "  hi  ", "hello", None), (2, "   ", "x", None),
                                   (None, "help", "ok", None)],
                                  "user_id long, message string, reply string, ts timestamp")
    sinks.append_chat_log(chats, d)
    back = spark.read.parquet(d)
    assert back.count() == 2 and "dt" in back.columns
    assert sorted(r.message for r in back.collect()) == ["help", "hi"]
    assert back.where(F.col("user_id").isNull()).count() == 1   # anonymous chats kept


def test_streaming_counters_and_log(spark):
    src = tempfile.mkdtemp(prefix="civicflow-act-")
    spark.createDataFrame([(1, "search", None), (1, "quiz", 10), (2, "chat", None)],
                          "user_id long, kind string, points long").write.mode("overwrite").parquet(src + "/a")
    spark.createDataFrame([(1, "quiz", 0), (2, "chat", None)],
                          "user_id long, kind string, points long").write.mode("overwrite").parquet(src + "/b")
    stream = spark.readStream.schema("user_id long, kind string, points long").parquet(src + "/*")
    name = "progress_" + os.path.basename(src).replace("-", "_")
    q = (ds.progress_stream(stream).writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", ds.checkpoint_location(spark, name)).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.user_id: tuple(r)[1:] for r in spark.table(name).collect()}
    assert got == {1: (1, 2, 0, 10), 2: (0, 0, 2, 0)}
    chats_src = tempfile.mkdtemp(prefix="civicflow-chats-")
    spark.createDataFrame([(1, "hi", "hello", "2024-01-02 10:00:00")],
                          "user_id long, message string, reply string, ts string") \
        .withColumn("ts", F.to_timestamp("ts")).write.mode("overwrite").parquet(chats_src + "/x")
    cs = spark.readStream.schema("user_id long, message string, reply string, ts timestamp").parquet(chats_src + "/*")
    out = tempfile.mkdtemp(prefix="civicflow-chatlog-")
    qq = ds.chat_log_sink(cs, out, name="chat_" + os.path.basename(out).replace("-", "_"), trigger_once=True)
    qq.awaitTermination(300)
    assert [str(r.dt) for r in spark.read.parquet(out).collect()] == ["2024-01-02"]
