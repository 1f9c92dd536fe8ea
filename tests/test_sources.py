"""Real input layouts: headers by name, file order, missing inputs, log filter, keys."""


import pytest
from pyspark.sql import functions as F

from civicflow.operators import keys as keys_of
from civicflow.operators.keys import KeyTable
from civicflow.operators.registry import KEYS_CONF, protect, protection_keys
from civicflow.session import get_spark
from civicflow.sources.readers import MissingInput, read_csv_corpus, read_directory, read_labelled_text
from civicflow.streaming.dialogue_stream import chat_log_sink


def test_directory_by_header(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Location,Extra,Name,Experience (Years),Practice Area, mobile number \n"
                                    "Pune,1,Asha,7,Civil,98\nGoa,2,Ravi,,Criminal,97\n")
    got = read_directory(spark, str(tmp_path / "d.csv"), "csv").orderBy("lawyer_id").collect()
    assert [tuple(r) for r in got] == [(0, "Asha", "98", "Pune", "Civil", 7.0), (1, "Ravi", "97", "Goa", "Criminal", None)]


def test_missing_inputs_and_columns_are_errors(spark, tmp_path):
    with pytest.raises(MissingInput):
        read_directory(spark, str(tmp_path / "none"))
    assert read_directory(spark, str(tmp_path / "none"), allow_missing=True).count() == 0
    (tmp_path / "bad.csv").write_text("text,label\nx,1\n")
    with pytest.raises(MissingInput):
        read_csv_corpus(spark, str(tmp_path / "bad.csv"))


def test_corpus_by_header_in_file_order(spark, tmp_path):
    probe = read_csv_corpus.__defaults__[0]
    names = [f.name for f in probe.fields]
    header = ["id", *reversed(names)]
    row = lambda tag: ",".join(["9", *(f"{tag}-{n}" for n in reversed(names))])
    (tmp_path / "a.csv").write_text("\n".join([",".join(header), row("a0"), row("a1")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(header), *[row(f"b{i}") for i in range(5000)]]) + "\n")
    got = read_csv_corpus(spark, str(tmp_path)).orderBy("row_id").limit(3).collect()
    assert [r["row_id"] for r in got] == [0, 1, 2]
    assert [r[names[0]] for r in got] == [f"{t}-{names[0]}" for t in ("a0", "a1", "b0")]


def test_labelled_text_by_header(spark, tmp_path):
    (tmp_path / "l.csv").write_text('label,text\n1,"two\nlines"\n0,\n')
    assert [tuple(r) for r in read_labelled_text(spark, str(tmp_path / "l.csv")).collect()] == [("two\nlines", 1)]


def test_stream_logs_answered_messages_only(spark, tmp_path):
    rows = [("u", "  hi ", "hello"), ("u", "   ", "hello"), ("u", "unanswered", None)]
    (spark.createDataFrame(rows, "user_id string, message string, reply string")
     .withColumn("ts", F.lit("2024-05-01 10:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema("user_id string, message string, reply string, ts timestamp").parquet(str(tmp_path / "in"))
    q = chat_log_sink(stream, str(tmp_path / "log"), name=f"log-{tmp_path.name}", trigger_once=True)
    q.awaitTermination(60)
    assert [r["message"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["hi"]


def test_key_is_required(spark, tmp_path):
    spark.conf.unset(KEYS_CONF)
    with pytest.raises(ValueError):
        protection_keys(spark)
    spark.conf.set(KEYS_CONF, str(tmp_path / "keys"))
    with pytest.raises(ValueError):
        protection_keys(spark).newest()  # no version yet
    assert protection_keys(spark).add_version(1) and not protection_keys(spark).add_version(1)
    assert protection_keys(spark).newest() == 1
    spark.conf.unset(KEYS_CONF)


def test_keys_stay_out_of_plans_and_rotate(spark, tmp_path):
    keys = KeyTable(spark, str(tmp_path / "k"))
    keys.add_version(1)
    ids = spark.createDataFrame([(1, "123456789012"), (2, None), (3, "987654321098")], "u long, gov string")
    first = keys_of.encrypted(ids, keys, F.col("gov"), "cipher").select("u", "cipher", "key_version")
    first.write.parquet(str(tmp_path / "first"))
    keys.add_version(2)
    mixed = spark.read.parquet(str(tmp_path / "first")).unionByName(
        keys_of.encrypted(ids.withColumn("u", F.col("u") + 10), keys, F.col("gov"), "cipher").select("u", "cipher", "key_version"))
    mixed = mixed.unionByName(spark.createDataFrame([(20, "bm90IGEgdG9rZW4=", 1), (21, "eA==", 9)], mixed.schema))
    moved = keys_of.rotated(mixed, keys, "cipher")
    moved.write.parquet(str(tmp_path / "moved"))
    got = {r["u"]: (r["text"], r["key_version"]) for r in keys_of.decrypted(spark.read.parquet(str(tmp_path / "moved")), keys, "cipher", "text").collect()}
    assert got[1] == ("123456789012", 2) and got[13] == ("987654321098", 2) and got[2][0] == "" and got[20] == ("", 1) and got[21] == ("", 9)
    plan = moved._jdf.queryExecution().toString()
    for r in keys.table.read().collect():
        raw = bytes(r["key"])
        assert raw.hex() not in plan.lower() and str(raw[:4]) not in plan and len(raw) == 32


def test_hash_match(spark):
    users = spark.createDataFrame([("a", "pw1"), ("b", "pw2")], "mobile string, password string").select(
        "mobile", F.sha2(F.concat(F.lit("salt"), "password"), 256).alias("password_hash"))
    attempts = spark.createDataFrame([("a", "pw1"), ("a", "pw2"), ("b", "pw2"), ("c", "pw1"), (None, "pw1"), ("a", None)],
                                     "mobile string, password string")
    got = keys_of.hash_match(attempts, users, "mobile", "password", "password_hash", salt="salt")
    assert [r["matches"] for r in got.collect()].count(True) == 2 and got.count() == 6 and "password" not in got.columns


def test_tampered_token_is_rejected(spark):
    df = spark.createDataFrame([(1, "123456789012", "pw")], "user_id long, gov_id string, password string")
    got = protect(df, spark, "password", "gov_id", ["password"]).collect()[0]
    assert got["roundtrip_ok"] and got["tamper_rejected"]


def test_running_session_keeps_its_settings(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert get_spark().conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
