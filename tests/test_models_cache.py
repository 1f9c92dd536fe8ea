"""Calibrated classifier, its place in the dialogue, stored predictions and the bucketed vector cache."""
import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from civicflow.operators import calibrated, encoder, report
from civicflow.operators.vector_cache import VectorCache
from civicflow.plans import triage


def test_sigmoid_is_the_likelihood_optimum(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * m - 0.5)))).astype(float)
    s = calibrated.fit_sigmoid(spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, y)], "margin double, label double"))
    n1, n0 = y.sum(), 400 - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(s.a * m + s.b))
    assert abs(((t - p) * m).sum()) < 1e-3 and abs((t - p).sum()) < 1e-3 and s.a < -1  # gradient is zero
    apart = calibrated.fit_sigmoid(spark.createDataFrame([(float(i), float(i > 0)) for i in (-3, -2, 2, 3)], "margin double, label double"))
    assert math.isfinite(apart.a) and math.isfinite(apart.b)


@pytest.fixture(scope="module")
def severe(spark):
    rng = random.Random(2)
    bad, fine = ["knife", "beaten", "hurt", "threat", "blood"], ["rent", "form", "letter", "fee", "date"]
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        words = [rng.choice(bad if (rng.random() < 0.85) == bool(y) else fine) for _ in range(4)] + ["my", "case"]
        rows.append((i, " ".join(words), y))
    rows += [(900, None, 1), (901, "", 0), (902, "rent", None)]
    data = spark.createDataFrame(rows, "id long, text string, label int")
    return data, calibrated.fit_calibrated_svc(data.where("id % 4 != 0 or id >= 900"), "id", num_features=1 << 10, max_iter=20)


def test_calibrated_probabilities(spark, severe, tmp_path):
    data, model = severe
    held = model.score(data.where("id % 4 = 0 and id < 900"))
    rows = held.collect()
    assert np.mean([(r["p"] > 0.5) == bool(r["label"]) for r in rows]) > 0.85
    error = calibrated.calibration_error(held).first()
    assert error["n"] == len(rows) and error["ece"] < 0.15 and error["brier"] < 0.12
    p = model.score(data.where("id >= 900")).collect()
    assert [r["p"] is None for r in p] == [True, False, False] and held.columns == ["id", "text", "label", "p"]
    model.save(str(tmp_path / "m"))
    again = calibrated.CalibratedSVC.load(str(tmp_path / "m"))
    assert [round(r["p"], 9) for r in again.score(data.where("id < 20")).orderBy("id").collect()] == [
        round(r["p"], 9) for r in model.score(data.where("id < 20")).orderBy("id").collect()]
    history = [r["objective"] for r in model.training_history().orderBy("iteration").collect()]
    assert len(history) > 2 and history[-1] < history[0] and again.history == model.history


def test_classifiers_score_after_an_observation(spark):
    """The session cannot be serialised once it has observed a query; models must not bring it to the tasks."""
    from pyspark.sql import Observation
    from civicflow.operators import models
    spark.range(5).observe(Observation("seen"), F.count(F.lit(1))).collect()
    rows = [(i, f"{'knife' if i % 2 else 'rent'} my case {i % 3}", float(i % 2)) for i in range(20)]
    data = spark.createDataFrame(rows, "id long, text string, label double")
    for fitted in (models.fit_text_classifier(data, max_iter=5), models.text_classifier(max_iter=5).fit(data)):
        assert [r["prediction"] for r in fitted.transform(data).orderBy("id").collect()] == [r[2] for r in rows]
    calibrated_model = calibrated.fit_calibrated_svc(data, "id", folds=2, max_iter=5, num_features=1 << 8)
    assert all((r["p"] > 0.5) == (r["label"] > 0) for r in calibrated_model.score(data).collect())


def test_classifier_trains_on_even_partitions(spark, tmp_path, monkeypatch):
    """The classifier goes over its rows in every iteration: one large file among small ones is not one task's work."""
    from civicflow.operators import models
    words = {"en": "the rent is due", "de": "die miete ist hoch", "fr": "le loyer est cher"}
    rows = [(i, f"{words[lang]} {i % 7} {i}", lang) for i in range(400) for lang in [sorted(words)[i % 3]]]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "no language", None)], "doc_id long, text string, lang string")
    path = str(tmp_path / "documents.parquet")
    docs.where("doc_id < 370 or doc_id >= 900").coalesce(1).write.parquet(path)
    docs.where("doc_id >= 370 and doc_id < 900").repartition(7).write.mode("append").parquet(path)
    seen, fit = [], models.IDF.fit

    def counted(self, tf):
        seen.extend(r["count"] for r in tf.groupBy(F.spark_partition_id()).count().collect())
        return fit(self, tf)
    monkeypatch.setattr(models.IDF, "fit", counted)
    got = models.complaint_type_job(spark, str(tmp_path)).collect()
    assert sum(seen) + len(got) == 400 and len(got) > 20 and all(r["lang"] == r["predicted_lang"] for r in got)
    cores = spark.sparkContext.defaultParallelism
    assert len(seen) == models.PARTS_PER_CORE * cores and max(seen) < 1.5 * min(seen)
    size = sum(len(t) for _, t, _ in rows) + len("no language")
    monkeypatch.setattr(models, "PART_BYTES", 100)  # more text, more partitions
    assert size <= 100 * models.training_parts(docs) < size + 100 * cores
    assert models.training_parts(docs.where("doc_id = 900")) == models.PARTS_PER_CORE * cores


def test_dialogue_uses_the_model_and_another_matcher(spark, severe):
    _, model = severe
    corpus = spark.createDataFrame([(1, "landlord keeps the deposit money", "IPC 354"), (2, "salary was not paid at all", "IT Act 66E")],
                                   "doc_id long, text string, law string")
    directory = spark.createDataFrame([(i, f"N{i}", "98", "Pune", "Civil", 1.0) for i in range(5)],
                                      "lawyer_id long, name string, mobile string, location string, practice_area string, experience_years double")
    turns = [(c, t, x) for c, last in enumerate(("knife threat blood hurt", "rent fee date police"))
             for t, x in enumerate(("hello to you all", "landlord keeps the deposit money", last))]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    branch = lambda **k: {(r["conv_id"], r["turn"]): r["branch"] for r in triage.triage(spark, turns, corpus, directory, **k).collect()}
    words = branch()
    assert words[(0, 2)] == "actions" and words[(1, 2)] == "ask_location"      # keywords: "police"
    trained = branch(severity=model)
    assert trained[(0, 2)] == "ask_location" and trained[(1, 2)] == "actions"  # the model's gate

    def by_vectors(texts):  # nearest example by dense vectors
        from civicflow.operators.vectors import knn_top_k
        q = encoder.hashed_encoder(texts.withColumn("n", F.xxhash64("query_id")), "text")
        c = encoder.hashed_encoder(corpus, "text")
        top = knn_top_k(q, "n", "embedding", c, "doc_id", "embedding", k=1, q_blocks=1, c_blocks=2).withColumnRenamed("query_id", "n")
        return top.join(q.select("n", F.col("query_id")), "n").select("query_id", "doc_id", "score")

    vector = triage.triage(spark, turns, corpus, directory, matcher=by_vectors).collect()
    assert {(r["conv_id"], r["turn"]): r["branch"] for r in vector} == words
    assert all(abs(r["score"] - 1) < 1e-6 and r["hit_doc"] == 1 for r in vector if r["turn"] == 1)


def test_evaluation_agrees_with_mllib(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 4)), (rng.dirichlet(np.ones(4))).tolist()) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, probabilities array<double>")
    got = {r["class_name"]: r for r in report.evaluation(df).collect()}
    from pyspark.ml.functions import array_to_vector
    ml = df.select(F.col("label").cast("double").alias("label"), report.argmax_index(F.col("probabilities")).cast("double").alias("prediction"),
                   array_to_vector("probabilities").alias("probability"))
    ask = lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(ml)
    assert got["accuracy"]["f1"] == pytest.approx(ask("accuracy"), abs=1e-6)
    assert got["weighted avg"]["f1"] == pytest.approx(ask("f1"), abs=1e-6)
    assert got["weighted avg"]["precision"] == pytest.approx(ask("weightedPrecision"), abs=1e-6)
    assert got["log loss"]["f1"] == pytest.approx(ask("logLoss"), abs=1e-6) and got["log loss"]["support"] == 300


def test_neighbours_hold_few_scores_at_once(monkeypatch):
    """A block pair is multiplied in slices: the same neighbours, whatever the slices, and bounded memory."""
    import tracemalloc
    import pandas as pd
    from civicflow.operators import vectors
    rng = np.random.default_rng(3)
    near = rng.integers(-2, 3, size=(900, 4)).astype(float)  # many ties, some vectors of zeros
    frames = lambda v: (pd.DataFrame({"query_id": np.arange(len(v)), "vec": list(v)}), pd.DataFrame({"doc_id": np.arange(len(v)), "vec": list(v)}))
    rows = lambda d: [(q, c, round(s, 9)) for q, c, s in d.itertuples(index=False)]
    whole = rows(vectors._local_top_k(5, True)(None, *frames(near)))
    monkeypatch.setattr(vectors, "SLICE_ENTRIES", 1000)
    monkeypatch.setattr(vectors, "SLICE_COLUMNS", 70)
    assert rows(vectors._local_top_k(5, True)(None, *frames(near))) == whole
    monkeypatch.undo()
    q, c = frames(rng.normal(size=(6000, 8)))
    tracemalloc.start()
    vectors._local_top_k(5, True)(None, q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # a product of the whole blocks alone is 288 MB


def test_encoder_takes_the_norm_once_a_row(spark):
    texts = spark.createDataFrame([(1, "knife knife rent"), (2, ""), (3, "a b")], "id long, text string")
    coded = encoder.hashed_encoder(texts, "text")
    assert "lambdafunction" not in coded._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: sorted(x for x in r["embedding"] if x) for r in coded.collect()}
    assert got[1] == pytest.approx([1 / 5 ** 0.5, 2 / 5 ** 0.5]) and got[2] == got[3] == []


def test_cache_moves_only_new_texts(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text number {i % 40}" if i % 11 else None) for i in range(100)], "id long, text string")
    cache = VectorCache(spark, str(tmp_path / "c"), buckets=8)
    cache.add(texts.where("id < 30"), "text")
    n = cache.rows().count()
    plan = cache.missing(texts, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "LeftAnti" in plan  # the texts' own shuffle
    cache.add(texts, "text")
    cache.add(texts, "text")
    assert n < cache.rows().count() == texts.where("text is not null").select("text").distinct().count()
    found = cache.vectors(texts, "text").collect()
    assert len(found) == 100 and all((r["embedding"] is None) == (r["text"] is None) for r in found)
    other = VectorCache(spark, str(tmp_path / "c"), "model-2", buckets=8)
    assert other.rows().count() == 0
    other.add(texts, "text", encoder.model_encoder(lambda: lambda batch: np.ones((len(batch), 3))))
    assert {len(r["embedding"]) for r in other.rows().collect()} == {3} and len(cache.rows().first()["embedding"]) == 1024
