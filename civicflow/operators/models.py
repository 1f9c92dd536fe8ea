"""Model jobs on tables (M1, M3, M4, M5, M6, K3) with MLlib.

Text features are hashed (``HashingTF``: stateless, so no vocabulary is
gathered on the driver) over the same tokens as retrieval (F6) plus word
bigrams (F7), weighted by MLlib's IDF. Classifiers are logistic regression
(binary or multinomial), which exposes the probability column the gates use.
Splits are md5 buckets of the row id (O4), stable under retries.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.codes import md5_bucket
from civicflow.functions.text import SEVERITY_GATE, TOKEN_PATTERN_JVM
from civicflow.operators.common import broadcast_checked, dense_index, first_appearance
from civicflow.operators.report import argmax_index
from civicflow.session import ensure_checkpoint_dir
from civicflow.sources.readers import read_table

NUM_FEATURES = 1 << 16
HOLDOUT_BUCKETS = 10  # bucket 0 of 10 = 10 % validation
PART_BYTES = 32 << 20  # of training text a partition: its term vectors take about three times as much memory
PARTS_PER_CORE = 2


def split(df: DataFrame, id_col: str, seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by md5 bucket of the id."""
    b = md5_bucket(F.col(id_col), HOLDOUT_BUCKETS, seed)
    return df.where(b != 0), df.where(b == 0)


def without_summary(model):
    """A fitted classifier as it is read back from the shared checkpoint folder: the same model without its training
    summary. The summary of a binary classifier holds the session, which goes to the tasks with the model and cannot
    once the session has run an ``Observation``."""
    path = f"{ensure_checkpoint_dir(SparkSession.active()).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


class ScoringLogisticRegression(LogisticRegression):
    """Logistic regression whose models carry no training summary (see ``without_summary``)."""

    def _fit(self, dataset: DataFrame):
        return without_summary(super()._fit(dataset))


def _feature_stages(text_col: str) -> list:
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN_JVM, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_tok", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=NUM_FEATURES),
    ]


def text_classifier(text_col: str = "text", label_col: str = "label", max_iter: int = 25,
                    reg: float = 0.01) -> Pipeline:
    """Tokens + bigrams -> hashed TF -> IDF -> logistic regression."""
    return Pipeline(stages=_feature_stages(text_col) + [
        IDF(inputCol="_tf", outputCol="features"),
        ScoringLogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg,
                                  family="auto"),
    ])


def training_parts(texts: DataFrame, text_col: str = "text") -> int:
    """Partitions for training on ``texts``: as many as their bytes are worth, and equally many for each core. The
    classifier reads its rows some thirty times, and each time waits for the largest partition."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return cores * max(PARTS_PER_CORE, -(-size // (PART_BYTES * cores)))


def fit_text_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                        max_iter: int = 25, reg: float = 0.01, parts: int | None = None) -> PipelineModel:
    """The same model as ``text_classifier().fit(train)``, with each text
    tokenised once.

    A plain pipeline fit reads and tokenises the training texts for the IDF
    pass and again for the classifier's own passes. Here the hashed term
    vectors (label + one sparse vector per row) are persisted once, with
    MEMORY_AND_DISK so large training sets spill instead of failing; a lost
    block is recomputed from its lineage. The IDF and the classifier are then
    fitted from that frame, and the fitted stages are assembled into one
    PipelineModel for scoring. With ``parts`` (see ``training_parts``) the
    texts are first dealt evenly: files and joins leave unlike partitions.
    """
    stages = _feature_stages(text_col)
    if parts:
        train = train.select(text_col, label_col).repartition(parts)
    for st in stages:  # all transformers: no data pass
        train = st.transform(train)
    tf = train.select(label_col, "_tf").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idf = IDF(inputCol="_tf", outputCol="features").fit(tf)
        lr = ScoringLogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg,
                                       family="auto").fit(idf.transform(tf))
    finally:
        tf.unpersist()
    return PipelineModel(stages + [idf, lr])


def save_model(model: PipelineModel, path: str) -> None:
    """K3: persist (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def severity_job(spark: SparkSession, sf: str) -> DataFrame:
    """P(severe) per held-out document (label = toxic); gate > 0.4."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf, "labels", ["doc_id", "toxic"])
    data = docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    train, valid = split(data, "doc_id")
    model = fit_text_classifier(train, parts=training_parts(docs))
    p = F.element_at(vector_to_array(F.col("probability")), 2)
    return (model.transform(valid)
            .select("doc_id", F.round(p, 6).alias("p_severe"), (p > F.lit(SEVERITY_GATE)).alias("is_severe")))


def complaint_type_job(spark: SparkSession, sf: str) -> DataFrame:
    """Multinomial classifier of a document's type (its language
    tag), labels numbered by first appearance and mapped back for output."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"]).dropna(subset=["text", "lang"])
    firsts = first_appearance(docs, "lang", "doc_id").cache()  # label-sized; counted before it is numbered
    index = dense_index(firsts, "first_row", "label_id")
    index = index.cache()  # label-sized; used twice (both directions of the map)
    idx = broadcast_checked(index.select("lang", F.col("label_id").cast("double").alias("label")))
    data = docs.join(idx, "lang")
    train, valid = split(data, "doc_id")
    model = fit_text_classifier(train, parts=training_parts(docs))
    back = broadcast_checked(index.select(F.col("label_id").cast("double").alias("prediction"),
                                          F.col("lang").alias("predicted_lang")))
    return (model.transform(valid).join(back, "prediction", "left")
            .select("doc_id", "lang", "predicted_lang"))


def emotion_job(spark: SparkSession, sf: str) -> DataFrame:
    """Multinomial classifier on stored vectors; per held-out
    row the argmax class and the probability given to the true class."""
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"]).dropna()
    data = emb.select("vec_id", array_to_vector(F.col("embedding")).alias("features"),
                      F.col("label").cast("double").alias("label"))
    train, valid = split(data, "vec_id", seed="42")
    lr = ScoringLogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=0.001)
    model = lr.fit(train)
    probs = vector_to_array(F.col("probability"))
    return (model.transform(valid)
            .select("vec_id", F.col("label").cast("int").alias("label"), argmax_index(probs).alias("prediction"),
                    F.round(F.try_element_at(probs, F.col("label").cast("int") + 1), 6).alias("p_label")))
