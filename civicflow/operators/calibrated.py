"""A linear support-vector classifier whose margins are calibrated to probabilities, and its evaluation.

Calibration is cross-fitted: the rows are dealt to ``FOLDS`` by hash of their id, each fold is scored by a classifier
that was fitted without it, and one sigmoid p = 1 / (1 + exp(a m + b)) is fitted to all these margins by Newton
steps, each an aggregate over them (smoothed targets, so that separable data keep finite slopes). The classifier
that is kept is fitted on all rows. Only sums reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.codes import md5_bucket
from civicflow.operators.models import NUM_FEATURES, _feature_stages, without_summary
from civicflow.session import cut_lineage

FOLDS = 5
NEWTON_STEPS = 30
BINS = 10


@dataclass
class Sigmoid:
    a: float
    b: float

    def of(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(F.least(F.greatest(margin * self.a + self.b, F.lit(-700.0)), F.lit(700.0))))


def fit_sigmoid(scored: DataFrame, margin: str = "margin", label: str = "label") -> Sigmoid:
    """The sigmoid of greatest likelihood for margins with labels 0 and 1, with targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2)."""
    n = scored.agg(F.sum(F.col(label)).alias("n1"), F.sum(1 - F.col(label)).alias("n0")).first()
    n1, n0 = float(n["n1"] or 0), float(n["n0"] or 0)
    target = F.when(F.col(label) > 0, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))
    m = F.col(margin)
    s = Sigmoid(0.0, math.log((n0 + 1) / (n1 + 1)))

    def sums(at: Sigmoid) -> tuple:
        z = m * at.a + at.b
        p, d = at.of(m), target - at.of(m)
        # the loss t z + log(1 + exp(-z)) without overflow
        loss = target * z + F.when(z > 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z)))
        w = p * (1 - p)
        r = scored.agg(F.sum(loss), F.sum(d * m), F.sum(d), F.sum(w * m * m), F.sum(w * m), F.sum(w)).first()
        return tuple(float(x or 0) for x in r)

    loss, ga, gb, haa, hab, hbb = sums(s)
    for _ in range(NEWTON_STEPS):
        haa, hbb = haa + 1e-10, hbb + 1e-10
        det = haa * hbb - hab * hab
        if abs(ga) + abs(gb) < 1e-7 * max(n1 + n0, 1) or det <= 0:
            break
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-10:
            new = Sigmoid(s.a + step * da, s.b + step * db)
            got = sums(new)
            if got[0] < loss + 1e-4 * step * (ga * da + gb * db):
                break
            step /= 2
        if step <= 1e-10:
            break
        s, (loss, ga, gb, haa, hab, hbb) = new, got
    return s


@dataclass
class CalibratedSVC:
    stages: PipelineModel
    sigmoid: Sigmoid
    history: list[float]  # the kept classifier's objective after each iteration

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` with the calibrated probability of label 1 (null for a null text)."""
        text = self.stages.stages[0].getInputCol()
        scored = self.stages.transform(df.withColumn("_given", F.col(text)).withColumn(text, F.coalesce(text, F.lit(""))))
        p = self.sigmoid.of(F.element_at(vector_to_array(F.col("rawPrediction")), 2))
        return scored.select(*[F.col("_given").alias(c) if c == text else F.col(c) for c in df.columns],
                             F.when(F.col("_given").isNotNull(), p).alias(out))

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        spark = SparkSession.active()
        rows = [(self.sigmoid.a, self.sigmoid.b, self.history)]
        spark.createDataFrame(rows, "a double, b double, history array<double>").write.mode("overwrite").parquet(f"{path}/sigmoid")

    @staticmethod
    def load(path: str) -> CalibratedSVC:
        r = SparkSession.active().read.parquet(f"{path}/sigmoid").first()
        return CalibratedSVC(PipelineModel.load(f"{path}/stages"), Sigmoid(r["a"], r["b"]), list(r["history"]))

    def training_history(self) -> DataFrame:
        """(iteration, objective)."""
        return SparkSession.active().createDataFrame(list(enumerate(self.history)), "iteration int, objective double")


def fit_calibrated_svc(train: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label", folds: int = FOLDS,
                       max_iter: int = 40, reg: float = 0.01, num_features: int = NUM_FEATURES) -> CalibratedSVC:
    """Fit on rows with labels 0 and 1; rows without a text or label are left out."""
    stages = _feature_stages(text_col)
    for st in stages:
        if st.hasParam("numFeatures"):
            st.setNumFeatures(num_features)
    rows = train.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1))
    for st in stages:
        rows = st.transform(rows)
    tf = (rows.select(F.col(label_col).cast("double").alias("label"), "_tf", md5_bucket(F.col(id_col), folds, "fold").alias("fold"))
          .persist(StorageLevel.MEMORY_AND_DISK))
    svc = LinearSVC(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg)
    try:
        parts = []
        for fold in range(folds):
            idf = IDF(inputCol="_tf", outputCol="features").fit(tf.where(F.col("fold") != fold))
            one = without_summary(svc.fit(idf.transform(tf.where(F.col("fold") != fold))))
            scored = one.transform(idf.transform(tf.where(F.col("fold") == fold)))
            parts.append(cut_lineage(scored.select(F.element_at(vector_to_array(F.col("rawPrediction")), 2).alias("margin"), "label")))
        margins = parts[0]
        for p in parts[1:]:
            margins = margins.unionByName(p)
        sigmoid = fit_sigmoid(margins)
        idf = IDF(inputCol="_tf", outputCol="features").fit(tf)
        model = svc.fit(idf.transform(tf))
        history = [float(x) for x in model.summary().objectiveHistory]
        model = without_summary(model)
    finally:
        tf.unpersist()
    return CalibratedSVC(PipelineModel(stages + [idf, model]), sigmoid, history)


def calibration_error(scored: DataFrame, p: str = "p", label: str = "label", bins: int = BINS) -> DataFrame:
    """One row: n, the expected calibration error over equal-width bins, and the Brier score."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = scored.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"),
        F.sum((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("sq"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"),
                   (F.sum("sq") / F.sum("n")).alias("brier"))
