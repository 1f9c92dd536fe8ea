"""Evaluation: classification report, argmax, mean log-loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_DECIMALS = 6


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support, plus accuracy, macro and
    weighted averages; 0/0 gives 0.0. Output: class_name, precision, recall, f1, support.

    The only pass over the data is a confusion-count aggregation (partial
    aggregation map side); everything after works on classes x classes rows.
    """
    conf = df.groupBy(F.col(label_col).alias("l"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_label = conf.groupBy(F.col("l").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    cls = (by_label.join(by_pred, "cls", "full_outer")
           .select("cls", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["support", "tp", "predicted"]]))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    per = (cls.withColumn("precision", prec).withColumn("recall", rec)
           .withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0))
                       .otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))))
    totals = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                     F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                     F.sum(F.col("precision") * F.col("support")).alias("wp"),
                     F.sum(F.col("recall") * F.col("support")).alias("wr"),
                     F.sum(F.col("f1") * F.col("support")).alias("wf"))
    r = REPORT_DECIMALS
    rows = per.select(F.col("cls").cast("string").alias("class_name"), F.round("precision", r).alias("precision"),
                      F.round("recall", r).alias("recall"), F.round("f1", r).alias("f1"), "support")
    acc = totals.select(F.lit("accuracy").alias("class_name"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"),
                        F.round(_safe_div(F.col("tp"), F.col("n")), r).alias("f1"), F.col("n").cast("long").alias("support"))
    macro = totals.select(F.lit("macro avg").alias("class_name"), F.round("mp", r).alias("precision"),
                          F.round("mr", r).alias("recall"), F.round("mf", r).alias("f1"),
                          F.col("n").cast("long").alias("support"))
    weighted = totals.select(F.lit("weighted avg").alias("class_name"), F.round(_safe_div(F.col("wp"), F.col("n")), r).alias("precision"),
                             F.round(_safe_div(F.col("wr"), F.col("n")), r).alias("recall"),
                             F.round(_safe_div(F.col("wf"), F.col("n")), r).alias("f1"),
                             F.col("n").cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def argmax_index(probs: Column) -> Column:
    """0-based index of the largest element (first on ties)."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def mean_log_loss(df: DataFrame, prob_col: str, label_col: str) -> DataFrame:
    """Average of -ln(p[label]) over scored rows (p clipped at 1e-15)."""
    p = F.try_element_at(F.col(prob_col), F.col(label_col).cast("int") + 1)
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("log_loss"))


def evaluation(predictions: DataFrame, prob_col: str = "probabilities", label_col: str = "label") -> DataFrame:
    """M6: the report of A9 on stored predictions (a probability for each class 0, 1, ... and the true class), with the
    class taken by A11, and A12 as a row ``log loss`` (its value in ``f1``). Rows without a label are left out."""
    rows = predictions.where(F.col(label_col).isNotNull()).withColumn("_class", argmax_index(F.col(prob_col)))
    loss = mean_log_loss(rows, prob_col, label_col).select(
        F.lit("log loss").alias("class_name"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        F.round("log_loss", REPORT_DECIMALS).alias("f1"))
    n = rows.agg(F.count(F.lit(1)).alias("support"))
    return classification_report(rows, label_col, "_class").unionByName(loss.join(F.broadcast(n)))
