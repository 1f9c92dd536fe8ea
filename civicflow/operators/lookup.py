"""Dimension lookups with fallbacks (law text, reply block, practice)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.text import DEFAULT_LAW
from civicflow.sources.literals import (DEFAULT_PRACTICE, FALLBACK_LANG, law_text_dim, practice_dim,
                                        reply_block_dim)


def with_law_text(df: DataFrame, spark: SparkSession, law_col: str = "law_key", lang_col: str = "lang",
                  out_col: str = "law_text") -> DataFrame:
    """Exact (law, lang) -> (law, english) -> (general, lang) -> (general, english).

    The dimension is a literal of fixed size, so it is broadcast; the four
    probes are four broadcast hash joins in one stage, no shuffle.
    """
    dim = law_text_dim(spark)
    probes = [
        (F.col(law_col), F.col(lang_col)),
        (F.col(law_col), F.lit(FALLBACK_LANG)),
        (F.lit(DEFAULT_LAW), F.col(lang_col)),
        (F.lit(DEFAULT_LAW), F.lit(FALLBACK_LANG)),
    ]
    out = df
    names = []
    for i, (law_e, lang_e) in enumerate(probes):
        d = F.broadcast(dim.select(F.col("law_key").alias(f"_lk{i}"), F.col("lang").alias(f"_lg{i}"),
                                   F.col("law_text").alias(f"_lt{i}")))
        out = (out.withColumn(f"_pk{i}", law_e).withColumn(f"_pg{i}", lang_e)
               .join(d, (F.col(f"_pk{i}") == F.col(f"_lk{i}")) & (F.col(f"_pg{i}") == F.col(f"_lg{i}")), "left")
               .drop(f"_pk{i}", f"_pg{i}", f"_lk{i}", f"_lg{i}"))
        names.append(f"_lt{i}")
    return out.withColumn(out_col, F.coalesce(*[F.col(n) for n in names])).drop(*names)


def with_practice_area(df: DataFrame, spark: SparkSession, law_col: str = "law_key",
                       out_col: str = "practice_area") -> DataFrame:
    """Law key -> practice area, default Civil."""
    d = F.broadcast(practice_dim(spark).select(F.col("law_key").alias("_pm_key"),
                                               F.col("practice_area").alias("_pm_area")))
    return (df.join(d, F.col(law_col) == F.col("_pm_key"), "left")
            .withColumn(out_col, F.coalesce(F.col("_pm_area"), F.lit(DEFAULT_PRACTICE)))
            .drop("_pm_key", "_pm_area"))


def with_reply_variants(df: DataFrame, spark: SparkSession, block_col: str = "block", lang_col: str = "lang",
                        out_col: str = "variants") -> DataFrame:
    """(lang, block) -> variants, falling back to the English block."""
    dim = reply_block_dim(spark)
    exact = F.broadcast(dim.select(F.col("lang").alias("_rl"), F.col("block").alias("_rb"),
                                   F.col("variants").alias("_rv")))
    eng = F.broadcast(dim.where(F.col("lang") == FALLBACK_LANG)
                      .select(F.col("block").alias("_eb"), F.col("variants").alias("_ev")))
    return (df.join(exact, (F.col(lang_col) == F.col("_rl")) & (F.col(block_col) == F.col("_rb")), "left")
            .join(eng, F.col(block_col) == F.col("_eb"), "left")
            .withColumn(out_col, F.coalesce(F.col("_rv"), F.col("_ev")))
            .drop("_rl", "_rb", "_rv", "_eb", "_ev"))
