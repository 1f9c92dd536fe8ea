"""Knowledge base: build from laws + articles (A2, F3, F4, U1, K4) and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.text import kb_category
from civicflow.operators.common import first_appearance
from civicflow.operators.containment import search_hits
from civicflow.sources.literals import ARTICLES, KB_DESCRIPTION_TEMPLATE

KB_COLUMNS = ["kb_id", "category", "title", "description", "keywords"]


def law_entries(laws: DataFrame, law_col: str, order_col: str) -> DataFrame:
    """One entry per distinct law; ``kb_id`` = first row of that law (stable)."""
    firsts = first_appearance(laws, law_col, order_col, out_rank="kb_id")
    return firsts.select(F.col("kb_id").cast("long"), kb_category(law_col).alias("category"),
                         F.col(law_col).alias("title"),
                         F.format_string(KB_DESCRIPTION_TEMPLATE, F.col(law_col)).alias("description"),
                         F.lower(F.col(law_col)).alias("keywords"))


def article_entries(spark: SparkSession) -> DataFrame:
    """The seeded articles; negative ids keep them apart from law rows."""
    rows = [(-(i + 1), cat, title, desc, title.lower()) for i, (cat, title, desc) in enumerate(ARTICLES)]
    return spark.createDataFrame(rows, "kb_id long, category string, title string, description string, "
                                       "keywords string")


def build_knowledge_base(spark: SparkSession, laws: DataFrame, law_col: str, order_col: str) -> DataFrame:
    """Law entries UNION ALL articles (duplicates kept)."""
    return law_entries(laws, law_col, order_col).unionByName(article_entries(spark))


def seed_if_absent(new: DataFrame, existing: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``existing``.

    Idempotent: appending the result and calling again yields nothing.
    """
    if existing is None:
        return new
    return new.join(existing.select(*key).distinct(), key, "left_anti")


def search(kb: DataFrame, queries: DataFrame, query_col: str = "query",
           columns: tuple[str, ...] = ("title", "description", "keywords")) -> DataFrame:
    """Hits (query, kb row) for a table of search terms."""
    return search_hits(kb, list(columns), queries, query_col)
