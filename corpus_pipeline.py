"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, sampled segmentations.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; every stage but the
last returns the columns of ``docs`` in their order. ``run`` writes each stage's result to the shared
checkpoint folder and reads it back for the next one.

Defined results, besides those of the operators: rows with a null id are filtered by quality and deduped
by line, and then kept, as nothing can name them; rows repeated under one id share its fate; an empty table
gives an empty result; extra columns pass through (a column ``n_chars`` follows a shortened text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm import decontaminate, line_windows, near_dups, piece_samples, quality
from civicflow.llm.frames import files_for, in_files, stored, table
from civicflow.llm.lattice import load_vocabulary

SAMPLES = 2  # segmentations of each document
NEAR = (4, 5)  # near-duplicates: linked if 5 * intersection >= 4 * union


def _files(docs: DataFrame) -> int:
    """Files that the documents are worth: partitions of a few rows are written together."""
    return files_for(docs.sparkSession, *docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first())


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives ``quality.CUT`` or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return (quality.score(docs, model, out="_quality_score").where(F.col("_quality_score") >= quality.CUT)
            .select(*docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, or parts of long lines, of repeated windows; a document that loses all its text goes.

    What near copies share with each other is not cut here: the next stage drops all of them but one, and could not
    tell the fragments that cutting would leave.
    """
    copies = near_dups.near_duplicates(docs, threshold=NEAR).select("doc_id", "component_id")
    files = _files(docs)
    out = line_windows.remove_repeated_lines(docs, fine=True, groups=stored(copies, files), files=files)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    lost = (F.col("_removed") > 0) & (F.trim("text") == "")
    return in_files(out.where(~F.coalesce(lost, F.lit(False))).select(*docs.columns), files)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate component."""
    dropped = near_dups.near_duplicates(docs, threshold=NEAR).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
    return in_files(docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti"), _files(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    benchmark, files = table(spark, sf_dir, "benchmark", ["item_id", "text"]), _files(docs)
    hit = decontaminate.contamination(docs, benchmark, files=max(files, _files(benchmark)))
    hit = hit.select(F.col("id").alias("_hit"), F.col("key").alias("_hit_key"))
    text_key = F.unhex(F.md5(F.col("text").cast("binary")))
    return in_files(docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]) & (text_key == hit["_hit_key"]), "left_anti"), files)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``SAMPLES`` distinct sampled segmentations of each document: ids, log probability, inclusion."""
    return piece_samples.sample_segmentations(docs, load_vocabulary(), SAMPLES)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", segmentations),
]

# Quality scores, near-duplicate sampling and sampled segmentations are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
