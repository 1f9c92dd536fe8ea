"""Scans: Parquet tables, CSV corpora with pandas-style missing tokens, guards.

Every reader takes an explicit schema (never inference) and returns a lazy
DataFrame, so Catalyst can prune columns and push filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.operators.common import dense_index

# The strings pandas.read_csv treats as missing by default.
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                    "n/a", "nan", "null"]

COMPLAINT_SCHEMA = T.StructType([T.StructField("text", T.StringType(), True),
                                 T.StructField("law", T.StringType(), True),
                                 T.StructField("abuse_type", T.StringType(), True)])
DIRECTORY_SCHEMA = T.StructType([T.StructField("lawyer_id", T.LongType(), True),
                                 T.StructField("name", T.StringType(), True),
                                 T.StructField("mobile", T.StringType(), True),
                                 T.StructField("location", T.StringType(), True),
                                 T.StructField("practice_area", T.StringType(), True),
                                 T.StructField("experience_years", T.DoubleType(), True)])
LABELLED_TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType(), True),
                                     T.StructField("label", T.IntegerType(), True)])


class MissingInput(FileNotFoundError):
    """Raised when a required input is absent and not allowed to be."""


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path (or a glob) names anything in the file system Spark reads it from."""
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _csv_by_name(spark: SparkSession, path: str, schema: T.StructType, names: dict[str, str]) -> DataFrame:
    """The columns of ``schema`` picked from a header CSV by name, cast to their types.

    ``names`` maps other header texts to schema names; case and blanks around a header do not matter, other
    columns are ignored, and a missing one is an error, as is a file whose header differs from the others'.
    A file with quoted line breaks is one task: give large inputs as many files.
    """
    raw = (spark.read.option("header", "true").option("multiLine", "true").option("enforceSchema", "false")
           .option("escape", '"').option("quote", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    key = lambda c: " ".join(c.lstrip("\ufeff").lower().split())
    known = {key(k): v for k, v in names.items()} | {key(f.name): f.name for f in schema.fields}
    at = {known[key(c)]: c for c in reversed(raw.columns) if key(c) in known}
    missing = [f.name for f in schema.fields if f.name not in at]
    if missing:
        raise MissingInput(f"{path}: no column for {', '.join(missing)} in header {raw.columns}")
    column = lambda name: F.col("`" + at[name].replace("`", "``") + "`")
    picked = raw.select(*[column(f.name).alias(f.name) for f in schema.fields], F.struct(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("_place"))
    clean = normalise_na(picked)
    return clean.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                          for f in schema.fields], "_place")


def _file_ordered(df: DataFrame, row_id: str) -> DataFrame:
    """``row_id`` counts rows by file path, then by their order in the file, whatever sizes the files have."""
    out = dense_index(df, "_place", row_id)
    return out.select(F.col(row_id).cast("long").alias(row_id), *[c for c in df.columns if c != "_place"])


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin to the default parallelism when the scan yields fewer
    splits (a single-row-group file is one task). A no-op on large inputs,
    which already have at least that many splits; filters and column pruning
    still reach the scan below the repartition."""
    sc = df.sparkSession.sparkContext
    n = sc.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


# Tables whose rows carry whole texts: per-row work on them (tokenising,
# regex tests, hashing) is CPU-heavy, so a single-split file is spread.
TEXT_TABLES = frozenset({"documents", "conversations", "pages", "benchmark"})


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               parallel: bool | None = None) -> DataFrame:
    """A Parquet table; ``columns`` prunes the scan's ReadSchema.

    ``parallel`` (default: text tables only) spreads a scan that yields fewer
    splits than the default parallelism. For short-row tables the extra
    round-robin shuffle costs more than the parallel per-row work saves.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if parallel is None:
        parallel = name in TEXT_TABLES
    return spread(df) if parallel else df


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count from Parquet footers (cheap); used only to size blocks."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").count()


def normalise_na(df: DataFrame, columns: list[str] | None = None,
                 tokens: list[str] | None = None) -> DataFrame:
    """Turn pandas' missing-value tokens into real nulls."""
    toks = PANDAS_NA_TOKENS if tokens is None else tokens
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.when(F.col(c).isin(toks), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def read_csv_corpus(spark: SparkSession, path: str, schema: T.StructType = COMPLAINT_SCHEMA,
                    allow_missing: bool = False, row_id: str = "row_id") -> DataFrame:
    """Header CSV with quoted multi-line fields, columns by name; adds an ingest ``row_id``.

    ``row_id`` follows (file path, place in the file), so "first row wins" rules do not depend on file
    sizes. Write the result to Parquet once and use that table from then on.
    """
    if not _exists(spark, path):
        if allow_missing:
            return empty_frame(spark, T.StructType([T.StructField(row_id, T.LongType(), False)] + schema.fields))
        raise MissingInput(path)
    return _file_ordered(_csv_by_name(spark, path, schema, {}), row_id)


# The directory's spreadsheet headers.
DIRECTORY_HEADERS = {"Name": "name", "Mobile Number": "mobile", "Location": "location",
                     "Practice Area": "practice_area", "Experience (Years)": "experience_years"}


def read_directory(spark: SparkSession, path: str, fmt: str = "parquet",
                   allow_missing: bool = False) -> DataFrame:
    """Adviser directory converted from the spreadsheet (Parquet or CSV with its headers).

    CSV columns are found by header; without an id column rows are numbered in file order. A missing
    directory is an error unless ``allow_missing``, which gives an empty table.
    """
    if not _exists(spark, path):
        if allow_missing:
            return empty_frame(spark, DIRECTORY_SCHEMA)
        raise MissingInput(path)
    if fmt == "csv":
        id_field = DIRECTORY_SCHEMA.fields[0].name
        rest = T.StructType(DIRECTORY_SCHEMA.fields[1:])
        return _file_ordered(_csv_by_name(spark, path, rest, DIRECTORY_HEADERS), id_field)
    return spark.read.schema(DIRECTORY_SCHEMA).parquet(path)


def read_labelled_text(spark: SparkSession, path: str, strict_parity: bool = False,
                       allow_missing: bool = False) -> DataFrame:
    """S3: (text, label) CSV. Default drops null texts; ``strict_parity``
    reproduces ``astype(str)`` where a missing text becomes the string 'nan'."""
    if not _exists(spark, path):
        if allow_missing:
            return empty_frame(spark, LABELLED_TEXT_SCHEMA)
        raise MissingInput(path)
    df = _csv_by_name(spark, path, LABELLED_TEXT_SCHEMA, {}).drop("_place")
    if strict_parity:
        return df.withColumn("text", F.coalesce(F.col("text"), F.lit("nan")))
    return df.dropna(subset=["text"])
