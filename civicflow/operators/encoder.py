"""M5/K2: text -> vector encoding with an incremental, content-keyed cache.

The default encoder is native and needs no model: hashed term counts of the
F6 tokens, L2-normalised, as ``array<float>`` (``HashingTF`` is stateless, so
nothing is gathered on the driver). A user model can be plugged in as a
batch function ``list[str] -> ndarray``; it runs in an iterator pandas UDF
(Arrow batches, the model loaded once per task, never per row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.text import tokens
from civicflow.operators.vectors import cache_delta

DEFAULT_DIM = 1 << 10


def hashed_encoder(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Native default: hashed token counts, L2-normalised, array<float>."""
    tf = HashingTF(inputCol="_enc_tok", outputCol="_enc_tf", numFeatures=dim)
    unit = Normalizer(inputCol="_enc_tf", outputCol="_enc_unit", p=2.0)  # once a row; a zero vector stays
    out = unit.transform(tf.transform(df.withColumn("_enc_tok", tokens(text_col))))
    return out.withColumn(out_col, vector_to_array("_enc_unit", "float32")).drop("_enc_tok", "_enc_tf", "_enc_unit")


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Wrap a model loader as an iterator pandas UDF (``load`` runs once per task)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            vecs = np.asarray(model(s.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vecs))
    return encode


def encode_missing(corpus: DataFrame, id_col: str, text_col: str, cache: DataFrame,
                   encoder: Callable | None = None) -> DataFrame:
    """K2: encode only texts whose SHA-256 is not in ``cache`` (text_sha256,
    embedding); the result is what to append. Appending twice adds nothing."""
    todo = cache_delta(corpus, id_col, text_col, cache.select("text_sha256"))
    texts = todo.join(corpus.select(id_col, text_col), id_col)
    if encoder is None:
        enc = hashed_encoder(texts, text_col)
    else:
        enc = texts.withColumn("embedding", encoder(F.col(text_col)))
    return enc.select("text_sha256", id_col, "embedding")
