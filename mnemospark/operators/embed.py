"""Text to vector (M1).

``hash_embed`` is the built-in embedder: lower-cased whitespace tokens,
feature hashing into ``buckets`` by the first 32 bits of the token's
md5, token counts, L2 norm.  All native SQL functions; the work is one
``explode`` and one partial aggregate keyed by document, so at most
``buckets`` rows per document and partition cross the shuffle.

``model_embed`` runs a real model: an iterator pandas UDF that loads
the model once per Python worker and embeds Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BUCKETS = 64
TOKEN_SPLIT = "[ \t\n\r]+"


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: x != "")


def token_bucket(tok: Column, buckets: int = HASH_BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hash_weights(df: DataFrame, id_col: str, text_col: str, buckets: int = HASH_BUCKETS) -> DataFrame:
    """Sparse form: ``id, bucket, weight`` (non-zero buckets, unit norm)."""
    toks = df.select(id_col, F.explode(tokens(text_col)).alias("_tok"))
    counts = (toks.groupBy(id_col, token_bucket(F.col("_tok"), buckets).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("_n")))
    # Norm per document: sum of squares over at most `buckets` rows.
    from pyspark.sql import Window
    w = Window.partitionBy(id_col)
    return counts.select(id_col, "bucket",
                         (F.col("_n") / F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(w))).alias("weight"))


def hash_embed(df: DataFrame, id_col: str, text_col: str, buckets: int = HASH_BUCKETS,
               out_col: str = "embedding") -> DataFrame:
    """Dense form: ``id, embedding array<float>`` of length ``buckets``;
    a document without tokens gets NULL (zero vector, no norm)."""
    sparse = hash_weights(df, id_col, text_col, buckets)
    m = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
    dense = m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)),
                                         lambda b: F.coalesce(F.col("_m")[b], F.lit(0.0)).cast("float"))
                     .alias(out_col))
    return df.select(id_col).join(dense, id_col, "left")


def model_embed(df: DataFrame, text_col: str, load_model: Callable[[], Callable[[list[str]], list]],
                dim: int, out_col: str = "embedding", normalize: bool = True) -> DataFrame:
    """M1 with a real model.  ``load_model()`` runs once per Python worker
    and returns ``encode(list_of_texts) -> list_of_vectors``."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _cached_model(load_model)
        for texts in batches:
            vecs = np.asarray(encode(texts.fillna("").tolist()), dtype=np.float64).reshape(len(texts), dim)
            if normalize:
                n = np.linalg.norm(vecs, axis=1, keepdims=True)
                vecs = np.divide(vecs, n, out=np.zeros_like(vecs), where=n > 0)
            yield pd.Series([v.astype(np.float32) for v in vecs])

    return df.withColumn(out_col, _embed(F.col(text_col)))


_MODELS: dict = {}


def _cached_model(load_model):
    key = id(load_model)
    if key not in _MODELS:
        _MODELS[key] = load_model()
    return _MODELS[key]
