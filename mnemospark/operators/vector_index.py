"""K5, stored lists: an index that reads a part of the vectors and says how
much of the exact result it finds.

Rows are kept in lists, one for each centroid; a query reads the lists whose
centroids are nearest (a partition filter) and ranks their rows exactly.  The
centroids are fitted on a bounded sample (``sample_rows``); every row is
indexed.  The number of lists read is not fixed: the exact neighbours of
``calibration_rows`` rows are looked up in the lists, and the least number that
finds the share ``floor`` of them is stored with the index.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

from ..functions import vectors as V
from ..plans.broadcast import checked_broadcast
from . import search as S
from . import vector_batch

MAX_LISTS = 16_384        # centroids on the driver and in each task
SAMPLE_ROWS = 20_000      # rows that the centroids are fitted on
CALIBRATION_ROWS = 200    # rows whose exact neighbours are looked up
FLOOR = 0.95              # share of the neighbours that the lists must hold
NO_LIST = -1              # rows without a comparable vector


@dataclass(frozen=True)
class Settings:
    metric: str
    id_col: str
    vector_col: str
    probes: int
    measured: float
    centroids: np.ndarray
    schema: StructType  # of the rows; an empty index has no file to ask


def _position(vector: Column, metric: str) -> Column:
    """Where a vector lies among the centroids: its direction for cosine."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return V.l2_normalize(x) if metric == "cosine" else x


def _usable(vector: str, dim: int, metric: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.exists(vector, lambda x: x != 0) if metric == "cosine" else F.lit(True)
    return F.coalesce((F.size(vector) == dim) & finite & some, F.lit(False))


def _by_hash(df: DataFrame, id_col: str, seed: int, rows: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(rows)


def build(df: DataFrame, path: str, dim: int, k: int = 10, metric: str = "cosine", id_col: str = "vec_id",
          vector_col: str = "embedding", floor: float = FLOOR, lists: int | None = None,
          sample_rows: int = SAMPLE_ROWS, calibration_rows: int = CALIBRATION_ROWS,
          calibrate_on: Column | None = None) -> Settings:
    """Writes the index of ``df`` to ``path`` and returns its settings.

    ``lists`` is about the square root of the row count by default.  Rows whose
    vector is null, of another length or not finite (for cosine also zero) have
    no distance; they are stored in the list ``NO_LIST``, which no query reads.
    ``calibrate_on`` narrows the rows that serve as calibration queries.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("lists are kept for the metrics 'cosine' and 'l2'")
    spark = df.sparkSession
    good = df.filter(_usable(vector_col, dim, metric))
    total = good.count()
    centroids = np.zeros((0, dim))
    listed = df.withColumn("list", F.lit(NO_LIST))
    if total:
        wanted = min(lists or max(1, round(math.sqrt(total))), MAX_LISTS, total)
        sample = _by_hash(good, id_col, 1, sample_rows).select(
            array_to_vector(_position(F.col(vector_col), metric)).alias("_at"))
        model = KMeans(k=wanted, seed=1, maxIter=10, featuresCol="_at", predictionCol="_list").fit(sample)
        centroids = np.array(model.clusterCenters())
        placed = model.transform(good.withColumn("_at", array_to_vector(_position(F.col(vector_col), metric))))
        placed = placed.withColumn("list", F.col("_list").cast("int")).drop("_at", "_list")
        listed = placed.unionByName(df.filter(~_usable(vector_col, dim, metric)).withColumn("list", F.lit(NO_LIST)))
    # A crowded list is written by several tasks, in ranges of its ids.
    listed.repartitionByRange("list", id_col).write.partitionBy("list").parquet(f"{path}/rows")
    probes, measured = 1, 1.0
    schema = StructType([*df.schema.fields, StructField("list", IntegerType())])
    if total:
        probes, measured = _calibrate(spark.read.schema(schema).parquet(f"{path}/rows"), centroids,
                                      k, metric, id_col, vector_col, floor, calibration_rows, calibrate_on)
    spark.createDataFrame([(metric, id_col, vector_col, probes, measured, dim, schema.json())],
                          "metric string, id_col string, vector_col string, probes int, measured double, dim int, schema string"
                          ).write.parquet(f"{path}/settings")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)],
                          "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    return Settings(metric, id_col, vector_col, probes, measured, centroids, schema)


def _calibrate(rows: DataFrame, centroids: np.ndarray, k: int, metric: str, id_col: str, vector_col: str, floor: float,
               calibration_rows: int, calibrate_on: Column | None) -> tuple[int, float]:
    """Lists to read, and the share of the exact neighbours they hold."""
    stored = rows.filter(F.col("list") != NO_LIST)
    chosen = stored if calibrate_on is None else stored.filter(calibrate_on)
    queries = _by_hash(chosen, id_col, 2, calibration_rows).select(
        F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("query_vec")).collect()
    if not queries:
        return len(centroids), 1.0
    asked = rows.sparkSession.createDataFrame(
        [(q["query_id"], [float(x) for x in q["query_vec"]]) for q in queries], "query_id long, query_vec array<double>")
    near = S.batch_top_k(stored.select(id_col, vector_col), asked, k + 1, metric, doc_id=id_col, doc_vec=vector_col)
    near = near.filter(F.col(id_col) != F.col("query_id")).select("query_id", id_col)
    found = near.join(stored.select(id_col, "list"), id_col).select("query_id", "list").collect()  # queries x k rows
    turn = {q["query_id"]: _turns(np.array(q["query_vec"], dtype=float), centroids, metric) for q in queries}
    needed = np.sort([np.nonzero(turn[r["query_id"]] == r["list"])[0][0] + 1 for r in found])
    if not len(needed):
        return len(centroids), 1.0
    probes = int(needed[max(0, math.ceil(floor * len(needed)) - 1)])
    return probes, float((needed <= probes).mean())


def _turns(query: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """The lists in the order in which the query reads them."""
    at = query / np.linalg.norm(query) if metric == "cosine" and np.linalg.norm(query) > 0 else query
    return np.argsort(np.square(centroids - at).sum(axis=1), kind="stable")


def load(spark: SparkSession, path: str) -> Settings:
    s = spark.read.parquet(f"{path}/settings").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MAX_LISTS at most
    centroids = np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, s["dim"]))
    return Settings(s["metric"], s["id_col"], s["vector_col"], s["probes"], s["measured"], centroids,
                    StructType.fromJson(json.loads(s["schema"])))


def search(spark: SparkSession, path: str, query: Sequence[float], k: int = 10, probes: int | None = None,
           columns: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """The k nearest rows in the lists that the query reads, ranked exactly."""
    s = load(spark, path)
    turns = _turns(np.array([float(x) for x in query]), s.centroids, s.metric)[:probes or s.probes]
    # Named as the partition column, so only these folders are listed.
    rows = spark.read.schema(s.schema).parquet(f"{path}/rows").filter(F.col("list").isin([int(x) for x in turns]))
    return S.exact_top_k(rows, query, k, s.metric, s.id_col, s.vector_col, list(columns), where)


def batch_search(path: str, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_vec: str = "query_vec",
                 probes: int | None = None) -> DataFrame:
    """``query_id, id, distance, rank`` for a table of queries.  Each query
    meets the rows of its own lists only."""
    spark = queries.sparkSession
    s = load(spark, path)
    p, metric, centroids = probes or s.probes, s.metric, s.centroids
    good = queries.filter(_usable(query_vec, centroids.shape[1], metric)).select(query_id, query_vec)
    rows = spark.read.schema(s.schema).parquet(f"{path}/rows").select("list", s.id_col, s.vector_col)
    whole = isinstance(s.schema[s.id_col].dataType, IntegralType)
    # Rows with a null id, or ids that numpy cannot order, are paired one by one.
    scored = _pairs(rows.filter(F.col(s.id_col).isNull()) if whole else rows, good, s, p, query_id, query_vec)
    if whole:
        found = vector_batch.listed_candidates(
            rows.filter(F.col(s.id_col).isNotNull() & (F.col("list") != NO_LIST)), good, k, metric, s.id_col, query_id,
            s.vector_col, query_vec, lambda q: _turns(q, centroids, metric)[:p], len(centroids))
        scored = scored.unionByName(found.withColumn(s.id_col, F.col(s.id_col).cast(s.schema[s.id_col].dataType)))
    w = Window.partitionBy(query_id).orderBy("distance", s.id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _pairs(rows: DataFrame, good: DataFrame, s: Settings, p: int, query_id: str, query_vec: str) -> DataFrame:
    """The distance of every query to every row of its lists."""
    metric, centroids = s.metric, s.centroids
    shared = vector_batch._share(rows.sparkSession, centroids)

    def turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["list"] = [_turns(np.asarray(v, dtype=float), shared(), metric)[:p] for v in f[query_vec]]
            yield f.explode("list").astype({"list": "int32"})

    asked = good.mapInPandas(turns, StructType([*good.schema.fields, StructField("list", IntegerType())]))
    small, _, fits = checked_broadcast(asked)
    pairs = rows.join(small if fits else asked, "list")
    return pairs.select(query_id, s.id_col, V.distance(metric, F.col(s.vector_col), F.col(query_vec)).alias("distance"))
