"""Shared pieces of the registered queries: probe vectors, label
centroids, and the DuckDB text of the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import MESSAGES_SQL, table

# Fixed values of the registered queries.
PROBE_VEC_ID = 7            # "nearest to vec_id 7, excluding itself"
PROBE_PAIR = (7, 11)        # query not stored: embedding 7 + 0.5 * embedding 11
AS_OF = "2024-01-17 12:00:00"  # fixed "now" for relative-time queries
SHORT_TERM_FROM = "2024-01-24 00:00:00"  # short-term store = messages from this time on


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, fetched to the driver (a single bounded row)."""
    row = (table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id)
           .select("embedding").first())
    if row is None:
        raise ValueError(f"vec_id {vec_id} not found")
    return [float(x) for x in row[0]]


def probe_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = (table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(list(PROBE_PAIR)))
            .select("vec_id", "embedding").collect())
    vecs = {r.vec_id: r.embedding for r in rows}
    a, b = vecs[PROBE_PAIR[0]], vecs[PROBE_PAIR[1]]
    return [float(x) + 0.5 * float(y) for x, y in zip(a, b)]


def label_centroids(emb: DataFrame) -> DataFrame:
    """Mean vector per label: ``query_id, query_vec``.  Per-element means
    via ``posexplode`` + a two-level aggregate (partial sums before the
    shuffle), then one bounded array per label (dim elements).  Spark ML's
    ``Summarizer`` avoids the exploded rows but keeps a running mean, whose
    rounding differs from sum / count; this form equals ``avg`` in SQL."""
    el = emb.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = el.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (means.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
            .select(F.col("label").cast("long").alias("query_id"),
                    F.transform("s", lambda s: s["m"].cast("float")).alias("query_vec")))


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------ DuckDB text

def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product(({a})::DOUBLE[], ({b})::DOUBLE[])"


def sql_cos(a: str, b: str) -> str:
    return (f"(1 - {sql_dot(a, b)} / nullif(sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)}), 0))")


def sql_l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip(({a})::DOUBLE[], ({b})::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def sql_ip(a: str, b: str) -> str:
    return f"(-{sql_dot(a, b)})"


SQL_DIST = {"cosine": sql_cos, "l2": sql_l2, "ip": sql_ip}

SQL_MESSAGES_CTE = f"messages as materialized ({MESSAGES_SQL.strip()})"
SQL_PROBE_CTE = (
    "q as (select list_transform(range(1, len(a.embedding) + 1), "
    "lambda i: a.embedding[i]::DOUBLE + 0.5 * b.embedding[i]::DOUBLE) as qv "
    f"from embeddings a, embeddings b where a.vec_id = {PROBE_PAIR[0]} and b.vec_id = {PROBE_PAIR[1]})"
)
SQL_CENTROIDS_CTE = """
centroids as (
  select label::BIGINT as query_id, list(m::FLOAT order by pos) as query_vec
  from (select label, pos, avg(x::DOUBLE) as m
        from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings)
        group by label, pos)
  group by label)
""".strip()


def sql_sign_hamming(a: str, b: str) -> str:
    """Number of positions whose sign bit (x > 0) differs."""
    return (f"list_sum(list_transform(list_zip({a}, {b}), lambda p: case when (p[1] > 0) <> (p[2] > 0) "
            f"then 1 else 0 end))")
