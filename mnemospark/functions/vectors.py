"""Vector expressions (P4-P10, K5 signatures) as JVM-side Column code.

Two forms of every distance:

* column against column (``dot``, ``cosine_distance`` ...): higher-order
  functions ``zip_with`` + ``aggregate``; works for any pair of arrays.
* column against a query known on the driver (``distance_to``): the
  query is a constant ``array<double>`` and its norm is folded on the
  driver.  (Writing the sum out term by term was measured slower: the
  generated method passes the 64 KB limit and Spark falls back to
  interpreted evaluation.)

All sums are taken in double precision.  Distances are NULL when a norm
is zero or the lengths differ; callers drop NULL before ranking.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _tree_sum(terms: list[Column]) -> Column:
    # Balanced tree: shallow expressions even for long vectors.
    while len(terms) > 1:
        nxt = [terms[i] + terms[i + 1] for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0] if terms else F.lit(0.0)


# ---------------------------------------------------------------- column x column

def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b),
                  F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def norm(a) -> Column:
    a = _col(a)
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine_distance(a, b) -> Column:
    """``1 - cos(a, b)``; smaller is closer."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_distance(a, b) -> Column:
    """Euclidean distance."""
    a, b = _col(a), _col(b)
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                    * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b),
                  F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v)))


def neg_inner_product(a, b) -> Column:
    """Negative inner product, so that smaller is closer."""
    return -dot(a, b)


def similarity_score(a, b) -> Column:
    """Dot product times 100 (the score of normalised vectors)."""
    return dot(a, b) * F.lit(100.0)


def distance(metric: str, a, b) -> Column:
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "l2":
        return l2_distance(a, b)
    if metric == "ip":
        return neg_inner_product(a, b)
    raise ValueError(f"unknown metric {metric!r}; expected one of {list(METRICS)}")


# ---------------------------------------------------------------- column x literal

def _check_query(q: Sequence[float]) -> list[float]:
    vals = [float(x) for x in q]
    if not vals:
        raise ValueError("query vector is empty")
    if any(math.isnan(x) or math.isinf(x) for x in vals):
        raise ValueError("query vector holds NaN or infinity")
    return vals


def query_literal(q: Sequence[float]) -> Column:
    """A driver-side query as an ``array<double>`` literal (folded once)."""
    return F.array(*[F.lit(float(v)) for v in _check_query(q)])


def distance_to(metric: str, a, q: Sequence[float]) -> Column:
    """Distance of an array column to a driver-side query vector.

    The query is a constant array; its norm is computed on the driver.
    Rows whose vector length differs from the query give NULL (a store
    may hold vectors of several models).
    """
    a, q = _col(a), _check_query(q)
    ql = query_literal(q)
    if metric == "cosine":
        qn = math.sqrt(sum(v * v for v in q))
        if qn == 0.0:
            raise ValueError("cosine distance to a zero query vector is undefined")
        expr = F.lit(1.0) - dot(a, ql) / F.nullif(norm(a) * F.lit(qn), F.lit(0.0))
    elif metric == "l2":
        expr = l2_distance(a, ql)
    elif metric == "ip":
        expr = -dot(a, ql)
    else:
        raise ValueError(f"unknown metric {metric!r}; expected one of {list(METRICS)}")
    return F.when(F.size(a) == F.lit(len(q)), expr)


# ---------------------------------------------------------------- sign signatures (K5)

def sign_words_expr(a: str) -> Column:
    """Sign bit of each element packed into 64-bit words: bit i of word w
    is set when element ``64*w + i`` is > 0.  Compared with ``hamming``."""
    return F.expr(
        f"transform(sequence(0, cast(floor((size(`{a}`) - 1) / 64) as int)), w -> "
        f"aggregate(transform(slice(`{a}`, w * 64 + 1, 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), "
        f"0L, (acc, v) -> acc | v))")


def sign_words_of(q: Sequence[float]) -> list[int]:
    q = _check_query(q)
    out = []
    for w in range(0, len(q), 64):
        word = 0
        for i in range(w, min(len(q), w + 64)):
            if q[i] > 0:
                word |= 1 << (i - w)
        if word >= 1 << 63:
            word -= 1 << 64
        out.append(word)
    return out


def hamming_to(sig, qwords: Sequence[int]) -> Column:
    """Hamming distance to a driver-side signature; NULL when the stored
    signature has another number of words."""
    sig = _col(sig)
    dist = _tree_sum([F.bit_count(F.try_element_at(sig, F.lit(w + 1)).bitwiseXOR(F.lit(v).cast("long")))
                      .cast("int") for w, v in enumerate(qwords)])
    return F.when(F.size(sig) == len(qwords), dist)


def hamming(a_sig, b_sig) -> Column:
    a_sig, b_sig = _col(a_sig), _col(b_sig)
    return F.aggregate(F.zip_with(a_sig, b_sig, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
                       F.lit(0), lambda acc, v: acc + v)


# ---------------------------------------------------------------- parse / format / normalise

def parse_vector(text, dtype: str = "double") -> Column:
    """``"[a, b, ...]"`` to ``array<dtype>`` element by element; a bad
    element becomes NULL, ``[]`` gives an empty array, NULL stays NULL.
    ``float`` restores stored single-precision values exactly."""
    t = _col(text)
    inner = F.trim(F.regexp_replace(F.trim(t), r"^\[|\]$", ""))
    parts = F.split(inner, ",")
    return F.when(t.isNull(), F.lit(None)).when(
        inner == "", F.array().cast(f"array<{dtype}>")).otherwise(
        F.transform(parts, lambda x: F.trim(x).try_cast(dtype)))


def vector_is_valid(text) -> Column:
    """Whole-vector validity: ``from_json`` is NULL when any element is bad."""
    return F.from_json(_col(text), "array<double>").isNotNull()


def vector_to_text(a) -> Column:
    """P5: vector to its JSON text form."""
    return F.to_json(_col(a))


def l2_normalize(a) -> Column:
    """P10: unit-length vector; a zero vector gives NULL."""
    a = _col(a)
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def register_sql_functions(spark: SparkSession) -> None:
    """P6-P9 as SQL functions for ad-hoc SQL (K8).  SQL-bodied functions
    are inlined by the analyzer, so they run as ordinary expressions."""
    dot_sql = ("aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), "
               "cast(0 as double), (acc, v) -> acc + v)")
    norm_a = "sqrt(aggregate(a, cast(0 as double), (acc, x) -> acc + cast(x as double) * cast(x as double)))"
    norm_b = "sqrt(aggregate(b, cast(0 as double), (acc, x) -> acc + cast(x as double) * cast(x as double)))"
    l2_sql = ("sqrt(aggregate(zip_with(a, b, (x, y) -> (cast(x as double) - cast(y as double)) * "
              "(cast(x as double) - cast(y as double))), cast(0 as double), (acc, v) -> acc + v))")
    defs = {
        "cosine_distance": f"1 - ({dot_sql}) / nullif({norm_a} * {norm_b}, 0)",
        "l2_distance": l2_sql,
        "neg_inner_product": f"-({dot_sql})",
        "inner_product": dot_sql,
    }
    for name, body in defs.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) "
            f"RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) THEN {body} END")
