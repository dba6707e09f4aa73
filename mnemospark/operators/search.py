"""Retrieval: exact and two-stage top-k, filters, batches, several stores.

Plans built here:

* single query (K1, K3): the query vector is a driver-side literal, filters
  and column pruning reach the parquet scan, each partition scores its Arrow
  batches and hands on k rows, and ``orderBy(distance, id).limit(k)`` plans
  as ``TakeOrderedAndProject`` (a k-row merge; no shuffle of the table).
* batch of queries (K4): the query set is broadcast only after its size
  is checked; per-query top-k uses ``row_number() <= k`` which Spark
  plans with a partial ``WindowGroupLimit`` before the exchange, so only
  k rows per query and partition cross the shuffle.  Larger query sets
  are processed in broadcast-sized blocks.
* two-stage (K5): stage one ranks by Hamming distance of sign-bit
  signatures (reads ids + signatures only), stage two rescores the best
  candidates exactly after a semi-join on a bounded id list.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..plans.broadcast import MAX_BROADCAST_ROWS, checked_broadcast
from ..schema import PRIMARY_KEY

# Search defaults (top-k, candidate list, rescored candidates)
# and the P1 result projection.
DEFAULT_K = 5
DEFAULT_SEARCH_LIST = 100
DEFAULT_RESCORE = 50
RESULT_COLUMNS = ["timestamp", "speaker", "text"]  # P1: never all columns


# ---------------------------------------------------------------- filters

_OPS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "nin": lambda c, v: ~c.isin(list(v)),
}
_PY_TYPES = {
    T.LongType: (int,), T.IntegerType: (int,), T.ShortType: (int,),
    T.DoubleType: (int, float), T.FloatType: (int, float),
    T.StringType: (str,), T.BooleanType: (bool,),
    T.TimestampType: (dt.datetime, dt.date), T.TimestampNTZType: (dt.datetime, dt.date),
    T.DateType: (dt.date,),
}


def metadata_predicate(schema: T.StructType, filters: Iterable[tuple[str, str, object]]) -> Column:
    """conjunction of ``(field, op, value)`` checked against the schema."""
    fields = {f.name: f.dataType for f in schema.fields}
    preds = []
    for field, op, value in filters:
        if field not in fields:
            raise ValueError(f"unknown filter field {field!r}; expected one of {sorted(fields)}")
        if op not in _OPS:
            raise ValueError(f"unknown filter operator {op!r}; expected one of {list(_OPS)}")
        allowed = _PY_TYPES.get(type(fields[field]))
        values = list(value) if op in ("in", "nin") else [value]
        if allowed is not None:
            for v in values:
                if isinstance(v, bool) and bool not in allowed or not isinstance(v, allowed):
                    raise TypeError(f"filter value {v!r} does not fit {field} {fields[field].simpleString()}")
        preds.append(_OPS[op](F.col(field), value))
    return F.lit(True) if not preds else _and(preds)


def _and(preds: Sequence[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def now(utc: bool = True) -> dt.datetime:
    """The current time as a naive datetime, UTC (default) or local."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) if utc else dt.datetime.now()


def day_bounds(as_of: dt.datetime | None, days_ago: int) -> tuple[dt.datetime, dt.datetime]:
    """The UTC calendar day ``days_ago`` days before ``as_of``
    (now when not given; pass it for repeatable results)."""
    as_of = as_of or now()
    day = (as_of - dt.timedelta(days=days_ago)).date()
    start = dt.datetime(day.year, day.month, day.day)
    return start, start + dt.timedelta(days=1)


def time_predicate(start: dt.datetime | None, end: dt.datetime | None, ts_col: str = "timestamp",
                   chunk_col: str | None = None, chunk_seconds: int | None = None) -> Column:
    """``[start, end)`` on the time column, plus the matching ``chunk``
    range when the table is partitioned by chunk, so partitions outside
    the range are never listed (Spark does not derive it from ``ts``)."""
    preds = []
    epoch = dt.datetime(1970, 1, 1)
    if start is not None:
        preds.append(F.col(ts_col) >= F.lit(start))
        if chunk_col and chunk_seconds:
            preds.append(F.col(chunk_col) >= int((start - epoch).total_seconds()) // chunk_seconds)
    if end is not None:
        preds.append(F.col(ts_col) < F.lit(end))
        if chunk_col and chunk_seconds:
            preds.append(F.col(chunk_col) <= int((end - epoch).total_seconds()) // chunk_seconds)
    return _and(preds) if preds else F.lit(True)


# ---------------------------------------------------------------- exact (K1, K3)

def with_distance(df: DataFrame, query: Sequence[float], metric: str = "cosine",
                  vector_col: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    keep = list(keep) if keep is not None else [c for c in df.columns if c != vector_col]
    d = V.distance_to(metric, vector_col, query)
    return df.select(*keep, d.alias("distance")).filter(F.col("distance").isNotNull())


def exact_top_k(df: DataFrame, query: Sequence[float], k: int = DEFAULT_K, metric: str = "cosine",
                id_col: str = "trans_id", vector_col: str = "embedding",
                columns: Sequence[str] | None = None, where: Column | None = None,
                method: str = "arrow") -> DataFrame:
    """K1 (+K3 with ``where``): the k nearest rows, ties broken by id, then
    timestamp where it is carried.  Rows without a distance are left out.

    ``arrow`` (default): the scan's Arrow batches are scored with numpy and
    each partition hands on its k best rows with the projected columns.
    ``jvm``: the distance is a built-in expression (interpreted: about three
    times the time on 100k messages).  Either way the filter reaches the
    scan and ``TakeOrderedAndProject`` ends the plan.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if where is not None:
        df = df.filter(where)
    keep = list(dict.fromkeys([id_col] + list(columns if columns is not None else
                                              [c for c in df.columns if c != vector_col])))
    if method == "jvm":
        scored = with_distance(df, query, metric, vector_col, keep).filter(~F.isnan("distance"))
    elif method == "arrow":
        from . import vector_batch
        scored = vector_batch.single_query_candidates(df, V._check_query(query), k, metric, id_col,
                                                      vector_col, keep, _tie_order(df.select(keep), id_col))
    else:
        raise ValueError("method must be 'jvm' or 'arrow'")
    return scored.orderBy("distance", *_tie_order(scored, id_col)).limit(k)


def _tie_order(df: DataFrame, id_col: str) -> list[str]:
    """The id and, where it is a part of the key, the timestamp."""
    return [id_col, *(["timestamp"] if "timestamp" in df.columns and id_col != "timestamp" else [])]


def search(df: DataFrame, query: Sequence[float], k: int = DEFAULT_K, metric: str = "cosine",
           speaker: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
           filters: Iterable[tuple[str, str, object]] = (), chunk_seconds: int | None = None,
           id_col: str = "trans_id", columns: Sequence[str] = RESULT_COLUMNS,
           method: str = "arrow") -> DataFrame:
    """K3: speaker, time and metadata filters, then exact top-k.  Returns
    the P1 projection ``timestamp, speaker, text, distance`` plus the id."""
    preds = [metadata_predicate(df.schema, filters)]
    if speaker is not None:
        preds.append(F.col("speaker") == F.lit(speaker))
    chunk_col = "chunk" if "chunk" in df.columns else None
    preds.append(time_predicate(start, end, "timestamp", chunk_col, chunk_seconds))
    return exact_top_k(df, query, k, metric, id_col=id_col, columns=columns, where=_and(preds), method=method)


def with_score_metadata(topk: DataFrame) -> DataFrame:
    """Result with a similarity score, metadata struct and P13 preview."""
    return topk.select(
        F.struct("trans_id", "timestamp", "speaker").alias("metadata"),
        (F.lit(1.0) - F.col("distance")).alias("score"),
        F.substring("text", 1, 100).alias("preview"),
    )


# ---------------------------------------------------------------- batch

def batch_top_k(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "cosine",
                doc_id: str = "vec_id", query_id: str = "query_id", doc_vec: str = "embedding",
                query_vec: str = "query_vec", max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                method: str = "arrow") -> DataFrame:
    """K4: top-k documents per query: ``query_id, doc_id, distance, rank``.

    ``arrow`` (default): the size-checked query matrix is broadcast and
    each partition scores its Arrow batches with numpy, keeping per query
    only its best k rows by ``(distance, id)``; Spark
    then ranks the few candidates exactly by ``(distance, id)``.  Only
    ``queries x k`` rows per partition cross the shuffle and no
    query-document pair is materialised as a row.
    ``sql``: the same result as a broadcast join + JVM expressions
    (every pair is a row; slower, but pure SQL).
    """
    if method == "sql":
        scored = score_pairs(docs, queries, metric, doc_id, query_id, doc_vec, query_vec, max_broadcast_rows)
        scored = scored.filter(F.col("distance").isNotNull())
    elif method == "arrow":
        from . import vector_batch
        scored = vector_batch.candidates(docs, queries, k, metric, doc_id, query_id, doc_vec, query_vec,
                                         max_broadcast_rows)
    else:
        raise ValueError("method must be 'arrow' or 'sql'")
    w = Window.partitionBy(query_id).orderBy("distance", doc_id)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_pairs(docs: DataFrame, queries: DataFrame, metric: str = "cosine", doc_id: str = "vec_id",
                query_id: str = "query_id", doc_vec: str = "embedding", query_vec: str = "query_vec",
                max_broadcast_rows: int = MAX_BROADCAST_ROWS, method: str = "sql") -> DataFrame:
    """Every query against every document, the query side broadcast
    after a size check.  ``sql``: a broadcast join with JVM expressions;
    ``arrow``: each document batch is scored against the query matrix with
    numpy.  Both process a query set above the bound in blocks that fit and
    union them.  Rows whose distance is undefined are NULL (``sql``) or
    absent (``arrow``), whatever the number of queries."""
    if method == "arrow":
        from . import vector_batch
        return vector_batch.all_pairs(docs, queries, metric, doc_id, query_id, doc_vec, query_vec,
                                      max_broadcast_rows)
    if method != "sql":
        raise ValueError("method must be 'sql' or 'arrow'")
    q = queries.select(query_id, query_vec)
    d = docs.select(doc_id, doc_vec)
    q_b, n, fits = checked_broadcast(q, max_broadcast_rows)
    dist = V.distance(metric, F.col(doc_vec), F.col(query_vec)).alias("distance")
    if fits:
        return d.join(q_b, how="cross").select(query_id, doc_id, dist)
    # Hash blocks with headroom (twice the minimum count); the largest block
    # is measured before anything is broadcast.
    blocks = 2 * -(-n // max_broadcast_rows)
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    largest = q.groupBy(block.alias("_b")).count().agg(F.max("count")).first()[0]
    if largest > max_broadcast_rows:
        raise ValueError(f"a query block holds {largest} rows, above the bound {max_broadcast_rows}")
    parts = []
    for b in range(blocks):
        qb = q.filter(block == b)
        parts.append(d.join(F.broadcast(qb), how="cross").select(query_id, doc_id, dist))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- two-stage (K2, K5, K6)

def two_stage_top_k(df: DataFrame, query: Sequence[float], k: int = DEFAULT_K,
                    search_list_size: int = DEFAULT_SEARCH_LIST, rescore: int = DEFAULT_RESCORE,
                    metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding",
                    sig_col: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """K5: candidate list by sign-bit Hamming distance, exact rescoring of
    the best ``rescore`` candidates, top-k by exact distance."""
    if not (0 < k and 0 < rescore and 0 < search_list_size):
        raise ValueError("k, rescore and search_list_size must be positive")
    qw = V.sign_words_of(query)
    sig = F.col(sig_col) if sig_col else V.sign_words_expr(vector_col)
    # Only comparable rows enter the ranking: a NULL Hamming distance would
    # sort first and take a candidate slot.
    stage1 = (df.filter(F.size(vector_col) == len(query)) if not sig_col
              else df.filter(F.size(sig_col) == len(qw)))
    # A store holds no other id unique: its key goes through both stages.
    key = PRIMARY_KEY if set(PRIMARY_KEY) <= set(df.columns) else [id_col]
    carried = list(dict.fromkeys([id_col, *key]))
    candidates = (stage1.select(*carried, V.hamming_to(sig, qw).alias("hamming"))
                  .orderBy("hamming", *carried).limit(search_list_size))
    best = candidates.orderBy("hamming", *carried).limit(min(rescore, search_list_size))
    # `best` holds at most `rescore` rows: a proven bound for the broadcast.
    best = best.select(*key, "hamming")
    wanted = list(dict.fromkeys([*carried, vector_col, *columns]))
    full = df.select(*wanted).join(F.broadcast(best), key, "inner")
    return (full.select(*carried, *[c for c in columns if c not in carried], "hamming",
                        V.distance_to(metric, vector_col, query).alias("distance"))
            .filter(F.col("distance").isNotNull())
            .orderBy("distance", *carried).limit(k)
            .select(id_col, *[c for c in columns if c != id_col], "hamming", "distance"))


def recall(approx: DataFrame, exact: DataFrame, query_id: str = "query_id",
           id_col: str = "vec_id") -> DataFrame:
    """K6: share of the exact result found by the approximate one, per query."""
    a = approx.select(query_id, id_col).withColumn("hit", F.lit(1))
    return (exact.select(query_id, id_col).join(a, [query_id, id_col], "left")
            .groupBy(query_id)
            .agg(F.avg(F.coalesce(F.col("hit"), F.lit(0))).alias("recall"),
                 F.count(F.lit(1)).alias("k")))


# ---------------------------------------------------------------- several stores

def pick_stores(registry: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> dict:
    """The chosen stores; an unknown name raises with the valid list."""
    names = list(registry) if names is None else list(names)
    for n in names:
        if n not in registry:
            raise ValueError(f"no store is named {n!r}; the stores are {sorted(registry)}")
    return {n: registry[n] for n in names}


def federated_top_k(registry: Mapping[str, DataFrame], query: Sequence[float], k: int = DEFAULT_K,
                    names: Iterable[str] | None = None, metric: str = "cosine",
                    columns: Sequence[str] = RESULT_COLUMNS, where: Column | None = None) -> DataFrame:
    """Top-k over several stores.  Each store contributes its own
    top-k (a per-store ``TakeOrderedAndProject``); the k-row lists are
    unioned, a message held by several stores is kept once (first store
    in order), and the final top-k is taken.  Exact, because a row in
    the global top-k is in the top-k of every store that holds it."""
    stores = pick_stores(registry, names)
    parts = []
    for prio, (name, df) in enumerate(stores.items()):
        top = exact_top_k(df, query, k, metric, id_col="trans_id", columns=columns, where=where)
        parts.append(top.withColumn("store", F.lit(name)).withColumn("_prio", F.lit(prio)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    w = Window.partitionBy("trans_id", "timestamp").orderBy("distance", "_prio")
    return (union.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .drop("_rn", "_prio").orderBy("distance", "trans_id", "timestamp").limit(k))


def batch_two_stage_top_k(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                          search_list_size: int = DEFAULT_SEARCH_LIST, rescore: int = DEFAULT_RESCORE,
                          metric: str = "cosine", doc_id: str = "vec_id", query_id: str = "query_id",
                          doc_vec: str = "embedding", query_vec: str = "query_vec",
                          max_broadcast_rows: int = MAX_BROADCAST_ROWS, method: str = "arrow") -> DataFrame:
    """K5 for a batch of queries: per query the best ``rescore`` of the
    ``search_list_size`` Hamming candidates are rescored exactly.

    ``arrow`` (default): one pass; each partition keeps per query its
    ``rescore`` best rows by ``(hamming, id)`` and scores them exactly with
    the vectors at hand; windows pick the global candidates and the top-k.
    ``sql``: Hamming over a broadcast join, candidates joined back to the
    documents for their vectors (a second scan)."""
    keep = min(rescore, search_list_size)
    if method == "arrow":
        from . import vector_batch
        cand = vector_batch.two_stage_candidates(docs, queries, keep, metric, doc_id, query_id, doc_vec,
                                                 query_vec, max_broadcast_rows)
        w1 = Window.partitionBy(query_id).orderBy("hamming", doc_id)
        best = cand.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= keep).drop("_r")
        w2 = Window.partitionBy(query_id).orderBy("distance", doc_id)
        return (best.filter(F.col("distance").isNotNull())
                .withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k))
    if method != "sql":
        raise ValueError("method must be 'arrow' or 'sql'")
    q = queries.select(query_id, query_vec, V.sign_words_expr(query_vec).alias("_qsig"))
    q_b, n, fits = checked_broadcast(q, max_broadcast_rows)
    if not fits:
        raise ValueError(f"{n} queries exceed the broadcast bound {max_broadcast_rows}; "
                         "run them in blocks of at most that size")
    d_sig = docs.select(doc_id, V.sign_words_expr(doc_vec).alias("_dsig"))
    ham = (d_sig.join(q_b.select(query_id, "_qsig"), how="cross")
           .select(query_id, doc_id, V.hamming("_dsig", "_qsig").alias("hamming"))
           .filter(F.col("hamming").isNotNull()))  # NULL vectors or other lengths
    w1 = Window.partitionBy(query_id).orderBy("hamming", doc_id)
    cand = ham.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= keep).drop("_r")
    # At most n x keep candidate rows (n checked above): broadcast them, so
    # the documents are scanned for their vectors without being shuffled.
    full = (docs.select(doc_id, doc_vec).join(F.broadcast(cand), doc_id)
            .join(q_b.select(query_id, query_vec), query_id))
    scored = full.select(query_id, doc_id, "hamming",
                         V.distance(metric, F.col(doc_vec), F.col(query_vec)).alias("distance"))
    w2 = Window.partitionBy(query_id).orderBy("distance", doc_id)
    return (scored.filter(F.col("distance").isNotNull())
            .withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k))
