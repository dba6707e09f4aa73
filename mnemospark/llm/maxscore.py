"""Exact top-k search over integer vectors by MaxScore.

A vector's component d is a posting of term d; a query's component is the
term's weight.  Tasks cut the rows they read into shards and keep each
shard's postings by term, with the least and the greatest value of the term:
they bound what the term can add to a score, whatever the signs.  Per query
the terms are ordered by the spread of that bound.  The terms with the
smallest spreads, as long as they cannot lift a row over the k-th best score
so far, are non-essential.  The essential postings are traversed for all rows
of the shard; the others are probed, largest spread first, only for rows that
are still competitive.  Rows that could tie with the k-th best stay, so ties
are exact.  Each task keeps k rows a query; the tasks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialize

#: Rows of a shard.
SHARD = 8192
#: Bytes of a block of queries: what a task holds of the query set at a time.
QUERY_BYTES = 1 << 23
#: Probed terms between two checks whether a row is still competitive.
PROBES = 8
_EXACT = 2 ** 53
_LONG = 2 ** 63 - 1
_FOUND = "query_id long, _query long, _id long, _row long, score long"


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``_id, _v``: floor(scale * x) of each component x, as double.  Rows
    whose id or vector is null, or with a null or non-finite component, are
    left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        F.col(vector_col), lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))
    return vectors.filter(whole).select(
        F.col(id_col).alias("_id"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("_v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


class Shard:
    """Postings of some rows by term, with the terms' bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray, terms: int):
        if values.shape[1] < terms:
            values = np.pad(values, ((0, 0), (0, terms - values.shape[1])))
        values = values[:, :terms]
        # ascending ids, so that the first of equal scores is the smaller id
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.postings = np.ascontiguousarray(values[order].T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)
        self.peak = max((abs(int(x)) for x in (*self.low, *self.high)), default=0)

    def floats(self) -> np.ndarray:
        return self.postings.astype(np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
        if len(level) > k:  # ties at the k-th place: the k smallest ids are enough
            level = level[np.lexsort((rows[level], ids[level]))[:k]]
        keep = np.concatenate([above, level])
        scores, ids, rows = scores[keep], ids[keep], rows[keep]
    order = np.lexsort((rows, ids, -scores))[:k]
    return scores[order], ids[order], rows[order]


class Query:
    """A query's weights and the best rows found so far."""

    def __init__(self, row: int, weights: np.ndarray, k: int):
        self.row, self.k = row, k
        self.weights = weights
        self.peak = max((abs(int(x)) for x in weights), default=0)
        self.best = (np.empty(0, np.float64), np.empty(0, np.int64), np.empty(0, np.int64))

    def search(self, shard: Shard, postings: np.ndarray) -> None:
        w = self.weights.astype(np.float64)
        a, b = w * shard.low, w * shard.high
        least, most = np.minimum(a, b), np.maximum(a, b)
        spread = most - least
        order = np.argsort(spread, kind="stable")
        # what the i smallest terms can reach together, beside the least of all
        reach = np.concatenate([[0.0], np.cumsum(spread[order])])
        floor = self.best[0][-1] - least.sum() if len(self.best[0]) >= self.k else -np.inf
        split = int(np.searchsorted(reach, floor, side="left")) - 1 if floor > -np.inf else 0
        split = min(max(split, 0), len(order))
        essential = order[split:]
        if not split:
            self.add(w @ postings, shard.ids, shard.rows)
            return
        scores, at, left = w[essential] @ postings[essential], None, split
        # what the terms that are not probed yet can add at most
        rest = np.concatenate([[0.0], np.cumsum(most[order])])
        while True:
            keep = scores + rest[left] >= self.best[0][-1]
            n = int(np.count_nonzero(keep))
            if not n:
                return
            if not left or 2 * n < len(scores):
                keep = np.flatnonzero(keep)
                scores, at = scores[keep], keep if at is None else at[keep]
            if not left:
                break
            terms = order[max(0, left - PROBES):left]
            left -= len(terms)
            scores = scores + w[terms] @ (postings[terms] if at is None else postings[np.ix_(terms, at)])
        self.add(scores, shard.ids[at], shard.rows[at])

    def search_exact(self, shard: Shard) -> None:
        """For values whose scores are beyond a double's whole numbers: every
        term is essential and is added in integers without bound."""
        scores = self.weights.astype(object) @ shard.postings.astype(object)
        scores = np.array([min(max(int(s), -_LONG), _LONG) for s in scores], object)
        self.add(scores, shard.ids, shard.rows)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = rows == self.row
        if own.any():
            scores, ids, rows = scores[~own], ids[~own], rows[~own]
        if scores.dtype == object or self.best[0].dtype == object:
            order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], rows[i]))[:self.k]
            scores, ids, rows = np.array([int(scores[i]) for i in order], object), ids[order], rows[order]
            all_ = [(int(s), int(i), int(r)) for part in (self.best, (scores, ids, rows)) for s, i, r in zip(*part)]
            all_.sort(key=lambda x: (-x[0], x[1], x[2]))
            cut = all_[:self.k]
            self.best = (np.array([c[0] for c in cut], object), np.array([c[1] for c in cut], np.int64),
                         np.array([c[2] for c in cut], np.int64))
            return
        scores, ids, rows = _best(scores, ids, rows, self.k)
        self.best = _best(np.concatenate([self.best[0], scores]), np.concatenate([self.best[1], ids]),
                          np.concatenate([self.best[2], rows]), self.k)


def _scan(queries: list[Query], terms: int, batches: Iterator[pa.RecordBatch], shard_rows: int) -> None:
    """Runs all queries over the shards of ``batches``."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def close() -> None:
        nonlocal held, n
        if not held:
            return
        wide = max(v.shape[1] for _, _, v in held)
        values = np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, _, v in held])
        shard = Shard(np.concatenate([i for i, _, _ in held]), np.concatenate([r for _, r, _ in held]), values, terms)
        held, n = [], 0
        postings = shard.floats()
        for q in queries:
            if max(terms, 1) * max(q.peak, 1) * max(shard.peak, 1) < _EXACT // 4 and q.best[0].dtype != object:
                q.search(shard, postings)
            else:
                q.search_exact(shard)

    for batch in batches:
        ids, rows, values = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))
        for a in range(0, len(ids), shard_rows):
            part = slice(a, a + shard_rows)
            if n and n + len(ids[part]) > shard_rows:
                close()
            held.append((ids[part], rows[part], values[part]))
            n += len(ids[part])
    close()


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024, shard_rows: int = SHARD, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, <id_col>, score`` (long): for each row whose id
    ``is_query`` picks, the ``k`` rows, its own left
    out, with the highest integer inner product of the quantised vectors;
    ties go to the smaller id.  Fewer rows than ``k``: all of them.

    Rows whose id or vector is null or holds a null or non-finite component
    take no part.  Repeated rows are rows of their own: a query leaves out
    one row, and a repeated query has its own ranks.  A shorter vector counts
    as filled with zeros; scores beyond a long are held at its ends.  Other
    columns are not read.  An empty table gives no rows.

    The query set is dealt by hash to blocks of about ``query_bytes``.  Each
    block is handed to every task of one pass over the vectors, whose result
    is written, so the driver and a task hold one block whatever the size of
    the table.
    """
    rows = materialize(quantise(vectors, id_col, vector_col, scale)
                       .withColumn("_row", F.monotonically_increasing_id()), "maxscore-vectors").select("_id", "_row", "_v")
    asked = materialize(rows.filter(is_query(F.col("_id"))), "maxscore-queries")
    n_asked = asked.count()
    wide = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    n_blocks = -(-n_asked * 8 * max(1, wide) // query_bytes)
    merged = vectors.sparkSession.createDataFrame([], _FOUND)
    for block in range(n_blocks):
        chosen = asked.filter(F.expr(f"pmod(xxhash64(_row), {n_blocks}) = {block}"))
        merged = merged.unionByName(_pass(rows, chosen, wide, k, shard_rows, f"maxscore-block-{block}"))
    best = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc("_id"), F.asc("_row"))
    return (merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("_id").alias(id_col), "score"))


def _pass(rows: DataFrame, chosen: DataFrame, terms: int, k: int, shard_rows: int, name: str) -> DataFrame:
    """One block of queries over all rows: each task's k best, written."""
    found = chosen.toArrow().combine_chunks()
    columns = [found.column(i).combine_chunks() for i in range(3)]
    weights = _matrix(columns[2])
    weights = np.pad(weights, ((0, 0), (0, terms - weights.shape[1])))
    held = rows.sparkSession.sparkContext.broadcast((np.asarray(columns[0]), np.asarray(columns[1]), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, matrix = held.value
        queries = [Query(int(r), w, k) for r, w in zip(places, matrix)]
        _scan(queries, terms, batches, shard_rows)
        for at in range(0, len(queries), 1024):
            part = queries[at:at + 1024]
            n = [len(q.best[0]) for q in part]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids[at:at + 1024], n), pa.int64()), pa.array(np.repeat(places[at:at + 1024], n), pa.int64()),
                pa.array(np.concatenate([q.best[1] for q in part]), pa.int64()),
                pa.array(np.concatenate([q.best[2] for q in part]), pa.int64()),
                pa.array([int(s) for q in part for s in q.best[0]], pa.int64())],
                names=["query_id", "_query", "_id", "_row", "score"])
    done = materialize(rows.mapInArrow(run, _FOUND), name)
    held.unpersist()
    return done
