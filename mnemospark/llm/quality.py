"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a set of hashed tokens.  One weight vector serves all grades:
``P(grade <= k) = sigmoid(theta_k - w.x)`` with ordered thresholds.  The
model gives the expected grade and the tail probability of a wanted grade.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows the fit gathers (those with the smallest hash).
MAX_FIT_ROWS = 8000
BUCKETS = 1 << 18
#: A bucket gets a weight if this many fitted texts have it.
MIN_TEXTS = 4
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct buckets of the lower-cased tokens, plus one bucket
    for each level of shouting (share of upper-case words, in eighths) and
    of punctuation (share of tokens that are not words)."""
    tokens = _TOKEN.findall(text or "")
    shout = sum(len(t) > 1 and t.isupper() for t in tokens)
    words = sum(t[0].isalnum() for t in tokens)
    seen = {t.lower() for t in tokens}
    n = max(1, len(tokens))
    seen.add(f"\x00shout {8 * shout // n}")
    seen.add(f"\x00marks {8 * (len(tokens) - words) // n}")
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(t.encode("utf-8", "surrogatepass")) for t in seen), np.int64, len(seen))
                     % buckets).astype(np.int32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """``P(grade <= k)`` for each threshold ``k``, a row for each score."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int = BUCKETS,
                steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood with weight decay by full-batch Adam.  No rows:
    zero weights and evenly spaced thresholds."""
    spread = np.arange(n_grades - 1, dtype=float) - (n_grades - 2) / 2
    if not len(rows):
        return OrdinalModel(np.zeros(buckets, np.float32), spread)
    idx = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    common = np.bincount(idx, minlength=buckets) >= MIN_TEXTS
    owner, idx = owner[common[idx]], idx[common[idx]]
    used, idx = np.unique(idx, return_inverse=True)
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(0.01, 0.99)
    theta0 = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    gaps = np.log(np.maximum(np.diff(theta0), 1e-3))
    x = np.concatenate([np.zeros(len(used)), theta0[:1], gaps])
    m, v, n = np.zeros_like(x), np.zeros_like(x), len(rows)
    for t in range(1, steps + 1):
        w, head, steps_up = x[:len(used)], x[len(used)], np.exp(x[len(used) + 1:])
        theta = head + np.concatenate([[0.0], np.cumsum(steps_up)])
        score = np.bincount(owner, weights=w[idx], minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi = 1 / (1 + np.exp(-np.clip(edge[grades + 1] - score, -30, 30)))
        lo = 1 / (1 + np.exp(-np.clip(edge[grades] - score, -30, 30)))
        hi[grades == n_grades - 1], lo[grades == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p  # d log p / d upper, lower edge
        g_score = (up - down) / n
        g_theta = np.array([(down[grades == k + 1].sum() - up[grades == k].sum()) / n for k in range(n_grades - 1)])
        g = np.concatenate([np.bincount(idx, weights=g_score[owner], minlength=len(used)) + decay * w,
                            [g_theta.sum()], [g_theta[k + 1:].sum() * s for k, s in enumerate(steps_up)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(buckets, np.float32)
    weights[used] = x[:len(used)]
    theta = x[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(used) + 1:]))])
    return OrdinalModel(weights, theta)


def _featured(df: DataFrame, text_col: str, keep: list[str], buckets: int) -> DataFrame:
    rows = df.select(*keep, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").withColumn("_x", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t.as_py(), buckets) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(xs, pa.list_(pa.int32()))],
                                             names=[*keep, "_x"])
    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", n_grades: int = 3, max_rows: int = MAX_FIT_ROWS,
          buckets: int = BUCKETS) -> OrdinalModel:
    """Fit on at most ``max_rows`` rated texts, chosen by the hash of their
    id; ratings that are null or outside the grades, and null texts, do not
    count.  The sample's features come to the driver, nothing else does."""
    usable = ratings.filter(F.col(grade_col).between(0, n_grades - 1) & F.col(id_col).isNotNull())
    chosen = (usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(grade_col).cast("int").alias("_grade"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    rated = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter("_t is not null").join(
        F.broadcast(chosen), "_id")  # at most max_rows narrow rows
    got = _featured(rated, "_t", ["_id", "_grade"], buckets).orderBy(F.xxhash64("_id"), "_id").limit(max_rows).toArrow()
    rows = [np.asarray(x, np.int32) for x in got.column("_x").to_pylist()]
    return fit_ordinal(rows, np.array(got.column("_grade").to_pylist(), int), n_grades, buckets)


def score(docs: DataFrame, model: OrdinalModel, wanted: int, text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the text) and ``expected_grade``,
    ``tail_probability`` = ``P(grade >= wanted)``.  Null and empty texts are
    scored as texts without tokens, very long ones whole; equal texts have
    equal scores.  Columns of ``docs`` with one of the two names are left out."""
    made = ("expected_grade", "tail_probability")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (c != text_col or keep)]
    rows = docs.select(*keep, F.col(text_col).alias("_quality_text"))
    schema = (rows.drop("_quality_text").withColumn("expected_grade", F.lit(0.0))
              .withColumn("tail_probability", F.lit(0.0)).schema)
    weights, thetas, buckets = model.weights, model.thresholds, len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(weights, thetas)
        for b in batches:
            s = np.array([float(weights[features(t.as_py(), buckets)].sum(dtype=np.float64))
                          for t in b.column(len(keep))])
            below = m.below(s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, wanted - 1])],
                names=[*keep, "expected_grade", "tail_probability"])
    return rows.mapInArrow(run, schema)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 2 for good and not toxic, one less
    for each fault.  Null in either column: no grade."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def select_quality(docs: DataFrame, model: OrdinalModel, wanted: int, least: float = 0.5,
                   text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose tail probability is at least ``least``."""
    plain = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(c) for c in plain]).alias("_row"), F.col(text_col).alias("_t"),
                         F.col(text_col).alias("_again"))
    good = score(packed, model, wanted, "_t", ["_row", "_again"]).filter(F.col("tail_probability") >= least)
    return good.select(*[F.col("_again").alias(c) if c == text_col else F.col("_row")[c].alias(c)
                         for c in docs.columns])
