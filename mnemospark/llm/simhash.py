"""SimHash near-duplicates found through segment popcounts.

A 64-bit fingerprint is embedded as the popcounts of its 16 segments of four
bits.  Flipping a bit moves one popcount by one, so the Manhattan distance of
two embeddings is a lower bound of the bit distance.  The range join runs on
the unit grid: each fingerprint stands in its own cell and in the cells at
Manhattan distance 1, so two embeddings at distance 2 or less meet in a cell.
Pairs of a cell are checked under the bound, then exactly by bit distance.

A cell of more than ``MAX_CELL`` fingerprints is not paired.  Its members go
to an exact key join instead: each is keyed by itself and its 64 one-bit
flips; two fingerprints differ in at most two bits exactly when they share
such a key.  Members of a key are linked to its smallest one, so the edges
grow with the members and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.broadcast import MAX_BROADCAST_ROWS

from .base import materialize

SHINGLE = 3
MAX_BITS = 2
SEED = 42
MAX_CELL = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A-Z are lower-cased, words end at ASCII white space.  A bit is set if
    more than half of the shingles' hashes have it; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE,
                 keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and ``fp``: the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    if "fp" in keep:
        raise ValueError("a kept column is called fp")
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    schema = rows.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


def _bit(n: int) -> int:
    return (1 << n) - (1 << 64 if n == 63 else 0)


def _meet(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner", small: bool = False) -> DataFrame:
    """A join that broadcasts a counted few rows only.  Spark would go by the
    size of compressed files, and what it broadcasts stays on the driver for
    rounds.  Both sides are dealt by the key otherwise; of a frequent key
    Spark splits a side that was written first or comes from a shuffle."""
    return left.join(right if small else right.hint("merge"), on, how)


def _few(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def _cells(fps: DataFrame) -> DataFrame:
    """``fp, cell, own``: a cell is a vector of 16 popcounts, written in
    three bits each (0 to 4, and a margin of one on both sides)."""
    count = lambda s: F.bit_count(F.shiftrightunsigned("fp", 4 * s).bitwiseAND(15)).cast("long")
    home = F.lit(0).cast("long")
    for s in range(16):
        home = home + F.shiftleft(count(s), 3 * s)
    moves = F.array(F.lit(0).cast("long"), *[F.lit(sign * (1 << 3 * s)).cast("long")
                                            for s in range(16) for sign in (1, -1)])
    return (fps.select("fp", home.alias("home")).select("fp", "home", F.explode(moves).alias("move"))
            .select("fp", "home", (F.col("home") + F.col("move")).alias("cell")))


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_cell: int = MAX_CELL) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``, no
    repeats) that connect exactly those within ``max_bits`` (1 or 2) bits,
    directly or by members of a shared flip key."""
    if max_bits not in (1, 2):
        raise ValueError("the grid of unit cells serves distances 1 and 2")
    cells = _cells(fps)
    hot = cells.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_cell).select("cell")
    hot = materialize(hot, "simhash-hot")
    few = _few(hot)
    cold = _meet(cells, hot, "cell", "left_anti", few)
    a = cold.select("cell", F.col("fp").alias("a"), (F.col("home") == F.col("cell")).alias("a_own"),
                    F.col("home").alias("a_home"))
    b = cold.select("cell", F.col("fp").alias("b"), (F.col("home") == F.col("cell")).alias("b_own"),
                    F.col("home").alias("b_home"))
    same = F.col("a_home") == F.col("b_home")
    # Equal embeddings meet in their own cell, neighbours in the smaller
    # fingerprint's own cell, others in a cell between them.
    where = (F.when(same, F.col("a_own") & F.col("b_own"))
             .when(F.col("a_own") | F.col("b_own"), F.col("a_own"))
             .otherwise(F.lit(max_bits > 1)))
    bound = F.lit(0)
    for s in range(16):
        part = lambda c: F.shiftright(F.col(c), 3 * s).bitwiseAND(7)  # noqa: E731,B023
        bound = bound + F.abs(part("a_home") - part("b_home"))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = (_meet(a, b, "cell").filter("a < b").filter(where).filter(bound <= max_bits)
            .filter(exact <= max_bits).select("a", "b"))
    crowd = _meet(cells, hot, "cell", "left_semi", few).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_bit(i)).cast("long") for i in range(64)])
    keyed = crowd.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("key"))
    if max_bits == 1:  # share a key that is one of the two themselves
        stars = _meet(keyed, crowd.select(F.col("fp").alias("key")), "key").select(
            F.least("fp", "key").alias("a"), F.greatest("fp", "key").alias("b")).filter("a < b")
    else:
        least = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("_z")).filter("a < _z")
        stars = _meet(keyed, least, "key").filter("fp > a").select("a", F.col("fp").alias("b"))
    return near.unionByName(stars).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``a, b``: ``node, root`` with the smallest
    node as root.  Each round links every node to the smallest node it or a
    neighbour points at and shortens the pointers; the rounds grow with the
    logarithm of the longest chain.  Minima are combined before the shuffle."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                       f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("root")), f"{name}-0")
    few = _few(labels)
    turn = 0
    while True:
        turn += 1
        near = (_meet(both, labels.select(F.col("node").alias("b"), "root"), "b", small=few)
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        least = _meet(labels, near, "node", small=few).select("node", F.col("root").alias("old"),
                                                              F.least("root", "near").alias("least"))
        # the old root follows its members (hooking), then pointers are halved
        hooked = (least.select(F.col("old").alias("node"), "least")
                  .unionByName(least.select("node", "least"))
                  .groupBy("node").agg(F.min("least").alias("root")))
        if not few:  # written, so that the nodes of a large component can be split
            hooked = materialize(hooked, f"{name}-hooked-{turn}")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = (_meet(hooked, up, "root", "left", few)
               .select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        new = materialize(new, f"{name}-{turn}")
        moved = _meet(new, labels.withColumnRenamed("root", "old"), "node", small=few).filter("root <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: its columns without the text,
    ``fp`` (signed long) and ``component_id``, the smallest id that is
    reachable over links of at most ``max_bits`` bits.  Columns of these
    names, ``_root`` and ``_min`` are left out.

    Null and empty texts have fingerprint zero and are linked like others.
    Null ids never win against another id; a component of null ids only has
    component_id null.  Repeated rows stay and share the component.
    """
    return _classed(docs, id_col, text_col, shingle, max_bits).drop("_root")


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    others = [c for c in docs.columns if c not in (text_col, "fp", "component_id", "_root", "_min")]
    rows = materialize(fingerprints(docs, text_col, shingle, others), "simhash-fps")
    fps = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("_min")), "simhash-distinct")
    roots = components(links(fps.select("fp"), max_bits), "simhash").select(F.col("node").alias("fp"), "root")
    few = _few(fps)
    rooted = _meet(fps, roots, "fp", "left", few).withColumn("_root", F.coalesce("root", "fp")).drop("root")
    smallest = rooted.groupBy("_root").agg(F.min("_min").alias("component_id"))
    if not few:
        smallest = materialize(smallest, "simhash-smallest")
    classes = _meet(rooted.drop("_min"), smallest, "_root", small=few)
    return _meet(rows, classes, "fp", small=few)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the
    smallest hash of the whole row, then any of rows that are the same."""
    name = "_row"
    marked = docs.withColumn(name, F.xxhash64(*docs.columns))
    classed = _classed(marked.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), name),
                       "_id", "_t", shingle, max_bits)
    winner = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col(name).alias("r")))
    best = classed.groupBy("_root").agg(winner.alias("w")).select(
        F.col("w.i").alias("_wi"), F.col("w.r").alias(name))
    best = materialize(best, "simhash-best")
    kept = _meet(marked, best, (marked[name] == best[name]) & marked[id_col].eqNullSafe(best["_wi"]), "left_semi", _few(best))
    return kept.dropDuplicates([id_col, name]).drop(name)
