"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each; rows are
sorted by their place on the Hilbert curve of that grid and cut into runs of
equal row counts.  Neighbours on the curve are neighbours in every
dimension, so a shard covers a small box and files can be skipped on any of
the dimensions.  Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import global_rank, materialize, row_key, text_or_empty

BITS = 5
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place of a grid point (coordinates below ``2**bits``) on the curve."""
    n = len(coordinates)
    if n < 2 or n * bits > 62:
        raise ValueError("two dimensions at least, 62 bits in all at most")
    point = F.array(*[c.cast("long") for c in coordinates])
    pair = lambda q, i: F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i"))
    turns = [pair(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, s: Column) -> Column:
        own, low = F.element_at(x, s["i"] + 1), s["q"] - 1
        swap = F.element_at(x, 1).bitwiseXOR(own).bitwiseAND(low)
        return F.when(own.bitwiseAND(s["q"]) != 0,
                      F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                      ).otherwise(F.transform(x, lambda v, j: F.when(
                          (j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    zero = F.lit(0).cast("long")
    if turns:
        point = F.aggregate(F.array(*turns), point, turn)
    gray = F.transform(point, lambda v, j: F.aggregate(F.slice(point, F.lit(1), j + 1), zero,
                                                       lambda a, b: a.bitwiseXOR(b)))
    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array(zero)
    flip = lambda g: F.aggregate(steps, zero, lambda a, q: F.when(
        F.element_at(g, -1).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
    order = [pair(1 << b, i) for b in range(bits - 1, -1, -1) for i in range(n)]
    join = lambda g: F.aggregate(F.array(*order), zero, lambda a, s: a * 2 + F.when(
        F.element_at(g, s["i"] + 1).bitwiseXOR(flip(g)).bitwiseAND(s["q"]) != 0, 1).otherwise(0).cast("long"))
    # one-element transform: the gray code is worked out once
    return F.element_at(F.transform(F.array(F.struct(gray.alias("g"))), lambda s: join(s["g"])), 1)


def _cell(value: Column, kind: str, cuts: list) -> Column:
    """How many cuts are below the value."""
    edges = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind}>")
    return F.size(F.filter(edges, lambda e: e < F.coalesce(value, e)))


def _quantised(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Numbers fall between approximate quantiles (nulls in the lowest
    cell); other values are dealt by hash, equal values together."""
    kinds = dict(rows.dtypes)
    numeric = [d for d in dims if kinds[d] in NUMBERS]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(d, shares, 10_000).alias(d) for d in numeric]).first() if numeric else {}
    cells = []
    for d in dims:
        if d in numeric:
            cells.append(_cell(F.col(d), kinds[d], cuts[d] or []))
        else:
            cells.append(F.pmod(F.xxhash64(d), F.lit(1 << bits)))
    return cells


def shard(docs: DataFrame, n_shards: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text",
          bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: id, ``size`` (UTF-8 bytes of the
    text plus 1), ``text_crc32``, ``cell`` (place on the curve), ``shard``
    (counts at most one apart), ``slot`` (from 0, in curve order) and the
    row's key ``_k1, _k2``.

    Ties on the curve are ordered by id, then text, then place in the input;
    repeated rows each get a slot.  Null texts have size 1 and the checksum
    of the empty text.  The size is a dimension named ``size``.  Fewer rows
    than shards leave shards empty; an empty table gives no rows.
    """
    extra = [d for d in dims if d != "size"]
    rows = docs.select(
        F.col(id_col).alias("_id"), *[F.col(d).alias(f"_dim_{d}") for d in extra],
        (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col)).alias("text_crc32"), *row_key(id_col, text_col),
        F.monotonically_increasing_id().alias("_tie"))
    rows = materialize(rows, "shard-rows")
    names = ["size" if d == "size" else f"_dim_{d}" for d in dims]
    celled = rows.withColumn("cell", hilbert_index(_quantised(rows, names, bits), bits)).drop(
        *[f"_dim_{d}" for d in extra])
    total = rows.count()
    ranked = global_rank(celled, ["cell", "_id", "_k2", "_tie"], "_rank", "shard-order")
    number = F.expr(f"cast(floor(cast(_rank as decimal(38,0)) * {n_shards} / {max(total, 1)}) as int)")
    first = F.expr(f"cast(ceil(cast(shard as decimal(38,0)) * {total} / {n_shards}) as long)")
    return (ranked.withColumn("shard", number).withColumn("slot", F.col("_rank") - first)
            .select(F.col("_id").alias(id_col), "size", "text_crc32", "cell", "shard", "slot", "_k1", "_k2"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` as one folder for each shard, in slot order.  Rows
    that repeat id and text are interchangeable, so they are paired by their
    count within the key."""
    numbered = shards.select("_k1", "_k2", "shard", "slot")
    once = numbered.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("shard", "slot")).alias("_places"))
    keyed = docs.dropDuplicates([id_col, text_col]).select("*", *row_key(id_col, text_col)).join(once, ["_k1", "_k2"])
    placed = keyed.withColumn("_place", F.explode("_places")).select(
        *docs.columns, F.col("_place.shard").alias("shard"), F.col("_place.slot").alias("_slot"))
    (placed.repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot")
     .write.partitionBy("shard").parquet(path))
