"""Merkle manifest of a dataset, a level of the tree kept as one string.

The leaves of a group (a source) stand in order.  ``FAN ** DEPTH`` of them
that follow each other form an aligned block.  A block keeps each of its
levels as one string of hex digests; the next level is the string of the
hashes of its substrings of ``FAN`` digests.  What flanks a digest inside its
substring are its siblings.  Block roots are the nodes of the next tier,
dealt to blocks again, until a group has one node; the groups' roots, in the
order of the groups, are one more group.  Paths of siblings then go down
from the root: a block hands its own path to its nodes.

No tier holds a group in one task: blocks have a fixed size, so a source
with a third of all rows is many blocks.  Only digests are shuffled, never
texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import global_rank, materialize

FAN = 3
#: Levels in a block: 243 leaves, strings of up to 15,552 digits.
DEPTH = 5
_HEX = 64


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The leaf of a row: the hash of its fields."""
    return digest(*[field(c) for c in columns])


def _parents(level: Column, fan: int) -> Column:
    """The level above as one string."""
    width = fan * _HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    hashes = F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashes, "").cast("binary")


def _blocks(nodes: DataFrame, fan: int, depth: int, payload: list[str]) -> DataFrame:
    """A row for each block of ``nodes`` (``_g``, ``_p`` place in the group,
    ``_n`` nodes of the group, ``_h``): ``_m`` its nodes in order, ``_levels``
    its level strings from the nodes up (as bytes, whose substrings are found
    without a count of characters), ``_top`` its root."""
    size = fan ** depth
    rows = (nodes.withColumn("_b", F.expr(f"_p div {size}")).groupBy("_g", "_n", "_b")
            .agg(F.array_sort(F.collect_list(F.struct("_p", "_h", *payload))).alias("_m")))
    def up(levels: Column, _) -> Column:
        top = F.element_at(levels, -1)
        # the only block of its group ends at one node
        done = (F.col("_n") <= size) & (F.length(top) == _HEX)
        return F.when(done, levels).otherwise(F.concat(levels, F.array(_parents(top, fan))))

    levels = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.array_join("_m._h", "").cast("binary")), up)
    return rows.withColumn("_levels", levels).withColumn("_top", F.element_at("_levels", -1).cast("string"))


def _path(place: Column, levels: Column, fan: int) -> Column:
    """Siblings left and right of the node at ``place`` of a block, level by
    level below the block's root."""
    def flanks(level, k):
        at = F.floor(place / F.pow(F.lit(fan), k)).cast("int")
        first = (F.floor(at / fan) * fan).cast("int")
        last = F.least(first + fan, (F.length(level) / _HEX).cast("int"))
        return F.struct(F.substring(level, first * _HEX + 1, (at - first) * _HEX).cast("string").alias("left"),
                        F.substring(level, (at + 1) * _HEX + 1, (last - at - 1) * _HEX).cast("string").alias("right"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


def _tiers(nodes: DataFrame, most: int, fan: int, depth: int, payload: list[str], name: str) -> list[DataFrame]:
    """Blocks of each tier, written, from the nodes to one block a group."""
    size, tiers = fan ** depth, []
    while True:
        blocks = materialize(_blocks(nodes, fan, depth, [] if tiers else payload), f"{name}-{len(tiers)}")
        tiers.append(blocks)
        if most <= size:
            return tiers
        most = -(-most // size)
        nodes = blocks.select("_g", F.col("_b").alias("_p"), F.col("_top").alias("_h"),
                              F.expr(f"(_n + {size - 1}) div {size}").alias("_n"))


def _down(tiers: list[DataFrame], above: DataFrame, fan: int, depth: int, carried: list[str]) -> DataFrame:
    """Hands paths from ``above`` (a row for each group: ``_g``, ``_path`` and
    ``carried`` columns) down to the nodes of the lowest tier."""
    upper, on = above, ["_g"]
    for blocks in reversed(tiers):
        rows = blocks.join(upper, on).select("*", F.explode("_m").alias("_node"))
        local = _path(F.col("_node._p") % F.lit(fan ** depth), F.col("_levels"), fan)
        nodes = rows.select("_g", "_node", F.concat(local, F.col("_path")).alias("_path"), *carried)
        upper, on = nodes.withColumn("_b", F.col("_node._p")).drop("_node"), ["_g", "_b"]
    return nodes


def manifest(leaves: DataFrame, group_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf",
             payload: list[str] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row for each row of ``leaves``: ``order_col``, ``leaf_col`` and the
    ``payload`` columns, with ``subroot``, ``root`` and ``path``, an array of
    ``(left, right)``: the siblings as hex text at each level, from the
    leaf's to the root's.

    Per group the leaves ascend by ``order_col`` (null first, ties by leaf).
    While several nodes remain, every ``fan`` that follow each other become
    their hash, the last run with fewer.  Groups ascend by ``group_col``
    (null first, bytewise) and their roots likewise give ``root``.  A null
    group is a group of its own; repeated rows are leaves of their own; a
    group of one leaf has it as subroot, with no siblings.  An empty table
    gives no rows.  Other columns are left out, so no name clashes.
    """
    payload = payload or []
    rows = leaves.select(F.col(group_col).alias("_s"), F.col(order_col).alias("_o"), F.col(leaf_col).alias("_h"),
                         F.struct(F.lit(0).alias("_"), *payload).alias("_with"))
    # written first: dealing by range reads its input twice, and texts are hashed once
    placed = global_rank(materialize(rows, "manifest-hashes"), ["_s", "_o", "_h"], "_place", "manifest-leaves")
    groups = materialize(placed.groupBy("_s").agg(F.min("_place").alias("_g"), F.count("*").alias("_n")), "manifest-groups")
    most, n_groups = groups.agg(F.max("_n"), F.count("*")).first()
    placed, starts = placed.alias("p"), groups.alias("s")
    nodes = placed.join(starts, F.col("p._s").eqNullSafe(F.col("s._s"))).select(
        "s._g", (F.col("_place") - F.col("s._g")).alias("_p"), "_h", "s._n", F.struct("_o", "_with").alias("_row"))
    tiers = _tiers(nodes, most or 0, fan, depth, ["_row"], "manifest-tier")
    # the groups' roots are one more group, in the order of their first places
    roots = global_rank(tiers[-1].select("_g", F.col("_top").alias("_h")), ["_g"], "_p", "manifest-roots")
    over = _tiers(roots.select(F.lit(0).cast("long").alias("_g"), "_p", "_h", F.lit(n_groups).cast("long").alias("_n"),
                               F.col("_g").alias("_of")), n_groups, fan, depth, ["_of"], "manifest-top")
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = over[-1].select("_g", none.alias("_path"), F.col("_top").alias("root"))
    per_group = _down(over, top, fan, depth, ["root"]).select(
        F.col("_node._of").alias("_g"), "_path", "root", F.col("_node._h").alias("subroot"))
    got = _down(tiers, per_group, fan, depth, ["root", "subroot"])
    return got.select(F.col("_node._row._o").alias(order_col), F.col("_node._h").alias(leaf_col),
                      *[F.col(f"_node._row._with.{c}").alias(c) for c in payload],
                      "subroot", "root", F.col("_path").alias("path"))


def proof(path: Column) -> Column:
    """The hash of all siblings, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def verify(docs: DataFrame, columns: list[str], group_col: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as a manifest over ``columns``, each row checked against the
    root after tampering: where 2 divides the CRC-32 of the decimal id, the
    text's newlines are deleted (a null id or text is left alone)."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    cut = [F.replace(F.col(c), F.lit("\n")) if c == text_col else F.col(c) for c in columns]
    leaves = docs.select(
        F.col(group_col).alias("_source"), F.col(id_col).alias("_id"), leaf_of([F.col(c) for c in columns]).alias("leaf"),
        F.when(even & F.contains(F.col(text_col), F.lit("\n")), leaf_of(cut)).alias("_tampered"))
    got = manifest(leaves, "_source", "_id", "leaf", ["_tampered"])
    folded = got.withColumn("folded_root", fold(F.coalesce("_tampered", "leaf"), F.col("path")))
    return folded.select(F.col("_id").alias(id_col), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
