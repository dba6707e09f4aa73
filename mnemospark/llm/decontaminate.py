"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words.  Documents meet test items through shared
token windows (the seeds, found by a running Karp-Rabin hash).  For each
document and item that meet, the longest match of unmarked tokens is marked
as a tile, again and again, down to ``MIN_MATCH`` tokens.  The share of the
item's tokens under tiles is its coverage: the order of the passages does not
matter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .base import materialize

MIN_MATCH = 5
COVERAGE = 0.8
#: Tokens of test items in one block; a larger benchmark takes more passes.
BLOCK_TOKENS = 2_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def running_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all windows of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _BASE + codes[i:i + n]
    return out


def tile(item: list, doc: list, seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item start, doc start, length)`` from the seed pairs
    of ``width`` tokens: longest first, then the first in item and document;
    a match whose tokens are partly taken goes on with what is left of it."""
    runs: dict[int, list[int]] = defaultdict(list)
    for i, j in seeds:
        if item[i:i + width] == doc[j:j + width]:
            runs[j - i].append(i)
    heap = []
    for shift, starts in runs.items():
        starts.sort()
        first = prev = starts[0]
        for i in [*starts[1:], None]:
            if i is None or i > prev + 1:
                heap.append((-(prev + width - first), first, first + shift))
                first = i
            prev = i
    heapq.heapify(heap)
    in_item, in_doc, tiles = set(), set(), []
    while heap:
        size, i, j = heapq.heappop(heap)
        free = [i + k not in in_item and j + k not in in_doc for k in range(-size)]
        if all(free):
            tiles.append((i, j, -size))
            in_item.update(range(i, i - size))
            in_doc.update(range(j, j - size))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return tiles


class _Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int):
        self.items = items
        self.codes = {t: 0 for _, ts in items for t in ts}
        for t in self.codes:  # a code depends on the token alone
            raw = t.encode("utf-8", "surrogatepass")
            self.codes[t] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5EED) | 1
        self.by_width: dict[int, tuple[np.ndarray, dict]] = {}
        seeds: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for n, (_, ts) in enumerate(items):
            w = min(width, len(ts))
            if w:
                for i, h in enumerate(running_hash(self.code(ts), w).tolist()):
                    seeds[w][h].append((n, i))
        for w, table in seeds.items():
            self.by_width[w] = np.sort(np.fromiter(table, np.uint64, len(table))), dict(table)

    def code(self, ts: list[str]) -> np.ndarray:
        get = self.codes.get
        return np.fromiter((get(t, 0) for t in ts), np.uint64, len(ts))

    def matches(self, ts: list[str]) -> Iterator[tuple[int, int, list]]:
        """``(item number, width, tiles)`` for each item that shares a seed."""
        codes = self.code(ts)
        for width, (known, table) in self.by_width.items():
            h = running_hash(codes, width)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            found: dict[int, list] = defaultdict(list)
            for j in np.flatnonzero(known[at] == h).tolist():
                for n, i in table[int(h[j])]:
                    found[n].append((i, j))
            for n, pairs in found.items():
                tiles = tile(self.items[n][1], ts, pairs, width)
                if tiles:
                    yield n, width, tiles


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
             block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document and item with at least one tile:
    ``id_col, item_id, coverage, n_tiles, longest, tiles`` where ``tiles``
    holds ``(item_start, doc_start, length)`` in tokens.

    Items shorter than ``min_match`` tokens match as a whole only; items
    without tokens, null texts and empty texts match nothing.  The items are
    the stated query set: they are read in blocks of about ``block_tokens``
    tokens, each matched against all documents in one scan.  Repeated
    documents or items give a row each; null ids are carried.
    """
    spark = docs.sparkSession
    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, "
              f"item_id {benchmark.schema[item_col].dataType.simpleString()}, coverage double, n_tiles int, "
              "longest int, tiles array<struct<item_start:int,doc_start:int,length:int>>")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_tokens):
        shared = spark.sparkContext.broadcast(block)  # at most block_tokens tokens and one item more

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _Index([(item, tokens(text)) for item, text in shared.value], min_match)
            for batch in batches:
                got: list[tuple] = []
                ids = batch.column(0)
                for r, text in enumerate(batch.column(1)):
                    for n, _, tiles in index.matches(tokens(text.as_py())):
                        size = len(index.items[n][1])
                        got.append((ids[r].as_py(), index.items[n][0], sum(t[2] for t in tiles) / size, len(tiles),
                                    max(t[2] for t in tiles), [
                                        {"item_start": a, "doc_start": b, "length": c} for a, b, c in sorted(tiles)]))
                cols = list(zip(*got)) if got else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], ids.type), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], tile_type)],
                    names=[id_col, "item_id", "coverage", "n_tiles", "longest", "tiles"])

        item_type = to_arrow_type(benchmark.schema[item_col].dataType)
        tile_type = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_tokens: int) -> Iterator[list]:
    """The items in blocks; only one block is on the driver at a time."""
    block, size = [], 0
    for item, text in benchmark.select(item_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((item, text))
        size += text.count(" ") + text.count("\n") + 1
        if size >= block_tokens:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", least: float = COVERAGE,
                 min_match: int = MIN_MATCH) -> DataFrame:
    """Rows of ``overlaps`` with coverage of at least ``least``."""
    return overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, min_match).filter(
        F.col("coverage") >= least)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", least: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """Rows of ``docs`` that hold no item to ``least``; equal texts share
    their fate, so the rows are named by a 128-bit hash of the text."""
    h1, h2 = F.xxhash64(text_col), F.xxhash64(F.lit(2), F.col(text_col))
    named = docs.select(F.struct(h1.alias("a"), h2.alias("b")).alias("_h"), F.col(text_col).alias("_t")).select(
        F.concat_ws(":", "_h.a", "_h.b").alias("_name"), "_t")
    bad = contaminated(named, benchmark, "_name", "_t", item_col, item_text_col, least, min_match)
    # Written first, so that many copies of one text can be split in the join.
    bad = materialize(bad.select("_name").distinct(), "contaminated")
    name = F.concat_ws(":", h1, h2)
    return docs.withColumn("_name", name).join(bad, "_name", "left_anti").drop("_name")
