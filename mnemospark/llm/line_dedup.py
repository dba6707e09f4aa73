"""Line deduplication by a suffix array over line-ID sequences.

Each line is an ID; each document is a sequence of IDs.  Prefix doubling
ranks the suffixes by their first 1, 2, 4, ... lines: the rank of 2n lines is
the rank of the pair (rank of the first n, rank of the next n).  Suffixes
that are alone at some length are sorted already and leave the doubling.
Suffixes that share a prefix of at least ``min_words`` words form a
longest-common-prefix interval; the union of these prefixes over a document
are its maximal repeated runs.  The first copy of a run stays, later copies
are deleted.  Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import global_rank, materialize, row_key, text_or_empty

MIN_WORDS = 20
#: Fixed: what counts as a word.
_NO_SPACES = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{_NO_SPACES}]|[^\s\p{{Z}}{_NO_SPACES}]+"
#: Lines without these have no space or script that ``\\S`` does not know.
_WIDE = r"[\u00A0\u0E00-\uFFFF]|[\x{10000}-\x{10FFFF}]"


def word_count(line: Column) -> Column:
    """Matches of ``WORD``; lines that allow it are counted the quicker way."""
    plain = (F.octet_length(line) == F.length(line)) | ~line.rlike(_WIDE)
    return F.when(plain, F.regexp_count(line, F.lit(r"\S++"))).otherwise(F.regexp_count(line, F.lit(WORD)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line that is not blank: ``pos`` counts these lines,
    ``line_no`` all lines, ``w`` are the words, ``h1, h2`` name the line."""
    numbered = F.transform(F.split(text_or_empty(text_col), "\n"),
                           lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    full = F.filter(numbered, lambda s: F.trim(s["line"]) != "")
    # The outer form keeps Spark from computing the array once more in a
    # filter on its size.
    rows = docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col),
                       F.posexplode_outer(full).alias("pos", "s")).filter("pos is not null")
    words = word_count(F.col("s.line"))
    return rows.select("_id", "_k1", "_k2", "pos", "s.line_no", F.xxhash64("s.line").alias("h1"),
                       F.xxhash64(F.lit(1), "s.line").alias("h2"), words.alias("w"))


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """``rows`` with ``need``, how many lines from here hold ``min_words``
    words, and ``last``, the last of them; null if the lines of ``rows`` that
    follow without a gap are too few."""
    ahead = Window.partitionBy("_k1", "_k2").orderBy("pos").rowsBetween(0, min_words - 1)
    near = F.collect_list(F.struct("pos", "w", "line_no")).over(ahead)
    grow = lambda acc, x: F.when(
        (acc["w"] >= min_words) | (x["pos"] != F.col("pos") + acc["n"]), acc).otherwise(F.struct(
            (acc["w"] + x["w"]).alias("w"), (acc["n"] + 1).alias("n"), x["line_no"].alias("last")))
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(0).alias("last"))
    rows = rows.withColumn("_near", near).withColumn("_r", F.aggregate("_near", none, grow))
    return (rows.withColumn("need", F.when(F.col("_r.w") >= min_words, F.col("_r.n")))
            .withColumn("last", F.col("_r.last")).drop("_near", "_r", "w"))


def _shared(rows: DataFrame, keys: list[str], rank: str, name: str) -> DataFrame:
    """Ranks of the key combinations that more than one row has."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    return global_rank(many, keys, rank, name)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of repeated line windows: ``_k1, _k2, line_no, last``."""
    lines = materialize(_lines(docs, id_col, text_col), "line-ids")
    first = _shared(lines, ["h1", "h2"], "r0", "line-rank0")
    state = (lines.join(first, ["h1", "h2"]).drop("h1", "h2")
             .dropDuplicates(["_k1", "_k2", "pos"]))
    state = materialize(_windows(state, min_words), "line-state0")
    level, ranks = 0, ["r0"]
    while 2 << level <= min_words:
        ahead = Window.partitionBy("_k1", "_k2").orderBy("pos")
        step = 1 << level
        nxt = F.when(F.lead("pos", step).over(ahead) == F.col("pos") + step,
                     F.lead(ranks[-1], step).over(ahead))
        paired = state.withColumn("_a", F.col(ranks[-1])).withColumn("_b", nxt)
        known = _shared(paired.filter("_a is not null and _b is not null"), ["_a", "_b"],
                        f"r{level + 1}", f"line-rank{level + 1}")
        level += 1
        ranks.append(f"r{level}")
        state = materialize(paired.join(known, ["_a", "_b"], "left").drop("_a", "_b"),
                            f"line-state{level}")
    # The window of `need` lines is two overlapping runs of 2^k <= need lines.
    k = F.floor(F.log2(F.col("need").cast("double"))).cast("int")
    of_level = F.element_at(F.array(*ranks), k + 1)
    head = (state.filter("need is not null").withColumn("_k", k).withColumn("_head", of_level)
            .filter("_head is not null")
            .withColumn("_tail_at", F.col("pos") + F.col("need") - F.pow(F.lit(2), F.col("_k")).cast("int")))
    tails = state.select("_k1", "_k2", F.col("pos").alias("_tail_at"), F.array(*ranks).alias("_tails"))
    windows = (head.join(tails, ["_k1", "_k2", "_tail_at"])
               .withColumn("_tail", F.element_at("_tails", F.col("_k") + 1)).filter("_tail is not null")
               .select("need", "_head", "_tail", "_k1", "_k2", "line_no", "last",
                       F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"),
                                "_k1", "_k2", "pos").alias("_place")))
    windows = materialize(windows, "line-windows")
    intervals = (windows.groupBy("need", "_head", "_tail")
                 .agg(F.count("*").alias("_c"), F.min("_place").alias("_first")).filter("_c > 1"))
    # Written first, so that a frequent run's side of the join can be split.
    intervals = materialize(intervals, "line-intervals")
    return (windows.join(intervals, ["need", "_head", "_tail"]).filter("_place > _first")
            .select("_k1", "_k2", "line_no", "last"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_removed`` and ``runs``
    (``array<struct<start, end>>``: deleted line numbers, end exclusive).

    Lines end at ``\\n``.  A run counts from ``min_words`` words on (runs
    between white space; a character of a script without spaces is one).  The first copy is the one with the smallest id, then the
    smallest place in the document; null ids come last.  Blank lines inside
    a deleted run go with it and do not break a run.  A text that repeats a
    run over and over keeps its first lines only.

    Null text: kept_text null, no lines.  Empty text: one empty line, kept.
    Rows that repeat id and text are one document and all get its result.
    Other columns are carried along; an empty table gives an empty one.
    """
    merge = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))
    ).otherwise(F.array_append(acc, x))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = (repeated_windows(docs, id_col, text_col, min_words)
             .groupBy("_k1", "_k2")
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.col("line_no").alias("start"), (F.col("last") + 1).alias("end")))).alias("_w"))
             .select("_k1", "_k2", F.aggregate("_w", none, merge).alias("_runs")))
    keyed = docs.select("*", *row_key(id_col, text_col))
    out = keyed.join(found, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    runs = F.coalesce(F.col("_runs"), none)
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists(
        F.col("_runs"), lambda r: (r["start"] <= i) & (i < r["end"])))
    return (out
            .withColumn("kept_text", F.when(F.size(runs) > 0, F.array_join(kept, "\n"))
                        .otherwise(F.col(text_col)))
            .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)))
            .withColumn("n_removed", F.aggregate(runs, F.lit(0), lambda a, r: a + r["end"] - r["start"]))
            .withColumn("runs", runs).drop("_runs"))
