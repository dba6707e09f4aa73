"""Conversation state.

State rows are ``thread_id, msg_id, seq, role, text``.  History text is
assembled in two levels: blocks of at most ``BLOCK`` consecutive
messages first (a long thread is spread over many tasks), then the
ordered blocks of each thread.  Only the per-thread result, which is the
output itself, is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import embed, integrity
from .numbering import place_in_group

BLOCK = 1024  # messages per first-level block


def from_turns(conversations: DataFrame) -> DataFrame:
    """Test-data conversations to state rows: thread = conversation,
    message id = arrival position = turn."""
    return conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("msg_id"),
                                F.col("turn").alias("seq"), "role", "text")


def upsert(state: DataFrame) -> DataFrame:
    """M2: append, and a message id seen again replaces the earlier one.
    The position of the first occurrence is kept.  One partial
    aggregate per ``(thread_id, msg_id)``, so replays of a hot message
    are combined map-side."""
    return (state.groupBy("thread_id", "msg_id")
            .agg(F.min("seq").alias("seq"),
                 F.max_by(F.struct("role", "text"), "seq").alias("_last"))
            .select("thread_id", "msg_id", "seq", "_last.role", "_last.text"))


def history_text(state: DataFrame, line: Column | None = None, sep: str = "\n") -> DataFrame:
    """One text per thread, messages in ``seq`` order: ``thread_id, history, messages``."""
    line = line if line is not None else F.concat(F.col("role"), F.lit(": "), F.coalesce(F.col("text"), F.lit("")))
    rows = state.select("thread_id", "seq", line.alias("_line"),
                        F.floor(F.col("seq") / F.lit(BLOCK)).alias("_block"))
    blocks = (rows.groupBy("thread_id", "_block")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_line"))),
                                            lambda s: s["_line"]), sep).alias("_text"),
                   F.count(F.lit(1)).alias("_n")))
    return (blocks.groupBy("thread_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_text"))),
                                          lambda s: s["_text"]), sep).alias("history"),
                 F.sum("_n").alias("messages")))


def history_rows(state: DataFrame) -> DataFrame:
    """A6 without the one text per thread: a row for each message with its
    ``position`` in the thread, from 1.  A long thread is numbered by several
    tasks."""
    placed = place_in_group(state.select("thread_id", "seq", "msg_id", "role", "text"), ["thread_id"],
                            ["seq", "msg_id"], "_n")
    return placed.select("thread_id", (F.col("_n") + 1).alias("position"), "msg_id", "role", "text")


def prompt(state: DataFrame, system: str | Column) -> DataFrame:
    """M3: the system message followed by the whole history."""
    sys_col = F.lit(system) if isinstance(system, str) else system
    h = history_text(state)
    return h.select("thread_id", F.concat(F.lit("system: "), sys_col, F.lit("\n"), F.col("history")).alias("prompt"),
                    (F.col("messages") + 1).alias("messages"))


def prompt_rows(state: DataFrame, system: str) -> DataFrame:
    """M3 as ordered rows for threads of any length: ``thread_id, position,
    role, text``; position 0 is the system message of each thread."""
    first = state.select("thread_id").distinct().select(
        "thread_id", F.lit(0).cast("long").alias("position"), F.lit("system").alias("role"), F.lit(system).alias("text"))
    return first.unionByName(history_rows(state).select("thread_id", "position", "role", "text"))


def with_replies(user_rows: DataFrame, replies: DataFrame) -> DataFrame:
    """M6: replies join the stream by a second source, after the F1
    filter, so the bot's own rows are stored too."""
    return user_rows.unionByName(replies)


def store_replies(store, users: DataFrame, replies: DataFrame, session_id: str, model: str, dim: int,
                  ingest_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M6 to the end: both sources get a vector (M1), provenance (P2) and go
    through the store's checks.  Returns the stored rows and the rejects."""
    rows = with_replies(users, replies)
    vectors = embed.hash_embed(rows, "seq", "text", dim)
    stamped = integrity.stamp_provenance(rows.join(vectors, "seq"), model, dim)
    return store.append(stamped, session_id, ingest_id=ingest_id)


def context_rows(ranked: DataFrame, query_id: str = "query_id", text_col: str = "text",
                 rank_col: str = "rank", sep: str = "\n") -> DataFrame:
    """M5: the retrieved rows of each query as one text in rank order.
    ``ranked`` holds at most k rows per query (a top-k result)."""
    return (ranked.groupBy(query_id)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, text_col))),
                                          lambda s: s[text_col]), sep).alias("context"),
                 F.count(F.lit(1)).alias("rows")))
