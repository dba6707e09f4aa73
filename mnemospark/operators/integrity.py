"""Ingest rules: F1 filter, P2 provenance, C1-C6 checks, rejects (S12),
load report (A2), prefix commit (A3) and promotion (J7).

The key rule (C6) is the one with real semantics: rows are inserted one
at a time in arrival order (``seq``), so a row is accepted when no
*accepted* earlier row shares its primary key ``(trans_id, timestamp)``
or its unique key ``(timestamp, speaker, text)``; a rejected row blocks
nothing.  Stored rows always win over the batch.

Rows that are alone on both keys are accepted and shuffled no further.  The
rest (the *contested* rows) fall into components that share no key:

1. both keys hold the time, so the contested rows of one time are a union of
   components; they are folded once, in arrival order, by one streaming pass
   that holds the keys of one time only;
2. a time with more than ``FOLD_ROWS`` contested rows first has every row
   decided that is the smallest for both of its keys, with all that share a
   key with it (partial aggregates: a hot key is combined map-side, and a key
   with a third of all rows is decided here);
3. what is left there are chains.  Their components are numbered by hooking
   and pointer jumping on the key graph, in a number of rounds that grows
   with the logarithm of a chain's length, and each is folded once.

Decisions are written as a narrow table of rejects in the session's shared
folder; the full rows meet it once, and as it is small Spark broadcasts it
and leaves the full rows where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRIMARY_KEY, REQUIRED, STORE_FIELDS, UNIQUE_KEY
from ..session import materialize

# Fixed reason codes (P19), one per rule.
R_CORRUPT = "corrupt_record"
R_UNKNOWN = "unknown_field"
R_NULL = "null"
R_TYPE = "type"
R_DIM = "dim_mismatch"
R_PK_STORED = "pk_stored"
R_UK_STORED = "unique_stored"
R_PK = "pk"
R_UK = "unique"

KEY_COLS = list(dict.fromkeys(PRIMARY_KEY + UNIQUE_KEY))

# Inside the key rounds the text of the unique key is compared by its
# SHA-256 digest (32 bytes): equal text gives equal digests, and distinct
# texts with equal digests are not known to exist.  The rounds then shuffle
# fixed-width keys instead of message text.
TEXT_DIGEST = "text_sha256"
UK_DIGEST = ["timestamp", "speaker", TEXT_DIGEST]
DIGEST_KEY_COLS = list(dict.fromkeys(PRIMARY_KEY + UK_DIGEST))


def text_digest(text: str | Column = "text") -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(t, 256))


# ---------------------------------------------------------------- F1, P2, P3

def keep_messages(df: DataFrame, bot: str) -> DataFrame:
    """drop empty text and the bot's own messages.  Null-safe: a NULL
    speaker or text stays, so the NOT NULL rule can reject it."""
    return df.filter(~(F.col("text").eqNullSafe(F.lit("")) | F.col("speaker").eqNullSafe(F.lit(bot))))


def stamp_provenance(df: DataFrame, model: str, dim: int, index_type: str | None = None,
                     index_measurement: str | None = None) -> DataFrame:
    """Model, dimension and index columns as constants."""
    return df.withColumns({
        "embedding_model": F.lit(model),
        "embedding_dim": F.lit(int(dim)).cast("int"),
        "index_type": F.lit(index_type).cast("string"),
        "index_measurement": F.lit(index_measurement).cast("string"),
    })


# ---------------------------------------------------------------- C1-C3

def row_checks(df: DataFrame, unknown_col: str | None = None, corrupt_col: str | None = None) -> DataFrame:
    """Add ``reject_reason``: the first failing row-level rule, else NULL.

    Order: corrupt CSV record, C1 unknown field, C2 NOT NULL (declared
    column order), P3 integer cast of ``embedding_dim``, C3 vector length.
    A NULL embedding is allowed.
    """
    dim_int = F.col("embedding_dim").try_cast("int")
    reason: Column = F.lit(None).cast("string")
    checks = []
    if corrupt_col:
        checks.append((F.col(corrupt_col).isNotNull(), F.lit(R_CORRUPT)))
    if unknown_col:
        checks.append((F.size(F.col(unknown_col)) > 0,
                       F.concat(F.lit(R_UNKNOWN + ":"), F.array_join(F.col(unknown_col), ","))))
    if "seq" in df.columns:  # arrival order: rows without one cannot be ordered
        checks.append((F.col("seq").isNull(), F.lit(f"{R_NULL}:seq")))
    for c in REQUIRED:
        checks.append((F.col(c).isNull(), F.lit(f"{R_NULL}:{c}")))
    checks.append((dim_int.isNull(), F.lit(f"{R_TYPE}:embedding_dim")))
    checks.append((F.col("embedding").isNotNull() & (F.size("embedding") != dim_int), F.lit(R_DIM)))
    expr = None
    for cond, val in checks:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    reason = expr.otherwise(reason)
    return df.withColumn("reject_reason", reason).withColumn("embedding_dim", dim_int)


def unknown_fields(json_col: str, allowed: Sequence[str] = STORE_FIELDS) -> Column:
    """C1 for JSON records: keys not in the schema."""
    keys = F.map_keys(F.from_json(F.col(json_col), "map<string,string>"))
    return F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))


JSON_RECORD_SCHEMA = ("trans_id long, timestamp timestamp, speaker string, text string, vec_id long, "
                      "embedding_model string, embedding_dim string, embedding array<float>, "
                      "index_type string, index_measurement string, seq long")


def json_records(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Parse JSON message records: the store columns (``embedding_dim`` as
    text, so P3 decides), ``seq`` when present, ``_unknown`` for C1 and
    ``_corrupt`` for text that is not a JSON object."""
    parsed = F.from_json(F.col(json_col), JSON_RECORD_SCHEMA)
    return df.select(parsed.alias("_r"), unknown_fields(json_col, STORE_FIELDS + ["seq"]).alias("_unknown"),
                     F.when(F.from_json(F.col(json_col), "map<string,string>").isNull(), F.col(json_col))
                     .alias("_corrupt")).select("_r.*", "_unknown", "_corrupt")


# ---------------------------------------------------------------- C4-C6

def _split_store_clashes(rows: DataFrame, store: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """C4/C5 against the store: ``(clashing rows with reason, the rest)``.

    Both keys hold the time, so a clash lies in the row's own ``chunk``; when
    both sides carry it, only the store's partitions of the batch's chunks
    are read (``chunks_of``: a static partition filter, as Spark prunes no
    outer join by itself).
    """
    if store is None:
        return rows.limit(0).withColumn("reject_reason", F.lit(None).cast("string")), rows
    by_chunk = "chunk" in store.columns and "chunk" in rows.columns
    if by_chunk:
        store = store.filter(chunks_of(rows))
    pk = PRIMARY_KEY + (["chunk"] if by_chunk else [])
    uk_cols = UK_DIGEST if TEXT_DIGEST in rows.columns else UNIQUE_KEY
    uk = uk_cols + (["chunk"] if by_chunk else [])
    if TEXT_DIGEST in rows.columns and TEXT_DIGEST not in store.columns:
        store = store.withColumn(TEXT_DIGEST, text_digest("text"))
    # The store is read once for each key, and its keys are distinct, so that
    # a left join adds no rows; the marks are written once for both outputs.
    spk = store.select(*pk).distinct().withColumn("_by_pk", F.lit(R_PK_STORED))
    suk = store.select(*uk).distinct().withColumn("_by_uk", F.lit(R_UK_STORED))
    marked = rows.join(spk, pk, "left").join(suk, uk, "left")
    marked = materialize(marked.withColumn("reject_reason", F.coalesce("_by_pk", "_by_uk"))
                         .select(*rows.columns, "reject_reason"), "store-clash")
    return (marked.filter(F.col("reject_reason").isNotNull()),
            marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"))


#: Chunks named one by one in a partition filter.
NAMED_CHUNKS = 2_000


def chunks_of(rows: DataFrame, named: int = NAMED_CHUNKS) -> Column:
    """A filter on ``chunk`` that holds for every chunk of ``rows``: their
    list, or from ``named`` chunks on their range."""
    found = [r["chunk"] for r in rows.select("chunk").distinct().limit(named + 1).collect()]
    if len(found) <= named:
        return F.col("chunk").isin(found) if found else F.lit(False)
    ends = rows.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()
    return F.col("chunk").between(ends["lo"], ends["hi"])


def _round(r: DataFrame, uk: list[str]) -> DataFrame:
    """One round over undecided rows: ``_status`` = accept / pk / unique / NULL."""
    keys = r.select("seq", *dict.fromkeys(PRIMARY_KEY + uk))
    mpk = keys.groupBy(*PRIMARY_KEY).agg(F.min("seq").alias("seq"))
    muk = keys.groupBy(*uk).agg(F.min("seq").alias("seq"))
    win = mpk.join(muk, ["seq", "timestamp"])  # smallest for both keys
    wpk = win.select(*PRIMARY_KEY, F.col("seq").alias("_wpk"))
    wuk = win.select(*uk, F.col("seq").alias("_wuk"))
    flagged = r.join(wpk, PRIMARY_KEY, "left").join(wuk, uk, "left")
    status = (F.when(F.col("_wpk") == F.col("seq"), F.lit("accept"))
              .when(F.col("_wpk").isNotNull(), F.lit(R_PK))
              .when(F.col("_wuk").isNotNull(), F.lit(R_UK)))
    return flagged.withColumn("_status", status).drop("_wpk", "_wuk")


#: Contested rows of one time that are folded without being told apart.
FOLD_ROWS = 100_000


def _contested(rows: DataFrame, uk: list[str]) -> DataFrame:
    """Rows that share a key with another one.  The shared keys are the
    small side of both joins."""
    shared_pk = rows.groupBy(*PRIMARY_KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        *PRIMARY_KEY, F.lit(True).alias("_p"))
    shared_uk = rows.groupBy(*uk).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*uk, F.lit(True).alias("_u"))
    return (rows.join(shared_pk, PRIMARY_KEY, "left").join(shared_uk, uk, "left")
            .filter("_p or _u").drop("_p", "_u"))


def _components(rows: DataFrame, uk: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``_group``: the least ``seq`` of the component of rows
    linked by shared keys.  Each round a row's label falls to the least label
    around it, the row that is its old label follows, and labels jump to
    their own label, so the rounds grow with the logarithm of a chain."""
    at = rows.withColumn("_group", F.col("seq"))
    rounds = 0
    while True:
        rounds += 1
        by_pk = at.groupBy(*PRIMARY_KEY).agg(F.min("_group").alias("_a"))
        by_uk = at.groupBy(*uk).agg(F.min("_group").alias("_b"))
        seen = at.join(by_pk, PRIMARY_KEY).join(by_uk, uk).withColumn("_m", F.least("_a", "_b")).drop("_a", "_b")
        # the row that a label names takes over what its members have seen
        hooks = seen.groupBy(F.col("_group").alias("seq")).agg(F.min("_m").alias("_h"))
        met = materialize(seen.join(hooks, "seq", "left").withColumn("_to", F.least("_m", F.coalesce("_h", "_m")))
                          .drop("_m", "_h"), "key-labels")
        jump = met.select(F.col("seq").alias("_to"), F.col("_to").alias("_j"))
        done = materialize(met.join(jump, "_to", "left").withColumn("_new", F.least("_to", F.coalesce("_j", "_to")))
                           .drop("_to", "_j"), "key-labels")
        if done.filter("_new < _group").isEmpty():
            return done.drop("_new"), rounds
        at = done.withColumn("_group", F.col("_new")).drop("_new")


def _fold(rows: DataFrame, uk: list[str]) -> DataFrame:
    """Rejects (``seq, reject_reason``) of rows inserted one at a time: each
    ``_group`` passes in arrival order through one task, which holds the
    keys accepted so far in it."""
    n_pk = len(PRIMARY_KEY)
    narrow = rows.select("_group", "seq", *PRIMARY_KEY, *uk).repartition("_group").sortWithinPartitions("_group", "seq")

    def run(batches):
        group, held = None, (set(), set())
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            seqs, reasons = [], []
            for g, seq, *keys in zip(*columns):
                if g != group:
                    group, held = g, (set(), set())
                pk, unique = tuple(keys[:n_pk]), tuple(keys[n_pk:])
                if pk in held[0]:
                    seqs.append(seq)
                    reasons.append(R_PK)
                elif unique in held[1]:
                    seqs.append(seq)
                    reasons.append(R_UK)
                else:
                    held[0].add(pk)
                    held[1].add(unique)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, batch.column(1).type), pa.array(reasons, pa.string())],
                                             names=["seq", "reject_reason"])
    seq_type = rows.schema["seq"].dataType.simpleString()
    return narrow.mapInArrow(run, f"seq {seq_type}, reject_reason string")


def key_rejects(rows: DataFrame) -> tuple[DataFrame, int]:
    """C4-C6 within a batch: ``(seq, reject_reason)`` of the rows that are
    not accepted, written, and the rounds taken.  ``rows`` holds ``seq`` and
    the key columns (the text may be given as its digest) and passed every
    row rule."""
    uk = UK_DIGEST if TEXT_DIGEST in rows.columns else UNIQUE_KEY
    contested = materialize(_contested(rows.select("seq", *dict.fromkeys(PRIMARY_KEY + uk)), uk), "contested")
    crowded = contested.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FOLD_ROWS)
    crowded = materialize(crowded.select("timestamp", F.lit(True).alias("_crowded")), "crowded")
    if crowded.isEmpty():
        return materialize(_fold(contested.withColumn("_group", F.xxhash64("timestamp")), uk), "key-rejects"), 1
    marked = contested.join(crowded, "timestamp", "left")
    few = marked.filter(F.col("_crowded").isNull()).drop("_crowded").withColumn("_group", F.xxhash64("timestamp"))
    many = marked.filter(F.col("_crowded")).drop("_crowded")
    status = materialize(_round(many, uk), "key-round")
    sure = status.filter(F.col("_status") == "accept").drop("_status")
    lost = status.filter(F.col("_status").isin(R_PK, R_UK)).withColumnRenamed("_status", "reject_reason")
    chains, rounds = _components(status.filter(F.col("_status").isNull()).drop("_status"), uk)
    folded = materialize(_fold(few.unionByName(chains), uk), "key-folded")
    held = sure.unionByName(chains.drop("_group").join(folded, "seq", "left_anti"))
    rejects = _pk_first(lost, held).select("seq", "reject_reason").unionByName(folded)
    return materialize(rejects, "key-rejects"), rounds + 1


def resolve_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(accepted, rejected, rounds)`` of ``rows``, see ``key_rejects``."""
    rejects, rounds = key_rejects(rows)
    return rows.join(rejects, "seq", "left_anti"), rows.join(rejects, "seq"), rounds


def check_batch(batch: DataFrame, store: DataFrame | None = None, unknown_col: str | None = None,
                corrupt_col: str | None = None, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Full ingest check of one batch (C1-C6) against an optional store.

    ``batch`` has the store columns and ``seq``.  Returns ``(accepted,
    rejected)``; ``accepted + rejected`` is the whole batch, rejected
    rows keep their columns and add ``reject_reason`` (the dead letter).

    The keys are decided on narrow columns only.  The checked rows and the
    rejects are written tables, so both outputs stay as decided whatever is
    appended to the store later, and neither is computed twice.  A batch that
    is a ``written`` table itself is not written again.
    """
    if "seq" not in batch.columns:
        raise ValueError("the batch needs a `seq` column (arrival order)")
    # The batch is computed once: keys, decisions and rejects all read the
    # same rows, even when the input is not deterministic (arrival numbers
    # assigned on the fly, a source that changes between reads).
    checked = row_checks(batch, unknown_col, corrupt_col)
    if not written:
        checked = materialize(checked, "checked")
    drop = [c for c in (unknown_col, corrupt_col) if c]
    bad_rows = checked.filter(F.col("reject_reason").isNotNull()).drop(*drop)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason", *drop)
    # The narrow key columns are written once: the store split and every
    # round read them several times.
    keys = materialize(good.select("seq", *PRIMARY_KEY, "speaker", text_digest("text").alias(TEXT_DIGEST),
                                   *(["chunk"] if "chunk" in good.columns else [])),
                       "batch-keys")
    # Arrival order must be a total order: one narrow aggregate on the keys.
    if not keys.groupBy("seq").count().filter(F.col("count") > 1).isEmpty():
        raise ValueError("`seq` values repeat within the batch; arrival order must be unique")
    stored_clash, candidates = _split_store_clashes(keys, store)
    rejects, _ = key_rejects(candidates)
    if store is not None:
        held = candidates.join(rejects, "seq", "left_anti")
        clashes = _pk_first(stored_clash.select("seq", *PRIMARY_KEY, "reject_reason"), held)
        rejects = materialize(rejects.unionByName(clashes.select("seq", "reject_reason")), "rejects")
    cols = [c for c in batch.columns if c not in drop]
    accepted = good.join(rejects, "seq", "left_anti").select(*cols)
    rejected = (bad_rows.select(*cols, "reject_reason")
                .unionByName(good.join(rejects, "seq").select(*cols, "reject_reason")))
    return accepted, rejected


def _pk_first(rejected: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reason order of a one-at-a-time insert: the primary key is checked
    before the unique key.  A row rejected for its unique key whose
    primary key is held by an earlier accepted row is a ``pk`` reject.
    Accepted rows have distinct primary keys, so the join adds no rows; only
    those that share one with such a reject take part."""
    uk_rej = rejected.filter(F.col("reject_reason").isin(R_UK, R_UK_STORED))
    other = rejected.filter(~F.col("reject_reason").isin(R_UK, R_UK_STORED))
    held = (accepted.join(uk_rej.select(*PRIMARY_KEY).distinct(), PRIMARY_KEY, "left_semi")
            .select(*PRIMARY_KEY, F.col("seq").alias("_aseq")))
    fixed = (uk_rej.join(held, PRIMARY_KEY, "left")
             .withColumn("reject_reason", F.when(F.col("_aseq") < F.col("seq"), F.lit(R_PK))
                         .otherwise(F.col("reject_reason")))
             .drop("_aseq"))
    return other.unionByName(fixed)


# ---------------------------------------------------------------- A2, A3

def batch_ids(df: DataFrame, chunk_rows: int, seq_col: str = "seq") -> DataFrame:
    """``batch_id = seq div chunk_rows`` (chunks of arrival order)."""
    return df.withColumn("batch_id", F.floor(F.col(seq_col) / F.lit(chunk_rows)).cast("long"))


def load_report(accepted: DataFrame, rejected: DataFrame, chunk_rows: int) -> DataFrame:
    """A2: per batch rows, accepted and errors, and an all-clear flag."""
    a = batch_ids(accepted.select("seq").withColumn("_ok", F.lit(1)), chunk_rows)
    r = batch_ids(rejected.select("seq").withColumn("_ok", F.lit(0)), chunk_rows)
    return (a.unionByName(r).groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum("_ok").cast("long").alias("accepted"),
                 F.sum(1 - F.col("_ok")).cast("long").alias("errors"))
            .withColumn("all_clear", F.col("errors") == 0))


def reasons_report(rejected: DataFrame) -> DataFrame:
    """A2 rollup: rejects per reason code."""
    return (rejected.select(F.split("reject_reason", ":").getItem(0).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


def prefix_commit(accepted: DataFrame, rejected: DataFrame, chunk_rows: int) -> DataFrame:
    """A3: chunks before the first chunk with an error are kept; that
    chunk and all later ones are not loaded.  The first failing chunk id
    is one aggregated number (the only value that reaches the driver)."""
    first_bad = (batch_ids(rejected.select("seq"), chunk_rows)
                 .agg(F.min("batch_id").alias("first_bad")).first()["first_bad"])
    acc = batch_ids(accepted, chunk_rows)
    return acc if first_bad is None else acc.filter(F.col("batch_id") < F.lit(int(first_bad)))
