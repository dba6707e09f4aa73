"""Exact substring deduplication by a sampled (difference-cover) suffix sort.

Sampled positions.  A position is sampled if the hash of its ``GRAM`` bytes
is the least in some window of ``LENGTH`` bytes.  Like a difference cover,
the sample meets every pair of equal windows at equal offsets; unlike one
that goes by position modulo v, it needs no second alignment.

Sampled triples.  A sampled position's triple is (bytes before, its gram,
bytes after), each as far as a window can reach.  Triples are sorted by
name.  A gram that occurs once lies in no repeated window; where a whole
triple occurs again, all windows in it are repeated.

Remaining suffixes.  Where a gram's triples differ, one copy of each triple
names the suffixes around it: the name of a 400-byte prefix is the name of
the triple of the names of three overlapping blocks.  Names are dealt to
buckets, merged with those of all other documents and sorted; a suffix that
equals its neighbour in this order is repeated.

Names are hashes and not ranks: equal strings have equal names without a
global sort in each level of the recursion.  A suffix is named by 64 bits
and compared by 16 more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, row_key

LENGTH = 400
GRAM = 64
#: Texts are scanned in chunks of about this many bytes (or one text).
CHUNK = 1 << 21
#: A batch of suffixes that is named, merged and answered together.
BATCH = 1 << 21
#: Suffix names meant for one bucket.
BUCKET = 1 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_B = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


class Chunk:
    """Running hashes over some texts laid end to end."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, self.gram, self.reach = length, gram, length - gram
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        power, self.inverse = _power_tables(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * power[:n], out=self.prefix[1:])
        self.grams = np.full(n, _NONE)
        if n >= gram:
            g = self.name(np.arange(n - gram + 1), gram)
            self.grams[:len(g)] = np.minimum(g, _NONE - np.uint64(1))
        valid = np.zeros(n, bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            self.grams[max(s, e - gram + 1):e] = _NONE
            valid[s:max(s, e - length + 1)] = True
        # least[p]: least gram hash of the window that starts at p
        least = _slide(np.minimum, np.concatenate([self.grams, np.full(self.reach, _NONE)]), self.reach + 1)
        self.least = np.where(valid, least, np.uint64(0))
        self.valid = valid

    def name(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _mix((self.prefix[at + size] - self.prefix[at]) * self.inverse[at] + np.uint64(_B) * np.asarray(size).astype(np.uint64))

    def sampled(self) -> np.ndarray:
        most = _slide(np.maximum, np.concatenate([np.zeros(self.reach, np.uint64), self.least]), self.reach + 1)
        return np.flatnonzero((most == self.grams) & (self.grams != _NONE))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def around(self, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.maximum(self.starts[owner], at - self.reach), np.minimum(self.ends[owner], at + self.length))

    def triples(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        lo, hi = self.around(at, owner)
        left, right = self.name(lo, at - lo), self.name(at, hi - at)
        return _mix(left + _mix(self.grams[at] + _mix(right)))

    def suffixes(self, at: int, lo: int) -> np.ndarray:
        """Starts of the windows that have ``at`` as their first least gram."""
        here = np.flatnonzero(self.least[lo:at + 1] == self.grams[at]) + lo
        ties = np.flatnonzero(self.grams[lo:at] == self.grams[at])
        return here[here > ties[-1] + lo] if len(ties) else here

    def window_names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of triples of names (three blocks that cover the window)
        and 16 more bits of the same triples, mixed another way."""
        step = self.length // 3
        last = self.length - 2 * step
        a, b, c = self.name(at, last), self.name(at + step, last), self.name(at + 2 * step, last)
        more = _mix(c ^ _mix(a ^ _mix(b ^ np.uint64(_B))))
        return _mix(a + _mix(b + _mix(c))), (more >> np.uint64(48)).astype(np.uint16)


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over all windows of ``width`` by doubling."""
    span, n = 1, len(x) - width + 1
    while 2 * span <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[:n], x[rest:rest + n])


def _sorted(names: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by name and further bits, and which neighbours in it are
    equal.  Only names that clash need the longer sort."""
    order = np.argsort(names, kind="stable")
    for again in (False, True):
        if again:
            order = np.lexsort((more, names))
        s, m = names[order], more[order]
        same, rest = s[1:] == s[:-1], m[1:] == m[:-1]
        if not (same & ~rest).any():
            break
    return order, same & rest


def _chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows whose last item is bytes, in lists of about ``size`` bytes."""
    block, held = [], 0
    for row in rows:
        if block and held + len(row[-1]) > size:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row[-1])
    if block:
        yield block


def _raw(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text


def _sample(docs: DataFrame, text_col: str, id_col: str, length: int, gram: int) -> DataFrame:
    """A row for each text with samples: ``_k1, _k2`` and lists of the
    grams, the triples and the positions."""
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_t"))
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((i, _raw(t.as_py())) for i, t in enumerate(batch.column(2)))
            for block in _chunks(((i, t) for i, t in texts if len(t) >= length), CHUNK):
                c = Chunk([t for _, t in block], length, gram)
                at = c.sampled()
                owner = c.owner(at)
                cuts = np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (
                    c.grams[at].view(np.int64), c.triples(at, owner).view(np.int64), at - c.starts[owner])]
                pick = pa.array([i for i, _ in block], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), *[x.cast(kind) for x in lists]],
                    names=["_k1", "_k2", "gram", "triple", "at"])
    return rows.mapInArrow(run, "_k1 long, _k2 long, gram array<long>, triple array<long>, at array<long>")


def _decisions(samples: DataFrame) -> DataFrame:
    """For each key a list ``_todo`` of ``(at, covered, name_it)``: whether
    the triple occurs again, and whether the suffixes around it are named."""
    flat = samples.select("_k1", "_k2", F.explode(F.arrays_zip("gram", "triple", "at")).alias("s")).select(
        "_k1", "_k2", "s.gram", "s.triple", F.col("s.at").cast("int").alias("at"))
    many = (samples.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("_n"))
            .filter("_n > 1").select("gram"))
    # Written first, so that a frequent gram's side of each join can be split.
    many = materialize(many, "suffix-many")
    shared = materialize(flat.join(many, "gram", "left_semi"), "suffix-shared")
    by_triple = materialize(shared.groupBy("gram", "triple").agg(
        F.count("*").alias("_n"), F.min(F.struct("_k1", "_k2", "at")).alias("_first")), "suffix-triples")
    mixed = materialize(by_triple.groupBy("gram").agg(F.count("*").alias("_t")).filter("_t > 1"), "suffix-mixed")
    facts = materialize(by_triple.join(mixed, "gram", "left").filter("_n > 1 or _t > 1"), "suffix-facts")
    marked = shared.join(facts, ["gram", "triple"]).select(
        "_k1", "_k2", "at", (F.col("_n") > 1).alias("covered"),
        (F.col("_t").isNotNull() & (F.struct("_k1", "_k2", "at") == F.col("_first"))).alias("name_it"))
    # each sampled position once, also if a row is repeated
    return (marked.filter("covered or name_it").groupBy("_k1", "_k2")
            .agg(F.array_sort(F.collect_set(F.struct("at", "covered", "name_it"))).alias("_todo")))


def _merge(spans: list[tuple[int, int]] | np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + length).tolist()))


def _finished(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str, list[int]]:
    digest, at = hashlib.sha256(), 0
    for a, b in spans:
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return (len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [x for s in spans for x in s])


_ROW = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"
_MERGE = f"kind int, bucket int, batch long, doc int, first int, body binary, marks binary, {_ROW}"


class _Rows:
    """Collects rows of the exchange schema."""

    def __init__(self, id_name: str, id_type: pa.DataType):
        self.schema = pa.schema([
            (id_name, id_type), ("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()),
            ("doc", pa.int32()), ("first", pa.int32()), ("body", pa.binary()), ("marks", pa.binary()),
            ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64()))])
        self.rows: list[tuple] = []

    def add(self, id_value, kind, bucket=0, batch=0, doc=0, first=0, body=None, marks=None, done=(None,) * 5):
        self.rows.append((id_value, kind, bucket, batch, doc, first, body, marks, *done))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.schema.types)], schema=self.schema)
        self.rows = []
        return out


#: Kinds of rows: finished, waiting for answers, names, answers.
DONE, WAITING, NAMES, ANSWERS = range(4)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``removed`` (byte spans ``start, end,
    start, end, ...``, ends exclusive, not touching each other).

    Removed are the bytes that lie in a string of ``length`` bytes which
    also starts anywhere else in the table, in the same text included.
    Texts are UTF-8 bytes; null is empty.  Texts shorter than ``length``
    keep all.  Repeated rows repeat each other's bytes.  Null ids are
    carried; an empty table gives no rows; other columns are left out.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram is at most as long as the strings sought")
    samples = materialize(_sample(docs, text_col, id_col, length, gram), "suffix-samples")
    todo = materialize(_decisions(samples), "suffix-todo")
    named = todo.select(F.sum(F.size(F.filter("_todo", lambda s: s["name_it"]))).alias("n")).first()["n"] or 0
    buckets = int(max(16, named * (length - gram) / 2 // BUCKET))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`_id` {id_type}, {_MERGE}"

    packed = docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col), F.col(text_col).alias("_t"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            body = pa.array([z.compress(_raw(t.as_py())) for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], body], names=["_id", "_k1", "_k2", "_z"])

    texts = packed.mapInArrow(compress, f"`_id` {id_type}, _k1 long, _k2 long, _z binary")
    joined = texts.join(todo, ["_k1", "_k2"], "left").select(
        "_id", "_z", F.transform("_todo", lambda s: s["at"].cast("long") * 4 + F.when(s["covered"], 2).otherwise(0)
                                 + F.when(s["name_it"], 1).otherwise(0)).alias("_do"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unzip, zipper = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        out, number = None, 0
        held: list[tuple] = []  # (names, further bits, answer wanted) of this batch
        n_held = n_docs = n_bytes = 0

        def close() -> None:
            """Sends the batch's names; those met twice here are answered."""
            nonlocal held, n_held, n_docs, n_bytes, number
            if held:
                batch = part << 32 | number
                names = np.concatenate([h[0] for h in held])
                more = np.concatenate([h[1] for h in held])
                wanted = np.concatenate([h[2] for h in held])
                order, same = _sorted(names, more)
                head = np.concatenate([[True], ~same])
                group = np.cumsum(head) - 1
                many = np.bincount(group)[group] > 1
                known = np.zeros(len(names), bool)
                known[order] = many
                hit = np.flatnonzero(known & wanted).astype("<u4")
                if len(hit):
                    out.add(None, ANSWERS, batch=batch, bucket=number % buckets, body=hit.tobytes())
                send = order[head]
                to = (names[send] % np.uint64(buckets)).astype(np.int64)
                send = send[np.argsort(to, kind="stable")]
                to = np.sort(to, kind="stable")
                for cut in np.split(np.arange(len(send)), np.flatnonzero(np.diff(to)) + 1):
                    index = send[cut]
                    open_ = wanted[index] & ~known[index]
                    index = np.concatenate([np.sort(index[open_]), index[~open_]])
                    gaps = np.diff(index[:open_.sum()], prepend=0).astype("<u4")
                    out.add(None, NAMES, int(to[cut[0]]), batch, done=(len(index), *[None] * 4),
                            body=names[index].astype("<u8").tobytes() + more[index].astype("<u2").tobytes(),
                            marks=gaps.tobytes())
            held, n_held, n_docs, n_bytes = [], 0, 0, 0
            number += 1

        for batch in batches:
            out = out or _Rows("_id", batch.column(0).type)
            rows = ((i, d, unzip.decompress(z)) for i, z, d in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for block in _chunks(rows, CHUNK):
                busy = [r for r in block if r[1]]
                for i, do, text in block:
                    if not do:
                        out.add(i, DONE, bucket=len(out.rows) % buckets, done=_finished(text, []))
                c = Chunk([r[2] for r in busy], length, gram) if busy else None
                for k, (i, do, text) in enumerate(busy):
                    do = np.array(do, np.int64)
                    at, covered, name_it = do >> 2, (do & 2) > 0, (do & 1) > 0
                    lo, hi = np.maximum(0, at - c.reach), np.minimum(len(text), at + length)
                    big = covered & (hi - lo >= length)
                    spans = _merge(list(zip(lo[big].tolist(), hi[big].tolist())))
                    base = int(c.starts[k])
                    found = [(c.suffixes(base + int(a), base + int(b)), not v)
                             for a, b, v in zip(at[name_it], lo[name_it], covered[name_it])]
                    found = [(p, want) for p, want in found if len(p)]
                    if not any(want for _, want in found):
                        out.add(i, DONE, bucket=len(out.rows) % buckets, done=_finished(text, spans))
                        if not found:
                            continue
                    starts = np.concatenate([p for p, _ in found])
                    wants = np.concatenate([np.full(len(p), want) for p, want in found])
                    names, more = c.window_names(starts)
                    if any(want for _, want in found):
                        marks = np.concatenate([[len(spans)], np.array(spans, np.int64).reshape(-1), starts - base])
                        out.add(i, WAITING, n_docs % buckets, part << 32 | number, n_docs, n_held,
                                zipper.compress(text), zipper.compress(np.diff(marks.astype("<i8"), prepend=0).tobytes()))
                    held.append((names, more, wants))
                    n_held, n_docs, n_bytes = n_held + len(names), n_docs + 1, n_bytes + len(text)
                    if n_held >= BATCH or n_bytes >= 16 * BATCH:
                        close()
                if len(out.rows) > 2000:
                    yield out.take()
        if out is not None:
            close()
            yield out.take()

    exchange = joined.mapInArrow(name, schema).repartition(F.col("kind") == NAMES, F.col("bucket"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorts each bucket's names and answers equal neighbours."""
        out, bucket, group = None, None, []

        def close() -> None:
            if group:
                names = np.concatenate([np.frombuffer(r[1], "<u8", r[3]) for r in group])
                more = np.concatenate([np.frombuffer(r[1], "<u2", r[3], 8 * r[3]) for r in group])
                order, same = _sorted(names, more)
                hit = np.zeros(len(names), bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                at = 0
                for batch, _, marks, n in group:
                    index = np.cumsum(np.frombuffer(marks, "<u4").astype(np.int64))
                    got = index[hit[at:at + len(index)]].astype("<u4")
                    at += n
                    if len(got):
                        out.add(None, ANSWERS, batch=batch, body=got.tobytes())
                group.clear()

        for b in batches:
            out = out or _Rows("_id", b.column(0).type)
            kinds = np.array(b.column(1))
            rest = pa.array(np.flatnonzero(kinds != NAMES))
            if len(rest):
                yield b.take(rest)
            for j in np.flatnonzero(kinds == NAMES).tolist():
                if b.column(2)[j].as_py() != bucket:
                    close()
                    bucket = b.column(2)[j].as_py()
                group.append(tuple(b.column(k)[j].as_py() for k in (3, 6, 7, 8)))
            if len(out.rows) > 2000:
                yield out.take()
        if out is not None:
            close()
            yield out.take()

    merged = materialize(exchange.sortWithinPartitions("kind", "bucket").mapInArrow(merge, schema), "suffix-merged")
    done = merged.filter(f"kind = {DONE}").select("_id", *[c.split()[0] for c in _ROW.split(", ")])
    waiting = (merged.filter(f"kind in ({WAITING}, {ANSWERS})").select("_id", "kind", "batch", "doc", "first", "body", "marks")
               .repartition("batch").sortWithinPartitions("batch", F.col("kind").desc(), "doc"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers of a batch come first, then its texts in their order."""
        unzip, number, hits, fresh = zstandard.ZstdDecompressor(), None, [], True
        names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        for b in batches:
            rows = []
            for i, kind, batch, _, first, body, marks in zip(*(c.to_pylist() for c in b.columns)):
                if batch != number:
                    number, hits, fresh = batch, [], True
                if kind == ANSWERS:
                    hits.append(np.frombuffer(body, "<u4"))
                    continue
                if fresh:
                    known, fresh = np.sort(np.concatenate([np.empty(0, "<u4"), *hits])), False
                text = unzip.decompress(body)
                marks = np.cumsum(np.frombuffer(unzip.decompress(marks), "<i8"))
                n = int(marks[0])
                spans, starts = marks[1:1 + 2 * n].reshape(-1, 2).tolist(), marks[1 + 2 * n:]
                a, z = np.searchsorted(known, [first, first + len(starts)])
                found = np.unique(starts[known[a:z].astype(np.int64) - first])
                rows.append((i, *_finished(text, _merge([*map(tuple, spans), *_runs(found, length)]))))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    answered = waiting.mapInArrow(answer, f"`_id` {id_type}, {_ROW}")
    return done.unionByName(answered).withColumnRenamed("_id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """As ``repeated_bytes``, with the kept bytes in ``kept`` (binary: a span
    may end inside a character).  Rows meet their spans by id, so the ids
    must be unique and not null."""
    found = repeated_bytes(docs, id_col, text_col, length)
    keep = F.expr("transform(sequence(0, cast(size(removed) / 2 as int)), i -> struct("
                  "if(i = 0, 0L, removed[2 * i - 1]) as a, if(2 * i < size(removed), removed[2 * i], n_bytes) as b))")
    raw = F.encode(F.coalesce(text_col, F.lit("")), "utf-8")
    return (docs.select(id_col, raw.alias("_raw")).join(found, id_col)
            .withColumn("_keep", keep)
            .withColumn("kept", F.expr("aggregate(_keep, cast('' as binary), (acc, s) -> "
                                       "acc || substring(_raw, cast(s.a + 1 as int), cast(s.b - s.a as int)))"))
            .drop("_raw", "_keep"))
