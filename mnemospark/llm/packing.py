"""Packing into fixed-length sequences by vector bin packing.

Every example has three sizes: tokens, segments and loss-bearing tokens.
Blocks of examples are packed where they are tokenised: an open sequence
takes the example whose size vector has the largest dot product with what is
left of its limits; when none fits whole, the best one is cut to fill it.
What a block leaves over at its end becomes sequences of powers of two, which
need no padding.  No row is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 2048
MAX_SEGMENTS = 128
END_ID = 1
#: A block ends at this many examples or tokens.
BLOCK_EXAMPLES = 4096
BLOCK_TOKENS = 1 << 22
#: Words whose ids a task remembers.
MEMO_WORDS = 400_000
#: Fixed pattern: how the byte-level BPE files cut a text before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GAP = re.compile(r"(?<=\S) (?=\S)")


def _added_tokens(path: str) -> dict[str, int]:
    """Tokens of a tokenizer file that stand for themselves in a text."""
    import json
    import os
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}


class Encoder:
    """Ids of whole texts by a byte-level BPE file.

    Its pre-tokeniser always cuts before a single space between two other
    characters, so texts are cut there and the ids of a piece are remembered
    as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = list(_added_tokens(path))
        self.memo: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _GAP.split(text)
        words = [first, *[" " + w for w in rest]]
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list(dict.fromkeys(words))
            for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
                memo[w] = np.array(e.ids, "<u4").tobytes()
        return b"".join([memo[w] for w in words])


class RankEncoder:
    """Ids of whole texts by a file of ranks: the same byte-level BPE in the
    form that does not build an object for each token.  Added tokens are in
    the tokenizer file of the same name that lies beside it."""

    def __init__(self, path: str):
        import base64

        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = _added_tokens(path.removesuffix(".tiktoken") + ".json")
        self.added = list(added)
        self.bpe = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()
        return array("I", self.bpe.encode_ordinary(text)).tobytes()


_ENCODERS: dict[str, Encoder | RankEncoder] = {}


def _encoder(path: str) -> Encoder | RankEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = (RankEncoder if path.endswith(".tiktoken") else Encoder)(path)
    return _ENCODERS[path]


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS


def pack_block(sizes: np.ndarray, prompts: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(example, start, length, sequence, offset)`` of a block.

    ``sizes`` are token counts (at least 1), ``prompts`` how many tokens at
    the front bear no loss.  A piece that would hold too many loss-bearing
    tokens is cut shorter.
    """
    start = np.zeros(len(sizes), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0

    def loss(i: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.maximum(0, start[i] + length - np.maximum(start[i], prompts[i]))

    def fit(i: int, tokens: int, left: int) -> int:
        """The longest piece of example i within tokens and loss left."""
        length = min(int(sizes[i] - start[i]), tokens)
        free = max(0, int(prompts[i] - start[i]))
        return min(length, free + left)

    # Whole sequences from one long example.
    for i in np.flatnonzero(sizes >= limits.tokens).tolist():
        while sizes[i] - start[i] >= limits.tokens:
            n = fit(i, limits.tokens, limits.loss)
            if n < limits.tokens:
                break
            out.append((i, int(start[i]), n, seq, 0))
            start[i] += n
            seq += 1
    todo = np.flatnonzero(sizes > start)
    while len(todo):
        tokens, segments, left, offset = limits.tokens, limits.segments, limits.loss, 0
        while len(todo) and tokens and segments:
            need = sizes[todo] - start[todo]
            bears = loss(todo, need)
            dot = (need / limits.tokens * (tokens / limits.tokens)
                   + 1 / limits.segments * (segments / limits.segments)
                   + bears / limits.loss * (left / limits.loss))
            whole = (need <= tokens) & (bears <= left)
            if whole.any():
                k = int(np.argmax(np.where(whole, dot, -1)))
            else:
                k = int(np.argmax(dot))
            i = int(todo[k])
            n = fit(i, tokens, left)
            if n <= 0:  # only loss is left of every example
                break
            out.append((i, int(start[i]), n, seq, offset))
            left -= int(loss(np.array([i]), np.array([n]))[0])
            start[i] += n
            tokens, segments, offset = tokens - n, segments - 1, offset + n
            if start[i] == sizes[i]:
                todo = np.delete(todo, k)
        seq += 1
    return _powers(out, limits)


def _powers(pieces: list[tuple], limits: Limits) -> list[tuple]:
    """Cuts each sequence that is not full into sequences of powers of two."""
    total: dict[int, int] = {}
    for _, _, n, s, _ in pieces:
        total[s] = total.get(s, 0) + n
    last = max(total, default=-1)
    ends: dict[int, list[tuple[int, int]]] = {}
    for s, n in list(total.items()):
        if n < limits.tokens and n & (n - 1):
            at, parts = 0, []
            for b in range(n.bit_length() - 1, -1, -1):
                if n >> b & 1:
                    at += 1 << b
                    parts.append((at, s if not parts else (last := last + 1)))
            ends[s] = parts
    out = []
    for i, start, n, s, offset in pieces:
        if s not in ends:
            out.append((i, start, n, s, offset))
            continue
        before = 0
        for end, name in ends[s]:
            take = min(offset + n, end) - max(offset, before)
            if take > 0:
                a = max(offset, before)
                out.append((i, start + a - offset, take, name, a - before))
            before = end
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         prompt_col: str | None = None, end_id: int = END_ID, limits: Limits | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row for each piece: the id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``loss_tokens`` and, on
    request, ``ids``.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can
    read: a tokenizer in JSON, or its vocabulary as ranks (``.tiktoken``),
    which gives the same ids in less time and bounded memory.  An example is the ids of its prompt (if there is such a column;
    they bear no loss), of its text and ``end_id``.  Null texts and prompts
    are empty: such an example is the end id alone.  Repeated rows and null
    ids are examples like any other; an empty table gives no rows.  A
    sequence's id is its partition and place; its rows come from one task.
    Examples meet in blocks in the order in which a partition is read.
    """
    limits = limits or Limits()
    picked = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text")]
    picked.append((F.col(prompt_col) if prompt_col else F.lit(None).cast("string")).alias("_prompt"))
    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, "
              "doc_tokens long, sequence_id long, offset long, loss_tokens long" + (", ids array<int>" if with_ids else ""))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = _encoder(tokenizer), TaskContext.get().partitionId() << 36
        ids: list = []
        raw: list[bytes] = []
        prompts: list[int] = []
        used = n_tokens = 0
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal used, n_tokens
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            pieces = pack_block(sizes, np.array(prompts, np.int64), limits)
            cols: list[list] = [[] for _ in range(9 if with_ids else 8)]
            for i, a, n, s, o in pieces:
                part = raw[i][4 * a:4 * (a + n)]
                row = [ids[i], a, n, zlib.crc32(part), int(sizes[i]), base + used + s, o,
                       max(0, a + n - max(a, prompts[i]))]
                if with_ids:
                    row.append(np.frombuffer(part, "<u4").astype(np.int32))
                for c, x in zip(cols, row):
                    c.append(x)
            used += max((p[3] for p in pieces), default=-1) + 1
            types = [kind, *[pa.int64()] * 7, *[pa.list_(pa.int32())] * with_ids]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens",
                     *["ids"] * with_ids]
            for c in (ids, raw, prompts):
                c.clear()
            n_tokens = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for name, text, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                front = encode(prompt or "")
                ids.append(name)
                prompts.append(len(front) // 4)
                raw.append(front + encode(text or "") + end)
                n_tokens += len(raw[-1]) // 4
                if len(raw) >= BLOCK_EXAMPLES or n_tokens >= BLOCK_TOKENS:
                    yield flush()
        if raw:
            yield flush()

    return docs.select(*picked).mapInArrow(run, schema)
