"""Document fingerprints: a Merkle tree over sections, paragraphs, pieces.

A text's paragraphs are its lines; a section ends at a blank line or at a
paragraph whose hash says so (one in eight), so an edit moves no boundary
elsewhere.  Paragraphs are cut into sentence pieces, the leaves.  Equal
roots mean equal texts; walking down unequal branches locates the edits.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64encode
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialize

#: Pieces are sentences, cut every 48 code points; they join to the text.
_PIECE = re.compile(r"[^.!?]{1,48}(?:[.!?]{1,8}\s{0,8})?|[.!?]{1,48}")
SECTION_MOD = 8
#: Bytes of a leaf's hash in the tree and in the printed fingerprint.
LEAF_BYTES, PRINTED_BYTES = 16, 3


def _hash(kind: bytes, data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size, person=kind).digest()


class Tree:
    """``sections`` -> ``paragraphs`` -> ``leaves``; a node is
    ``(hash, code points, children)``, a leaf has no children."""

    __slots__ = ("root", "size", "sections")

    def __init__(self, text: str):
        sections, paragraphs = [], []
        for line in text.split("\n"):
            leaves = [(_hash(b"leaf", p.encode("utf-8", "surrogatepass"), LEAF_BYTES), len(p), ())
                      for p in _PIECE.findall(line)]
            node = _hash(b"paragraph", line.encode("utf-8", "surrogatepass"))
            paragraphs.append((node, len(line), leaves))
            if not line.strip() or node[0] % SECTION_MOD == 0:
                sections.append(_join(paragraphs))
                paragraphs = []
        if paragraphs:
            sections.append(_join(paragraphs))
        self.sections, self.size = sections, len(text)
        self.root = _hash(b"text", b"".join(s[0] for s in sections))

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        for section in self.sections:
            for paragraph in section[2]:
                for leaf in paragraph[2]:
                    yield leaf[0], leaf[1]


def _join(paragraphs: list) -> tuple:
    return _hash(b"section", b"".join(p[0] for p in paragraphs)), sum(p[1] for p in paragraphs), paragraphs


def fingerprint(tree: Tree) -> str:
    """The root in hex, then each leaf's shortened hash and length (four bytes
    a leaf, in base 64)."""
    return tree.root.hex() + ":" + b64encode(b"".join(h[:PRINTED_BYTES] + bytes([n]) for h, n in tree.leaves())).decode()


def likeness(a: Tree, b: Tree) -> float:
    """Share of both texts' code points in common leaves, 0 to 1; 1 for equal
    roots."""
    if a.root == b.root:
        return 1.0
    ours, theirs = Counter(a.leaves()), Counter(b.leaves())
    common = sum(n * min(c, theirs[h, n]) for (h, n), c in ours.items() if (h, n) in theirs)
    total = sum(n * c for (_, n), c in ours.items()) + sum(n * c for (_, n), c in theirs.items())
    return 2 * common / total if total else 0.0


def _aligned(old: list[bytes], new: list[bytes]) -> list[tuple[int, int]]:
    """Places in ``old`` and ``new`` of equal hashes, ascending in both: the
    common start and end, and between them the longest ascending run of the
    k-th occurrences of a hash in both."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    places: dict[bytes, list[int]] = {}
    for i in range(len(old) - tail - 1, head - 1, -1):
        places.setdefault(old[i], []).append(i)
    pairs = [(places[new[j]].pop(), j) for j in range(head, len(new) - tail) if places.get(new[j])]
    ends: list[int] = []  # least last place of an ascending run of each length
    last: list[int] = []  # its pair
    before: list[int | None] = []
    for n, (i, _) in enumerate(pairs):
        at = bisect_left(ends, i)
        before.append(last[at - 1] if at else None)
        ends[at:at + 1], last[at:at + 1] = [i], [n]
    run, n = [], last[-1] if last else None
    while n is not None:
        run.append(pairs[n])
        n = before[n]
    return [*((k, k) for k in range(head)), *reversed(run),
            *((len(old) - k, len(new) - k) for k in range(tail, 0, -1))]


_NEWLINE = (_hash(b"leaf", b"\n"), 1, ())


def _placed(nodes: list, at: int, end: int) -> list[tuple]:
    """``(node, start, end)``; a paragraph takes the line break after it."""
    out = []
    for node in nodes:
        breaks = (len(node[2]) if _is_section(node) else 1) if isinstance(node[2], list) else 0
        out.append((node, at, min(at + node[1] + breaks, end)))
        at = out[-1][2]
    return out


def _below(placed: list[tuple], end: int) -> list[tuple]:
    """The children of sections or of paragraphs, with line breaks as leaves."""
    out = []
    for node, start, stop in placed:
        children = node[2]
        if not _is_section(node) and start + node[1] < stop:
            children = [*children, _NEWLINE]
        out += _placed(children, start, end)
    return out


def _is_section(node: tuple) -> bool:
    return isinstance(node[2], list) and bool(node[2]) and isinstance(node[2][0][2], list)


def edits(old: str, new: str) -> list[tuple[int, int]]:
    """Code point ranges of ``new`` (end exclusive) that ``old`` lacks there,
    by descending unequal branches only; an empty range is a place where
    something of ``old`` is gone.  Children are aligned in order, so a
    paragraph that moved is gone in one place and new in another, and a
    repeated one is new.  Neighbouring ranges merge.  Equal texts: no range;
    unequal texts: at least one.  Very long texts are compared whole, in time
    n log n of the nodes that differ."""
    a, b = Tree(old), Tree(new)
    if a.root == b.root:
        return []
    out: list[tuple[int, int]] = []

    def walk(mine: list, theirs: list, end: int) -> None:
        pairs = _aligned([n[0][0] for n in theirs], [n[0][0] for n in mine])
        i = j = 0
        for their_next, my_next in [*pairs, (len(theirs), len(mine))]:
            ours, gone = mine[j:my_next], theirs[i:their_next]
            here = mine[j][1] if j < len(mine) else end
            if ours and gone and isinstance(ours[0][0][2], list):
                walk(_below(ours, b.size), _below(gone, a.size), ours[-1][2])
            elif ours or gone:
                start, stop = here, ours[-1][2] if ours else here
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], max(stop, out[-1][1]))
                else:
                    out.append((start, stop))
            i, j = their_next + 1, my_next + 1

    walk(_placed(b.sections, 0, b.size), _placed(a.sections, 0, a.size), b.size)
    return out


def locate_edits(pairs: DataFrame, old_col: str, new_col: str, id_col: str) -> DataFrame:
    """For each row ``id_col`` and ``edits``, an array of ``(start, end)`` in
    ``new_col`` (see ``edits``).  Null texts are empty, repeated rows give a
    row each, other columns are left out."""
    kind = pairs.schema[id_col].dataType.simpleString()
    picked = pairs.select(F.col(id_col), F.col(old_col).alias("_a"), F.col(new_col).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"start": s, "end": e} for s, e in edits(a.as_py() or "", b.as_py() or "")]
                     for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=[id_col, "edits"])
    return picked.mapInArrow(run, f"`{id_col}` {kind}, edits array<struct<start:int,end:int>>")


_RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compared(text: str, tree: Tree, after: str, after_tree: Tree) -> tuple:
    take = len(text) // 4
    edited = text[:len(text) - take] + after[:take]
    other = tree if edited == text else Tree(edited)
    return (len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(tree),
            fingerprint(other), likeness(tree, other), likeness(tree, after_tree))


def _result_batch(kind: pa.DataType, rows: list[tuple], extra: list[tuple[str, pa.DataType]], id_col: str) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[t for _, t in extra]]
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             *[n for n, _ in extra]]
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the last quarter of the
    code points replaced by the start of the next document's text) and their
    likeness, and the likeness to the next document.

    The next document is the next in order of the id (nulls first; equal ids
    by hash of the text); after the last comes the first, so a single
    document follows itself.  Null texts are empty.  Texts are dealt by
    ranges of ids and read in order in each range, one at a time; only the
    first and last text of each range are joined with those of the
    neighbouring ranges.  Other columns are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       F.xxhash64(text_col).alias("_h"))
    order = [F.col(id_col).asc_nulls_first(), F.col("_h")]

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            body = [z.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(body, pa.binary()), b.column(2)],
                                             names=[id_col, "_text", "_h"])

    # Texts are shuffled once, compressed.
    small = rows.mapInArrow(shrink, f"`{id_col}` {id_type}, _text binary, _h long")
    ranged = small.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, "_text")
    extra = [("_part", pa.int32()), ("_role", pa.string()), ("_edge", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, kind = TaskContext.get().partitionId(), None, None
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            kind, out = batch.column(0).type, []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = unzip.decompress(text.as_py()).decode("utf-8", "surrogatepass")
                tree = Tree(text)
                if before is None:
                    out.append((name, *[None] * 6, part, "first", text))
                else:
                    out.append((before[0], *_compared(before[1], before[2], text, tree), part, "row", None))
                before = name, text, tree
            yield _result_batch(kind, out, extra, id_col)
        if before is not None:
            yield _result_batch(kind, [(before[0], *[None] * 6, part, "last", before[1])], extra, id_col)

    found = materialize(ranged.mapInArrow(run, f"`{id_col}` {id_type}, {_RESULT}, _part int, _role string, _edge string"),
                        "merkle-rows")
    parts = found.filter("_role = 'first'").select("_part")
    after = Window.orderBy("_part")
    nexts = parts.select("_part", F.lead("_part").over(after).alias("_next"), F.min("_part").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_least"))
    nexts = nexts.select("_part", F.coalesce("_next", "_least").alias("_next"))
    edges = (found.filter("_role = 'last'").select(id_col, F.col("_edge").alias("_a"), "_part").join(nexts, "_part")
             .join(found.filter("_role = 'first'").select(F.col("_part").alias("_next"), F.col("_edge").alias("_b")),
                   "_next").select(id_col, "_a", "_b"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result_batch(batch.column(0).type, [
                (name, *_compared(a, Tree(a), b, Tree(b))) for name, a, b in zip(*(c.to_pylist() for c in batch.columns))],
                [], id_col)
    closed = edges.mapInArrow(close, f"`{id_col}` {id_type}, {_RESULT}")
    return found.filter("_role = 'row'").drop("_part", "_role", "_edge").unionByName(closed)
