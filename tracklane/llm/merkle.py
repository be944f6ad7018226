"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.

Leaves are clauses (a run of text with the punctuation and line ends after it), so every byte of the text lies in one
leaf. Lines make paragraphs, blank lines end sections, and the root covers the sections. Equal texts have equal roots;
where roots differ, the branches that differ lead to the edits. The likeness of two trees is the share of bytes, of
both texts, in leaves that the other tree has too. Both are found by descending the trees where they differ.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents

# Where clauses end.
_CLAUSE = re.compile(rb"[^.,;:!?|%&*$#\n]+(?:[.,;:!?|%&*$#]+ ?\n*|\n+)?|[.,;:!?|%&*$#]+ ?\n*|\n+")
_FINE = re.compile(rb"[^ ]*[anrs] +|[^ ]+ *| +")
#: A clause of more bytes is cut after words that end in a, n, r or s; a word of more bytes every so many bytes.
LONG = 256
HASH_BYTES = 16


def _hash(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(level + data, digest_size=HASH_BYTES).digest()


def _clauses(text: bytes) -> Iterator[bytes]:
    for piece in _CLAUSE.findall(text):
        if len(piece) <= LONG:
            yield piece
            continue
        held = b""
        for word in _FINE.findall(piece):
            held += word
            if word.rstrip(b" ")[-1:] in (b"a", b"n", b"r", b"s") or len(held) > LONG:
                for i in range(0, len(held), LONG):
                    yield held[i : i + LONG]
                held = b""
        if held:
            yield held


@dataclass(frozen=True, slots=True)
class Node:
    """A hash, the bytes of text below it, and its parts: the root has sections, these paragraphs, and these clauses."""

    hash: bytes
    size: int
    parts: tuple[Node, ...] = ()


def tree(text: bytes) -> Node:
    sections, paragraphs, clauses = [], [], []

    def closed(level: bytes, parts: list[Node]) -> Node:
        return Node(_hash(level, b"".join(p.hash for p in parts)), sum(p.size for p in parts), tuple(parts))

    def end_paragraph():
        if clauses:
            paragraphs.append(closed(b"\1", clauses))
            clauses.clear()

    def end_section():
        end_paragraph()
        if paragraphs:
            sections.append(closed(b"\2", paragraphs))
            paragraphs.clear()

    for piece in _clauses(text):
        clauses.append(Node(_hash(b"\0", piece), len(piece)))
        if piece.endswith(b"\n"):
            end_section() if piece.endswith(b"\n\n") else end_paragraph()
    end_section()
    return closed(b"\3", sections)


def common_bytes(a: tuple[Node, ...], b: tuple[Node, ...]) -> int:
    """Bytes in clauses that both sides have, as often as both have them. Equal branches count whole and aren't entered."""
    left = Counter(n.hash for n in b)
    common, rest = 0, []
    for n in a:
        if left[n.hash]:
            left[n.hash] -= 1
            common += n.size
        elif n.parts:
            rest += n.parts
    other = []
    for n in b:
        if n.parts and left[n.hash]:
            left[n.hash] -= 1
            other += n.parts
    return common + (common_bytes(tuple(rest), tuple(other)) if rest and other else 0)


def likeness(a: Node, b: Node) -> float:
    """The share of both texts' bytes in common clauses: 1 for equal texts (also two empty ones), 0 if there are none."""
    if a.hash == b.hash:
        return 1.0
    return 2 * common_bytes(a.parts, b.parts) / (a.size + b.size)


def unmatched(a: tuple[Node, ...], b: tuple[Node, ...]) -> list[int]:
    """Positions in ``a`` outside of a longest run of nodes that ``b`` has in the same order (its k-th copy for the k-th)."""
    places: dict[bytes, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j].hash, []).append(j)
    ends, last, before = [], [], {}  # the least end of an ascending run of each length, whose it is, and what it follows
    for i, n in enumerate(a):
        if places.get(n.hash):
            j = places[n.hash].pop()
            k = bisect_left(ends, j)
            ends[k : k + 1], last[k : k + 1] = [j], [i]
            before[i] = last[k - 1] if k else None
    keep, i = set(), last[-1] if last else None
    while i is not None:
        keep.add(i)
        i = before[i]
    return [i for i in range(len(a)) if i not in keep]


def edits(a: Node, b: Node) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a``, from 0, that ``b`` lacks or has elsewhere; equal branches aren't entered.

    Sections are set against each other first; the paragraphs of those that differ, or have moved, against the
    paragraphs of ``b``'s that do.
    """
    if a.hash == b.hash:
        return []
    ours, theirs = unmatched(a.parts, b.parts), unmatched(b.parts, a.parts)
    at = [(i, j) for i in ours for j in range(len(a.parts[i].parts))]
    found = unmatched(tuple(a.parts[i].parts[j] for i, j in at), tuple(p for i in theirs for p in b.parts[i].parts))
    return [at[k] for k in found]


def first_difference(a: Node, b: Node) -> int | None:
    """The paragraph, from 0 over all of the text, at which the trees begin to differ; None if they don't."""
    if a.hash == b.hash:
        return None
    at = 0
    for x, y in zip(a.parts, b.parts, strict=False):
        if x.hash != y.hash:
            return at + next((k for k, (p, q) in enumerate(zip(x.parts, y.parts, strict=False)) if p.hash != q.hash), min(len(x.parts), len(y.parts)))
        at += len(x.parts)
    return at


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, root, and the hashes of sections and of their paragraphs, in hex.

    A null text counts as empty; it has a root and no sections. Ids may be null or repeat. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [tree((x or "").encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.hash.hex() for t in trees], pa.string()),
                 pa.array([[{"hash": x.hash.hex(), "paragraphs": [p.hash.hex() for p in x.parts]} for x in t.parts] for t in trees], pa.list_(pa.struct([("hash", pa.string()), ("paragraphs", pa.list_(pa.string()))])))],
                ["id", "root", "sections"],
            )

    section = T.StructType([T.StructField("hash", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("root", T.StringType()), T.StructField("sections", T.ArrayType(section))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (part, copy, id, text) dealt into ranges of ascending id, each in order and followed by the row after it.

    The range bounds are ids that exist, so the first row of a range is known by its id: it is dealt to the range before
    as well, as a copy, and the very first row to the last range. Null ids come first; rows of one id are in text order.
    One shuffle of the texts; the driver gets ``parts`` numbers.
    """
    spread = [i / parts for i in range(1, parts)]
    least, nulls, bounds = docs.agg(F.min(id_col), F.count(F.when(F.col(id_col).isNull(), 1)), F.percentile_approx(id_col, spread, 100 * parts) if spread else F.lit(None)).first()
    bounds = [b for b in sorted(set(bounds or [])) if nulls or b != least]
    last = len(bounds)

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(bounds)
        for batch in batches:
            rows, part, copy = [], [], []
            for i, x in enumerate(batch.column(0).to_pylist()):
                own = bisect_right(bounds, x) if x is not None else 0
                places = [(own, 0)] + [(own - 1, 1)] * (x in known) + [(last, 2)] * (x is None if nulls else x == least)
                for p, c in places:
                    rows.append(i)
                    part.append(p)
                    copy.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(copy, pa.int32()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns)], ["part", "copy", "id", "text"])

    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("copy", T.IntegerType()), kept.schema["id"], T.StructField("text", T.StringType())])
    return kept.mapInArrow(part_of, schema).repartitionById(last + 1, F.col("part")).sortWithinPartitions("copy", F.col("id").asc_nulls_first(), "text")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and the likeness to the next document.

    The edited text has the last quarter of its code points, rounded down, replaced by the first as many of the next
    document by ascending id (all of it if it is shorter; the first document follows the last). Null texts count as
    empty, null ids come first, and rows that share an id follow each other by text. ``edit_at`` is the paragraph, from
    0, of the first difference, null if there is none. A single row is its own next. No rows give no rows. Ids are whole
    numbers of any width, else a TypeError tells so; rows of one id, or without one, are put in order by one task.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, not {kind.simpleString()}")
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, id_col, text_col, parts)

    def compare(cur, nxt):
        text, own = cur[1], cur[2]
        k = len(text) // 4
        edited = text[: len(text) - k] + nxt[1][:k] if k else text
        raw = edited.encode()
        other = tree(raw)
        return cur[0], len(text), hashlib.sha256(raw).hexdigest(), own.hash.hex(), other.hash.hex(), likeness(own, other), likeness(own, nxt[2]), first_difference(own, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come as the range's own, then copies of what follows; the first copy closes the range
        held, closed, out = None, False, []
        for batch in batches:
            copies, ids, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for copy, i, text in zip(copies, ids, texts, strict=True):
                if closed:
                    break
                row = (i, text, tree(text.encode()))
                if held is not None:
                    out.append(compare(held, row))
                held, closed = row, copy > 0
                if len(out) >= 1024:
                    yield _batch(out, id_type)
                    out = []
        if out:
            yield _batch(out, id_type)

    id_type = pa.int64()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_at"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType()]
    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], id_type) -> pa.RecordBatch:
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_at"]
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(documents(spark, sf_dir))
