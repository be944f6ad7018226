"""Secret scans by a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams that any match must contain. Each block of
documents gets an inverted index of the trigrams that occur in the queries; postings are intersected and united as
the query says, and only the surviving documents are verified with the regex. A rule whose regex has no mandatory
trigram (a run of hex digits, say) scans every document in full. A block never leaves its task, so nothing is
shuffled, and memory is bounded by the block and the largest document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents, utf8

#: At most so many alternative literals are followed side by side while a query is derived.
MOST_LITERALS = 64
#: Bytes of text indexed at once.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex over UTF-8 bytes, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def __reduce__(self):
        return Rule, (self.kind, self.pattern, self.group, self.least)

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches; those that are too short are dropped, but keep what they consumed."""
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", rb"[0-9a-f]{16,}", 0, 16),
)
# A private key goes on to its END line; if there is none before the next dashes, to the end of its base64 lines, which
# may come after lines like "Proc-Type: 4,ENCRYPTED", be quoted or have their breaks escaped.
_KEY_BEGIN = rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_TO_KEY_END = rb"(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----"
_BREAK = rb"(?:[\x09-\x0D\x20\"',>|]|\\[nr])*"
_KEY_LINES = rb"(?:(?:[\x09-\x0D\x20>]*[A-Z][A-Za-z-]*:\x20[^\n]*\n)*" + _BREAK + rb"[A-Za-z0-9+/]{16,}={0,2})+(?:" + _BREAK + rb"[A-Za-z0-9+/]+(?:={1,2}|[\"\x27]|\\[nr]|\r?(?m:$)))?"
# Public formats of keys that the base kinds miss. What comes before a mark that may be missing has a
# bound (a scheme's name, a token's header), so that a long run of letters isn't read again from each of them.
MORE = (
    Rule("private_key", _KEY_BEGIN + rb"(?:" + _TO_KEY_END + rb"|" + _KEY_LINES + rb")?"),
    Rule("session_key", rb"ASIA[A-Z0-9]{16,}"),
    Rule("forge_token", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", rb"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", rb"[a-z][a-z0-9+.-]{0,31}://[^\x00-\x20:@/]+:[^\x00-\x20:@/]{6,}@"),
)

#: A query: None (every document), or alternatives, each a set of trigrams that must all occur.
Query = frozenset[frozenset[bytes]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _simple({x | y for x in a for y in b})


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _simple(a | b)


def _simple(alternatives: Iterable[frozenset[bytes]]) -> Query:
    """Without alternatives that a weaker one covers."""
    out = set(alternatives)
    return frozenset(x for x in out if not any(y < x for y in out))


def _literals_query(literals: set[bytes]) -> Query:
    if any(len(x) < 3 for x in literals):
        return None
    return _simple(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in literals)


def _exact(tree) -> set[bytes] | None:
    """All lower-cased strings that the tree matches, or None if they are many or endless."""
    out = {b""}
    for op, arg in tree:
        if op is C.LITERAL:
            nxt = {bytes([arg]).lower()}
        elif op is C.IN:
            nxt = _members(arg)
        elif op is C.SUBPATTERN:
            nxt = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            nxt = None if any(x is None for x in parts) else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            part = _exact(arg[2])
            nxt = None if part is None else part | ({b""} if arg[0] == 0 else set())
        elif op is C.AT:
            nxt = {b""}
        else:
            nxt = None
        if nxt is None or len(out) * len(nxt) > MOST_LITERALS:
            return None
        out = {x + y for x in out for y in nxt}
    return out


def _members(arg) -> set[bytes] | None:
    found: set[int] = set()
    for op, x in arg:
        if op is C.LITERAL:
            found.add(x)
        elif op is C.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            return None
    low = {bytes([x]).lower() for x in found}
    return low if len(low) <= 8 else None


def _query(tree) -> Query:
    found: Query = None
    run = {b""}
    for item in tree:
        op, arg = item
        literals = _exact([item])
        if literals is not None and len(run) * len(literals) <= MOST_LITERALS:
            run = {x + y for x in run for y in literals}
            continue
        found, run = _both(found, _literals_query(run)), {b""}
        if op is C.SUBPATTERN:
            found = _both(found, _query(arg[3]))
        elif op is C.BRANCH:
            parts = [_query(x) for x in arg[1]]
            whole = parts[0]
            for x in parts[1:]:
                whole = _either(whole, x)
            found = _both(found, whole)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            found = _both(found, _query(arg[2]))
    return _both(found, _literals_query(run))


def trigram_query(pattern: bytes) -> Query:
    """The trigrams, lower-cased, that a text must hold for the regex to match; None if it has no mandatory one."""
    return _query(parser.parse(pattern))


class BlockIndex:
    """Postings of the wanted trigrams over one block of documents, in any case of letters."""

    def __init__(self, wanted: Iterable[bytes]):
        self.wanted = sorted(set(wanted))
        self.codes = np.array([x[0] << 16 | x[1] << 8 | x[2] for x in self.wanted], np.int64)
        self.number = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 255 else np.uint32)
        self.number[self.codes] = np.arange(1, len(self.codes) + 1)

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ascending positions of the texts that hold each wanted trigram."""
        ends = np.cumsum([len(x) + 2 for x in texts])
        data = np.frombuffer(b"\xff\xff".join([*texts, b""]).lower(), np.uint8)
        code = data[:-2].astype(np.int32) << 16
        code |= data[1:-1].astype(np.int32) << 8
        code |= data[2:]
        hits = self.number[code]
        at = np.flatnonzero(hits)
        pairs = np.unique(hits[at].astype(np.int64) << 40 | np.searchsorted(ends, at, side="right"))
        which, text = pairs >> 40, pairs & ((1 << 40) - 1)
        cuts = np.searchsorted(which, np.arange(1, len(self.wanted) + 2))
        return {x: text[cuts[i] : cuts[i + 1]] for i, x in enumerate(self.wanted)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> Iterable[int]:
    """Positions of the documents that the query leaves: intersections within an alternative, then their union."""
    if query is None:
        return range(n)
    found: np.ndarray = np.zeros(0, np.int64)
    for trigrams in query:
        left: np.ndarray | None = None
        for lists in sorted((postings[x] for x in trigrams), key=len):
            left = lists if left is None else np.intersect1d(left, lists, assume_unique=True)
            if not len(left):
                break
        found = np.union1d(found, left)
    return found.tolist()


_CONTINUES = bytes(range(0x80, 0xC0))


def _code_points(text: bytes, spans: list[tuple[int, str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets, ascending by start, as code-point offsets."""
    if text.isascii():
        return [(kind, a, b) for a, _, kind, b in spans]
    out, at, points = [], 0, 0
    for a, _, kind, b in spans:
        points, at = points + len(text[at:a].translate(None, _CONTINUES)), a
        out.append((kind, points, points + len(text[a:b].translate(None, _CONTINUES))))
    return out


class Scanner:
    """Finds the spans of all rules in blocks of documents."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = BlockIndex(t for q in self.queries if q for alternative in q for t in alternative)

    def block(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        postings = self.index.postings(texts) if texts else {}
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        for order, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in candidates(query, postings, len(texts)):
                found[i] += [(a, order, rule.kind, b) for a, b in rule.spans(texts[i])]
        return [_code_points(t, sorted(x)) if x else [] for t, x in zip(texts, found, strict=True)]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id (also null or repeated) and its spans, ``spans`` by start, then by rule.

    Offsets are code points, the end exclusive. A null or empty text has no spans. Other columns aren't read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scanner.block(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, pa.list_(kinds))], ["id", "spans"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", size_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; overlapping spans become one.

    Columns, their order and all other values stay; ``size_col``, where there is one, gets the new length in code
    points of a changed text. Null texts stay null.
    """
    names = docs.columns
    at, size_at = names.index(text_col), names.index(size_col) if size_col in names else None

    def cut(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, end = [], 0
        for _, a, b in spans:
            if a >= end:
                out += [text[end:a], mask]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
            changed = {}
            for a, b in _blocks(raw):
                for i, spans in enumerate(scanner.block(raw[a:b]), a):
                    if spans:
                        changed[i] = cut(texts[i], spans)
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(texts)], columns[at].type)
                if size_at is not None:
                    sizes = columns[size_at].to_pylist()
                    columns[size_at] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(sizes)], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
    return flat.mapInArrow(scan, flat.schema).toDF(*names)


def _listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = [r.kind for r in BASE]
    count = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *count, F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
