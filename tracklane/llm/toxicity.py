"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all of their terms; document counts are taken over all documents. The labelled examples
are held as an inverted index in blocks: for each term and block that has it, the postings and their largest weight.
The largest weights bound the cosine of a query with anything in a block, and a block is opened only while its bound
can still reach the k-th best so far; so the neighbours found are the exact ones. Their votes, weighted by closeness,
and, apart from the cosine, the terms that tell the label are calibrated on the examples themselves, each judged by its
neighbours without itself.

Counts of the examples' terms and of the commonest others travel with the model; counts of other terms, whose number
grows with the corpus and which only lengthen a query, are joined to the documents by hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents, fold, labels, stored
from tracklane.llm.labelled import labelled_sample

#: Labelled examples in the index, at most, and terms that tell the label, at most.
EXAMPLES, TERMS = 4096, 256
#: Terms beyond those of the examples whose document counts travel with the model, at most.
KNOWN = 1 << 17
#: A term is chosen if its log likelihood ratio, and how much oftener it is in one label than in the other, reach these.
LEAST_GAIN, LEAST_LIFT = 8.0, 2.0
NEIGHBOURS, BLOCK = 16, 128
#: What the telling terms of a text say together, in natural logs of odds, at most.
MOST_TOLD = 6.0
#: Documents whose vectors are held at once; postings from which on a list is read as a piece.
ROWS, PIECE = 1024, 64
#: Blocks that are opened first, for a k-th best to compare the bounds of the others with.
FIRST = 2
_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


def one_of_each(texts: list[bytes], seeds: int = 4) -> list[int]:
    """Positions of texts of which no earlier one is a near copy: none has one of four least shingle hashes in common.

    A text that was copied a hundred times with its label would otherwise make all of its words tell the label.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, t in enumerate(texts):
        w = terms_of(t)
        hashes = np.array([crc32(b" ".join(w[j : j + 5])) for j in range(max(1, len(w) - 4))], np.uint64)
        own = {(k, int((hashes * np.uint64(2 * k * 0x9E3779B1 + 0x85EBCA6B) % np.uint64((1 << 61) - 1)).min())) for k in range(seeds)}
        if seen.isdisjoint(own):
            kept.append(i)
        seen |= own
    return kept


def choose_terms(texts: list[bytes], truth: np.ndarray, n: int = TERMS) -> dict[bytes, float]:
    """The terms that tell most about the label, by the likelihood ratio of their document counts, and their log lift.

    Common words that merely follow the length of a text pass no test of lift, and chance finds no test of gain.
    """
    single = one_of_each(texts)
    texts, truth = [texts[i] for i in single], truth[single]
    with_, without = Counter(), Counter()
    for t, y in zip(texts, truth, strict=True):
        (with_ if y else without).update(set(terms_of(t)))
    a, b = int(truth.sum()), int(len(truth) - truth.sum())

    def gain(w: bytes) -> float:
        x, y = with_[w], without[w]
        cells = ((x, a), (y, b), (a - x, a), (b - y, b))
        p = (x + y) / (a + b)
        return sum(o * np.log(o / (m * q)) for (o, m), q in zip(cells, (p, p, 1 - p, 1 - p), strict=True) if o)

    if not a or not b:
        return {}
    lift = lambda w: (with_[w] + 0.5) / (a + 1) / ((without[w] + 0.5) / (b + 1))
    known = {w: gain(w) for w in with_.keys() | without.keys() if with_[w] + without[w] >= 3 and not 1 / LEAST_LIFT < lift(w) < LEAST_LIFT}
    return {w: float(np.log(lift(w))) for w in sorted((w for w, g in known.items() if g >= LEAST_GAIN), key=lambda w: (-known[w], w))[:n]}


def hashes_of(terms: Collection[bytes]) -> np.ndarray:
    """As Spark's xxhash64, signed."""
    return np.fromiter(map(xxhash.xxh64_intdigest, terms, repeat(42)), np.uint64, len(terms)).view(np.int64)


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Stored: hash of each term and the number of rows of ``docs`` that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes_of(c)), pa.array(np.fromiter(c.values(), np.int64, len(c)))], ["hash", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(set(terms_of(text or b"")))
                if len(counts) > 400_000:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "hash long, n long")
    return stored(rows.groupBy("hash").agg(F.sum("n").alias("n")), "terms")


def commonest(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of up to ``n`` terms, whole steps of like counts at a time."""
    step = F.floor(F.log(F.col("n")) / np.log(1.02)).cast("int")
    left, least = n, 1 << 30
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > left:
            break
        left, least = left - r["n"], r["step"]
    return _by_hash(counts.filter(step >= least))


def _by_hash(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = counts.select("hash", "n").toArrow()
    hashes, n = (found.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes)
    return hashes[order], n[order]


@dataclass
class Rows:
    """Sparse vectors: row i has the terms ``terms[cuts[i]:cuts[i + 1]]``, ascending, with their weights."""

    cuts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, x: Rows | np.ndarray) -> Rows:
        if isinstance(x, Rows):
            return x
        row, term = np.nonzero(x)
        return cls(np.searchsorted(row, np.arange(len(x) + 1)), term, x[row, term])

    @classmethod
    def joined(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        cuts = np.cumsum([0, *(len(t) for t, _ in rows)])
        return cls(cuts, np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)]), np.concatenate([np.zeros(0), *(w for _, w in rows)]))

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.cuts[i] : self.cuts[i + 1]], self.weights[self.cuts[i] : self.cuts[i + 1]]


def vectors(terms: list[list[int]], counts: list[list[int]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(terms), len(idf)))
    for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
        if t:
            out[i, t] = (1 + np.log(c)) * idf[t]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Index:
    """Examples in blocks of like ones; for each term the blocks that have it, their largest weight and postings."""

    first: np.ndarray  # of each term, and the end: where its blocks begin
    block: np.ndarray
    largest: np.ndarray
    begin: np.ndarray  # of each block of a term, and the end: where its postings begin
    slot: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    truth: np.ndarray

    @classmethod
    def of(cls, x: Rows | np.ndarray, ids: np.ndarray, truth: np.ndarray) -> Index:
        width = 0 if isinstance(x, Rows) else x.shape[1]
        x = Rows.of(x)
        width = max(width, int(x.terms.max(initial=-1)) + 1)
        held = np.bincount(x.terms, minlength=width)
        # Like ones share the term, of those in a hundredth of the examples, that weighs most
        lead = [max(zip(w[often], t[often], strict=True), default=(0.0, -1)) for t, w in map(x.row, range(len(x))) for often in [held[t] * 100 >= len(x)]]
        order = np.lexsort((ids, [-w for w, _ in lead], [t for _, t in lead])).astype(np.int64)
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        slot = np.repeat(rank, np.diff(x.cuts))
        by = np.lexsort((slot, x.terms))
        term, slot, weight = x.terms[by], slot[by], x.weights[by]
        new = np.flatnonzero(np.diff(term * (len(x) // BLOCK + 1) + slot // BLOCK, prepend=-1))
        return cls(np.searchsorted(term[new], np.arange(width + 1)), slot[new] // BLOCK, np.maximum.reduceat(weight, new) if len(new) else np.zeros(0), np.append(new, len(slot)), slot, weight, ids[order], truth[order])

    @property
    def rows(self) -> Rows:
        """The examples, in the order of the index."""
        term = np.repeat(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), np.diff(self.begin))
        by = np.lexsort((term, self.slot))
        return Rows(np.searchsorted(self.slot[by], np.arange(len(self.ids) + 1)), term[by], self.weight[by])

    @property
    def postings(self) -> list[np.ndarray]:
        """Blocks written out, terms x slots."""
        full, rows = np.zeros((len(self.ids), len(self.first) - 1)), self.rows
        full[np.repeat(np.arange(len(rows)), np.diff(rows.cuts)), rows.terms] = rows.weights
        return [full[a : a + BLOCK].T for a in range(0, len(full), BLOCK)]

    def nearest(self, queries: Rows | np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and positions of the k nearest examples of each query; equals by position. -1: there are fewer.

        ``skip``: the position that a query may not find. Similarities are compared to 2**-30.
        """
        queries, n = Rows.of(queries), len(self.ids)
        sims, where = np.zeros((len(queries), k)), np.full((len(queries), k), -1)
        blocks, most = -(-n // BLOCK), min(k, n)
        for i in range(len(queries) if n else 0):
            terms, weights = queries.row(i)
            starts, ends = self.first[terms], self.first[terms + 1]
            sizes = ends - starts
            at = _ranges(starts, sizes)
            own = np.repeat(weights, sizes)
            block = self.block[at]
            bound = np.bincount(block, own * self.largest[at], blocks) + 2.0**-28
            keys = np.full(n, -1, np.int64)
            opened = np.zeros(blocks, bool)
            best = np.zeros(0, np.int64)
            while True:
                ahead = ~opened
                if not opened.any():
                    ahead[np.argsort(-bound, kind="stable")[FIRST:]] = False
                elif len(best) == most:
                    ahead &= bound * 2**30 >= keys[best].min()
                if not ahead.any():
                    break
                if 2 * ahead.sum() > blocks:  # most of each list is wanted: whole lists are read, long ones in one piece
                    first, held = self.begin[starts], self.begin[ends] - self.begin[starts]
                    short, long = np.flatnonzero(held <= PIECE), np.flatnonzero(held > PIECE)
                    post = _ranges(first[short], held[short])
                    cuts = list(zip(first[long].tolist(), (first + held)[long].tolist(), strict=True))
                    slot, weight = (np.concatenate([x[post], *(x[a:b] for a, b in cuts)]) for x in (self.slot, self.weight))
                    order = np.concatenate([short, long])
                    weight *= np.repeat(weights[order], held[order])
                    slots = slice(None)
                else:
                    use = np.flatnonzero(ahead[block])
                    size = self.begin[at[use] + 1] - self.begin[at[use]]
                    post = _ranges(self.begin[at[use]], size)
                    slot, weight = self.slot[post], self.weight[post] * np.repeat(own[use], size)
                    slots = np.flatnonzero(np.repeat(ahead, BLOCK)[:n])
                keys[slots] = np.rint(np.bincount(slot, weight, n)[slots] * 2**30)
                if skip is not None:
                    keys[skip[i]] = -1
                opened |= ahead
                # The k largest, of equals the first: all above the k-th, and of its equals as many as are wanted
                have = np.flatnonzero(keys >= 0)
                if len(have) > most:
                    least = np.partition(keys[have], len(have) - most)[len(have) - most]
                    above = have[keys[have] > least]
                    have = np.concatenate([above, have[keys[have] == least][: most - len(above)]])
                best = have
            best = best[np.lexsort((best, -keys[best]))]
            sims[i, : len(best)], where[i, : len(best)] = keys[best] / 2**30, best
        return sims, where

    def said(self, sims: np.ndarray, where: np.ndarray, told: np.ndarray) -> np.ndarray:
        """What the calibration sees: the neighbours' votes, what the terms tell, and ones."""
        return np.stack([_log_odds(self.votes(sims, where)), told, np.ones(len(told))], 1)

    def votes(self, sims: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each with the weight of its closeness."""
        weight = np.where(where >= 0, 1 / (1.05 - np.minimum(sims, 1)) ** 2, 0)  # so a copy outvotes all others
        return (weight * self.truth[where]).sum(1) / np.maximum(weight.sum(1), 1e-12)


def calibrated(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Logistic curve over the columns of ``x``, the last of them ones, by Newton steps with a little ridge."""
    begin = np.array([1.0] * (x.shape[1] - 1) + [0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - truth * z).sum() + 0.25 * ((w - begin) ** 2).sum())

    w = begin.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - truth) + 0.5 * (w - begin)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    w[:-1] = np.maximum(w[:-1], 1e-3)
    return w


def _log_odds(votes: np.ndarray) -> np.ndarray:
    v = np.clip(votes, 0.01, 0.99)
    return np.log(v / (1 - v))


class _Terms(dict):
    """Numbers of terms, remembered while they are few: those of the examples, then known others, then rare ones."""

    def __init__(self, examples: np.ndarray, known: np.ndarray):
        self.examples, self.known = examples, known
        self.rare_from, self.rare = len(examples) + len(known), []

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms, ascending, and how often it has each."""
        terms = terms_of(text)
        if len(self) >= 1 << 17:
            self.clear()
            self.rare.clear()
        if new := [t for t in set(terms) if t not in self]:
            hashes = hashes_of(new)
            numbers = np.full(len(new), -1)
            for of, first in ((self.known, len(self.examples)), (self.examples, 0)):
                at = np.searchsorted(of, hashes)
                has = np.flatnonzero(of[np.minimum(at, len(of) - 1)] == hashes) if len(of) else []
                numbers[has] = at[has] + first
            rare = np.flatnonzero(numbers < 0)
            numbers[rare] = np.arange(len(rare)) + self.rare_from + len(self.rare)
            self.rare += hashes[rare].tolist()
            self.update(zip(new, numbers.tolist(), strict=True))
        return np.unique(np.fromiter(map(self.__getitem__, terms), np.int64, len(terms)), return_counts=True)


@dataclass
class Model:
    """Terms are told by their hashes; ``idf`` is that of the examples' terms, then of known others, ``tells`` by example term."""

    examples: np.ndarray
    known: np.ndarray
    idf: np.ndarray
    tells: np.ndarray
    index: Index
    curve: np.ndarray
    empty: float  # for a text without a term

    def __post_init__(self):
        self.terms = _Terms(self.examples, self.known)

    def __reduce__(self):
        return Model, (self.examples, self.known, self.idf, self.tells, self.index, self.curve, self.empty)

    def weighed(self, text: bytes) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray, np.ndarray]:
        """Terms of the examples with their weights, the others' squared length, what the terms tell; hashes of the rest
        and the squares of their weights, but for the document frequency."""
        terms, counts = self.terms(text)
        own, known = np.searchsorted(terms, (len(self.examples), self.terms.rare_from))
        weights = 1 + np.log(counts)
        weights[:known] *= self.idf[terms[:known]]
        told = float(np.clip(self.tells[terms[:own]].sum(), -MOST_TOLD, MOST_TOLD))
        rest = np.array([self.terms.rare[i - self.terms.rare_from] for i in terms[known:].tolist()], np.int64)
        return terms[:own], weights[:own], float(weights[own:known] @ weights[own:known]), told, rest, weights[known:] ** 2

    def judged(self, sims: np.ndarray, where: np.ndarray, told: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Scores by the neighbours (positions) with their similarities. ``some``: which rows have a term."""
        if not len(self.index.ids):
            return np.full(len(some), round(self.empty, 9))
        x = self.index.said(sims, where, told)
        return np.round(np.where(some, 1 / (1 + np.exp(-x @ self.curve)), self.empty), 9)


def fit(sample: list[tuple[int, str, int]], examples: np.ndarray, known: np.ndarray, idf: np.ndarray) -> Model:
    texts = [t.encode() for _, t, _ in sample]
    truth = np.array([y for _, _, y in sample], float)
    some = np.array([bool(_TERM.search(t)) for t in texts], bool)
    share = lambda y: float((y.sum() + 0.1) / (len(y) + 1)) if len(y) else 0.1
    telling, tells = choose_terms(texts, truth), np.zeros(len(examples))
    tells[np.searchsorted(examples, hashes_of(telling))] = list(telling.values())
    model = Model(examples, known, idf, tells, None, np.array([1.0, 1.0, 0.0]), share(truth[~some]))
    found = [model.weighed(t) for t, s in zip(texts, some, strict=True) if s]
    x = Rows.joined([(t, w / np.sqrt(w @ w)) for t, w, *_ in found])
    ids = np.array([i for i, _, _ in sample], np.int64)[some]
    place = np.arange(len(ids))
    model.index = Index.of(x, ids, truth[some])
    order = Index.of(x, ids, place).truth  # where each slot's example stands in the sample
    if len(ids) > NEIGHBOURS:
        sims, where = model.index.nearest(model.index.rows, NEIGHBOURS, place)
        told = np.array([f[3] for f in found])[order]
        model.curve = calibrated(model.index.said(sims, where, told), model.index.truth)
    return model


def toxicity(docs: DataFrame, sample: list[tuple[int, str, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, and ``evidence``, the nearest examples with id, label and similarity.

    Cosines are over all terms of both texts; document counts of terms are taken over all of ``docs``. A text without a
    term, also a null or empty one, has no evidence and the score of the examples without one. Ids may be null or
    repeat. Other columns aren't read.
    """
    session = docs.sparkSession
    counts = document_counts(docs, text_col)
    n = docs.count()
    examples = np.unique(hashes_of({w for _, t, _ in sample for w in terms_of(t.encode())}))
    wanted = session.createDataFrame(pa.table({"hash": pa.array(examples)}))  # terms of the bounded sample
    hashes, held = _by_hash(counts.join(F.broadcast(wanted), "hash"))
    of = np.ones(len(examples))
    of[np.searchsorted(examples, hashes)] = held
    known, others = commonest(counts, KNOWN)
    shared = session.sparkContext.broadcast(fit(sample, examples, known, np.log(1 + n / np.concatenate([of, others]))))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, at = shared.value, TaskContext.get().partitionId(), 0
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = [model.weighed(x or b"") for x in batch.column(1).to_pylist()]
            sims, where = model.index.nearest(Rows.joined([f[:2] for f in found]), NEIGHBOURS)
            rows = pa.array(np.arange(at, at + batch.num_rows) + (part << 40))
            at += batch.num_rows
            rest = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *(f[i] for f in found)])) for i, k in ((4, np.int64), (5, float))], ["hash", "square"])
            ends, each = pa.array(np.cumsum([0, *(len(f[4]) for f in found)]), pa.int32()), pa.array(np.arange(batch.num_rows + 1) * NEIGHBOURS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array([len(f[0]) + len(f[4]) + (f[2] > 0) > 0 for f in found]), pa.array([float(f[1] @ f[1]) + f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()),
                 pa.ListArray.from_arrays(each, pa.array(where.ravel())), pa.ListArray.from_arrays(each, pa.array(sims.ravel())), pa.ListArray.from_arrays(ends, rest)],
                ["row", "id", "some", "square", "told", "where", "products", "rest"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            some, square, told = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            where, sims = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, NEIGHBOURS) for i in (4, 5))
            sims = sims / np.sqrt(np.maximum(square, 1e-24))[:, None]
            score = model.judged(sims, where, told, some)
            ids, truth = model.index.ids, model.index.truth
            evidence = [[{"id": int(ids[j]), "label": int(truth[j]), "similarity": round(float(s), 6)} for j, s in zip(w, v, strict=True) if j >= 0 and e] for w, v, e in zip(where[:, :3], sims[:, :3], some, strict=True)]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(evidence, kind)], ["id", "score", "evidence"])

    id_type = docs.schema[id_col].dataType
    pair = T.StructType([T.StructField("hash", T.LongType()), T.StructField("square", T.DoubleType())])
    fields = [("row", T.LongType()), ("id", id_type), ("some", T.BooleanType()), ("square", T.DoubleType()), ("told", T.DoubleType()), ("where", T.ArrayType(T.LongType())), ("products", T.ArrayType(T.DoubleType())), ("rest", T.ArrayType(pair))]
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(weigh, T.StructType([T.StructField(*f) for f in fields])), "weighed")
    rare = rows.select("row", F.explode("rest").alias("x")).select("row", "x.hash", F.col("x.square").alias("part")).join(counts, "hash")
    more = rare.groupBy("row").agg(F.sum(F.col("part") * F.pow(F.log(1 + n / F.col("n")), 2)).alias("more"))
    whole = rows.drop("rest").join(more, "row", "left").select("id", "some", (F.col("square") + F.coalesce("more", F.lit(0.0))).alias("square"), "told", "where", "products")
    item = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(item))])
    return whole.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = labelled_sample(docs, labels(spark, sf_dir), "toxic", fold("doc_id", 4) != 2, EXAMPLES)
    scored = toxicity(docs, sample)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
