"""Scoring by a gated recurrent language model in numpy.

Word counts over all training documents give the vocabulary. Frequent words, in classes of like frequency, are
predicted by a class softmax and a softmax within the class; every other word belongs to one of a few tail classes by
its ending, and has its share of the class by count; all unseen words of a class share one place in it. So the model is
a probability over texts whose unseen words are told apart by class only. It starts out as the unigram model of the counts. Truncated back-propagation on a seeded sample of training
documents gives it a start; then every partition goes on training it on all of its own documents, and the copies are
averaged by the tokens they have seen (so the network depends on how the input is partitioned). Scoring carries the state of each document from window to window
until its end.

Counts of the commonest words travel with the model; the counts of other words, whose number grows with the corpus,
are joined to the documents by hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents, fold, stored

#: Words with a softmax of their own; words in a class; tail classes; size of the state.
HEAD, CLASS, TAILS, STATE = 2048, 64, 16, 16
#: Words whose counts travel with the model, at most.
KNOWN = 1 << 17
#: Documents and tokens that the recurrent part starts from, on average at most; lanes, window and passes of that training.
TRAIN_DOCS, TRAIN_TOKENS, LANES, WINDOW, PASSES = 1500, 4 << 20, 64, 16, 2
#: Lanes of the training in partitions, its pace, and tokens trained at once.
MANY_LANES, MANY_RATE, BATCH_TOKENS = 512, 0.01, 1 << 20
#: Copies of the network that are averaged in one place, level by level; the driver averages those of the last.
FAN = 16
#: Documents scored side by side, and tokens between two rounds of the output layer; columns of that layer at once.
SIDE, STRETCH, COLUMNS = 512, 64, 2048
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    return [*text.lower().split(), END]


def tail_of(word: bytes) -> int:
    return crc32(word[-2:]) % TAILS


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Stored: word (bytes, the end is empty), its tail class, count and hash, over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text or b""))
                if len(counts) > 400_000:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word binary, n long")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("c")).withColumn("hash", F.xxhash64("word")), "words")


@dataclass
class Vocabulary:
    """Known words by falling count, and what scoring needs to know of each; the first HEAD are the head."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    tail_mass: np.ndarray  # sum of c + 1 over each tail class, and one for the unseen
    number: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(self.words)}
        self.head = min(HEAD, len(self.words))
        self.classes = -(-self.head // CLASS)
        self.tails = np.array([tail_of(w) for w in self.words], np.int64)
        self.log_counts = np.log10(self.counts + 1.0)

    def __reduce__(self):
        return Vocabulary, (self.words, self.counts, self.total, self.distinct, self.tail_mass)

    @property
    def end(self) -> int:
        return self.number[END]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the stored counts; the driver gets KNOWN words at most, and sums by tail class and by size of count."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The least count of a known word: counts are sorted into steps of 2 %, of which there are some thousands at most
    step = F.floor(F.log(F.col("c")) / np.log(1.02)).cast("int")
    left, least = KNOWN, 1 << 30
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > left:
            break
        left, least = left - r["n"], r["step"]
    top = sorted(counts.filter(step >= least).select("word", "c").collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    words, c = [bytes(r["word"]) for r in top], [r["c"] for r in top]
    if END not in words[:HEAD]:  # the end is always in the head
        have = counts.filter(F.octet_length("word") == 0).select("c").first()
        at = min(HEAD, len(words) + 1) - 1
        if END in words:
            i = words.index(END)
            words.pop(i), c.pop(i)
        words.insert(at, END)
        c.insert(at, have["c"] if have else 0)
    head = set(words[:HEAD])
    suffix = F.substring("word", -2, 2)
    tail = (F.crc32(F.when(F.octet_length("word") > 2, suffix).otherwise(F.col("word"))) % TAILS).cast("int")
    mass = np.ones(TAILS)
    for r in counts.groupBy(tail.alias("tail")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[r["tail"]] += r["n"] + r["v"]
    for w, n in zip(words[:HEAD], c, strict=False):
        if w in head and (w != END or n):
            mass[tail_of(w)] -= n + 1
    return Vocabulary(words, np.array(c, np.int64), int(total), int(distinct), mass)


@dataclass
class Network:
    """Gated recurrent units over a table of inputs; ``classes`` and ``words`` are the two levels of the output."""

    inputs: np.ndarray  # (head + TAILS + 1) x 3 STATE, the last row starts a document
    state: np.ndarray  # STATE x 3 STATE
    classes: np.ndarray  # STATE x C
    class_bias: np.ndarray
    words: np.ndarray  # head x STATE
    word_bias: np.ndarray

    def copy(self) -> Network:
        return Network(*(p.copy() for p in self.parts()))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.classes, self.class_bias, self.words, self.word_bias]


def start_network(v: Vocabulary, seed: int = 0) -> Network:
    luck = np.random.default_rng(seed)
    n = lambda *shape, s=0.1: luck.normal(0, s, shape).astype(np.float32)
    mass = v.counts[: v.head] + 1.0
    by_class = [mass[k * CLASS : (k + 1) * CLASS].sum() for k in range(v.classes)]
    return Network(n(v.head + TAILS + 1, 3 * STATE, s=0.3), n(STATE, 3 * STATE, s=0.3), n(STATE, v.classes + TAILS), np.log(np.array([*by_class, *v.tail_mass])).astype(np.float32), n(v.head, STATE), np.log(mass).astype(np.float32))


def _step(net: Network, act: np.ndarray, h: np.ndarray, gates: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The state after a token. Arrays have a row for each unit and a column for each lane; the last three are filled."""
    s = net.state.T @ h
    np.add(act[: 2 * STATE], s[: 2 * STATE], out=gates)
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    q[:] = s[2 * STATE :]
    np.multiply(gates[STATE:], q, out=n)
    n += act[2 * STATE :]
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:STATE]
    out += n
    return out


def _by_class(v: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each symbol, the head's symbols ordered by class, and where each class begins in that order."""
    cls = np.where(target < v.head, target // CLASS, target - v.head + v.classes).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(v.classes + 1))
    return cls, order[: cuts[-1]], cuts


def symbols(v: Vocabulary, numbers: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Input and output symbols of the network: head words as they are, then tail classes."""
    return np.where((numbers >= 0) & (numbers < v.head), numbers, v.head + tails)


def log_probs(net: Network, v: Vocabulary, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logs of the symbols' probabilities after the given states, a column each."""
    cls, order, cuts = _by_class(v, target)
    out = np.empty(len(target), np.float32)

    def logs(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        x -= x.max(0)
        own = x[of, np.arange(x.shape[1])]
        return own - np.log(np.exp(x, out=x).sum(0))

    for a in range(0, len(target), COLUMNS):
        here = slice(a, a + COLUMNS)
        out[here] = logs(net.classes.T @ h[:, here] + net.class_bias[:, None], cls[here])
    states, goals = np.ascontiguousarray(h.T)[order], target[order]
    within = np.empty(len(order), np.float32)
    for k in np.flatnonzero(np.diff(cuts)):
        here, block = slice(cuts[k], cuts[k + 1]), slice(k * CLASS, min((k + 1) * CLASS, v.head))
        within[here] = logs(net.words[block] @ states[here].T + net.word_bias[block][:, None], goals[here] - block.start)
    out[order] += within
    return out


def train(v: Vocabulary, streams: list[np.ndarray], seed: int = 0, passes: int = PASSES, rate: float = 0.01, lanes: int = LANES, begin: Network | None = None) -> Network:
    """Truncated back-propagation: gradients stay within a window, the state goes on into the next."""
    net = begin.copy() if begin else start_network(v, seed)
    if not streams:
        return net
    luck = np.random.default_rng(seed)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parts()]
    start, steps = v.head + TAILS, 0
    for _ in range(passes):
        order = luck.permutation(len(streams))
        outs = np.concatenate([streams[i] for i in order])
        ins = np.concatenate([np.concatenate([[start], streams[i][:-1]]) for i in order])
        length = max(-(-len(outs) // lanes), WINDOW)
        outs, ins = (np.ascontiguousarray(np.resize(x, (lanes, length)).T) for x in (outs, ins))  # the last lane is filled from the first
        h = np.zeros((STATE, lanes), np.float32)
        for a in range(0, length, WINDOW):
            h, grads = _window(net, v, ins[a : a + WINDOW], outs[a : a + WINDOW], h)
            steps += 1
            pace = np.float32(rate / (1 + steps / 1500) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps))
            for p, g, (m, s) in zip(net.parts(), grads, moments, strict=True):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                g *= g
                g -= s
                g *= 0.001
                s += g
                np.sqrt(s, out=g)
                g += 1e-6
                p -= pace * m / g
    return net


def _window(net: Network, v: Vocabulary, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The state after a window of inputs ``x`` and outputs ``y`` (a row a token, a column a lane), and its gradients."""
    width, lanes = x.shape
    goes = (x != v.head + TAILS).astype(np.float32)  # 0 where a document starts
    before, q, n = (np.empty((width, STATE, lanes), np.float32) for _ in range(3))
    gates, states = np.empty((width, 2 * STATE, lanes), np.float32), np.empty((STATE, width, lanes), np.float32)
    for t in range(width):
        np.multiply(h, goes[t], out=before[t])
        h = _step(net, np.ascontiguousarray(net.inputs[x[t]].T), before[t], gates[t], q[t], n[t])
        states[:, t] = h
    grads = [np.zeros_like(p) for p in net.parts()]
    dh_out = _output_gradient(net, v, states.reshape(STATE, -1), y.ravel(), grads).reshape(STATE, width, lanes)
    by_input = np.empty((width, lanes, 3 * STATE), np.float32)
    da, ds, dh = np.empty((3 * STATE, lanes), np.float32), np.empty((3 * STATE, lanes), np.float32), np.zeros((STATE, lanes), np.float32)
    dz, dr, dn = da[:STATE], da[STATE : 2 * STATE], da[2 * STATE :]
    for t in reversed(range(width)):
        z, r = gates[t, :STATE], gates[t, STATE:]
        stays = 1 - z
        dh += dh_out[:, t]
        np.multiply(n[t], n[t], out=dn)
        np.subtract(1, dn, out=dn)
        dn *= stays
        dn *= dh
        np.subtract(before[t], n[t], out=dz)
        dz *= z
        dz *= stays
        dz *= dh
        np.subtract(1, r, out=dr)
        dr *= r
        dr *= q[t]
        dr *= dn
        ds[: 2 * STATE] = da[: 2 * STATE]
        np.multiply(dn, r, out=ds[2 * STATE :])
        grads[1] += before[t] @ ds.T
        dh *= z
        dh += net.state @ ds
        dh *= goes[t]
        by_input[t] = da.T
    symbol = x.ravel().astype(np.int16)
    order = np.argsort(symbol, kind="stable")
    first = np.flatnonzero(np.diff(symbol[order], prepend=-1))
    grads[0][symbol[order[first]]] = np.add.reduceat(by_input.reshape(-1, 3 * STATE)[order], first)
    return h, grads


def _output_gradient(net: Network, v: Vocabulary, h: np.ndarray, target: np.ndarray, grads: list[np.ndarray]) -> np.ndarray:
    """The gradient of the mean loss by the states (a column each); those of the output layer are added to ``grads``."""
    cls, order, cuts = _by_class(v, target)
    scale = np.float32(1 / len(target))

    def errors(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        x -= x.max(0)
        np.exp(x, out=x)
        x *= scale / x.sum(0)
        x[of, np.arange(x.shape[1])] -= scale
        return x

    out = np.empty_like(h)
    for a in range(0, len(target), COLUMNS):
        here = slice(a, a + COLUMNS)
        d = errors(net.classes.T @ h[:, here] + net.class_bias[:, None], cls[here])
        grads[2] += h[:, here] @ d.T
        grads[3] += d.sum(1)
        out[:, here] = net.classes @ d
    states, goals = np.ascontiguousarray(h.T)[order], target[order]
    for k in np.flatnonzero(np.diff(cuts)):
        here, block = slice(cuts[k], cuts[k + 1]), slice(k * CLASS, min((k + 1) * CLASS, v.head))
        d = errors(net.words[block] @ states[here].T + net.word_bias[block][:, None], goals[here] - block.start)
        grads[4][block] += d @ states[here]
        grads[5][block] += d.sum(1)
        states[here] = d.T @ net.words[block]  # no longer needed, so the gradient takes their place
    by_word = np.zeros((len(target), STATE), np.float32)
    by_word[order] = states
    out += by_word.T
    return out


def document_scores(net: Network, v: Vocabulary, streams: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole stream of symbols. Documents run side by side, the longest first."""
    out = np.zeros(len(streams))
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    start = v.head + TAILS
    for a in range(0, len(order), SIDE):
        group = order[a : a + SIDE]
        sizes = np.array([len(streams[i]) for i in group])
        longest = int(sizes[0])
        h, last = np.zeros((STATE, len(group)), np.float32), np.full(len(group), start)
        buffers = [np.empty((k * STATE, len(group)), np.float32) for k in (2, 1, 1)]
        for b in range(0, longest, STRETCH):
            width = min(STRETCH, longest - b)
            alive = int((sizes > b).sum())
            y = np.zeros((width, alive), np.int64)
            for k in range(alive):
                own = streams[group[k]][b : b + width]
                y[: len(own), k] = own
            states, symbol = [], []
            left = [int(x) for x in np.searchsorted(-sizes[:alive], -(b + np.arange(width)), side="left")]
            for t, m in enumerate(left):
                if m < len(last):  # documents that have ended go; arrays stay in one piece
                    h, last, buffers = np.ascontiguousarray(h[:, :m]), last[:m], [np.empty((len(x), m), np.float32) for x in buffers]
                h = _step(net, np.ascontiguousarray(net.inputs[last].T), h, *buffers)
                last = y[t, :m]
                states.append(h)
                symbol.append(last)
            logs = log_probs(net, v, np.concatenate(states, 1), np.concatenate(symbol))
            out[np.array(group)[:alive]] += np.bincount(np.concatenate([np.arange(m) for m in left]), logs, alive)
    return out / np.log(10)


def numbered(v: Vocabulary, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its number (-1: not among the known), its tail class; and the hashes of the unknown ones."""
    tokens = tokens_of(text)
    numbers = np.fromiter(map(v.number.get, tokens, repeat(-1)), np.int64, len(tokens))
    tails = v.tails[numbers]
    rare = np.flatnonzero(numbers < 0)
    words = [tokens[i] for i in rare]
    tails[rare] = [tail_of(w) for w in words]
    return numbers, tails, np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def refined(training: DataFrame, v: Vocabulary, net: Network, text_col: str) -> Network:
    """The network after each partition has trained it on all of its documents, averaged by tokens.

    A partition sends one copy, whatever its size. Copies are averaged level by level, FAN neighbours at a time, until
    the driver gets FAN of them at most. They are added up in the order of their partitions, so reruns agree.
    """
    shapes = [p.shape for p in net.parts()]
    shared = training.sparkSession.sparkContext.broadcast((v, net.parts()))

    def flat(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([p.ravel() for p in parts]).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = shared.value
        model, streams, held, seen, part = Network(*parts), [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                stream = symbols(own, *numbered(own, text or b"")[:2])
                streams.append(stream)
                held += len(stream)
                if held >= BATCH_TOKENS:
                    model, seen, streams, held = train(own, streams, passes=1, rate=MANY_RATE, lanes=MANY_LANES, begin=model), seen + held, [], 0
        if held:
            lanes = min(MANY_LANES, max(1, held // WINDOW))
            model, seen = train(own, streams, passes=1, rate=MANY_RATE, lanes=lanes, begin=model), seen + held
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([(flat(model.parts()) * seen).tobytes()], pa.binary())], ["part", "seen", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "seen", "sums"])

        group, seen, sums = None, 0, None
        for batch in batches:
            for part, n, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group is not None and part // FAN != group:
                    yield out()
                    seen, sums = 0, None
                group, seen, sums = part // FAN, seen + n, np.frombuffer(more) if sums is None else sums + np.frombuffer(more)
        if seen:
            yield out()

    schema = "part int, seen long, sums binary"
    copies = stored(training.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema), "networks")
    top = copies.agg(F.max("part")).first()[0] or 0
    while top >= FAN:  # a level reads FAN copies for each that it writes
        top //= FAN
        copies = copies.repartition(top + 1, F.expr(f"part div {FAN}")).sortWithinPartitions("part").mapInArrow(add, schema)
    found = sorted(copies.collect(), key=lambda r: r["part"])
    if not found:
        return net
    mean, at, parts = sum(np.frombuffer(r["sums"]) for r in found) / sum(r["seen"] for r in found), 0, []
    for shape in shapes:
        n = int(np.prod(shape))
        parts.append(mean[at : at + n].reshape(shape).astype(np.float32))
        at += n
    return Network(*parts)


def start_sample(training: DataFrame, share: float, id_col: str, text_col: str) -> DataFrame:
    """About ``share`` of the rows, as ``t``, each drawn by itself: copies of a text come in proportion.

    Drawn by id and text; rows without an id, which nothing tells apart, by their place.
    """
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    drawn = training.select(F.col(text_col).cast("binary").alias("t"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), place, F.lit(7)), F.lit(1 << 40)).alias("luck"))
    return drawn.filter(F.col("luck") < int(share * (1 << 40))).select("t")


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score and score, log10 of probabilities.

    ``train_on`` says which rows are learned from, over columns of ``docs``. A null or empty text is the end alone. Ids
    may be null or repeat. Without training rows nothing is known, and both models see only unseen words. Other columns
    aren't read.
    """
    session = docs.sparkSession
    training = docs.filter(train_on)
    counts = word_counts(training, text_col)
    v = vocabulary(counts)
    rows_to_learn = int(v.counts[v.end])
    share = min(1.0, TRAIN_DOCS / max(rows_to_learn, 1), TRAIN_TOKENS / max(v.total, 1))
    sample = start_sample(training, share, id_col, text_col).collect()
    streams = [symbols(v, *numbered(v, bytes(r["t"] or b""))[:2]) for r in sorted(sample, key=lambda r: bytes(r["t"] or b""))]
    net = refined(training, v, train(v, streams), text_col)
    shared = session.sparkContext.broadcast((v, net.parts()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = shared.value
        model, part, at = Network(*parts), TaskContext.get().partitionId(), 0
        log_mass = np.log10(own.tail_mass)
        for batch in batches:
            streams, fixed, base, known, rare = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                numbers, tails, hashes = numbered(own, text or b"")
                streams.append(symbols(own, numbers, tails))
                here = numbers >= 0
                tail = numbers >= own.head
                base.append(own.log_counts[numbers[here]].sum())
                fixed.append(own.log_counts[numbers[tail]].sum() - log_mass[tails[tail | ~here]].sum())
                known.append(int((own.counts[numbers[here]] > 0).sum()))
                rare.append(hashes)
            ends = np.cumsum([0, *map(len, rare)])
            ids = pa.array(np.arange(at, at + batch.num_rows) + (part << 40))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), pa.array([len(s) for s in streams], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(document_scores(model, own, streams) + np.array(fixed)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])))],
                ["row", "id", "n_tokens", "known", "base", "lm", "rare"],
            )

    fields = [T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lm", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType()))]
    scored = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, T.StructType(fields)), "scored")
    found = scored.select("row", F.explode("rare").alias("hash")).join(counts.select("hash", "c"), "hash")
    rest = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("more_known"))
    out = scored.drop("rare").join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    unit = float(np.log10(v.total + v.distinct + 1))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * unit).alias("base_score"), (F.col("lm") + more).alias("score"),
    )


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
