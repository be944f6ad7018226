"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Each pattern can supply its tokens
once at no cost, and again at a cost that rises with every repetition (a convex cost, so early repetitions fill up
first everywhere). Flow of least cost routes the patterns' tokens to the sources' targets. Patterns, not documents, are
the nodes, so the network stays as small as the catalogue of sources. Within a pattern, a seeded order then decides
which documents give the routed amount: whole passes over all of them, and a prefix for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.llm.common import WORD, documents, stored

#: Weights of the sources by code point, null last, over and over.
WEIGHTS = (3, 1, 2)
#: Hex digits of the seeded hash that make a bucket; the cut falls into one bucket of each pattern.
DIGITS = 3
#: More membership patterns than this are refused rather than collected.
MOST_PATTERNS = 1_000_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> dict[str | None, float]:
    """Each source's target: its part of ``share`` of all sizes by weight, at most ``most`` times its own size.

    What a source can't take is shared again by weight among the others until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    open_ = list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


class _Network:
    """A network with whole-number capacities; edge e goes to ``to[e]`` and has ``room[e]`` left, e ^ 1 is its reverse."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int) -> int:
        e = len(self.to)
        self.to += [b, a]
        self.room += [capacity, 0]
        self.at[a].append(e)
        self.at[b].append(e + 1)
        return e

    def _levels(self, source: int, sink: int) -> list[int] | None:
        level = [-1] * len(self.at)
        level[source], reached = 0, [source]
        for a in reached:
            for e in self.at[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    reached.append(self.to[e])
        return level if level[sink] >= 0 else None

    def fill(self, source: int, sink: int) -> None:
        """Sends as much more as there is room for, by blocking flows along shortest paths."""
        to, room, at = self.to, self.room, self.at
        while level := self._levels(source, sink):
            turn, path, a = [0] * len(at), [], source
            while True:
                if a == sink:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    full = next(i for i, e in enumerate(path) if not room[e])
                    a = to[path[full] ^ 1]
                    del path[full:]
                while turn[a] < len(at[a]) and not (room[at[a][turn[a]]] and level[to[at[a][turn[a]]]] == level[a] + 1):
                    turn[a] += 1
                if turn[a] < len(at[a]):
                    path.append(at[a][turn[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break


def route(capacity: dict[tuple, int], target: dict[str | None, float], most: int = 2) -> dict[tuple, dict[str | None, int]]:
    """Tokens from each pattern to each of its sources, of least cost. The k-th repetition of a token costs k.

    Only the edges into patterns have a cost, and a path of least cost uses one of them; so all paths of one cost can be
    filled up together, cost by cost: the flow stays of least cost.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(target, key=lambda s: (s is None, s or ""))
    net = _Network(2 + len(patterns) + len(sources))
    number = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    supply = [net.add(0, i, 0) for i in range(2, 2 + len(patterns))]
    sent = {p: {s: net.add(i, number[s], most * capacity[p]) for s in dict.fromkeys(p)} for i, p in enumerate(patterns, 2)}
    for s in sources:
        net.add(number[s], 1, round(target[s]))
    for _ in range(most):
        for e, p in zip(supply, patterns, strict=True):
            net.room[e] += capacity[p]
        net.fill(0, 1)
    return {p: {s: net.room[e ^ 1] for s, e in x.items()} for p, x in sent.items()}


def sized(docs: DataFrame, size: F.Column, members: F.Column, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_members`` (sorted, without repeats) and ``mix_order``, a seeded hash of the id."""
    ordered = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.withColumns({"mix_size": F.coalesce(size, F.lit(0)).cast("long"), "mix_members": F.array_sort(F.array_distinct(members)), "mix_order": ordered})


def quotas(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> tuple[DataFrame, dict, dict]:
    """For the rows of ``sized``: what the mix takes of each pattern, the sizes of the sources, and their targets.

    A row per pattern: whole passes over its documents, and how far the seeded order is followed once more: before
    ``mix_cut``, and up to ``mix_last`` (order and size) after it. A document at the end is in if its middle is.
    """
    found = rows.groupBy("mix_members").agg(F.sum("mix_size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity = {tuple(r["mix_members"]): r["n"] for r in found}
    sizes: dict[str | None, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes, weights, share, most)
    flow = {p: sum(x.values()) for p, x in route(capacity, target, most).items()}
    plan = [(list(p), flow[p] // n if n else 0, flow[p] % n if n else 0) for p, n in capacity.items()]
    quota = rows.sparkSession.createDataFrame(plan, "mix_members array<string>, mix_passes long, mix_rest long")

    # Radix descent: sums of buckets of the hash show in which bucket the cut of each pattern falls
    bucket = F.substring("mix_order", 1, DIGITS)
    sums = rows.groupBy("mix_members", bucket.alias("bucket")).agg(F.sum("mix_size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("mix_members").orderBy("bucket"))
    cuts = sums.withColumn("upto", upto).join(quota, "mix_members").filter("upto >= mix_rest and upto - n < mix_rest").groupBy("mix_members").agg(F.min("bucket").alias("mix_cut"), F.min(F.col("upto") - F.col("n")).alias("before"))
    quota = stored(quota.join(cuts, "mix_members", "left"), "mix_quota")
    few = len(capacity) <= 10_000
    edge = rows.join(F.broadcast(quota) if few else quota, "mix_members").filter(bucket == F.col("mix_cut"))
    own = Window.partitionBy("mix_members").orderBy("mix_order", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("mix_size").over(own) - F.col("mix_size") / 2
    last = edge.withColumn("in", middle <= F.col("mix_rest")).filter("in").groupBy("mix_members").agg(F.max(F.struct("mix_order", "mix_size")).alias("mix_last"))
    out = stored(quota.join(last, "mix_members", "left").select("mix_members", "mix_passes", "mix_cut", "mix_last"), "mix_plan")
    return (F.broadcast(out) if few else out), sizes, target


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``sized`` with ``times``, how often the mix takes each."""
    here = F.struct("mix_order", "mix_size")
    more = F.coalesce((F.col("mix_order") < F.col("mix_cut")) | (here <= F.col("mix_last")), F.col("mix_order") < F.col("mix_cut"), F.lit(False))
    return rows.join(plan, "mix_members").withColumn("times", (F.col("mix_passes") + more.cast("long")).cast("int")).drop("mix_passes", "mix_cut", "mix_last")


def mix(docs: DataFrame, size: F.Column, members: F.Column, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """``docs`` with ``times``, how often the mix takes each document: 0 to ``most``, always as a whole.

    ``members`` is an array of sources; a null in it is a source of its own. A pattern's sum misses the routed amount
    by half a document at most, or by half of the rows that share an id and a size. Ids may be null or repeat. A null
    size is 0. No rows give no rows. Same input and seed, same result. Columns of ``docs`` stay, those named mix_ aside.
    """
    rows = sized(docs, size, members, id_col, seed)
    plan, _, _ = quotas(stored(rows.select("mix_size", "mix_members", "mix_order"), "mix"), weights, share, most)
    return take(rows, plan).drop("mix_size", "mix_members", "mix_order")


def words(text: str) -> F.Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    rows = stored(sized(docs, words("text"), F.array("source")).drop("text"), "mix")
    plan, sizes, target = quotas(rows)
    catalogue = spark.createDataFrame([(s, n, target[s]) for s, n in sizes.items()], "s string, source_size long, target double")
    mixed = take(rows, plan).join(F.broadcast(catalogue) if len(sizes) <= 10_000 else catalogue, F.col("source").eqNullSafe(F.col("s")))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("times") * F.col("mix_size")).alias("taken"))
