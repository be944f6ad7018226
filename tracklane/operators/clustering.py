"""Labels of speakers: dense numbering and clustering into an exact number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: clusters whose mean cosine distance is larger stay apart.
APART = 0.45
#: Rows whose distances are all held at once, at most; distances held of more rows; vectors taken out of Arrow at once.
HELD, BLOCK, STEP = 2048, 1 << 20, 4096


def dense_labels(rows: DataFrame, key: str = "file_id", pos: str = "pos", label: str = "label") -> DataFrame:
    """``rows`` with ``dense``: labels renumbered from 0 in the order in which they first appear within the key."""
    first = rows.groupBy(key, label).agg(F.min(pos).alias("first"))
    ranked = first.withColumn("dense", (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long")).drop("first")
    return rows.join(ranked, [key, label])


def k_means(x: np.ndarray, k: int, iterations: int = 100, seed: int = 0) -> np.ndarray:
    """Labels, dense by first appearance; at most as many clusters as rows. Centres start far apart, by chance."""
    k = min(k, len(x))
    if not k:
        return np.zeros(0, np.int64)
    luck = np.random.default_rng(seed)
    centres = [x[luck.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[luck.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[len(centres)])
    c = np.stack(centres)
    labels = np.zeros(len(x), np.int64)
    for _ in range(iterations):
        now = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[now == j].mean(0) if (now == j).any() else c[j] for j in range(k)])
        if (now == labels).all():
            break
        labels = now
    order: dict[int, int] = {}
    return np.array([order.setdefault(int(a), len(order)) for a in labels])


def agglomerated(x: np.ndarray, most: int | None = None, apart: float = APART) -> np.ndarray:
    """Labels, dense by first appearance: the two clusters with the least mean cosine distance between their rows are
    joined until that exceeds ``apart`` for all and there are ``most`` clusters at most. Of equal pairs the earliest.

    A zero row is at distance 1 from all others. The distances of all rows are held at once, if they are few.
    """
    n = len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if n > HELD:
        return _agglomerated_by_sums(unit, most or n, apart)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, member, left = np.ones(n), np.arange(n), n
    while left > 1:
        a, b = divmod(int(d.argmin()), n)
        a, b = min(a, b), max(a, b)
        if d[a, b] > apart and left <= (most or n):
            break
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = joined, joined
        d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
        size[a] += size[b]
        member[member == b] = a
        left -= 1
    return _dense(member)


def _dense(member: np.ndarray) -> np.ndarray:
    order: dict[int, int] = {}
    return np.array([order.setdefault(int(m), len(order)) for m in member], np.int64)


def _agglomerated_by_sums(sums: np.ndarray, most: int, apart: float) -> np.ndarray:
    """``agglomerated`` of unit rows, which are overwritten, without their distances: memory grows with the rows, time
    with their square.

    The mean distance of two clusters follows from the sums of their rows. Each cluster knows the nearest later one. A
    join brings nothing nearer to a third cluster than the nearer of the two was, so only clusters whose nearest was one
    of the two look again.
    """
    n = len(sums)
    size, near, least = np.ones(n), np.zeros(n, np.int64), np.full(n, np.inf)
    name, into = np.arange(n), np.arange(n)  # first row of each cluster; what a cluster's first row was joined to

    def look(rows: np.ndarray) -> None:
        k = 0
        while k < len(rows):
            first = int(rows[k])
            some = rows[k : k + max(1, BLOCK // max(1, len(sums) - first))]
            k += len(some)
            d = 1 - sums[some] @ sums[first:].T / (size[some][:, None] * size[first:])
            d[np.arange(first, len(sums)) <= some[:, None]] = np.inf
            d[:, gone[first:]] = np.inf
            near[some] = d.argmin(1) + first
            least[some] = d.min(1)

    gone, left = np.zeros(n, bool), n
    look(np.arange(n))
    while left > 1:
        a = int(least.argmin())
        b = int(near[a])
        if least[a] > apart and left <= most:
            break
        sums[a] += sums[b]
        size[a] += size[b]
        into[name[b]] = name[a]
        gone[b], least[b] = True, np.inf
        left -= 1
        again = ~gone & np.isfinite(least) & ((near == a) | (near == b))
        again[a] = True
        look(np.flatnonzero(again))
        if left < len(sums) // 2:
            stay = ~gone
            at = np.cumsum(stay) - 1
            sums, size, name, least, near, gone = sums[stay], size[stay], name[stay], least[stay], at[near[stay]], gone[stay]
    for i in range(n):  # a row is joined to an earlier one
        into[i] = into[into[i]]
    return _dense(into)


def labels_of(x: np.ndarray, k: int | None, most: int | None = None, seed: int = 0) -> np.ndarray:
    """Exactly ``k`` clusters, or as many as are apart."""
    return agglomerated(x, most) if k is None else k_means(x, k, seed=seed)


def clustered(rows: DataFrame, k: int | None, seed: int = 0, most: int | None = None) -> DataFrame:
    """(file_id, pos, label): each file's vectors (file_id, pos, vector) in exactly k clusters, fewer if it has fewer;
    without ``k`` in as many as are apart, ``most`` at most.

    A file's vectors, a few per second of sound, are held in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        vectors, x = table.column("vector"), None
        for at in range(0, table.num_rows, STEP):
            some = vectors.slice(at, STEP)
            part = np.array(some.to_pylist(), np.float64).reshape(len(some), -1)
            x = np.empty((table.num_rows, part.shape[1])) if x is None else x
            x[at : at + STEP] = part.reshape(len(some), x.shape[1])
        return pa.table({"file_id": table.column("file_id"), "pos": table.column("pos"), "label": pa.array(labels_of(x, k, most, seed), pa.int64())})

    return rows.select("file_id", "pos", "vector").groupBy("file_id").applyInArrow(run, f"file_id {rows.schema['file_id'].dataType.simpleString()}, pos {rows.schema['pos'].dataType.simpleString()}, label long")
