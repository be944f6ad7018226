"""Similarity join on sets of word n-grams with PartEnum signatures, and the classes that its links make.

Texts with the same set make one class from the start. For the others, a Jaccard similarity of at least p/q bounds the
symmetric difference of two sets by K. Sizes are cut into bands, each with its own K. The feature domain is hashed into
first-level parts, so many that one of them holds at most one difference, and each of these into second-level parts, of
which all but one are then free of differences: a signature hashes the features of such a subset of parts. Two sets
that are similar enough and belong to a band share a signature.

Features that many unrelated documents have (a licence line, say) are left out of signatures, as they would bring
documents together that have little else in common. That is exact, since a difference can only shrink when a part of
the domain is left out; so it doesn't matter that these features are found on a sample.

Sets that share a signature aren't all compared with one another, since a large group of near copies would give the
square of its size. Each bucket of a signature has a hub, the set that shares most, and every member is compared with
it. Whatever links to its hub is in the hub's class. A member x that doesn't link can still link to another member y,
but only if their differences from the hub, x^h and y^h, have enough features in common, by
|x^y| = |x^h| + |y^h| - 2|(x^h)&(y^h)|. Small groups are compared pair by pair; in large ones a prefix index over the
differences finds the pairs, features that the hub lacks first, rarest of them first, then as many of the hub's own as a
prefix takes; what is still crowded there becomes a bucket of the next round. Members of a crowded entry agree with one another and with their new hub on its feature, so rounds end. No link
is lost.

A large group of near copies has buckets without the text that it was made from, each with a hub of its own, to which few
members link. A hub needn't be in its bucket for this: so each bucket takes the best hub that any of its members has in
another bucket, and the sets to fetch grow with the members, not with members times hubs. Later rounds leave out what
earlier ones joined.

Near copies share hundreds of signatures, most of them with the same members: buckets with equal members count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents, kept, passing, stored
from tracklane.llm.components import components

#: Second-level parts, of which each signature leaves one out. Sets with too many empty subsets go on to the next.
SECOND = (2, 3, 4)
#: A group of up to so many members is compared pair by pair.
SMALL = 16
#: And an entry of the prefix index, whose pairs are then sifted by position, if up to so many members seek or offer in it.
CROWD = 64
#: Texts, and features of theirs, sampled on average at most to find features that many have, and how many make one common.
SAMPLE, SAMPLE_FEATURES, COMMON = 8192, 8 << 20, 8
#: Bits of a signature beyond those that count the rows. Chance meetings only add candidates, which are sifted.
MORE_BITS = 21
#: Bytes in a batch that carries sets.
SET_BYTES = 4 << 20
#: Positions of the bitmap that says which sets must be kept; its size doesn't depend on the input.
BITMAP = 1 << 26
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of 64-bit hashes of n-grams of words, A-Z lower-cased."""

    def __init__(self, n: int):
        self.n, self.hashes = n, _Hashes()

    def set_of(self, text: bytes) -> np.ndarray:
        """Ascending; with fewer than n words, the whole sequence is one; without a word it is empty."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out *= _M3
            out += h[i : len(h) - n + 1 + i]
        return np.unique(_mix(out + np.uint64(n)))


def common_features(docs: DataFrame, share: float, words: int, text_col: str) -> np.ndarray:
    """Ascending features that at least COMMON of the sampled texts have; of near copies among them one counts."""
    luck = F.pmod(F.xxhash64(F.col(text_col), F.lit(5)), F.lit(1 << 30))
    rows = docs.filter(luck < int(share * (1 << 30))).select(F.col(text_col).cast("binary").alias("t")).distinct().limit(2 * SAMPLE).collect()
    shingler, sets = Shingler(words), []
    seen: set[tuple[int, int]] = set()
    for text in sorted(bytes(r["t"] or b"") for r in rows):
        s = shingler.set_of(text)
        if len(s):
            least = {(k, int(_mix(s ^ np.uint64(k * 0x9E37)).min())) for k in range(1, 5)}
            if seen.isdisjoint(least):
                sets.append(s)
            seen |= least
    features, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
    return features[counts >= COMMON]


def class_of(features: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little", signed=True)


class PartEnum:
    """Signatures of sets for Jaccard similarity of at least p/q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.bands = [1]
        while self.bands[-1] < 1 << 40:
            self.bands.append(max(self.bands[-1] + 1, self.bands[-1] * q // p))
        self.edges = np.array(self.bands)
        self.known: dict[tuple[int, int], tuple[int, int]] = {}
        self.subsets = {n: [list(c) for c in combinations(range(n), n - 1)] for n in SECOND}

    def most(self, total: int) -> int:
        """The largest symmetric difference of two similar sets with so many features together."""
        return total * (self.q - self.p) // (self.q + self.p)

    def similar(self, a: int, b: int, common: int) -> bool:
        return self.q * common >= self.p * (a + b - common)

    def bands_of(self, n: int) -> list[int]:
        """The band of the size, and later ones that hold sizes of similar sets."""
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = [own]
        while self.q * n >= self.p * self.bands[out[-1] + 1]:
            out.append(out[-1] + 1)
        return out

    def parts(self, band: int, second: int) -> tuple[int, int]:
        """First-level parts of a band, and how many of them are spare.

        A pair needs one that holds at most one difference and has no empty subset, since nothing in common is no
        likeness. So many are spare that a set rarely has more than that with an empty subset.
        """
        if (band, second) not in self.known:
            need, least = self.most(2 * (self.bands[band + 1] - 1)) // 2 + 1, max(1, self.bands[band] * self.p // self.q)
            best = (2.0, 0)
            for spare in range(need // 3 + 2):
                n = need + spare
                rate = second * n * exp(-least * (second - 1) / (second * n))
                term = total = exp(-min(rate, 700))
                for k in range(1, spare + 1):
                    term *= rate / k
                    total += term
                best = min(best, (round(1 - total, 3), spare))
                if best[0] < 0.01:
                    break
            self.known[band, second] = (need + best[1], best[1])
        return self.known[band, second]

    def signatures(self, features: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a set of ``size`` features, those given: a fixed part of the domain can be left out.

        With each signature, its band and how many of that band any similar set must have in common with this one,
        as band * 2**16 + least: of the spare parts, those that aren't needed for empty ones give one each.
        """
        out, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for band in self.bands_of(size) if size else []:
            if self.most(2 * (self.bands[band + 1] - 1)) == 0:
                continue  # only equal sets are similar
            for second in SECOND:
                first, spare = self.parts(band, second)
                part = ((features >> np.uint64(17)) % np.uint64(first * second)).astype(np.int64)
                sums = np.zeros(first * second, np.uint64)
                np.add.at(sums, part, features)
                sums, counts = sums.reshape(first, second), np.bincount(part, minlength=first * second).reshape(first, second)
                total = np.stack([sums[:, s].sum(1) for s in self.subsets[second]], 1)
                empty = np.stack([counts[:, s].sum(1) for s in self.subsets[second]], 1) == 0
                name = np.arange(total.size, dtype=np.uint64).reshape(total.shape) + np.uint64(band << 40 | second << 32)
                signed = _mix(total + _mix(name * _M3 + np.uint64(1)))
                out.append(signed[~empty])
                weak = int(empty.any(1).sum())
                if weak <= spare:  # of two similar sets, one that stops here leaves them signatures in common here
                    need = 1 + spare - weak if second == SECOND[0] else 1
                    break
            else:
                need = 1
                out.append(signed[empty])
            have = sum(map(len, out)) - sum(map(len, least))
            least.append(np.full(have, (band << 16) + min(need, 0xFFFF), np.int32))
        return np.concatenate(out).view(np.int64), np.concatenate(least)


def shingled(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Stored: id, n_shingles, class (null for an empty set) and a hash of the text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            sizes, classes = [], []
            for t in texts:
                s = shingler.set_of(t)
                sizes.append(len(s))
                classes.append(class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (sizes, classes, map(_text_hash, texts)))], ["id", "n_shingles", "class", "text_hash"])

    longs = [T.StructField(n, T.LongType()) for n in ("n_shingles", "class", "text_hash")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs])
    return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema), "shingled")


def signatures(docs: DataFrame, rows: DataFrame, words: int, p: int, q: int, text_col: str) -> DataFrame:
    """(class, bucket, least) for each signature of each set; of copies that a task meets, the first gives them."""
    count, features = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    bits = min(64, 8 * -(-(count.bit_length() + MORE_BITS) // 8))  # whole bytes; what is left out isn't shuffled
    share = min(1.0, SAMPLE / max(count, 1), SAMPLE_FEATURES / max(features, 1))
    shared = docs.sparkSession.sparkContext.broadcast(common_features(docs, share, words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, enum = Shingler(words), PartEnum(p, q)
        common, narrow = shared.value, np.int64(-1 if bits == 64 else (1 << bits) - 1)
        seen: set[int] = set()
        for batch in batches:
            classes, signs, least, held = [], [], [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                key = _text_hash(text or b"")
                if text and key not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(key)
                    s = shingler.set_of(text)
                    rest = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s] if len(common) else s
                    own, needs = enum.signatures(rest, len(s))
                    own &= narrow
                    needs -= np.minimum(needs % (1 << 16) - 1, len(own) - len(np.unique(own))).astype(np.int32)  # of equal ones, one counts
                    least.append(needs)
                    classes.append(np.full(len(own), class_of(s)))
                    signs.append(own)
                    held += len(own)
                if held > 1 << 18 or text is None and held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(classes)), pa.array(np.concatenate(signs)), pa.array(np.concatenate(least))], ["class", "bucket", "least"])
                    classes, signs, least, held = [], [], [], 0

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "class long, bucket long, least int")


def _text_hash(text: bytes) -> int:
    """As Spark's xxhash64, signed."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def text_hash(text_col: str) -> Column:
    """What tells the texts of rows that share an id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int, text_col: str) -> DataFrame:
    """Stored: (class, features) for the wanted classes, once each.

    The sets are made again from one text of each class. A bitmap of fixed size tells most of the other texts apart.
    """
    texts = rows.filter("class is not null").groupBy("class").agg(F.min("text_hash").alias("text_hash")).join(wanted, "class", "left_semi")
    place = F.pmod("text_hash", F.lit(BITMAP)) + 1  # both bitmap functions count from one
    maps = texts.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # BITMAP bits at most
    bits = np.zeros(BITMAP // 8 + 4096, np.uint8)
    for r in maps:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, here = Shingler(words), shared.value
        seen: set[int] = set()  # texts that this task has met: of thousands of copies, one gives its set
        for batch in batches:
            classes, sets = [], []
            for text in batch.column(0).to_pylist():
                at = _text_hash(text or b"")
                if here[at % BITMAP >> 3] >> (at & 7) & 1 and at not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(at)
                    if len(s := shingler.set_of(text or b"")):
                        classes.append(class_of(s))
                        sets.append(s.tobytes())
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "features"])

    found = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "class long, features binary")
    return stored(found.join(wanted, "class", "left_semi").dropDuplicates(["class"]), "sets")


def _compared(stars: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Stored: each member with its hub, whether they link or are joined already, the member's size, and d, the size of
    their difference. ``own`` and ``own_hub`` say which component a member and its hub are in by now.

    In large groups also how far into the difference, in the order of the prefix index, others must be met: ``reach`` by a
    member that doesn't link to the hub, ``offer`` by any member to one that doesn't. ``delta`` holds the difference so far:
    the features that the hub lacks, ``outside`` of them, then those that only the hub has, ascending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum = PartEnum(p, q)
        c = (q - p) / (q + p)
        for batch in batches:
            large, joins = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            linked, size, d, reach, offer, outside, delta = [], [], [], [], [], [], []
            for big, a, b, joined in zip(large, batch.column(3).to_pylist(), batch.column(4).to_pylist(), joins, strict=True):
                h, x = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                same = h[at] == x
                common = int(same.sum())
                linked.append(joined or enum.similar(len(h), len(x), common))
                size.append(len(x))
                d.append(len(h) + len(x) - 2 * common)
                # How many features two differences must share at least, if one of the two doesn't link to the hub
                least = max(1, -(-(d[-1] + 1 - int(np.ceil(c * max(0, len(x) - len(h))))) // 2))
                reach.append(enum.most(len(x) + len(x) * q // p))  # of two similar sets only one has what precedes the first that both have
                offer.append(min(d[-1] - least, reach[-1]))
                outside.append(len(x) - common)
                upto = offer[-1] if linked[-1] else reach[-1]  # no less than offer
                missing = np.delete(h, at[same])[: max(0, upto + 1 - outside[-1])] if big else h[:0]
                delta.append(np.concatenate([x[~same], missing] if big else [missing]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(linked), *(pa.array(v, pa.int64()) for v in (size, d, reach, offer, outside)), pa.array(delta, pa.list_(pa.int64())), *batch.columns[6:]],
                ["hub", "class", "large", "linked", "size", "d", "reach", "offer", "outside", "delta", "own", "own_hub"],
            )

    # A table, so that the joins below deal plain rows and Spark can split a hub with many members
    sizes = stored(stars.groupBy("hub").agg((F.count("*") > SMALL).alias("large")), "hub_sizes")
    rows = stars.join(sizes, "hub").join(sets.select(F.col("class").alias("hub"), F.col("features").alias("of_hub")), "hub").join(sets, "class")
    schema = "hub long, class long, large boolean, linked boolean, size long, d long, reach long, offer long, outside long, delta array<long>, own long, own_hub long"
    return stored(rows.select("hub", "class", "large", "of_hub", "features", F.expr("own = own_hub"), "own", "own_hub").mapInArrow(run, schema), "stars", SET_BYTES)


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Stored: the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum = PartEnum(p, q)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                keep.append(enum.similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("class").alias(k), F.col("features").alias(f"of_{k}")) for k in "ab")
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "verified", SET_BYTES)


def _owners() -> list[Column]:
    return [F.min("own").alias("first_own"), F.max("own").alias("last_own")]


def _left(stars: DataFrame, found: list[DataFrame]) -> DataFrame:
    """(hub, class, own, own_hub) of the entries whose members aren't all joined by what is found."""
    labels = components(_union(found))
    named = stars.join(labels.toDF("class", "own"), "class", "left").join(labels.toDF("hub", "own_hub"), "hub", "left")
    named = stored(named.withColumns({"own": F.coalesce("own", "class"), "own_hub": F.coalesce("own_hub", "hub")}), "owned")
    apart = named.groupBy("entry").agg(*_owners()).filter("first_own <> last_own").select("entry")
    return named.join(apart, "entry", "left_semi")


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _entries(done: DataFrame) -> DataFrame:
    """Stored: the prefix index over the differences of large groups, an entry for each feature and member.

    Features that the hub lacks come first. Those of them that a single member has, or only members that link, or only
    members of one component, can't lead to a pair: they lead, without an entry. The others follow by how many have them,
    so that a prefix holds the rarest. Features that only the hub has come last, in a fixed order, so that they needn't be
    counted to know how far a prefix reaches: most members lack most of them, and most prefixes end before.

    Of two similar sets only one has what precedes the first feature that both differences have, so the two places of that
    feature add up to no more than either's ``reach``; members too far back for this leave an entry. Of the rest ``sought``
    members seek and ``offered`` offer.
    """
    spread = done.filter("large").select("hub", "class", "linked", "size", "d", "reach", "offer", "own", "outside", F.posexplode("delta").alias("pos", "feature")).withColumn("inside", F.expr("pos >= outside"))
    common = spread.groupBy("hub", "feature").agg(F.count("*").alias("have"), F.min("linked").alias("all_linked"), *_owners()).filter("have > 1 and not all_linked and first_own <> last_own").select("hub", "feature", "have")
    own = Window.partitionBy("hub", "class")
    at = F.when(F.col("inside"), F.col("pos")).otherwise(F.col("outside") - F.count_if(~F.col("inside")).over(own) + F.row_number().over(own.orderBy("inside", "have", "feature")) - 1)
    placed = spread.join(common, ["hub", "feature"]).withColumn("at", at).withColumns({"seeks": F.expr("not linked and at <= reach"), "offers": F.expr("at <= offer")}).filter("seeks or offers")
    ranked = stored(placed.select("hub", "feature", "class", "size", "d", "at", "reach", "seeks", "offers", "own"), "placed")
    first = ranked.groupBy("hub", "feature").agg(F.expr("min(at) filter (where seeks)").alias("first_seek"), F.expr("min(at) filter (where offers)").alias("first_offer"), F.count("*").alias("n"), *_owners()).filter("n > 1 and first_own <> last_own").select("hub", "feature", "first_seek", "first_offer")
    near = ranked.join(first, ["hub", "feature"]).withColumns({"seeks": F.expr("seeks and at + first_offer <= reach"), "offers": F.expr("offers and at + first_seek <= reach")}).filter("seeks or offers")
    ranked = stored(near.drop("first_seek", "first_offer"), "near")
    met = ranked.groupBy("hub", "feature").agg(F.count_if("seeks").alias("sought"), F.count_if("offers").alias("offered"), F.count("*").alias("n"), F.min_by("class", F.struct("d", "class")).alias("nearest"), *_owners()).filter("n > 1 and sought > 0 and offered > 0 and first_own <> last_own").select("hub", "feature", "sought", "offered", "nearest")
    return stored(ranked.join(met, ["hub", "feature"]), "entries")


def _met(entries: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of a member that seeks and one that offers under the same feature, where both prefixes reach it."""
    a = entries.filter("seeks").select("hub", "feature", F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("d").alias("d_a"), F.col("at").alias("at_a"), F.col("own").alias("own_a"))
    b = entries.filter("offers").select("hub", "feature", F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("d").alias("d_b"), F.col("at").alias("at_b"), F.col("own").alias("own_b"))
    most = F.floor((F.col("size_a") + F.col("size_b")) * (q - p) / (q + p))
    least = F.ceil((F.col("d_a") + F.col("d_b") - most) / 2)
    fits = (F.col("at_a") <= F.col("d_a") - least) & (F.col("at_b") <= F.col("d_b") - least) & (q * F.least("size_a", "size_b") >= p * F.greatest("size_a", "size_b"))
    return a.join(b, ["hub", "feature"]).filter((F.col("own_a") != F.col("own_b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _shared(signs: DataFrame) -> DataFrame:
    """Stored: (bucket, class, least, n) for buckets with several classes; those with the same members are one.

    ``n`` says how many signatures a row stands for. Buckets are told apart by a hash of their members; if two unlike
    ones had the same, their members would just be compared with more others.
    """
    by = Window.partitionBy("bucket")
    before = F.lag("class").over(by.orderBy("class"))
    single = signs.withColumn("of", F.when(before.isNull() | (before != F.col("class")), F.xxhash64("class")).otherwise(0))
    met = single.withColumns({"first": F.min("class").over(by), "last": F.max("class").over(by), "members": F.bit_xor("of").over(by)}).filter("first <> last")
    alike = met.select(F.xxhash64("first", "last", "members").alias("alike"), "bucket", "class", "least").distinct()
    return stored(alike.groupBy(F.col("alike").alias("bucket"), "class", "least").agg(F.count("*").alias("n")), "buckets")


def _sifted(shared: DataFrame) -> DataFrame:
    """Stored: (bucket, class, n) of classes that share as many signatures of a band as any similar set must have in common.

    A set that merely has a few features of some other sets goes here, before any set is fetched. Buckets that are left
    with one class go too.
    """
    enough = shared.groupBy("class", "least").agg(F.sum("n").alias("have")).filter(F.col("have") >= F.col("least") % (1 << 16)).select("class").distinct()
    left = stored(shared.join(enough, "class", "left_semi").groupBy("bucket", "class").agg(F.sum("n").alias("n")), "sifted")
    met = left.groupBy("bucket").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first <> last").select("bucket")
    return stored(left.join(met, "bucket", "left_semi"), "sifted")


def links(rows: DataFrame, docs: DataFrame, words: int, p: int, q: int, text_col: str) -> DataFrame:
    """Links (a, b) between classes: every class that links to another is joined to it by a path of these."""
    shared = _sifted(_shared(signatures(docs, rows, words, p, q, text_col)))
    sets = sets_of(docs, rows, shared.select("class").distinct(), words, text_col)
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("size"))
    degree = stored(shared.join(sizes, "bucket").groupBy("class").agg(F.sum(F.col("n") * F.col("size")).alias("degree")), "degree")
    ranked = stored(shared.join(degree, "class").select("bucket", "class", "degree"), "ranked")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "class")).alias("hub"))
    near_hubs = stored(ranked.join(hubs, "bucket").select("bucket", "class", "hub"), "bucket_hubs")
    best = near_hubs.groupBy("class").agg(F.max("hub").alias("best"))
    hubs = stored(near_hubs.join(best, "class").groupBy("bucket").agg(F.max("best")["class"].alias("hub")), "bucket_hubs")
    stars = near_hubs.drop("hub").join(hubs, "bucket").select("hub", "class", F.col("class").alias("own"), F.col("hub").alias("own_hub"))
    found = []
    while True:
        stars = stored(stars.filter("hub <> class").select("hub", "class", "own", "own_hub").distinct(), "hubs")
        done = _compared(stars, sets, p, q)
        found.append(done.filter("linked and own <> own_hub").select(F.col("hub").alias("a"), F.col("class").alias("b")))
        few = done.filter("not large")
        lone = few.filter("not linked").select("hub", F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("own").alias("own_a"))
        others = few.select("hub", F.col("class").alias("b"), "linked", F.col("size").alias("size_b"), F.col("own").alias("own_b"))
        near = q * F.least("size_a", "size_b") >= p * F.greatest("size_a", "size_b")
        pairs = lone.join(others, "hub").filter(F.expr("own_a <> own_b and (linked or a < b)") & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        crowd = False
        if done.filter("large and not linked").limit(1).count():
            entries = _entries(done)
            pairs = pairs.unionByName(_met(entries.filter(f"least(sought, offered) <= {CROWD}"), p, q))
            crowded = entries.filter(f"least(sought, offered) > {CROWD}").select(F.xxhash64("hub", "feature").alias("entry"), F.col("nearest").alias("hub"), "class")
            crowd = crowded.limit(1).count() > 0
        found.append(_verified(pairs.distinct(), sets, p, q))
        if not crowd:
            break
        stars = _left(crowded, found)
    return _union(found)


def near_duplicates(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, and component_id, the least id that links lead to, itself included.

    Also ``text_hash`` of its text and ``component``, a number for all rows that links lead to (null for empty sets).

    Two rows link when the Jaccard similarity of their n-gram sets is at least p/q; features are compared by 64-bit
    hashes. Rows without a word, null texts too, link with nothing. Ids may repeat or be null; a component of null ids
    only has a null component_id. No rows give no rows. Other columns aren't read.
    """
    with passing(docs.sparkSession):
        rows = shingled(docs, words, id_col, text_col)
        labels = components(links(rows, docs, words, p, q, text_col))
        own = rows.select("id", "n_shingles", "class", "text_hash")
        joined = own.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        joined = kept(joined, "labelled")
        # Read from a table, the join below deals plain rows, so that Spark can split a component with many of them
        least = kept(joined.filter("component is not null").groupBy("component").agg(F.min("id").alias("least")), "least")
    out = joined.join(least, "component", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "text_hash", "component")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, p=90, q=100).select("doc_id", "n_shingles", "component_id")
