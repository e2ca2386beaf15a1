"""SimHash near-duplicates, with exact pairs found through vantage-point trees.

Copies share a fingerprint, so all that follows is about distinct fingerprints. A tree
of vantage points, built on a bounded sample, deals them to shards: at a node, those
within a radius of the vantage point go inside, the others outside. By the triangle
bound, a pair at most `radius` bits apart is only split where its inner member lies
within `radius` of the border; such members are also sent outside as copies. So every
close pair meets in some shard. Inside a shard the same splitting goes on in memory down
to small leaves, whose pairs are compared directly. Links become a spanning forest for
each shard, and components are found by stars over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import dropped, over_texts, table, written
from rangewise.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints that the tree of shards is built on; a shard's size aimed at; the
#: sample a shard must have to be split; leaves compared directly.
SAMPLE, SHARD, LEAST, LEAF = 65_536, 4096, 16, 256
#: Above SAMPLE * PER_SAMPLE fingerprints the sample grows with them, up to MOST_SAMPLE
#: (8 MB), so that shards keep their size up to 270 million fingerprints; beyond that
#: they grow, and are searched in memory by splitting on.
PER_SAMPLE, MOST_SAMPLE = 256, 1 << 20
_CANDIDATES = 8
#: Fingerprints that walk down the tree together.
DEALT = 1 << 15


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is set if it is in over half of the
    shingles' hashes. Texts with fewer words are one shingle; without words, zero."""
    hashes: list[int] = []
    sizes = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split() if text else []
        if len(words) > shingle:
            own = [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)), strict=False)]
        else:
            own = [b" ".join(words)] if words else []
        hashes += [digest(s, SEED) for s in own]
        sizes.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        n = np.array(sizes)[some]
        starts = np.cumsum(n) - n
        raw = np.array(hashes, np.uint64)
        weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for k, (start, size) in enumerate(zip(starts, n, strict=True)):
            ones = np.zeros(64, np.int64)
            for at in range(start, start + size, 1 << 16):
                part = raw[at : min(at + (1 << 16), start + size)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[some[k]] = weight[ones * 2 > size].sum(dtype=np.uint64)
    return out


def majority(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of each row of hashes: a bit is set if it is in over half of them."""
    rows, n = hashes.shape
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(rows, n, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long."""
    return over_texts(docs, lambda texts: {"fp": pa.array(fingerprints_of(texts, shingle).view(np.int64))}, "fp long", id_col, text_col)


def distances(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def _vantage(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int, int] | None:
    """The vantage point and border, of a few tried, for which the larger side, its copies
    with it, is smallest; None where no split makes the sides smaller than the whole."""
    best = None
    for v in points[rng.choice(len(points), min(_CANDIDATES, len(points)), replace=False)]:
        ordered = np.cumsum(np.bincount(distances(points, v), minlength=65))
        # inside: up to t; outside: from t + 1 - radius on
        outside = len(points) - np.concatenate([np.zeros(radius, np.int64), ordered])[:65]
        worst = np.maximum(ordered, outside)
        t = int(worst[:64].argmin())
        if best is None or worst[t] < best[2]:
            best = (v, t, int(worst[t]))
    return best if best and best[2] < 0.95 * len(points) else None


class Tree:
    """Nodes as arrays; a leaf's vantage index is -1 and its shard number is in border."""

    def __init__(self, sample: np.ndarray, per_sample: float, radius: int = RADIUS, shard: int = SHARD):
        self.radius, self.point, self.border, self.inner, self.outer, self.shards = radius, [], [], [], [], 0
        rng = np.random.default_rng(SEED)
        todo = [(np.unique(sample), None, False)]
        while todo:
            points, parent, inside = todo.pop()
            here = len(self.point)
            if parent is not None:
                (self.inner if inside else self.outer)[parent] = here
            split = _vantage(points, radius, rng) if len(points) * per_sample > shard and len(points) > LEAST else None
            self.point.append(split[0] if split else np.uint64(0))
            self.border.append(split[1] if split else self.shards)
            self.inner.append(-1)
            self.outer.append(-1)
            if split:
                d = distances(points, split[0])
                todo += [(points[d <= split[1]], here, True), (points[d > split[1] - radius], here, False)]
            else:
                self.shards += 1

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, place in points), several for points near borders."""
        shards, places = [], []
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if self.inner[node] < 0:
                shards.append(np.full(len(at), self.border[node], np.int32))
                places.append(at)
            elif len(at):
                d = distances(points[at], self.point[node])
                todo += [(self.inner[node], at[d <= self.border[node]]), (self.outer[node], at[d > self.border[node] - self.radius])]
        return np.concatenate(shards), np.concatenate(places)


def close_pairs(points: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (places in points) at most radius apart, by splitting on;
    a pair may come several times."""
    rng = np.random.default_rng(SEED)
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        split = _vantage(points[at], radius, rng) if len(at) > LEAF else None
        if split:
            d = distances(points[at], split[0])
            todo += [at[d <= split[1]], at[d > split[1] - radius]]
            continue
        for k in range(0, len(at), LEAF):
            near = distances(points[at[k : k + LEAF], None], points[None, at[k:]]) <= radius
            i, j = np.nonzero(near)
            keep = i < j
            yield at[k + i[keep]], at[k + j[keep]]


def forest(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Root (place of the smallest point reached) of each point, by union and find."""
    parent = list(range(len(points)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in close_pairs(points, radius):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(len(points))], np.int64)


def _tree(distinct: DataFrame, radius: int) -> Tree:
    """On a bounded sample of fingerprints, chosen by hash; all are indexed with it."""
    n = distinct.count()
    size = max(SAMPLE, min(MOST_SAMPLE, n // PER_SAMPLE))
    rank = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(1 << 40)) / float(1 << 40)
    sample = np.sort(distinct.filter(rank < min(1.0, size / max(n, 1))).select("fp").toArrow()["fp"].to_numpy())
    return Tree(sample.view(np.uint64), n / max(len(sample), 1), radius)


def sharded(distinct: DataFrame, tree) -> DataFrame:
    """(shard, fp): every fingerprint in its shard of the broadcast tree, and copies near
    borders."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        fp = np.concatenate(held)
        shard, place = tree.value.deal(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[place])], names=["shard", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= DEALT:
                yield dealt(held)
                held = []
        if sum(map(len, held)):
            yield dealt(held)

    return distinct.select("fp").mapInArrow(run, "shard int, fp long")


def close(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints at most radius bits apart. A
    fingerprint has a bounded number of others so near (2,080 within 2 bits)."""

    def one(own: pa.Table) -> pa.Table:
        fp = own["fp"].to_numpy()
        found = [np.stack([fp[a], fp[b]], axis=1) for a, b in close_pairs(fp.view(np.uint64), radius)]
        pairs = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _by_shard(distinct, radius, one).distinct()


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of those pairs in each shard, at most a link for each
    fingerprint; it has the same components."""

    def one(part: pa.Table) -> pa.Table:
        fp = np.sort(part["fp"].to_numpy())
        root = forest(fp.view(np.uint64), radius)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[own], "b": fp[root[own]]})

    return _by_shard(distinct, radius, one)


def _by_shard(distinct: DataFrame, radius: int, one) -> DataFrame:
    """What `one` finds in each shard, written; the tree's broadcast ends with it."""
    tree = distinct.sparkSession.sparkContext.broadcast(_tree(distinct, radius))
    found = written(sharded(distinct, tree).groupBy("shard").applyInArrow(one, "a long, b long"))
    tree.destroy()
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest id that
    links of at most radius bits reach from it, copies included.

    Null and empty texts have fingerprint zero and are linked like any other. Null ids
    have a row and a component each like others, but are never the smallest unless all
    are null. Repeated rows are copies. Other columns are not read."""
    prints = written(fingerprints(docs, shingle, id_col, text_col))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = linked(distinct, radius)
    roots = components(links)
    dropped(links)
    rooted = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    of_root = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = written(rooted.join(of_root, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")  # a hot fingerprint's rows are split by AQE


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
