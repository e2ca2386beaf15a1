"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the runs of WORDS consecutive words of the benchmark items (an item of
fewer words is one pattern). For each pattern length there is a shift table over
blocks of two words: how far the search may move on when it sees that block at the end
of its window, by default past the block. Where the shift is zero, a hash of the block
selects a bucket of patterns, and direct comparison of all words confirms.

The benchmark is a stated query set: it is read in blocks of bounded size, and every
document is searched for every block. One block (the usual case) is one narrow pass.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import over_texts, table, written

WORDS = 10
#: Bytes of item text that are compiled and broadcast together.
BLOCK_BYTES = 8 << 20
# Fixed value: letters, digits and everything beyond ASCII, after lower-casing A-Z.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; bytes.lower() changes A-Z only."""
    return _WORD.findall(raw.lower()) if raw else []


class Patterns:
    """Shift tables and buckets for one block of items."""

    def __init__(self, items: list[tuple[object, bytes | None]], size: int = WORDS):
        by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for item, raw in items:
            own = words(raw)
            if own:
                n = min(size, len(own))
                for k in range(len(own) - n + 1):
                    ids = by_length[n][tuple(own[k : k + n])]
                    if not ids or ids[-1] != item:
                        ids.append(item)
        self.tables = [(n, *self._compile(n, patterns)) for n, patterns in sorted(by_length.items())]

    @staticmethod
    def _compile(n: int, patterns: dict[tuple[bytes, ...], list]):
        block = min(2, n)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[int, list] = defaultdict(list)
        for pattern, ids in patterns.items():
            for end in range(block, n + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, n), n - end)
            buckets[hash(pattern[n - block :])].append((pattern, ids))
        return block, shift, dict(buckets)

    def occurrences(self, own: list[bytes]) -> list[tuple[int, int, list]]:
        """(start, end, items) of every place where a pattern's words stand."""
        found = []
        for n, block, shift, buckets in self.tables:
            most, at, last = n - block + 1, n, len(own)
            while at <= last:
                tail = tuple(own[at - block : at])
                move = shift.get(tail, most)
                if not move:
                    here = tuple(own[at - n : at])
                    for pattern, ids in buckets[hash(tail)]:
                        if pattern == here:
                            found.append((at - n, at, ids))
                    move = 1
                at += move
        return sorted(found, key=lambda f: f[:2])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return own.filter("text is not null").distinct()


def _block(items: DataFrame, k: int, parts: int) -> list:
    """One of the parts of the items: all that the driver holds at a time."""
    own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
    return sorted(((r["item_id"], bytes(r["text"])) for r in own.collect()), key=lambda r: (str(r[0]), r[1]))


#: The block that a worker has compiled last, by its name; workers serve many tasks.
_compiled: dict[str, Patterns] = {}


def _searched(docs: DataFrame, name: str, block: Broadcast, kind: pa.DataType, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One narrow pass over all texts for one block of items."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(texts):
        if name not in _compiled:
            _compiled.clear()
            _compiled[name] = Patterns(block.value)
        own = [words(t) for t in texts]
        found = [_compiled[name].occurrences(w) for w in own]
        ids = [{i for _, _, some in f for i in some if i is not None} for f in found]
        return {
            "n_words": pa.array(list(map(len, own)), pa.int64()),
            "hits": pa.array([[{"start": s, "end": e} for s, e in merged([f[:2] for f in own])] for own in found], span),
            "items": pa.array([sorted(x if kind != pa.string() else map(str, x)) for x in ids], pa.list_(kind)),
        }

    named = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}[kind]
    return over_texts(docs, work, f"n_words long, hits array<struct<start: int, end: int>>, items array<{named}>", id_col, text_col, keep)


def _joined(hits: Column) -> Column:
    """Sorted spans, those that touch made one."""
    return F.aggregate(
        F.array_sort(hits),
        F.array().cast("array<struct<start: int, end: int>>"),
        lambda out, h: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= h["start"]), F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1),
            F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], h["end"]).alias("end"))),
        )).otherwise(F.concat(out, F.array(F.struct(h["start"].alias("start"), h["end"].alias("end"))))),
    )


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *keep, n_words, hits, items) for every row: hits are merged word spans, ends
    exclusive, items the sorted ids of items with a pattern there.

    Null texts have no words. Items with a null text have no patterns; one with a null id
    hits, but has no id to name; repeated items count once. An empty benchmark hits
    nothing. One row out per row in, repeated and null ids too; columns other than id,
    text and `keep` are not read.

    A benchmark of several blocks is searched for block by block, each compiled once by a
    worker; what a block finds is written and gathered by row at the end."""
    sent = docs.sparkSession.sparkContext.broadcast
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(benchmark.schema[item_col].dataType.simpleString(), pa.string())
    items = _items(benchmark, item_col, item_text_col)
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // block_bytes))
    if parts == 1:
        return _searched(docs, uuid.uuid4().hex, sent(_block(items, 0, 1)), kind, id_col, text_col, keep)
    inner = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *inner)
    own = written(own.withColumn("row", F.monotonically_increasing_id()))
    found = []
    for k in range(parts):
        block = sent(_block(items, k, parts))
        part = _searched(own.select("row", "text"), uuid.uuid4().hex, block, kind, "row", "text", ())
        found.append(written(part if k == 0 else part.filter(F.size("hits") > 0)))
        block.destroy()
    n_words = found[0].select(F.col("doc_id").alias("row"), "n_words")
    hits = reduce(DataFrame.unionByName, found).filter(F.size("hits") > 0).groupBy(F.col("doc_id").alias("row"))
    hits = hits.agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = own.drop("text").join(n_words, "row").join(hits.withColumn("hits", _joined(F.col("hits"))), "row", "left")
    empty = {c: F.coalesce(F.col(c), F.array().cast(found[0].schema[c].dataType)).alias(c) for c in ("hits", "items")}
    return rows.select(F.col("id").alias("doc_id"), *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)], "n_words", *empty.values())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"]).cast("long")
    named = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
