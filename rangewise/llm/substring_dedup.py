"""Substring dedup: passages of WINDOW words that an earlier document has, removed.

1. Every window of WINDOW words selects an anchor, the smallest hash among its runs of
   GRAM words (winnowing): equal windows select equal anchors, and a text has few.
   Anchors found in one text class only cannot belong to a recurring window. Texts of
   the same words form a class and are looked at once, as their smallest id.
2. Around each recurring anchor lies a region: the windows that selected it. Equal
   regions are merged before they are dealt, by anchor, to shards of bounded size. There
   windows that seem to recur are compiled into an Aho-Corasick automaton over words (a
   character stands for a word). Every text is streamed through the automata of the
   shards that its anchors lead to, in its regions; the rest of it has no window of
   theirs. The matches confirm the passages, locate every occurrence and tell the first
   document of each.
3. Documents lose the words that a window with an earlier first document covers.

An anchor with very many different regions (a common phrase in ever new surroundings)
is dealt by whole windows instead, so no shard grows without bound and nothing is left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import WordHashes, dropped, over_texts, runs_of, slices, small_batches, table, written

WINDOW, GRAM = 50, 8
#: Regions that a shard is meant to have, and that one anchor may have in its shard.
SHARD, HOT = 1500, 6000
#: Words that an automaton has letters for.
LETTERS = 1_000_000
#: Regions whose texts a task holds before it gives them out.
HELD = 20_000
_SEED = 5
_EMPTY = hashlib.sha256(b"").hexdigest()


class Hasher:
    """Anchors of word lists."""

    def __init__(self):
        self.hashes = WordHashes(_SEED)

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the place of its anchor; and the anchor hash at each place."""
        grams = runs_of(self.hashes.of(words), GRAM)
        span = WINDOW - GRAM + 1
        place = np.empty(len(words) - WINDOW + 1, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, span)
        for at in range(0, len(place), 1 << 15):
            place[at : at + (1 << 15)] = view[at : at + (1 << 15)].argmin(axis=1)
        return place + np.arange(len(place)), grams.view(np.int64)


def _surveyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_words, sha256, anchors) of every row; key names the words."""
    hasher: list[Hasher] = []

    def work(texts):
        hasher or hasher.append(Hasher())
        keys, sizes, digests, found = [], [], [], []
        for text in texts:
            words = text.split() if text else []
            joined = b" ".join(words)
            keys.append(xxhash.xxh3_128_digest(joined))
            sizes.append(len(words))
            digests.append(hashlib.sha256(joined).hexdigest())
            if len(words) < WINDOW:
                found.append([])
            else:
                place, grams = hasher[0].anchors(words)
                found.append(np.unique(grams[np.unique(place)]))
        return {"key": pa.array(keys, pa.binary()), "n_words": pa.array(sizes, pa.int64()), "sha256": pa.array(digests, pa.string()), "anchors": pa.array(found, pa.list_(pa.int64()))}

    return over_texts(docs, work, "key binary, n_words long, sha256 string, anchors array<long>", id_col, text_col)


def _regions(flagged: DataFrame) -> DataFrame:
    """Rows of two kinds. Occurrences (doc_id, key, start, region): the runs of windows
    that selected a recurring anchor; start is the first window's, region names the text.
    Texts (region, anchor, text, low, high), one for each region that a task has met."""
    hasher: list[Hasher] = []
    doc_type = flagged.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher or hasher.append(Hasher())
        seen: dict[bytes, list] = {}

        def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), kind, kind]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "start", "region", "anchor", "text", "low", "high"])

        def texts() -> list[tuple]:
            out = [(None, None, None, region, anchor, text, low, high) for region, (anchor, text, low, high) in seen.items()]
            seen.clear()
            return out

        kind = None
        for part in slices(batches, 2):
            kind = part.schema.field(0).type
            rows: list[tuple] = []
            for doc, key, text, recurring in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = text.split()
                place, grams = hasher[0].anchors(words)
                starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                ends = np.r_[starts[1:], len(place)]
                own = grams[place[starts]]
                for k in np.flatnonzero(np.isin(own, np.array(recurring, np.int64))):
                    joined = b" ".join(words[starts[k] : ends[k] + WINDOW - 1])
                    region = xxhash.xxh3_128_digest(joined)
                    rows.append((doc, key, int(starts[k]), region, None, None, None, None))
                    met = seen.setdefault(region, [int(own[k]), joined, doc, doc])
                    met[2], met[3] = min(met[2], doc), max(met[3], doc)
            if len(seen) > HELD:
                rows += texts()
            yield made(rows, kind)
        if seen:
            yield made(texts(), kind)

    small_batches(flagged.sparkSession)
    return flagged.select("doc_id", "key", "text", "recurring").mapInArrow(run, f"doc_id {doc_type}, key binary, start int, region binary, anchor long, text binary, low {doc_type}, high {doc_type}")


def located(texts: list[bytes], low: list, high: list) -> list[list[tuple[int, int, object]]]:
    """For each region the runs (first window, last window, first document) of its
    recurring windows. low and high: smallest and largest id that has the region.

    Windows whose hash stands in regions of two documents are compiled into the automaton;
    its matches over all regions say where each one is, which document has it first, and
    whether another one has it."""
    letters: dict[bytes, int] = {}
    codes = [np.array([letters.setdefault(w, len(letters) + 1) for w in text.split(b" ")], np.uint32) for text in texts]
    coded = [np.where(c < 0xD800, c, c + 0x800).astype("<u4").tobytes().decode("utf-32-le") for c in codes]  # a letter for each word
    ids = sorted({*low, *high})
    rank = {x: k for k, x in enumerate(ids)}
    lows, highs = (np.array([rank[x] for x in own], np.int64) for own in (low, high))
    sizes = np.array([len(c) - WINDOW + 1 for c in codes])
    hashes = np.concatenate([runs_of(c.astype(np.uint64), WINDOW) for c in codes])
    region = np.repeat(np.arange(len(codes)), sizes)
    _, of = np.unique(hashes, return_inverse=True)
    least, most = np.full(of.max() + 1, len(ids)), np.full(of.max() + 1, -1)
    np.minimum.at(least, of, lows[region])
    np.maximum.at(most, of, highs[region])
    starts = np.cumsum(sizes) - sizes
    automaton = ahocorasick.Automaton()
    for at in np.flatnonzero((least < most)[of]).tolist():
        r = int(region[at])
        k = at - int(starts[r])
        phrase = coded[r][k : k + WINDOW]
        if not automaton.exists(phrase):
            automaton.add_word(phrase, len(automaton))
    out: list[list[tuple[int, int, object]]] = [[] for _ in texts]
    if not len(automaton):
        return out
    automaton.make_automaton()
    first, last = [len(ids)] * len(automaton), [-1] * len(automaton)
    found: list[list[tuple[int, int]]] = []
    for r, text in enumerate(coded):
        found.append(list(automaton.iter(text)))
        lo, hi = int(lows[r]), int(highs[r])
        for _, phrase in found[-1]:
            first[phrase], last[phrase] = min(first[phrase], lo), max(last[phrase], hi)
    for matches, runs in zip(found, out, strict=True):
        for end, phrase in matches:
            if first[phrase] < last[phrase]:
                at, doc = end - WINDOW + 1, ids[first[phrase]]
                if runs and runs[-1][1] == at - 1 and runs[-1][2] == doc:
                    runs[-1] = (runs[-1][0], at, doc)
                else:
                    runs.append((at, at, doc))
    return out


def _portions(anchors: list[int], words: list[int]) -> Iterator[list[int]]:
    """Places of regions, whole anchors together, in portions of at most LETTERS words, as
    there are only so many letters (one anchor has at most HOT regions of 92 words)."""
    held, n = [], 0
    for _, own in groupby(sorted(range(len(anchors)), key=lambda k: anchors[k]), key=lambda k: anchors[k]):
        own = list(own)
        size = sum(words[k] for k in own)
        if held and n + size > LETTERS:
            yield held
            held, n = [], 0
        held += own
        n += size
    if held:
        yield held


def _found(regions: DataFrame, kind: str) -> DataFrame:
    """(region, runs) of distinct regions (region, shard, anchor, text, low, high)."""

    def one(own: pa.Table) -> pa.Table:
        texts, low, high = (own[c].to_pylist() for c in ("text", "low", "high"))
        struct = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", own["low"].type)]))
        keep, found = [], []
        for part in _portions(own["anchor"].to_pylist(), [t.count(b" ") + 1 for t in texts]):
            for k, runs in zip(part, located(*([of[k] for k in part] for of in (texts, low, high))), strict=True):
                if runs:
                    keep.append(k)
                    found.append([{"a": a, "b": b, "first": d} for a, b, d in runs])
        return pa.table([own["region"].take(pa.array(keep, pa.int64())), pa.array(found, struct)], names=["region", "runs"])

    return regions.groupBy("shard").applyInArrow(one, f"region binary, runs array<struct<a: int, b: int, first: {kind}>>")


def _windows_of(regions: DataFrame) -> DataFrame:
    """(region, at, window, low, high): the hashes of the regions' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for region, text, low, high in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = text.split(b" ")
                rows += [(region, k, xxhash.xxh3_128_digest(b" ".join(words[k : k + WINDOW])), low, high) for k in range(len(words) - WINDOW + 1)]
            kinds = [pa.binary(), pa.int32(), pa.binary(), part.schema.field(2).type, part.schema.field(2).type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["region", "at", "window", "low", "high"])

    kind = regions.schema["low"].dataType.simpleString()
    small_batches(regions.sparkSession)
    return regions.select("region", "text", "low", "high").mapInArrow(run, f"region binary, at int, window binary, low {kind}, high {kind}")


def _merged(texts: DataFrame, by: str) -> DataFrame:
    """Distinct regions, dealt by the shard in `by`: the texts move once, as the
    aggregation and the shards' groups need no other partitioning."""
    dealt = texts.repartition(by)
    own = {c: F.first(c).alias(c) for c in ("anchor", "text")}
    return dealt.groupBy(by, "region").agg(*own.values(), F.min("low").alias("low"), F.max("high").alias("high"))


def _all_runs(texts: DataFrame, kind: str, shard: int, hot: int) -> DataFrame:
    """(region, runs) for all regions of texts (region, anchor, text, low, high)."""
    sizes = written(texts.select("anchor", "region").distinct().groupBy("anchor").count())
    n = sizes.agg(F.sum("count")).first()[0] or 0
    named = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n // shard)))).cast("int")
    crowded = sizes.filter(F.col("count") > hot).select("anchor")
    if crowded.isEmpty():
        return _found(_merged(texts.withColumn("shard", named), "shard"), kind)
    crowded = written(crowded)
    plain = _found(_merged(texts.join(crowded, "anchor", "left_anti").withColumn("shard", named), "shard"), kind)
    # equal windows have one hash: counted by it, those of a single document fall away, and
    # one region lends each of the others its text for the automata
    own = texts.join(crowded, "anchor", "left_semi")
    cut = written(_windows_of(own))
    windows = cut.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("region", "at")).alias("of")).filter("low < high")
    windows = written(windows.select("window", "low", "high", "of.region", "of.at"))
    shards = max(1, -(-windows.count() // shard))
    lent = own.select("region", "text").join(windows, "region").dropDuplicates(["window"])
    words = F.array_join(F.slice(F.split(F.col("text").cast("string"), " "), F.col("at") + 1, WINDOW), " ").cast("binary")
    named = F.xxhash64("window")
    single = lent.select(F.col("window").alias("region"), named.alias("anchor"), words.alias("text"), "low", "high", F.pmod(named, F.lit(shards)).cast("int").alias("shard"))
    single = _found(single, kind).select(F.col("region").alias("window"), F.col("runs")[0]["first"].alias("first"))
    back = cut.select("region", "at", "window").distinct().join(single, "window").groupBy("region").agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"), "first")).alias("runs"))
    return plain.unionByName(back)


def _kept(flagged: DataFrame) -> DataFrame:
    """(doc_id, key, n_removed, kept_sha256) of texts with their located runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            removed, digests = [], []
            for text, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = text.split()
                keep = np.ones(len(words), bool)
                for span in spans:
                    keep[span["a"] : span["b"] + WINDOW] = False
                removed.append(int((~keep).sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep, strict=True) if k)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "key", "n_removed", "kept_sha256"])

    small_batches(flagged.sparkSession)
    kind = flagged.schema["doc_id"].dataType.simpleString()
    return flagged.select("doc_id", "key", "text", "spans").mapInArrow(run, f"doc_id {kind}, key binary, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row: spans are the
    removed windows' runs (a, b: first and last start; null where a whole copy goes).

    Null and empty texts have no words. Rows with a null id lose nothing and take nothing
    from others. Rows of one id do not take from each other, whether their texts are equal
    or not. Texts of fewer than WINDOW words stay. Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = written(_surveyed(docs, id_col, text_col))
    able = base.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    classes = written(able.groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    firsts = able.join(classes, ["key", "doc_id"], "left_semi").select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = firsts.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    flags = written(firsts.join(recurring, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("recurring")))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    flagged = written(_keyed(texts.join(flags, "doc_id")))
    regions = written(_regions(flagged))
    runs = written(_all_runs(regions.filter("text is not null").select("region", "anchor", "text", "low", "high"), kind, shard, hot))
    at = regions.filter("text is null").select("doc_id", "key", "start", "region").join(runs, "region")
    earlier = F.filter("runs", lambda r: r["first"] < F.col("doc_id"))
    at = at.withColumn("spans", F.transform(earlier, lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))).filter(F.size("spans") > 0)
    spans = written(at.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))  # of one text each
    kept = _kept(flagged.select("doc_id", "key", "text").join(spans, ["doc_id", "key"])).dropDuplicates(["doc_id", "key"]).join(spans, ["doc_id", "key"])
    kept = written(kept)
    dropped(flagged, flags, regions, runs, spans)
    classes = classes.join(kept, ["key", "doc_id"], "left").withColumnRenamed("doc_id", "first_id")
    rows = base.drop("anchors").join(classes, "key", "left")
    copy = F.coalesce((F.col("n_words") >= WINDOW) & (F.col("doc_id") > F.col("first_id")), F.lit(False))
    same = F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)) & F.col("n_removed").isNotNull()
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(same, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).when(same, F.col("kept_sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(~copy, F.when(same, F.col("spans")).otherwise(F.array().cast("array<struct<a: int, b: int>>"))).alias("spans"),
    )


def _keyed(texts: DataFrame) -> DataFrame:
    """Adds the key of the words (ids need not be unique); texts of too few words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            words = [t.split() if t else [] for t in part.column(1).to_pylist()]
            keys = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
            own = pa.RecordBatch.from_arrays([*part.columns, keys], names=["doc_id", "text", "recurring", "key"])
            yield own.filter(pa.array([len(w) >= WINDOW for w in words], pa.bool_()))

    small_batches(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "recurring").mapInArrow(run, f"doc_id {kind}, text binary, recurring array<long>, key binary")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("spans")
