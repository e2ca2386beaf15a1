"""What the operators of this subpackage share: scratch tables, reading, batches."""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.plans.registry import shared_dir

#: Rows of one Arrow batch that are worked on together; bounds a worker's memory.
SLICE_ROWS = 256
#: Characters (or bytes) of text worked on together.
SLICE_BYTES = 4 << 20
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 300_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that written() has made and dropped() has not deleted yet.
_scratch: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage is
    cut, a lost executor loses nothing, and later scans prune columns. Its shuffle files
    end with it (where Spark can do so)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rangewise-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")  # with None, get() says None for an unset one
    spark.conf.set(_CLEANUP, "true")  # no later plan reads this one's shuffles
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _scratch.add(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that no plan needs any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rangewise-" in path:
                _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    _scratch.discard(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    """At the end of the program; where the session has ended before, its folder goes
    with the cluster."""
    spark = SparkSession.getActiveSession()
    for path in sorted(_scratch) if spark else ():
        _drop(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default of 10,000 rows an Arrow batch, which whole
    texts make too large, ask for fewer; a session's own setting stays. As plans are run
    later, by whoever asks for their rows, the setting stays with the session."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Pieces of at most SLICE_ROWS rows and about SLICE_BYTES of the text column;
    a single longer text is a piece by itself."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            stop, size = start, 0
            while stop < batch.num_rows and stop - start < SLICE_ROWS:
                value = batch.column(text)[stop]
                size += value.as_buffer().size if value.is_valid else 0
                if size > SLICE_BYTES and stop > start:
                    break
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def over_texts(
    docs: DataFrame,
    work: Callable[[list[bytes | None]], dict[str, list | pa.Array]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """One narrow pass over (id, text): work gets the UTF-8 texts of a slice and
    returns the other columns of schema. The columns in `more` pass through. No shuffle;
    other columns are pruned."""
    ids = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").cast("binary").alias("\x1ftext"),
        *[F.col(f"`{c}`") for c in more],
    )
    id_type = ids.schema["doc_id"].dataType.simpleString()
    kept = "".join(f"`{c}` {ids.schema[c].dataType.simpleString()}, " for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = work(part.column(1).to_pylist())
            columns = [part.column(0), *(part.column(2 + k) for k in range(len(more))), *(v if isinstance(v, pa.Array) else pa.array(v) for v in out.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *more, *out])

    small_batches(docs.sparkSession)
    return ids.mapInArrow(run, f"doc_id {id_type}, {kept}{schema}")


class WordHashes:
    """Hashes of words and of runs of words; those of words are kept (bounded)."""

    def __init__(self, seed: int):
        self.seed, self.known = seed, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        hashes = [known.get(w) for w in words]
        if None in hashes:
            for w in set(words):
                if w not in known:
                    known[w] = digest(w, self.seed)
            hashes = [known[w] for w in words]
        return np.array(hashes, np.uint64)


@lru_cache
def _powers(n: int) -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(n)], np.uint64)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes: a polynomial, mixed."""
    grams = np.lib.stride_tricks.sliding_window_view(hashes, n) @ _powers(n)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return grams


def learned(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What fit makes of a bounded sample, in one task: the driver gets the result only,
    and a lost executor costs a retry. fit gets the rows in no particular order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], names=["made"])

    made = sample.repartition(1).mapInArrow(run, "made binary").first()
    return pickle.loads(made["made"]) if made else None
