"""SimHash near-dedup (operator 4) at a similarity threshold: SimHash of parts.

The pipeline's form of the operator, for documents that share most of their shingles.
At a similarity of 0.8 whole-document fingerprints lie some ten bits apart, further than
any tree can prune. So a document is represented by a few short parts, chosen by content
(the smallest hashes of their first words, which near copies have in common); an edit
changes few of them, and the others' fingerprints stay within RADIUS bits. Close part
fingerprints are found through the vantage-point trees and form clusters; each
document of a cluster is compared with two of its members of like size, the shortest one
(with the least of its own beside what all have) and the one that has most parts in
common with others (an original among its edited copies), by the Jaccard similarity of
all shingles. This links most copies with few comparisons.

What it leaves apart goes through an exact prefix-filter join. Shingles have one order,
those seldom in a sample first; two texts that are similar enough share a shingle among
the first n - ceil(similarity * n) + 1 of each. Every text that meets others there is
compared with one of them; then all that meet, are not linked yet, and whose sizes and
number and places of common first shingles allow the similarity are compared. So every
pair at the threshold ends in one group, and pairs within a group are not enumerated.
Sets are only fetched for pairs whose parities allow the similarity too.

Shingles are hashed to 64 bits where texts are looked up by them, however many texts
there are, and to SET_BITS where two texts' sets are compared. There a chance collision
can make two texts of n shingles each share one more, once in 2 ** SET_BITS / n ** 2
comparisons; it never hides a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangewise.llm.common import WordHashes, dropped, over_texts, runs_of, slices, small_batches, written
from rangewise.llm.components import components
from rangewise.llm.simhash import RADIUS, majority, linked
from rangewise.llm.simhash import SHINGLE as PRINT_SHINGLE

SHINGLE, SIMILARITY = 5, 0.8
#: Parts of a document, words of a part, and words whose hash chooses it.
PARTS, PART_WORDS, FIRST_WORDS = 8, 12, 4
#: Parts that a text has in common with a leader it is compared with, where it has as
#: many and LONG shingles; pairs with fewer are left to the exact join.
COMMON_PARTS, LONG = 2, 24
#: Times that texts are compared with one further text each before all pairs are.
ROUNDS = 1
SET_BITS = 32
#: Bits of a text's parities, at least; a text of more shingles has a bit for each, up to
#: a power of two.
PARITIES = 512
#: Part of the shingles needed in common that is asked for among the first ones: more leave
#: fewer pairs, but are looked for further on.
FEW = 0.02
#: Portions, by hash, in which first shingles are looked through for those that several
#: components have: shuffle files take the space of one portion.
PORTIONS = 4
#: Rows whose ids are broadcast (some 50 MB); more are joined by shuffle.
FEW_ROWS = 2_000_000
_SEED = 9
#: Texts, and their most frequent shingles, that the order of shingles is learned from;
#: any order gives the same result.
SAMPLE, FREQUENT = 10_000, 100_000


def words_of(raw: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; null has none."""
    return raw.lower().split() if raw else []


def parts_of(hashes: np.ndarray) -> np.ndarray:
    """Distinct fingerprints of the parts that represent a text, from its words' hashes;
    a text of few words is one part, and one without words has fingerprint zero."""
    n = len(hashes)
    if n <= PART_WORDS:
        return majority(runs_of(hashes, min(PRINT_SHINGLE, n))[None]) if n else np.zeros(1, np.uint64)
    _, first = np.unique(runs_of(hashes, FIRST_WORDS)[: n - PART_WORDS + 1], return_index=True)
    within = np.arange(PART_WORDS - PRINT_SHINGLE + 1)
    return np.unique(majority(runs_of(hashes, PRINT_SHINGLE)[first[:PARTS, None] + within]))


def shingles_of(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles; fewer words are one shingle, none none."""
    return np.unique(runs_of(hashes, min(shingle, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """PARITIES bits or more, each set if an odd number of shingles fall to it. A shingle that
    only one of two texts has turns one bit, so two texts differ in as many shingles at least
    as in bits. The half of more bits is the exclusive or of their two halves."""
    bits = max(PARITIES, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _frequent(docs: DataFrame, shingle: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most often found in about SAMPLE different texts, sorted, and the
    numbers of those texts that have them."""
    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text is not null")
    n = texts.count()
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40) < min(1.0, SAMPLE / max(n, 1))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(_SEED)
        for part in slices(batches, 0):
            found = [shingles_of(known.of(words_of(t)), shingle).view(np.int64) for t in part.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["token"])

    small_batches(docs.sparkSession)
    often = some.mapInArrow(run, "token long").groupBy("token").count().filter("count > 1").orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    tokens, counts = (often[c].to_numpy() for c in ("token", "count"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _surveyed(docs: DataFrame, often, similarity: float, shingle: int, id_col: str, text_col: str, more: tuple[str, ...]) -> DataFrame:
    """(doc_id, more, key, n, parts, tokens, parity, shingles): key names the words, n is
    the number of shingles, parts are distinct fingerprints, tokens the first shingles, in
    an order that puts those frequent in a sample (the broadcast `often`) last, parity see
    parity_of(), and shingles the set of all."""
    known: list[WordHashes] = []

    def first(own: np.ndarray) -> np.ndarray:
        tokens, counts = often.value
        x = own.view(np.int64)
        seen = np.zeros(len(x), np.int64)
        if len(tokens) and len(x):
            at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
            seen = np.where(tokens[at] == x, counts[at], 0)
        # never shorter by a rounding error
        return x[np.lexsort((x, seen))][: len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1]

    def work(texts):
        known or known.append(WordHashes(_SEED))
        words = [words_of(t) for t in texts]
        hashes = [known[0].of(w) for w in words]
        sets = [shingles_of(h, shingle) for h in hashes]
        return {
            "key": pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
            "n": pa.array(list(map(len, sets)), pa.int32()),
            "parts": pa.array([parts_of(h).view(np.int64) for h in hashes], pa.list_(pa.int64())),
            "tokens": pa.array([first(s) for s in sets], pa.list_(pa.int64())),
            "parity": pa.array([parity_of(s) for s in sets], pa.list_(pa.int64())),
            "shingles": pa.array([np.unique((s >> np.uint64(64 - SET_BITS)).astype(np.uint32)).view(np.int32) for s in sets], pa.list_(pa.int32())),
        }

    return over_texts(docs, work, "key binary, n int, parts array<long>, tokens array<long>, parity array<long>, shingles array<int>", id_col, text_col, more)


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of those with shingles (a, b, of_a, of_b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for k in range(part.num_rows):
                x, y = part.column(2)[k].values, part.column(3)[k].values
                both = len(np.intersect1d(x.to_numpy(), y.to_numpy(), assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small_batches(pairs.sparkSession)
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, f"a {kind}, b {kind}")


def _possible(pairs: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose parities, brought to the same number of bits, allow the
    similarity."""
    own = base.select("row", "n", "parity")
    of = {x: own.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"of_{x}")) for x in "ab"}
    size = F.least(F.size("of_a"), F.size("of_b"))

    def folded(held, of: str):
        parts = F.sequence(F.lit(0), (F.size(of) / size).cast("int") - 1)
        return F.aggregate(parts, held, lambda held, k: F.zip_with(held, F.slice(of, k * size + 1, size), lambda x, y: x.bitwiseXOR(y)))

    turned = folded(folded(F.array_repeat(F.lit(0).cast("long"), size), "of_a"), "of_b")
    apart = F.aggregate(turned, F.lit(0), lambda n, x: n + F.bit_count(x))
    most = (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6
    found = written(pairs.join(of["a"], "a").join(of["b"], "b").filter(apart <= most).select("a", "b"))
    dropped(pairs)
    return found


def _compared(pairs: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of rows of base that are similar enough."""
    pairs = _possible(pairs, base, similarity)
    wanted = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct())
    few = wanted.count() <= FEW_ROWS
    sets = written(base.select("row", "shingles").join(F.broadcast(wanted) if few else wanted, "row", "left_semi"))
    of = {x: sets.select(F.col("row").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab"}
    found = written(_similar(pairs.join(of["a"], "a").join(of["b"], "b"), similarity))
    dropped(pairs, wanted, sets)
    return found


def _fits(similarity: float):
    """Whether the sizes of two sets allow the similarity."""
    return (F.col("n_a") >= similarity * F.col("n_b") - 1e-6) & (F.col("n_b") >= similarity * F.col("n_a") - 1e-6)


def _led(first: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): the members of each cluster of the parts (row, n, fp), with its two
    leaders, where sizes and common parts make a similar pair likely. Members of a
    cluster whose sizes no similar pair has are clusters of their own."""
    close = components(linked(first.select("fp").distinct(), radius))
    sized = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -float(np.log(similarity))).alias("sized")
    clusters = first.join(close.withColumnRenamed("vertex", "fp"), "fp", "left").select("row", "n", F.coalesce("root", "fp").alias("cluster"), sized).distinct()
    sizes = clusters.groupBy("cluster", "sized").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(clusters.join(sizes, ["cluster", "sized"]))
    common = members.groupBy("row").agg(F.sum("size").alias("common"))
    of = F.struct("n", "row")
    most = F.min_by(of, F.struct(-F.col("common"), "row"))
    leaders = members.join(common, "row").groupBy("cluster", "sized").agg(F.array_distinct(F.array(F.min(of), most)).alias("leaders"))
    met = members.join(leaders, ["cluster", "sized"]).select("row", "n", F.explode("leaders").alias("leader")).filter("row != leader.row")
    swap = F.col("row") > F.col("leader.row")
    one, other = F.struct("n", "row"), F.col("leader")
    met = met.select(F.when(swap, other).otherwise(one).alias("x"), F.when(swap, one).otherwise(other).alias("y"))
    met = met.groupBy(F.col("x.row").alias("a"), F.col("y.row").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(F.count("*").alias("common"))
    likely = (F.col("common") >= COMMON_PARTS) | (F.least("n_a", "n_b") < LONG)
    found = written(met.filter(_fits(similarity) & likely).select("a", "b"))
    dropped(members, close)
    return found


def _portion(placed: DataFrame, k: int) -> DataFrame:
    """(row, n, root, at, token) of the k-th portion of first shingles of placed (row, n, root,
    tokens)."""
    each = placed.select("row", "n", "root", F.posexplode("tokens").alias("at", "token"))
    return each.filter(F.pmod("token", F.lit(PORTIONS)) == k)


def _apart(own: DataFrame) -> DataFrame:
    """Those of own (row, n, root, at, token) whose shingles are found in several components."""
    apart = own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    return written(own.join(apart, "token", "left_semi"))


def _needed(similarity: float):
    """Shingles that two texts have in common at least, if they are similar enough."""
    return similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6


def _able(similarity: float):
    """At their first common shingle, at places at_a and at_b of one order, two texts have at
    most the shingles from there on in common: whether those are enough."""
    return F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= _needed(similarity)


def _few(similarity: float):
    """Common first shingles that two texts are asked for: FEW of those they need, and one; no
    more than they must have among those that are kept."""
    kept = _needed(similarity) + 1 - F.ceil(similarity * F.greatest("n_a", "n_b") - 1e-6)
    return F.least(kept, 1 + FEW * _needed(similarity))


def _nearest(own: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text with one of another component, the one it shares most of its
    first shingles with among those that come to a shingle soonest (which have the
    fewest seldom ones, as the centre of a group of copies has)."""
    of = ("at", "n", "row", "root")
    soonest = own.groupBy("token").agg(F.min(F.struct(*of)).alias("b"))
    met = own.join(soonest, "token").select(*[F.col(c).alias(f"{c}_a") for c in of], *[F.col(f"b.{c}").alias(f"{c}_b") for c in of])
    met = met.filter((F.col("root_a") != F.col("root_b")) & _fits(similarity) & _able(similarity))
    met = met.groupBy("row_a", "row_b").agg(F.count("*").alias("both")).groupBy("row_a").agg(F.max_by("row_b", F.struct("both", "row_b")).alias("row_b"))
    return written(met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct())


def _rest(own: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of texts in different components that may be similar enough.

    Of two texts' first shingles, as far as _few() more than their first common one may
    come, the text whose end sooner has all that are common among the other's. So those
    have _few() in common at least, which long texts seldom have by chance."""
    a, b = (own.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "root", "at")]) for x in "ab")
    apart = (F.col("row_a") < F.col("row_b")) & (F.col("root_a") != F.col("root_b"))
    early = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) > _needed(similarity) - _few(similarity)
    met = a.join(b, "token").filter(apart & _fits(similarity) & early)
    met = met.groupBy("row_a", "row_b", "n_a", "n_b").agg(F.count("*").alias("both"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    found = met.filter(_able(similarity) & (F.col("both") >= _few(similarity)))
    return written(found.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))


def grouped(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, more, key, root) for every row: rows of one root are a group. Texts of the
    same words (A-Z lower-cased) are one; further ones are joined by similarity. Null
    and empty texts have no words and are copies of each other."""
    often = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle, text_col))  # FREQUENT rows at most
    surveyed = _surveyed(docs, often, similarity, shingle, id_col, text_col, more)
    base = written(surveyed.withColumn("row", F.monotonically_increasing_id()))
    often.destroy()
    classes = written(base.groupBy("key").agg(F.min("row").alias("row")))
    rows = classes.select("row")
    first = written(base.select("row", "n", "parts").join(rows, "row", "left_semi").select("row", "n", F.explode("parts").alias("fp")))
    links = _compared(_led(first, radius, similarity), base, similarity)
    dropped(first)
    tokens, roots, before = None, components(links), links
    for last in [False] * ROUNDS + [True]:
        of = rows.join(roots.withColumnRenamed("vertex", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        if tokens is None:
            tokens = written(base.select("row", "n", "tokens").join(of, "row"))
            apart = reduce(DataFrame.unionByName, [_apart(_portion(tokens, k)) for k in range(PORTIONS)])
        else:  # no other shingle can join two components any more
            apart = _apart(tokens.drop("root").join(of, "row"))
        dropped(tokens)
        found = _compared((_rest if last else _nearest)(apart, similarity), base, similarity)
        dropped(before)
        before, roots = roots, components(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).union(found))
        dropped(found)
        tokens = apart
    dropped(tokens, before)
    roots = classes.join(roots.withColumnRenamed("vertex", "row"), "row", "left").select("key", F.coalesce("root", "row").alias("root"))
    found = written(base.select("doc_id", *more, "key").join(roots, "key"))
    dropped(base, classes)
    return found


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) for every row with an id: the smallest id of its group, see
    grouped().

    Rows without an id are left out; rows of one id with different texts are each
    grouped, and then the id has several rows. Other columns are not read."""
    found = grouped(docs.filter(F.col(f"`{id_col}`").isNotNull()), similarity, shingle, radius, id_col, text_col)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("doc_id", "group_id")
