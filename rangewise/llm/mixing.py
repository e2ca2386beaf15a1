"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame operations. A hash gives every document a place in its source, and the
blocks of a source are ranges of places. A source's target fixes its exact quota: whole
passes over all its blocks and, for the rest, blocks in order up to the place at which
the target is met, which is found by two rounds of 1,024 ranges each. All taken blocks of
all sources are dealt to the output shards by a tree: a node's counts of each source are
split between its two halves by multivariate hypergeometric draws, so every shard gets
the random counts of a uniform deal and their sums stay exact. A shard's blocks of a
source are the next ones, disjoint, in a permutation of the quota; inside a shard
documents are ordered by a hash. Everything random is a hash of the seed and of names,
so reruns agree.

No task gets more than DIGIT rows of a source, its documents at the one place where the
target is met, or a row for each shard and source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangewise.llm.common import table, written

#: Places of a source, and ranges that a round tells apart, as powers of two.
PLACES, DIGIT = 60, 10
#: Levels of the splitting tree, 2 ** LEVELS output shards, at least; words that a shard
#: is to have at most; blocks that it is to have, and bits of a source's blocks at most.
LEVELS, SHARD_WORDS, PER_SHARD, BLOCK_BITS = 3, 1 << 26, 128, 24
#: Levels of the tree in one plan.
PLANNED = 4
#: Files that a shard is written as.
PIECES = 4
#: Standard deviations around the mean that a draw is looked for in.
TAILS = 12
#: A prime over any quota, by which blocks are permuted.
_STEP = 4_294_967_291
WEIGHTS, MOST, SEED = (1.0, 2.0, 3.0), 3, 20
_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _unit(*names) -> Column:
    """A number in (0, 1) from a hash of names."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *names), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size, target) from (src, source_size): weights repeat over the
    sources in order and share the total; a target stops at `most` times its source's
    size, and the excess is shared again by weight.

    The shares end at one level: target = min(most * size, level * weight). Sources sorted
    by the level at which they stop, the level is the first at which the next one doesn't."""
    every = Window.partitionBy()
    named = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = sizes.withColumn("weight", named).withColumn("stop", most * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", "src")
    before = F.coalesce(F.sum(most * F.col("source_size")).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    level = F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", "src", "level"))).over(every)["level"]
    return own.select("src", "source_size", F.least((most * F.col("source_size")).cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value's expression in the plan once."""
    return F.transform(F.array(value), then)[0]


def _ln_factorial(n: Column) -> Column:
    """Stirling's series; its error is below 5e-6 from 2 on, and 0 and 1 are exact."""

    def series(x: Column) -> Column:
        by = 1 / (x * x)
        return F.when(x < 2, 0.0).otherwise((x + 0.5) * F.log(x) - x + 0.9189385332046727 + (1 / 12 - (1 / 360 - by / 1260) * by) / x)

    return _let(n.cast("double"), series)


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Good ones among `drawn` of `total`, by inversion: walk up from the least likely
    count, each probability from the last, until the sum reaches u. Counts TAILS standard
    deviations off the mean are out of reach of any u, so the work grows with the root."""

    def ends(mean: Column) -> Column:
        spread = TAILS * (F.sqrt(F.greatest(mean * (1 - mean / F.greatest(drawn, F.lit(1))), F.lit(0.0))) + 1)
        low = F.greatest(F.lit(0).cast("long"), drawn - (total - good), F.floor(mean - spread))
        return F.struct(low.alias("low"), F.least(good, drawn, F.ceil(mean + spread)).alias("high"))

    def walked(end: Column) -> Column:
        choose = lambda n, k: _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
        first = choose(good, end["low"]) + choose(total - good, drawn - end["low"]) - choose(total, drawn)

        def step(s: Column, x: Column) -> Column:
            ratio = ((good - x) * (drawn - x)).cast("double") / ((x + 1) * (total - good - drawn + x + 1)).cast("double")
            return F.struct(
                F.when(s["found"] >= 0, s["sum"]).otherwise(s["sum"] + F.exp(s["ln"])).alias("sum"),
                F.when(s["found"] >= 0, s["ln"]).otherwise(s["ln"] + F.coalesce(F.log(ratio), F.lit(0.0))).alias("ln"),
                F.when((s["found"] < 0) & (s["sum"] + F.exp(s["ln"]) >= u), x).otherwise(s["found"]).alias("found"),
            )

        start = F.struct(F.lit(0.0).alias("sum"), first.alias("ln"), F.lit(-1).cast("long").alias("found"))
        found = F.aggregate(F.sequence(end["low"], F.greatest(end["low"], end["high"] - 1)), start, step, lambda s: s["found"])
        return F.when(found >= 0, F.least(found, end["high"])).otherwise(end["high"])

    return _let(_let(good.cast("double") * drawn / F.greatest(total, F.lit(1)), ends), walked)


def split_quotas(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(src, shard, quota) from (src, quota): the splitting tree. A node is a row with
    the quotas of all sources in order; its left half gets half of its blocks."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", F.col("quota").cast("long").alias("q")))).alias("own")).select(F.lit(0).cast("long").alias("node"), "own")
    for level in range(levels):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, s: a + s["q"])
        node = node.withColumn("total", total).withColumn("half", F.floor((F.col("total") + F.pmod(F.col("node"), F.lit(2))) / 2))

        u = F.lit(level)

        def draw(state: Column, s: Column) -> Column:
            x = _hypergeometric(state["total"], s["q"], state["drawn"], _unit(u, F.col("node"), s["src"]))  # noqa: B023
            return F.struct((state["total"] - s["q"]).alias("total"), (state["drawn"] - x).alias("drawn"), F.concat(state["left"], F.array(x)).alias("left"))

        start = F.struct(F.col("total"), F.col("half").alias("drawn"), F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.aggregate("own", start, draw, lambda s: s["left"]))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("own", "left", lambda s, x: F.struct(s["src"].alias("src"), x.alias("q"))).alias("own")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("own", "left", lambda s, x: F.struct(s["src"].alias("src"), (s["q"] - x).alias("q"))).alias("own")),
        )
        node = node.select(F.explode(halves).alias("h")).select("h.node", "h.own")
        if level % PLANNED == PLANNED - 1 and level < levels - 1:
            node = written(node)
    return node.select(F.col("node").alias("shard"), F.explode("own").alias("s")).select("s.src", "shard", F.col("s.q").alias("quota"))


def _met(cells: DataFrame, cell: str) -> DataFrame:
    """(src, cell, need, size): the cell of (src, cell, size, need) in which need is met,
    and what is left of need there."""
    order = Window.partitionBy("src").orderBy(cell)
    until = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("need") - (F.col("until") - F.col("size"))
    return cells.withColumn("until", until).filter((F.col("until") >= F.col("need")) & (left > 0)).select("src", cell, left.alias("need"), "size")


def _goals(slim: DataFrame, weights: tuple[float, ...], most: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of each source (src, source_size, target, passes, cell, bits, last, quota): target
    is met in the range `cell` of places after `passes` whole passes, `last` is the last
    place of which something is taken (else -1), and quota the blocks in all, of 2 ** bits
    a pass. And (src, place, each): words of each document at that place, in that cell."""
    digit = lambda k: F.shiftright("place", PLACES - k * DIGIT)
    sizes = written(slim.groupBy("src", digit(1).alias("cell")).agg(F.sum("size").alias("size")))
    goal = targets(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), weights, most)
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("int")
    goal = written(goal.withColumn("passes", passes).withColumn("need", words - F.col("passes") * F.col("source_size")))
    first = _met(sizes.join(goal.select("src", "need"), "src"), "cell")
    within = slim.withColumn("cell", digit(1)).join(first.select("src", "cell", "need"), ["src", "cell"])
    cells = within.groupBy("src", digit(2).alias("cell2"), "need").agg(F.sum("size").alias("size"))
    second = written(_met(cells, "cell2"))
    # in the last cell by place; equal documents have equal places, and the same words of each are taken
    within = slim.withColumn("cell2", digit(2)).join(second.select("src", "cell2", "need"), ["src", "cell2"])
    places = within.groupBy("src", "place", "need").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    before = F.sum("size").over(Window.partitionBy("src").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    each = F.floor(F.least(F.col("size"), F.col("need") - F.col("before")) / F.col("rows"))
    edge = written(places.withColumn("before", before).filter("before < need and size > 0").select("src", "place", each.alias("each")))
    last = edge.groupBy("src").agg(F.max("place").alias("last"))

    # blocks of like size over all sources, PER_SHARD to a shard, as far as BLOCK_BITS allow
    per_block = F.greatest(F.sum("source_size").over(Window.partitionBy()) / float(PER_SHARD << levels), F.lit(1.0))
    bits = F.least(F.lit(BLOCK_BITS), F.ceil(F.log2(F.greatest(F.col("source_size") / per_block, F.lit(1.0))))).cast("int")
    goal = goal.join(second.select("src", "cell2"), "src", "left").join(last, "src", "left").withColumn("bits", bits)
    goal = goal.withColumn("last", F.coalesce("last", F.lit(-1).cast("long")))
    quota = (F.col("passes") * _blocks() + _block("last") + 1).alias("quota")
    goal = goal.select("src", "source_size", "target", "passes", F.coalesce("cell2", F.lit(-1).cast("long")).alias("cell"), "bits", "last", quota)
    return written(goal), edge


def _blocks() -> Column:
    """Blocks of a source."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))


def _block(place: str) -> Column:
    """The block of a place; of -1 it is -1."""
    return F.call_function("shiftright", F.col(place), F.lit(PLACES) - F.col("bits"))


def _dealt(slim: DataFrame, goals: DataFrame, levels: int) -> DataFrame:
    """(src, block, items): the shard of each pass (pass, shard) over a block. An item's
    number in its source is permuted; each shard has the next numbers, as its quota says."""
    quotas = written(split_quotas(goals.select("src", "quota"), levels))
    until = F.sum("quota").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    spans = quotas.withColumn("until", until).withColumn("since", F.col("until") - F.col("quota")).filter("quota > 0").join(goals.select("src", F.col("quota").alias("all")), "src")
    near = lambda n: F.floor(n * F.lit(1 << levels) / F.col("all"))
    spans = spans.withColumn("near", F.explode(F.sequence(near(F.col("since")), near(F.col("until") - 1)))).select("src", "near", "since", "until", "shard")
    own = slim.join(goals.select("src", "bits", "passes", "last", F.col("quota").alias("all")), "src")
    blocks = own.select("src", _block("place").alias("block"), "bits", "passes", _block("last").alias("final"), "all").distinct()
    number = F.col("pass") * _blocks() + F.col("block")
    items = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    items = items.filter((F.col("pass") < F.col("passes")) | (F.col("block") <= F.col("final"))).withColumn("number", number)
    shift = F.pmod(F.xxhash64(F.lit(SEED), "src"), F.col("all"))
    items = items.withColumn("at", F.pmod(F.col("number") * F.lit(_STEP) + shift, F.col("all"))).withColumn("near", near(F.col("at")))
    met = items.join(spans, ["src", "near"]).filter("since <= at and at < until")
    return met.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", F.col("shard").cast("int").alias("shard")))).alias("items"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    levels: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *keep, size, source_size, target, takes) for every row; takes lists
    (pass, shard, words, key): words below size mean that the document's first words are
    taken; key orders a shard. The sum of a document's takes is what the tree has dealt.

    A source's words over all takes are its target, rounded, but for the document at
    which it is met: if that one is repeated, each of its rows gives equally many words.
    Null texts have size 0; the null source is the last. Sources of size 0 have target 0.
    Equal documents are taken alike, rows with a null id too. An empty table gives no
    rows. The table is read twice if columns are kept, so it must read the same."""
    src = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))  # '=' sorts before 'n'
    text = F.col(f"`{text_col}`")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), text), 64 - PLACES)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep], src.alias("src"), words_in(text).alias("size"), place.alias("place"))
    slim = written(own.drop(*keep))
    if levels is None:
        total = slim.agg(F.sum("size")).first()[0] or 0
        levels = max(LEVELS, (-(-total // SHARD_WORDS) - 1).bit_length())
    goals, edge = _goals(slim, weights, most, levels)
    plan = written(_dealt(slim, goals, levels))

    rows = (own if keep else slim).join(goals.drop("quota"), "src").withColumn("block", _block("place"))
    rows = rows.join(plan, ["src", "block"], "left").join(edge, ["src", "place"], "left")
    cell = F.shiftright("place", PLACES - 2 * DIGIT)
    last = F.when(cell < F.col("cell"), F.col("size")).otherwise(F.coalesce("each", F.lit(0).cast("long")))
    take = lambda i: F.struct(
        i["pass"].alias("pass"), i["shard"].alias("shard"),
        F.when(i["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("last_words")).alias("words"),
        F.xxhash64(F.lit(SEED), i["pass"], F.col("doc_id").cast("string"), F.col("size")).alias("key"),
    )
    items = F.coalesce("items", F.array().cast("array<struct<pass:int,shard:int>>"))
    takes = F.filter(F.transform(items, take), lambda t: t["words"] > 0)
    return rows.withColumn("last_words", last).select("doc_id", *keep, "size", "source_size", "target", takes.alias("takes"))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({_WORD})")), F.lit(1), n.cast("int")), " ")


def shards(mixed: DataFrame, text_col: str | None = None) -> DataFrame:
    """The mix itself, a row for each document and pass taken: by shard, each one in
    PIECES parts, rows in the order of their hash. A text of which only the first words
    are taken is cut to them."""
    rows = mixed.withColumn("take", F.explode("takes")).withColumn("words", F.col("take.words"))
    if text_col:
        cut = F.when(F.col("words") < F.col("size"), first_words(F.col(f"`{text_col}`"), F.col("words"))).otherwise(F.col(f"`{text_col}`"))
        rows = rows.withColumn(text_col, cut)
    own = [c for c in mixed.columns if c != "takes"]
    rows = rows.select("take.shard", F.pmod("take.key", F.lit(PIECES)).cast("int").alias("piece"), "take.key", "take.pass", *own, "words")
    return rows.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "key")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken sums what the tree has dealt; shards are those of each take, in order of passes."""
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"])
    dealt = F.array_join(F.transform("takes", lambda t: t["shard"].cast("string")), ",")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), dealt.alias("shards"))
