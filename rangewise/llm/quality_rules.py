"""Quality rules: robust multivariate outliers among documents of a kind.

Every text gets a vector of transformed statistics. For each language and source the
minimum covariance determinant (MCD) gives a location and scatter that outliers cannot
pull; a document whose Mahalanobis distance is beyond a chi-squared quantile is rejected.

Large groups are handled as the fast MCD algorithm does, with nothing sampled: a
group is dealt by hash into blocks of about BLOCK rows, each block's MCD is found by
concentration steps from deterministic starts, the blocks' estimates are averaged, and
concentration steps over the whole group follow as plain aggregations (the half of the
rows with the smallest distances gives the next estimate). Every group has its own
estimate, whatever its size; like a prior that weighs PRIOR rows, the estimate of its
language is mixed in, and into that one the estimate over all documents, so that a few
rows don't judge themselves. The covariance has a floor for each statistic (a
regularised MCD), because many statistics are constant in more than half of a group.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import over_texts, table, written

#: Rules of the base verdict.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STATS = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "letters", "variety")
#: Standard deviation that each statistic is taken to have at least.
FLOOR = (0.8, 0.5, 0.05, 0.08, 0.10, 0.05, 0.10)
#: Rows of a block; rows that the next wider group's estimate counts as; full-data steps.
BLOCK, PRIOR, STEPS = 1500, 60, 2
#: Random starts of a block's MCD, and how many of them go on.
RANDOM_STARTS, BEST_STARTS = 24, 4
#: Groups whose estimates are broadcast, about 1 kB each; more are joined by shuffle.
FEW_GROUPS = 10_000
#: Relative error of the half's distance is 1 / ACCURACY in rank.
ACCURACY = 10_000
#: Share of good documents under the normal model that lie beyond the cut.
TAIL = 1e-6
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]+")
_SYMBOL = re.compile(rb"[#*$%&|<>]")


def statistics(raw: bytes | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector.

    bytes.split() cuts at exactly 0x20 and 0x09-0x0D."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    chars = sum(map(len, words)) if raw.isascii() else sum(len(w.decode()) for w in words)
    symbols = len(_SYMBOL.findall(raw))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else []
    dup = len(lines) - len(set(lines))
    repeat = _repeat_words(words)
    letters = sum(map(len, _LETTER.findall(raw)))
    vector = [
        math.log1p(n),
        chars / n if n else 0.0,
        math.sqrt(symbols / (chars + 1)),
        math.sqrt(dup / (len(lines) + 1)),
        math.sqrt(repeat / (n + 1)),
        math.sqrt(max(0, len(raw) - sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))) - letters) / (len(raw) + 1)),
        len(set(words)) / (n + 10.0) ** 0.9,
    ]
    return n, chars, symbols, dup, repeat, vector


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first one included."""
    if len(words) < 4:
        return 0
    seen: dict[tuple[bytes, bytes, bytes], int] = {}
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, end = 0, 0
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered += k + 3 - max(k, end)
            end = k + 3
    return covered


def measured(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, ...]) -> DataFrame:
    def work(texts):
        found = [statistics(t) for t in texts]
        out = {n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        return out | {s: pa.array([f[5][k] for f in found], pa.float64()) for k, s in enumerate(STATS)}

    longs = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    doubles = ", ".join(f"{s} double" for s in STATS)
    inputs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").cast("string").alias(f"group_{k}") for k, c in enumerate(group_cols)])
    return over_texts(inputs, work, f"{longs}, {doubles}", "id", "text", tuple(f"group_{k}" for k in range(len(group_cols))))


def mcd(x: np.ndarray, floor: np.ndarray = np.array(FLOOR)) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of the half of x with the smallest (floored) covariance
    determinant: concentration steps from the median-centred ball in scaled coordinates,
    in ranks, from the coordinatewise trimmed half, and from the best of a few random
    small sets (of a fixed seed)."""
    n, p = x.shape
    x = x[np.lexsort(x.T)]  # the order in which rows come plays no part
    h = min(n, (n + p + 1) // 2)
    centre = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), floor)
    z = np.abs(x - centre) / spread
    ranks = np.abs(np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0) - (n - 1) / 2)

    def estimate(half: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = x[half].mean(0)
        d = x[half] - mean
        cov = d.T @ d / len(half) + np.diag(floor**2)
        return np.linalg.slogdet(cov)[1], mean, cov

    def nearest(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        d = x - mean
        return np.argsort(((d @ np.linalg.inv(cov)) * d).sum(1), kind="stable")[:h]

    starts = [np.argsort(start, kind="stable")[:h] for start in ((z**2).sum(1), z.max(1), ranks.max(1))]
    if n > p + 1:
        rng = np.random.default_rng(n)
        tried = []
        for _ in range(RANDOM_STARTS):
            half = rng.choice(n, p + 1, replace=False)
            for _ in range(2):
                half = nearest(*estimate(half)[1:])
            tried.append((estimate(half)[0], len(tried), half))
        starts += [half for _, _, half in sorted(tried, key=lambda t: t[:2])[:BEST_STARTS]]
    best = None
    for half in starts:
        found = estimate(half)
        for _ in range(20):
            after = estimate(nearest(*found[1:]))
            if after[0] >= found[0] - 1e-9:
                break
            found = after
        if best is None or found[0] < best[0]:
            best = found
    return best[1], best[2]


def chi2_quantile(p: int, tail: float) -> float:
    """x with P(chi-squared of p degrees > x) = tail, by bisection on the series of
    the regularised lower gamma function."""

    def above(x: float) -> float:
        term = total = 1.0 / (p / 2)
        k = p / 2
        while term > total * 1e-17:
            k += 1
            term *= x / 2 / k
            total += term
        return 1 - total * math.exp(-x / 2 + p / 2 * math.log(x / 2) - math.lgamma(p / 2))

    low, high = 1e-9, 60.0 + 4 * p
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > tail else (low, mid)
    return low


def _matrix(rows: list[list[Column]]) -> Column:
    return F.array(*[F.array(*r) for r in rows])


def _distance(mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance of a row's statistics."""
    d = [F.col(s) - F.col(mean)[i] for i, s in enumerate(STATS)]
    return sum((d[i] * d[j] * F.col(inverse)[i][j] for i in range(len(STATS)) for j in range(len(STATS))), F.lit(0.0))


def _inverted(estimates: DataFrame) -> DataFrame:
    """Adds the inverse of cov; a row for each group, however many there are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["inverse"] = [np.linalg.inv(np.array([list(r) for r in c])).tolist() for c in f["cov"]]
            f["mean"] = [list(m) for m in f["mean"]]
            f["cov"] = [[list(r) for r in c] for c in f["cov"]]
            yield f[["grp", "mean", "cov", "inverse"]]

    matrix = "array<array<double>>"
    return estimates.select("grp", "mean", "cov").mapInPandas(run, f"grp string, mean array<double>, cov {matrix}, inverse {matrix}")


def _joined(rows: DataFrame, estimates: DataFrame, few: bool, *names: str) -> DataFrame:
    own = estimates.select("grp", *names)
    return rows.join(F.broadcast(own) if few else own, "grp")


def _of_blocks(rows: DataFrame) -> DataFrame:
    """(grp, n, mean, cov): averages of the blocks' MCD estimates for each group."""
    p = len(STATS)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        mean, cov = mcd(f[list(STATS)].to_numpy(float))
        return pd.DataFrame([{"grp": f["grp"].iloc[0], "rows": len(f), "mean": mean.tolist(), "cov": cov.ravel().tolist()}])

    blocks = rows.groupBy("grp", "block").applyInPandas(one, "grp string, rows long, mean array<double>, cov array<double>")
    weighted = lambda c: F.sum(F.col("rows") * c) / F.sum("rows")
    return blocks.groupBy("grp").agg(
        F.sum("rows").alias("n"),
        F.array(*[weighted(F.col("mean")[i]) for i in range(p)]).alias("mean"),
        _matrix([[weighted(F.col("cov")[i * p + j]) for j in range(p)] for i in range(p)]).alias("cov"),
    )


def _concentrated(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """One concentration step over all rows of all groups."""
    d = _joined(rows, estimates, few, "mean", "inverse").withColumn("d2", _distance("mean", "inverse")).select("grp", *STATS, "d2")
    half = d.groupBy("grp").agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("cut"))
    inner = _joined(d, half, few, "cut").filter("d2 <= cut")
    mean = {s: F.avg(s) for s in STATS}
    cov = _matrix([[F.covar_pop(a, b) + (FLOOR[i] ** 2 if a == b else 0.0) for b in STATS] for i, a in enumerate(STATS)])
    return inner.groupBy("grp").agg(F.array(*mean.values()).alias("mean"), cov.alias("cov"))


def _mixed(own: DataFrame, wider: DataFrame) -> DataFrame:
    """Estimates (grp, wide, n, mean, cov) with those of the wider groups (grp, mean, cov)
    mixed in as PRIOR rows."""
    p = len(STATS)
    both = own.join(wider.select(F.col("grp").alias("wide"), F.col("mean").alias("mean_"), F.col("cov").alias("cov_")), "wide")
    of = lambda a, b: (F.col("n") * a + PRIOR * b) / (F.col("n") + PRIOR)
    mean = F.array(*[of(F.col("mean")[i], F.col("mean_")[i]) for i in range(p)])
    cov = _matrix([[of(F.col("cov")[i][j], F.col("cov_")[i][j]) for j in range(p)] for i in range(p)])
    return both.select("grp", "n", mean.alias("mean"), cov.alias("cov"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), tail: float = TAIL) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the
    statistics, base_failed, distance2, kept) for every row.

    Null texts have no words and fail the base rules. Null languages and sources are
    groups of their own. Rows that fail the base rules have a part in the estimates, as
    any outlier. Repeated rows and null ids give a row each; columns other than those
    named are not read."""
    keys = [f"group_{k}" for k in range(len(group_cols))]
    rows = measured(docs, id_col, text_col, group_cols)
    named = [F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("null")) for k in keys]
    # a group, its wider one and the one of all rows; rows without an id spread over the blocks too
    rows = rows.withColumn("grp", F.concat_ws("\x1f", *named)).withColumn("wide", F.concat_ws("\x1f", named[0], F.lit("*")))
    spread = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    rows = written(rows.withColumn("spread", spread).drop(*keys))
    sizes = written(rows.groupBy("grp", "wide").agg(F.count("*").alias("n")))
    few = sizes.count() <= FEW_GROUPS

    def dealt(level: Column, total: DataFrame) -> DataFrame:
        """Rows of one level's groups with their blocks."""
        own = _joined(rows.select(level.alias("grp"), "spread", *STATS), total, few, "n")
        return own.withColumn("block", F.pmod("spread", F.ceil(F.col("n") / BLOCK))).drop("n", "spread")

    levels = (F.col("grp"), F.col("wide"), F.lit("*"))
    totals = (sizes, sizes.groupBy(F.col("wide").alias("grp")).agg(F.sum("n").alias("n")), sizes.groupBy(F.lit("*").alias("grp")).agg(F.sum("n").alias("n")))
    # of all levels in one pass; names of levels differ
    estimates = written(_of_blocks(reduce(DataFrame.unionByName, map(dealt, levels, totals))))
    own = _inverted(estimates.join(sizes.select("grp"), "grp", "left_semi"))
    stats = rows.select("grp", *STATS)
    for _ in range(STEPS):
        own = written(_inverted(_concentrated(stats, own, few)))
    wide = estimates.join(sizes.select(F.col("wide").alias("grp")), "grp", "left_semi").withColumn("wide", F.lit("*"))
    wide = _mixed(wide, estimates.filter("grp = '*'"))
    final = written(_inverted(_mixed(own.join(sizes, "grp"), wide)))
    # consistency: the median distance is at most that of the normal model (floors make it less)
    p = len(STATS)
    d = _joined(rows, final, few, "mean", "inverse").withColumn("d2", _distance("mean", "inverse")).drop("mean", "inverse")
    scale = d.groupBy("grp").agg(F.count("*").alias("n"), (F.percentile_approx("d2", 0.5, ACCURACY) / chi2_quantile(p, 0.5)).alias("scale"))
    scale = scale.withColumn("scale", (F.col("n") * F.greatest(F.col("scale"), F.lit(1.0)) + PRIOR) / (F.col("n") + PRIOR))
    d = _joined(d, scale, few, "scale")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    distance2 = F.col("d2") / F.col("scale")
    kept = ~failed & (distance2 <= chi2_quantile(p, tail))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.select("doc_id", *counts, *STATS, failed.alias("base_failed"), distance2.alias("distance2"), kept.alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
