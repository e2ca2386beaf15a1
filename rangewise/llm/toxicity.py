"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Every text is cut into overlapping windows of words that cover it whole. A word
enters as the sum of a word embedding and the embeddings of its character n-grams; two
gated recurrent layers read the window from either end, attention pools their states,
and a logistic unit scores the window. A document's score is its highest window's,
calibrated. The network is trained here, in numpy, on a bounded labelled sample.

Words and n-grams that come with label 1 far more often than chance would have it (a
Chernoff bound, corrected for the number of candidates) start with an embedding that
says so; common ones start near zero; all are learned further.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import learned, over_texts, slices, small_batches, table
from rangewise.llm.language_id import held_out

WINDOW, STRIDE = 64, 48
EMBED, HIDDEN = 10, 8
#: Bounds of the training sample: documents of label 1 and 0, bytes of each (of a longer
#: text, windows spread over it).
POSITIVE, NEGATIVE, TRAIN_BYTES = 1500, 2500, 16_000
#: Common words and n-grams, and telling ones, that get an embedding of their own.
COMMON, TELLING = 512, 4096
GRAMS = (4, 5)
#: How much rarer than one false find among all candidates a telling feature is (log).
MARGIN = 2.0
#: Power of the labels' ratio that weighs documents in the calibration (in training: 1/2).
CALIBRATED = 0.125
#: Further windows of a document of label 0.
MORE = 3
#: Log odds from which one word is enough.
STRONG = 4.0
#: Pull to zero of the embeddings, and of the other weights.
DECAY_EMBED, DECAY = 1e-3, 1e-4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 11
THRESHOLD = 0.7
CACHE = 300_000
_WORD = re.compile(r"[^\W_]+")


def words_of(raw: bytes | None) -> list[str]:
    return _WORD.findall(raw.decode().lower()) if raw else []


def grams_of(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)}


def window_starts(n_words: int) -> range:
    """Starts of windows that cover all words, each overlapping the next."""
    return range(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """vocabulary: row of emb for 'w' + word and 'c' + n-gram."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def rows(self, word: str) -> list[int]:
        get = self.vocabulary.get
        found = [get("w" + word), *(get("c" + g) for g in grams_of(word))]
        return [r for r in found if r is not None]

    def states(self, gx: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Gated recurrent layer over (windows, steps, 3 x HIDDEN) inputs."""
        n, steps, _ = gx.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            x, g = gx[:, t], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, c, g[:, 2 * HIDDEN :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def logits(self, gx: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """gx: (windows, steps, 6 x HIDDEN) projected inputs, forward then backward."""
        fw = self.states(gx[:, :, : 3 * HIDDEN], self.p["uf"])
        bw = self.states(gx[:, ::-1, 3 * HIDDEN :], self.p["ub"])[::-1]
        return pool(np.concatenate([fw, bw], axis=2), sizes, self.p)[0]

    def project(self, rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), EMBED), np.float32)
        flat = [r for own in rows for r in own]
        if flat:
            at = np.repeat(np.arange(len(rows)), [len(own) for own in rows])
            np.add.at(x, at, self.p["emb"][flat])
        return np.tanh(x) @ self.p["wx"] + self.p["bx"]

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logit + self.shift)


def pool(h: np.ndarray, sizes: np.ndarray, p: dict) -> tuple:
    """Attention over the steps inside each window; h: (steps, windows, 2 x HIDDEN)."""
    a = h @ p["att"]
    a = np.where(np.arange(len(h))[:, None] < np.maximum(sizes, 1)[None], a, -np.inf)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", a, h)
    return pooled @ p["out"] + p["bias"][0], a, pooled


class Scorer:
    """A model with its words' projected inputs, kept as they come (bounded)."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.inputs = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.empty = model.project([[]])[0]

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE:
            self.index = {}
        get = self.index.get
        ids = [get(w) for w in words]
        if None in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i is None))
            at = len(self.index)
            while at + len(new) > len(self.inputs):
                self.inputs = np.concatenate([self.inputs, np.zeros_like(self.inputs)])
            self.inputs[at : at + len(new)] = self.model.project([self.model.rows(w) for w in new])
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            ids = [get(w) for w in words]
        return np.array(ids, np.int64)

    def logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest window logit, and that window's first word."""
        starts = [list(window_starts(len(w))) for w in texts]
        ids = self._ids([w for own in texts for w in own])
        base = np.cumsum([0, *map(len, texts)])
        first = np.array([base[d] + s for d, own in enumerate(starts) for s in own])
        sizes = np.array([min(WINDOW, len(texts[d]) - s) for d, own in enumerate(starts) for s in own])
        out = np.empty(len(first), np.float32)
        for k in range(0, len(first), 512):
            at = first[k : k + 512, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < sizes[k : k + 512, None]
            gx = self.inputs[ids[np.minimum(at, max(0, len(ids) - 1))]] if len(ids) else np.zeros((*at.shape, 6 * HIDDEN), np.float32)
            gx[~inside] = self.empty
            out[k : k + 512] = self.model.logits(gx, sizes[k : k + 512])
        ends = np.cumsum(list(map(len, starts)))
        best = [int(e - len(s) + out[e - len(s) : e].argmax()) for s, e in zip(starts, ends, strict=True)]
        return out[best], np.array([first[b] - base[d] for d, b in enumerate(best)])


def _telling(texts: list[list[str]], y: np.ndarray) -> tuple[dict[str, float], Counter]:
    """Log odds of the features that label 1 explains, and how many documents have each."""
    ones, zeros, grams = Counter(), Counter(), {}
    for own, label in zip(texts, y, strict=True):
        seen = set()
        for w in set(own):
            if w not in grams:
                grams[w] = ["w" + w, *("c" + g for g in grams_of(w))]
            seen.update(grams[w])
        (ones if label else zeros).update(seen)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    every = ones + zeros
    limit = np.log(max(2, sum(n >= 4 for n in every.values()))) + MARGIN
    found = {}
    for f, c in ones.items():
        expected = every[f] * n1 / (n1 + n0)
        if c >= 4 and c > expected and c * np.log(c / expected) + (zeros[f] * np.log(zeros[f] / (every[f] - expected)) if zeros[f] else 0) > limit:
            found[f] = float(np.log((c + 0.5) / (n1 + 1)) - np.log((zeros[f] + 0.5) / (n0 + 1)))
    return dict(sorted(found.items(), key=lambda x: (-x[1] * ones[x[0]], x[0]))[:TELLING]), every


def fit(texts: list[list[str]], labels: list[int]) -> Model:
    """Adam on windows: of a document of label 1 the one with the most telling
    features, and the same one with its most telling word only, where that tells as much
    that it is enough; of the others the one with the most and MORE others. Then a logistic
    calibration of the documents' highest logits. The rarer label weighs more, by powers
    of the ratio."""
    y = np.array(labels)
    rng = np.random.default_rng(SEED)
    telling, every = _telling(texts, y)
    common = [f for f, _ in sorted(((f, n) for f, n in every.items() if f not in telling), key=lambda x: (-x[1], x[0]))]
    common = [f for f in common if f[0] == "w"][:COMMON] + [f for f in common if f[0] == "c"][: COMMON // 2]
    vocabulary = {f: k for k, f in enumerate([*telling, *common])}
    p = {
        "emb": rng.normal(0, 0.05, (max(1, len(vocabulary)), EMBED)),
        "wx": rng.normal(0, EMBED**-0.5, (EMBED, 6 * HIDDEN)), "bx": np.zeros(6 * HIDDEN),
        "uf": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), "ub": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
        "att": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1),
    }
    for k, odds in enumerate(telling.values()):
        p["emb"][k, 0] += min(odds, 8) / 8
    model = Model(vocabulary, {k: v.astype(np.float32) for k, v in p.items()})
    p = model.p
    odds = np.array([*telling.values(), 0.0])
    rows: dict[str, list[int]] = {}
    tells: dict[str, float] = {}
    picked, targets = [], []
    for own, label in zip(texts, y, strict=True):
        for w in own:
            if w not in rows:
                rows[w] = model.rows(w)
                tells[w] = float(max(odds[[r for r in rows[w] if r < len(telling)]], default=0.0))
        hits = np.cumsum([0, *(sum(r < len(telling) for r in rows[w]) for w in own)])
        starts = list(window_starts(len(own)))
        most = max(starts, key=lambda s: (hits[min(s + WINDOW, len(own))] - hits[s], -s))
        for s in {most} if label else {most, *(starts[int(k)] for k in rng.integers(len(starts), size=MORE))}:
            picked.append(own[s : s + WINDOW])
            targets.append(label)
        if label:
            window = own[most : most + WINDOW]
            best = max(range(len(window)), key=lambda k: (tells[window[k]], -k), default=-1)
            if best >= 0 and tells[window[best]] >= STRONG:
                picked.append([w for k, w in enumerate(window) if k == best or not tells[w]])
                targets.append(label)
    t = np.array(targets)
    weight = ((len(t) / (2 * np.maximum(1, np.bincount(t, minlength=2)))) ** 0.5)[t].astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(picked))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            g = _gradient(model, [[rows[w] for w in picked[k]] for k in pick], t[pick], weight[pick] / len(pick))
            step += 1
            for key, grad in g.items():
                grad = grad + (DECAY_EMBED if key == "emb" else DECAY) * p[key]
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad * grad
                p[key] -= RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    scorer = Scorer(model)
    logit = np.concatenate([scorer.logits(texts[k : k + 256])[0] for k in range(0, len(texts), 256)]).astype(float)
    both = ((len(y) / (2 * np.bincount(y, minlength=2))) ** CALIBRATED)[y]
    a, b = 1.0, 0.0
    for _ in range(50):  # damped Newton steps, with a weak pull to slope 1 and shift 0
        q = _sigmoid(a * logit + b)
        e, s = both * (q - y), both * q * (1 - q)
        grad = np.array([e @ logit + (a - 1), e.sum() + b])
        hess = np.array([[s @ (logit * logit) + 1, s @ logit], [s @ logit, s.sum() + 1]])
        a, b = np.array([a, b]) - 0.5 * np.linalg.solve(hess, grad)
    model.slope, model.shift = float(a), float(b)
    return model


def _gradient(model: Model, batch: list[list[list[int]]], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    p, n = model.p, len(batch)
    sizes = np.array(list(map(len, batch)))
    x = np.zeros((n, WINDOW, EMBED), np.float32)
    where = [(i, j, r) for i, own in enumerate(batch) for j, rows in enumerate(own) for r in rows]
    i, j, r = np.array(where, np.int64).reshape(-1, 3).T
    np.add.at(x, (i, j), p["emb"][r])
    e = np.tanh(x)
    gx = e @ p["wx"] + p["bx"]
    kept: dict[str, list] = {"uf": [], "ub": []}
    fw = model.states(gx[:, :, : 3 * HIDDEN], p["uf"], kept["uf"])
    bw = model.states(gx[:, ::-1, 3 * HIDDEN :], p["ub"], kept["ub"])[::-1]
    h = np.concatenate([fw, bw], axis=2)
    logit, a, pooled = pool(h, sizes, p)
    d = ((_sigmoid(logit) - y) * weight).astype(np.float32)
    g = {"out": d @ pooled, "bias": np.array([d.sum()])}
    dpool = d[:, None] * p["out"]
    da = np.einsum("tnd,nd->tn", h, dpool)
    ds = a * (da - (a * da).sum(axis=0))
    g["att"] = np.einsum("tn,tnd->d", ds, h)
    dh = a[:, :, None] * dpool[None] + ds[:, :, None] * p["att"]
    dgx = np.zeros_like(gx)
    for key, own, cut in (("uf", dh[:, :, :HIDDEN], slice(0, 3 * HIDDEN)), ("ub", dh[::-1, :, HIDDEN:], slice(3 * HIDDEN, None))):
        du, carry, u = np.zeros_like(p[key]), np.zeros((n, HIDDEN), np.float32), p[key]
        for t in range(WINDOW - 1, -1, -1):
            before, z, r_, c, gc = kept[key][t]
            carry = carry + own[t]
            dc = carry * (1 - z) * (1 - c * c)
            dz = carry * (before - c) * z * (1 - z)
            dr = dc * gc * r_ * (1 - r_)
            dg = np.concatenate([dz, dr, dc * r_], axis=1)
            du += before.T @ dg
            step = t if key == "uf" else WINDOW - 1 - t
            dgx[:, step, cut] = np.concatenate([dz, dr, dc], axis=1)
            carry = carry * z + dg @ u.T
        g[key] = du
    flat = dgx.reshape(-1, 6 * HIDDEN)
    g["wx"], g["bx"] = e.reshape(-1, EMBED).T @ flat, flat.sum(0)
    dx = (dgx @ p["wx"].T) * (1 - e * e)
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], r, dx[i, j])
    return g


def _drawn(raw: bytes) -> list[str]:
    """The words of a text for training; of a text over TRAIN_BYTES those of windows
    spread evenly over all of it."""
    own = words_of(raw)
    if len(raw) <= TRAIN_BYTES or len(own) <= WINDOW:
        return own
    starts = range(0, len(own) - WINDOW + 1, WINDOW)
    some = max(1, min(len(starts), TRAIN_BYTES * len(own) // (WINDOW * len(raw))))
    return [w for k in np.linspace(0, len(starts) - 1, some).astype(int) for w in own[starts[k] : starts[k] + WINDOW]]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit, in one task, on about POSITIVE and NEGATIVE labelled rows that are not held
    out, chosen by a hash of the id, with about TRAIN_BYTES of each. A document with
    several labels has the largest; repeated rows count once. None where either label
    is missing."""
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    own = own.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rank = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = own.filter(rank < F.when(F.col("y") == 1, min(1.0, POSITIVE / sizes[1])).otherwise(min(1.0, NEGATIVE / sizes[0])))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").distinct()  # the sample's size is bounded above

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            cut = pa.array([" ".join(_drawn(t)) for t in part.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), cut, part.column(2)], names=["doc_id", "text", "y"])

    def one(sample: pa.Table) -> Model | None:
        rows = sorted(zip(*(sample[c].to_pylist() for c in ("doc_id", "text", "y")), strict=True))
        y = [label for _, _, label in rows]
        return fit([t.split() for _, t, _ in rows], y) if len(set(y)) == 2 else None

    small_batches(docs.sparkSession)
    return learned(found.mapInArrow(drawn, "doc_id string, text string, y int"), one)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, worst_word) for every row, in one narrow pass over whole texts.

    worst_word is the first word of the window that scored highest. Null and empty
    texts score as one window without words; without a model every score is 0. One row
    out per row in, repeated and null ids too; other columns are not read."""
    scorer: list[Scorer] = []

    def work(texts):
        own = [words_of(t) for t in texts]
        if model is None:
            scores, worst = np.zeros(len(own)), np.zeros(len(own), np.int64)
        else:
            scorer or scorer.append(Scorer(model))
            logit, worst = scorer[0].logits(own)
            scores = model.calibrated(logit.astype(float))
        return {"score": pa.array(scores, pa.float64()), "worst_word": pa.array(worst, pa.int64())}

    return over_texts(docs, work, "score double, worst_word long", id_col, text_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
