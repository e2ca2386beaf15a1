"""Language identification with a byte convolutional network.

Fixed-length windows tile the UTF-8 bytes of the whole text. Filters of several
widths slide over embedded bytes, each filter's largest response in the window is
kept (max pooling), and a softmax over the learned languages follows. The network is
trained here, in numpy, on windows of a bounded sample of labelled documents. For
scoring, embedding and filters are multiplied out to one table of byte responses per
filter position, so that a window costs table look-ups only. A document's
probabilities are the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import learned, over_texts, slices, small_batches, table, written

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4, 5), 12, 6
#: Bounds of the training sample: documents over all languages, of each language at
#: least (every language is learned), and windows of each document.
TRAIN_DOCS, LEAST_DOCS, TRAIN_WINDOWS = 3000, 10, 4
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
UND = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows(raw: bytes) -> np.ndarray:
    """The bytes of a text as rows of WINDOW; the last one is filled up with zeros."""
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(rows, WINDOW)


def has_letter(raw: bytes | None) -> bool:
    return bool(raw) and (bool(_ASCII_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode()))


@dataclass(frozen=True)
class Network:
    """tables[w][j]: responses of the filters of width w to each byte at place j."""

    labels: tuple[str, ...]
    tables: tuple[tuple[np.ndarray, ...], ...]
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(rows), 256):
            block = rows[at : at + 256]
            pooled = []
            for places, bias in zip(self.tables, self.biases, strict=True):
                width = len(places)
                total = places[0][block[:, : WINDOW - width + 1]]
                for j in range(1, width):
                    total += places[j][block[:, j : WINDOW - width + 1 + j]]
                pooled.append(np.maximum(total.max(axis=1) + bias, 0))
            logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            exp = np.exp(logits)
            parts.append(exp / exp.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def fit(rows: np.ndarray, labels: list[str]) -> Network:
    """A network with embedding and filters multiplied out to tables."""
    p = weights(rows, labels)
    places = tuple(tuple(np.ascontiguousarray(p["embed"] @ p[f"f{w}"][j * EMBED : (j + 1) * EMBED]) for j in range(w)) for w in WIDTHS)
    return Network(tuple(sorted(set(labels))), places, tuple(p[f"b{w}"] for w in WIDTHS), p["out"], p["bias"])


def weights(rows: np.ndarray, labels: list[str]) -> dict[str, np.ndarray]:
    """Adam on the cross entropy, classes weighted to count alike; gradients reach a
    filter through the patch that its maximum came from."""
    names = tuple(sorted(set(labels)))
    at = {x: k for k, x in enumerate(names)}
    y = np.array([at[x] for x in labels])
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y].astype(np.float32)
    rng = np.random.default_rng(SEED)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["out"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names)))
    p["bias"] = np.zeros(len(names))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, n = rows[pick], len(pick)
            e = p["embed"][x]
            pooled, patches = [], []
            for w in WIDTHS:
                view = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                response = view @ p[f"f{w}"]
                best = response.argmax(axis=1)
                patches.append((best, view[np.arange(n)[:, None], best]))
                pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0] + p[f"b{w}"])
            raw = np.concatenate(pooled, axis=1)
            h = np.maximum(raw, 0)
            logits = h @ p["out"] + p["bias"]
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(n), y[pick]] -= 1
            d = prob * (weight[pick] / n)[:, None]
            g = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            dh = (d @ p["out"].T) * (raw > 0)
            for k, w in enumerate(WIDTHS):
                best, patch = patches[k]
                own = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"f{w}"] = np.einsum("nfp,nf->pf", patch, own)
                g[f"b{w}"] = own.sum(0)
                back = (own[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
                at_bytes = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
                np.add.at(g["embed"], at_bytes.ravel(), back.reshape(-1, EMBED))
            step += 1
            for key, grad in g.items():
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad * grad
                p[key] -= RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return p


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(bytes, lang): windows of about TRAIN_DOCS documents, as many of each language as
    there are, and of more where languages are so many that one would have fewer than
    LEAST_DOCS. Documents are chosen by a hash and repeated rows count once; each gives
    up to TRAIN_WINDOWS."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = written(own.groupBy("lang").agg(F.count("*").alias("n")))  # of a known size, so that texts don't move
    share = max(LEAST_DOCS, TRAIN_DOCS / max(1, sizes.count()))
    rank = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    chosen = own.join(sizes, "lang").filter(rank < share / F.col("n")).select("doc_id", F.col("text").cast("binary").alias("text"), "lang").distinct()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, langs = [], []
            for raw, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if has_letter(raw):
                    own = windows(raw)
                    for k in np.linspace(0, len(own) - 1, min(TRAIN_WINDOWS, len(own))).astype(int):
                        rows.append(own[k].tobytes())
                        langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(langs, pa.string())], names=["bytes", "lang"])

    small_batches(docs.sparkSession)
    return chosen.mapInArrow(cut_up, "bytes binary, lang string")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit, in one task, on the rows that are not held out and have text and lang; None
    where no such row has a letter."""

    def one(sample: pa.Table) -> Network:
        found = sorted(zip(sample["lang"].to_pylist(), sample["bytes"].to_pylist(), strict=True))
        rows = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, WINDOW)
        return fit(rows, [lang for lang, _ in found])

    return learned(_sample(docs, id_col, text_col, lang_col), one)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) for every row, in one narrow pass over whole texts.

    und with score 0 for null texts and texts without a letter, and for all where
    there was nothing to learn from. Ties go to the first label. Repeated rows and null
    ids give a row each; columns other than id, text and `keep` are not read."""

    def work(texts):
        seen = [network is not None and has_letter(t) for t in texts]
        rows = [windows(t) for t, s in zip(texts, seen, strict=True) if s]
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if rows:
            prob = network.probabilities(np.concatenate(rows))
            fill = np.concatenate([np.r_[np.full(len(r) - 1, WINDOW), np.count_nonzero(r[-1])] for r in rows])
            starts = np.cumsum([0, *(len(r) for r in rows)])[:-1]
            mean = np.add.reduceat(prob * fill[:, None], starts) / np.add.reduceat(fill, starts)[:, None]
            for k, p in zip(np.flatnonzero(seen), mean, strict=True):
                names[k], scores[k] = network.labels[int(p.argmax())], min(1.0, float(p.max()))
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return over_texts(docs, work, "lang_pred string, score double", id_col, text_col, keep)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
