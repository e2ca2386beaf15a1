"""Exact token counts at every prefix, for byte-level BPE tokenizer files.

A text is cut into pre-tokens; within one, a dynamic program over its bytes keeps
for each prefix the last token of that prefix's encoding and the number of tokens.
Prefix i ends in the one vocabulary token t for which (last token before t, t) is a
pair that the merges leave alone, so count[i] = count[i - len(t)] + 1. Pre-tokens
repeat, so their tables are kept (a bounded cache); a text's table is their running
sum. Truncation and budget questions are then look-ups, without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm.common import over_texts, table

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose tables a worker keeps, and their bytes.
CACHE, CACHED_BYTES = 400_000, 8 << 20
#: Runs of white space whose bytes and tokens it keeps.
RUNS = 10_000
LIMIT = 512


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such files: bytes that
    print stand for themselves, the others for letters from 256 upwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables under one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        #: every ending of a token: the token's id where the ending is one itself, else -1
        self.endings = dict.fromkeys((t[k:] for t in self.ids for k in range(1, len(t))), -1) | self.ids
        # order[t]: when t comes to be; single bytes are there from the start
        self.order, self.parts, self.joined = {}, {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (self.ids[bytes(letters[c] for c in x)] for x in (a, b))
            made = self.ids[bytes(letters[c] for c in "".join(merge if isinstance(merge, list) else merge.split(" ")))]
            self.joined[a, b] = rank
            if made not in self.order:
                self.order[made], self.parts[made] = rank, (a, b)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.spaces = regex.compile(r"\s{2,}(?=\S)")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.run_tokens: dict[str, tuple[int, int]] = {}

    def stays(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b, side by side, as they are.

        Undo merges on either side of the border from the latest back; a and b stay
        if no merge across the border was due before the one being undone."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self._stays(a, b)
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
        return known

    def _stays(self, a: int, b: int) -> bool:
        due = float("inf")  # merges from here on come too late; on equal rank the left one is first
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < due:
                return False
            left, right = self.order.get(a, -1), self.order.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                due, a = left, self.parts[a][1]
            else:
                due, b = right + 0.5, self.parts[b][0]

    def counts(self, word: bytes) -> np.ndarray:
        """Tokens of word[:1], word[:2], ... as one pre-token each."""
        n, endings, stays = len(word), self.endings.get, self.stays
        last, count = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs.get
        for i in range(1, n + 1):
            start = i
            while start:  # only one token can be the last one, so any order will do
                start -= 1
                token = endings(word[start:i])
                if token is None:
                    raise ValueError("the vocabulary lacks single bytes")
                if token >= 0:
                    ok = not start or pairs((last[start], token))
                    if ok is None:
                        ok = stays(last[start], token)
                    if ok:
                        last[i], count[i] = token, count[start] + 1
                        break
        return np.array(count[1:], dtype=np.int32)

    def _known(self, word: str) -> int:
        """Where the word's table is in the store, which is emptied when it is full."""
        raw = word.encode()
        found = self.counts(raw)
        if word in ("'re", "'ve", "'ll"):
            found[1] = 2  # cut short it isn't that contraction: a mark, then a letter
        at = self.used
        if at + len(raw) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(raw)), np.int32)])
        self.flat[at : at + len(raw)] = found
        self.used = at + len(raw)
        self.index[word] = (at << 32) + len(raw)
        return self.index[word]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Tables of texts without special tokens."""
        if len(self.index) > CACHE or self.used > CACHED_BYTES:
            self.index, self.used = {}, 0
        found = [self.pattern.findall(t) for t in texts]
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        words = [w for f in found for w in f]
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        known = self.index.get
        at = [known(w) for w in words]
        if None in at:
            at = [known(w) or self._known(w) for w in words]
        at = np.array(at, np.int64)
        start, size = at >> 32, at & 0xFFFFFFFF
        ends = np.cumsum(size)
        own = self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        last = own[ends - 1]
        before = np.cumsum(last) - last
        text_start = np.cumsum(per_text) - per_text
        base = np.where(per_text > 0, before[np.minimum(text_start, len(words) - 1)], 0)
        own += np.repeat((before - np.repeat(base, per_text)).astype(np.int32), size)
        text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
        tables = np.split(own, text_ends[:-1])
        for text, table in zip(texts, tables, strict=True):  # cut inside a run of white space, the run so far is one pre-token
            seen = at = 0  # characters and bytes before
            for run in self.spaces.finditer(text):
                at += len(text[seen : run.start()].encode())
                whole = self.run_tokens.get(run[0])
                if whole is None:
                    own = self.counts(run[0].encode())
                    whole = len(own), int(own[-1])
                    if len(self.run_tokens) < RUNS and whole[0] < 1 << 10:
                        self.run_tokens[run[0]] = whole
                table[at + whole[0] - 1] = whole[1] + (table[at - 1] if at else 0)
                seen, at = run.end(), at + whole[0]
        return tables

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """For each text counts[k]: tokens of its first k + 1 bytes, exact wherever a
        character ends (inside one, the bytes of its pre-token so far count)."""
        special = [bool(self.cut and self.cut.search(t)) for t in texts]
        plain = iter(self._plain([t for t, s in zip(texts, special, strict=True) if not s]))
        return [self._with_special(t) if s else next(plain) for t, s in zip(texts, special, strict=True)]

    def _with_special(self, text: str) -> np.ndarray:
        out, start, total = [], 0, 0
        for found in [*self.cut.finditer(text), None]:
            piece = text[start : found.start() if found else len(text)]
            (plain,) = self._plain([piece])
            if not found:
                out.append(plain + total)
                break
            # a prefix that ends inside the special string is ordinary text
            (longer,) = self._plain([piece + found[0][:-1]])
            longer[: len(plain)] = plain
            out += [longer + total, [total + (plain[-1] if len(plain) else 0) + 1]]
            total, start = int(out[-1][0]), found.end()
        return np.concatenate(out).astype(np.int32)


@lru_cache(2)
def _counter(spec: str) -> PrefixCounter:
    return PrefixCounter(spec)


def _tables(docs: DataFrame, tokenizer: str) -> Callable[[list[bytes | None]], list[np.ndarray]]:
    """The prefix tables of texts, for tasks. The driver reads the file; it is broadcast
    (a vocabulary of fixed size)."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    return lambda texts: _counter(spec.value).prefixes([t.decode() if t else "" for t in texts])


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, counts): counts[k] is the number of tokens of the first k + 1
    bytes. A null text counts as empty: n_bytes 0 and an empty array. One row out per
    row in, repeated and null ids too; other columns are ignored. tokenizer: path of a
    byte-level BPE file. For totals and budgets use budgets(), which keeps the tables in
    the tasks."""
    made = _tables(docs, tokenizer)

    def work(texts):
        tables = made(texts)
        ends = np.cumsum([0, *map(len, tables)])
        if ends[-1] >= 2**31:
            raise ValueError("a text of 2 GB or more")
        values = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        return {
            "n_bytes": pa.array([len(t) if t else 0 for t in texts], pa.int64()),
            "counts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())),
        }

    return over_texts(docs, work, "n_bytes long, counts array<int>", id_col, text_col)


def budgets(docs: DataFrame, tokenizer: str, limits: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fitting): fitting has, for each limit, the bytes of the
    longest prefix below which every prefix has at most so many tokens. Rows as in
    prefix_counts()."""
    made = _tables(docs, tokenizer)

    def work(texts):
        tables = made(texts)
        # the first prefix over a limit; running maxima are sorted
        most = [np.maximum.accumulate(t) if limits else t for t in tables]
        return {
            "n_bytes": pa.array([len(t) if t else 0 for t in texts], pa.int64()),
            "n_tokens": pa.array([int(t[-1]) if len(t) else 0 for t in tables], pa.int64()),
            "fitting": pa.array([[int(np.searchsorted(m, n, side="right")) for n in limits] for m in most], pa.list_(pa.int64())),
        }

    return over_texts(docs, work, "n_bytes long, n_tokens long, fitting array<long>", id_col, text_col)


def total(counts: str = "counts"):
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("long")


def fitting_bytes(limit: int, counts: str = "counts"):
    """Bytes of the longest prefix below which every prefix has at most limit tokens
    (a truncation point; round it down to where a character ends)."""
    over = F.array_position(F.transform(counts, lambda c: c > limit), True)
    return F.when(over > 0, over - 1).otherwise(F.size(counts)).cast("long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = budgets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
