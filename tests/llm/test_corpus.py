"""Operators that look at documents together, and learned ones."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rangewise.llm import components, language_id, mixing, near_copies, simhash, substring_dedup, toxicity
from rangewise.llm.common import written
from tests.llm import odd

WORDS = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def _shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def _prints(raw, n=3):
    words = (raw or "").lower().encode().split()
    own = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprints_against_brute_force():
    rng = random.Random(1)
    texts = [text(rng, rng.randrange(40)) for _ in range(40)] + ["", "a", "A b", "a B c"]
    assert simhash.fingerprints_of([t.encode() for t in texts] + [None]).tolist() == [_prints(t) for t in texts] + [0]


def test_tree_finds_every_close_pair():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = points[:800].copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    points = np.unique(np.concatenate([points, near]))
    expected = {(i, i + 1 + int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2)}
    got = {(min(i, j), max(i, j)) for a, b in simhash.close_pairs(points) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == expected
    tree = simhash.Tree(points[::3], 3.0, shard=300)
    shard, place = tree.deal(points)
    assert tree.shards > 4 and set(place.tolist()) == set(range(len(points)))
    members = [set(place[shard == s].tolist()) for s in range(tree.shards)]
    assert all(any(i in m and j in m for m in members) for i, j in expected)
    assert simhash.forest(points).tolist() == _roots(len(points), expected)


def test_a_dense_ball_is_whole():
    ball = np.unique(np.array([1 << a ^ 1 << b ^ 1 << c for a in range(0, 64, 3) for b in range(64) for c in (1, 9)], np.uint64))
    expected = sum(int((np.bitwise_count(ball[i + 1 :] ^ ball[i]) <= 2).sum()) for i in range(len(ball)))
    assert len({(i, j) for a, b in simhash.close_pairs(ball) for i, j in zip(a.tolist(), b.tolist(), strict=True)}) == expected


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    nodes = sorted({x for p in pairs for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    expected = {nodes[k]: nodes[r] for k, r in enumerate(_roots(len(nodes), [(at[a], at[b]) for a, b in pairs])) if k != r}
    own = spark.createDataFrame(pairs, "a long, b long")
    assert {r.vertex: r.root for r in components.components(own).collect()} == expected
    assert components.components(own.limit(0)).isEmpty()


def test_near_duplicates_of_odd_documents(spark):
    found = simhash.near_duplicates(odd.docs(spark)).collect()
    prints = [(r[0], _prints(r[1])) for r in odd.rows()]
    distinct = sorted({p for _, p in prints})
    pairs = [(i, j) for i in range(len(distinct)) for j in range(i) if (distinct[i] ^ distinct[j]).bit_count() <= 2]
    root = dict(zip(distinct, _roots(len(distinct), pairs), strict=True))
    smallest = {k: min((i for i, p in prints if root[p] == k and i is not None), default=None) for k in root.values()}
    assert odd.counted((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == odd.counted((i, p, smallest[root[p]]) for i, p in prints)
    assert simhash.near_duplicates(odd.empty(spark)).isEmpty()


def _windows(rows):
    """Brute force of the windows' rule: (n_words, n_removed, digest of what is kept)."""
    words = [(t or "").encode().split() for _, t in rows]
    keys = [[tuple(w[k : k + 50]) for k in range(len(w) - 49)] for w in words]
    first = {}
    for (i, _), own in zip(rows, keys, strict=True):
        for k in own:
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), w, own in zip(rows, words, keys, strict=True):
        gone = {k + j for k, key in enumerate(own) if i is not None and key in first and first[key] < i for j in range(50)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 0])
def test_passages_against_brute_force(spark, hot):
    rng = random.Random(4)
    passages = [text(rng, n) for n in (49, 50, 51, 130)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(x for _ in range(rng.randrange(4)) for x in (rng.choice(passages), text(rng, rng.randrange(30)))))
    texts += [passages[3], "a " * 130, "a " * 90, texts[0], texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    own = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup(own, shard=20, hot=hot).drop("spans").collect()
    assert odd.counted(map(tuple, got)) == odd.counted(_windows(rows))


def test_the_automaton_locates(monkeypatch):
    """Matches alone decide: without them nothing is found; hashes that all collide change nothing."""
    rng = random.Random(8)
    passage = text(rng, 70)
    texts = [f"{text(rng, 9)} {passage}".encode(), f"{passage} {text(rng, 12)}".encode(), text(rng, 80).encode()]
    expected = [[(9, 29, 1)], [(0, 20, 1)], []]
    assert substring_dedup.located(texts, [1, 4, 2], [1, 4, 2]) == expected
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "runs_of", lambda c, n: np.zeros(len(c) - n + 1, np.uint64))
        assert substring_dedup.located(texts, [1, 4, 2], [1, 4, 2]) == expected

    class Deaf:
        def __init__(self):
            self.own = made()

        def __len__(self):
            return len(self.own)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def iter(self, _):
            return iter(())

    made = substring_dedup.ahocorasick.Automaton

    with monkeypatch.context() as m:
        m.setattr(substring_dedup.ahocorasick, "Automaton", Deaf)
        assert substring_dedup.located(texts, [1, 4, 2], [1, 4, 2]) == [[], [], []]


def test_portions_keep_anchors_together(monkeypatch):
    monkeypatch.setattr(substring_dedup, "LETTERS", 100)
    anchors, words = [3, 1, 3, 2, 1, 5], [60, 50, 60, 50, 40, 10]
    got = list(substring_dedup._portions(anchors, words))
    assert got == [[1, 4], [3], [0, 2], [5]]


def test_passages_of_odd_documents(spark):
    got = substring_dedup.dedup(odd.docs(spark)).drop("spans").collect()
    assert odd.counted(map(tuple, got)) == odd.counted(_windows([(r[0], r[1]) for r in odd.rows()]))
    assert substring_dedup.dedup(odd.empty(spark)).isEmpty()


def test_near_copies(spark):
    rng = random.Random(5)
    base = [text(rng, 200) for _ in range(30)]
    changed = []
    for t in base[:20]:
        w = t.split()
        for k in rng.sample(range(200), 3):
            w[k] = "edited"
        changed.append(" ".join(w))
    texts = base + changed + [base[0].upper(), "", None, base[25] + " " + text(rng, 150)]
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(odd.of(spark, texts)).collect()}
    assert all(got[30 + k] == k for k in range(20)) and got[50] == 0 and got[51] == got[52] == 51 and got[53] == 53
    assert all(got[k] == k for k in range(30))
    assert near_copies.near_copies(odd.empty(spark)).isEmpty()
    assert {r.doc_id for r in near_copies.near_copies(odd.docs(spark)).collect()} == {r[0] for r in odd.rows()} - {None}


def test_an_original_links_its_copies(spark):
    """Copies are too far from each other, and the original has not the smallest id."""
    rng = random.Random(9)
    base = text(rng, 300).split()
    copies = []
    for _ in range(12):
        w = list(base)
        for k in rng.sample(range(300), 5):
            w[k] = text(rng, 1)
        copies.append(" ".join(w))
    texts = copies[:6] + [" ".join(base)] + copies[6:]
    shingles = [_shingles(t) for t in texts]
    near = lambda i, j: len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
    assert all(near(6, k) for k in range(13)) and sum(near(0, k) for k in range(1, 13) if k != 6) < 11
    assert {r.group_id for r in near_copies.near_copies(odd.of(spark, texts)).collect()} == {0}


def _shares(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, rest, left = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, {}, set(order), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in rest}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            rest.discard(s)


def test_mixing_hits_its_targets(spark):
    rng = random.Random(6)
    n_of = {"a": 400, "b": 10, None: 60, "ab": 5, "z": 30}
    rows = [(k, text(rng, rng.randrange(80)), s) for k, s in enumerate(s for s, n in n_of.items() for _ in range(n))]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",)).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in n_of}
    goal = _shares(sizes)
    for s in n_of:
        own = [r for r in mixed if r.source == s]
        taken = sum(t["words"] for r in own for t in r.takes)
        assert len(own) == n_of[s] and abs(own[0].target - goal[s]) < 1e-6 and abs(taken - goal[s]) <= 1
        assert all(sum(t["words"] for t in r.takes) <= 3 * r.size for r in own)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7), keep=("source",)).collect()
    assert odd.counted(map(tuple, again)) == odd.counted(map(tuple, mixed))
    shards = {t["shard"] for r in mixed for t in r.takes}
    assert shards == set(range(2**mixing.LEVELS))


def test_shards_come_from_the_tree(spark):
    """Blocks are whole in a shard, and each shard has as many of a source as its quota says."""
    rng = random.Random(16)
    rows = [(k, text(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "text"), 64 - mixing.PLACES)
    slim = mixing.written(docs.select("doc_id", src.alias("src"), mixing.words_in(F.col("text")).alias("size"), place.alias("place")))
    goals, _ = mixing._goals(slim, mixing.WEIGHTS, mixing.MOST, 3)
    quotas = {(r.src, r.shard): r.quota for r in mixing.split_quotas(goals.select("src", "quota"), 3).collect()}
    dealt = mixing._dealt(slim, goals, 3).collect()
    sources = {r.src: r for r in goals.collect()}
    seen, empty = {}, 0
    for r in dealt:
        for item in r["items"]:
            seen[r.src, item.shard] = seen.get((r.src, item.shard), 0) + 1
    for s, g in sources.items():
        blocks = {r.block for r in dealt if r.src == s}
        empty += sum(b not in blocks for b in range(2**g.bits))
        assert g.quota == g.passes * 2**g.bits + (g["last"] >> (mixing.PLACES - g.bits)) + 1
    assert all(seen.get(k, 0) <= q for k, q in quotas.items()) and sum(quotas.values()) - sum(seen.values()) <= 4 * empty
    assert sum(quotas.values()) == sum(g.quota for g in sources.values())
    # documents of a block and pass are in one shard, that of the deal
    of = {(r.src, r.block, i["pass"]): i.shard for r in dealt for i in r["items"]}
    at = {r.doc_id: (r.src, r.place >> (mixing.PLACES - sources[r.src].bits)) for r in slim.collect()}
    mixed = mixing.mix(docs, levels=3).collect()
    takes = [(of[(*at[r.doc_id], t["pass"])], t["shard"]) for r in mixed for t in r.takes]
    assert len({s for _, s in takes}) == 8 and all(a == b for a, b in takes)


def test_draws_of_many_stay_in_bounds(spark):
    n = F.lit(40_000_000).cast("long")
    draws = spark.range(200).select(mixing._hypergeometric(n, F.lit(16_000_000).cast("long"), F.lit(20_000_000).cast("long"), mixing._unit("id")).alias("x"))
    x = np.array([r.x for r in draws.collect()], float)
    sigma = (2e7 * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(x.mean() - 8e6) < 4 * sigma / 200**0.5 and 0.8 * sigma < x.std() < 1.2 * sigma


def test_partial_takes_are_cut(spark):
    rng = random.Random(18)
    docs = spark.createDataFrame([(k, text(rng, 90), f"s{k % 7}") for k in range(70)], "doc_id long, text string, source string")
    rows = mixing.shards(mixing.mix(docs, keep=("text",)), "text").collect()
    assert all(len(r.text.split()) == r.words for r in rows) and any(r.words < r.size for r in rows)
    assert {r.doc_id: r.text for r in rows if r.words == r.size}.items() <= {r.doc_id: r.text for r in docs.collect()}.items()


def test_quotas_are_split_exactly_and_evenly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 1)], "src string, quota long")
    own = mixing.split_quotas(quotas, 3).collect()
    total = {}
    for r in own:
        assert r.quota >= 0
        total[r.src] = total.get(r.src, 0) + r.quota
    by_shard = [sum(r.quota for r in own if r.shard == s) for s in range(8)]
    assert total == {"a": 1000, "b": 37, "c": 0, "d": 1} and max(by_shard) - min(by_shard) <= 2


def test_draws_are_hypergeometric(spark):
    from math import comb

    draws = spark.range(20_000).select(mixing._hypergeometric(F.lit(20).cast("long"), F.lit(8).cast("long"), F.lit(10).cast("long"), mixing._unit("id")).alias("x"))
    got = {r.x: r["count"] / 20_000 for r in draws.groupBy("x").count().collect()}
    for x in range(9):
        assert abs(got.get(x, 0) - comb(8, x) * comb(12, 10 - x) / comb(20, 10)) < 0.012


def test_mixing_of_odd_documents(spark):
    found = mixing.mix(odd.docs(spark)).collect()
    assert len(found) == len(odd.rows()) and sum(r.size for r in found) == sum(t["words"] for r in found for t in r.takes)
    assert mixing.mix(odd.empty(spark)).isEmpty() and mixing.mix(odd.docs(spark).filter("text is null")).count() == 2


def test_language_on_held_out_documents(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    found = language_id.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_odd_documents(spark):
    docs = odd.docs(spark)
    network = language_id.train(docs)
    got = language_id.identify(docs, network).collect()
    expected = []
    for i, t, *_ in odd.rows():
        name, score = "und", 0.0
        if language_id.has_letter((t or "").encode()):
            own = language_id.windows(t.encode())
            fill = np.count_nonzero(own, axis=1)
            fill[:-1] = language_id.WINDOW
            mean = (network.probabilities(own) * fill[:, None]).sum(0) / fill.sum()
            name, score = network.labels[int(mean.argmax())], round(float(mean.max()), 4)
        expected.append((i, name, score))
    assert odd.counted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in got) == odd.counted(expected)
    assert language_id.train(odd.empty(spark)) is None and {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert language_id.identify(odd.empty(spark), network).isEmpty()


def test_tables_equal_the_convolution():
    """Tables of byte responses against filters slid over embedded bytes, one by one."""
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (60, language_id.WINDOW), dtype=np.uint8)
    rows[:30] %= 50
    labels = ["low"] * 30 + ["any"] * 30
    network = language_id.fit(rows, labels)
    assert (np.array(network.labels)[network.probabilities(rows).argmax(1)] == np.array(labels)).mean() > 0.95
    p = language_id.weights(rows, labels)
    for row in rows[::7]:
        embedded = p["embed"][row]
        h = []
        for w in language_id.WIDTHS:
            responses = [embedded[k : k + w].ravel() @ p[f"f{w}"] for k in range(language_id.WINDOW - w + 1)]
            h.append(np.maximum(np.max(responses, axis=0) + p[f"b{w}"], 0))
        z = np.concatenate(h) @ p["out"] + p["bias"]
        expected = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(network.probabilities(row[None])[0], expected, atol=1e-4)


def test_scores_are_means_of_windows(spark):
    """A document's probabilities by hand from its windows'."""
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 123, (40, language_id.WINDOW), dtype=np.uint8)
    rows[:20] %= 110
    network = language_id.fit(rows, ["a"] * 20 + ["b"] * 20)
    raw = "".join(chr(c) for c in rng.integers(97, 123, 300))
    got = language_id.identify(odd.of(spark, [raw]), network).first()
    own = [raw[k : k + language_id.WINDOW].encode() for k in range(0, 300, language_id.WINDOW)]
    prob = [network.probabilities(np.frombuffer(w.ljust(language_id.WINDOW, b"\0"), np.uint8)[None])[0] for w in own]
    mean = sum(len(w) * p for w, p in zip(own, prob, strict=True)) / 300
    assert got.lang_pred == network.labels[int(mean.argmax())] and abs(got.score - mean.max()) < 1e-5


def test_every_language_is_learned(spark):
    """Far more languages than documents a language in the sample."""
    rows = [(k * 50 + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 60, f"l{k}") for k in range(400) for j in range(2)]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in rows], "doc_id long, text string, lang string")
    held = docs.filter(~language_id.held_out()).select("lang").distinct().count()
    sample = language_id._sample(docs, "doc_id", "text", "lang")
    assert sample.select("lang").distinct().count() == held > 300


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(1)
    texts, labels = [["bad", "word", "x"] * 5, ["good", "word", "y"] * 5] * 6, [1, 0] * 6
    model = toxicity.fit(texts, labels)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    batch = [[model.rows(w) for w in t] for t in texts[:2]]
    y, weight = np.array([1, 0]), np.array([0.5, 0.5])

    def loss():
        sizes = np.array([len(t) for t in batch])
        gx = np.stack([model.project(rows + [[]] * (toxicity.WINDOW - len(rows))) for rows in batch])
        return float((weight * (np.logaddexp(0, (z := model.logits(gx, sizes))) - y * z)).sum())

    grad = toxicity._gradient(model, batch, y, weight)
    for key in ("wx", "uf", "ub", "att", "out", "bx", "emb"):
        for flat in rng.choice(model.p[key].size, 3, replace=False):
            at = np.unravel_index(flat, model.p[key].shape)
            old, e = model.p[key][at], 3e-3
            model.p[key][at] = old + e
            up = loss()
            model.p[key][at] = old - e
            down = loss()
            model.p[key][at] = old
            assert abs((up - down) / (2 * e) - grad[key][at]) < 3e-3 + 0.05 * abs(grad[key][at]), key


def test_scores_against_a_plain_network():
    """Windows, gates, attention and the highest window, one step at a time."""
    rng = random.Random(3)
    texts = [[rng.choice(["bad", "word", "x", "fine", "other"]) for _ in range(n)] for n in (5, 64, 65, 200, 130, 1)] * 4
    labels = [int("bad" in t) for t in texts]
    labels[-1] = 0
    model = toxicity.fit(texts, labels)
    p, h = {k: v.astype(float) for k, v in model.p.items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def layer(xs, key, cut):
        u, state, out = p[key], np.zeros(h), []
        for x in xs:
            gx, g = x[cut], state @ u
            z, r = sigmoid(gx[:h] + g[:h]), sigmoid(gx[h : 2 * h] + g[h : 2 * h])
            c = np.tanh(gx[2 * h :] + r * g[2 * h :])
            state = (1 - z) * c + z * state
            out.append(state)
        return out

    def window_logit(words):
        xs = []
        for k in range(toxicity.WINDOW):
            rows = model.rows(words[k]) if k < len(words) else []
            e = np.tanh(p["emb"][rows].sum(0)) if rows else np.zeros(toxicity.EMBED)
            xs.append(e @ p["wx"] + p["bx"])
        fw = layer(xs, "uf", slice(0, 3 * h))
        bw = layer(xs[::-1], "ub", slice(3 * h, 6 * h))[::-1]
        both = [np.concatenate(x) for x in zip(fw, bw, strict=True)][: max(1, len(words))]
        a = np.array([x @ p["att"] for x in both])
        a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        return sum(w * x for w, x in zip(a, both, strict=True)) @ p["out"] + p["bias"][0]

    own = [*texts[:6], []]
    got, worst = toxicity.Scorer(model).logits(own)
    for words, logit, first in zip(own, got, worst, strict=True):
        every = {s: window_logit(words[s : s + 64]) for s in range(0, max(1, len(words) - 16), 48)}
        assert abs(max(every.values()) - logit) < 1e-3 and abs(every[int(first)] - logit) < 1e-3


def test_toxicity_on_held_out_documents(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    found = toxicity.op6_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in found if r.toxic == 1], [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.88 and sum(r.predicted for r in clean) / len(clean) < 0.02
    assert all(0 <= r.score <= 1 for r in found)


def test_toxicity_of_odd_documents(spark):
    docs = odd.docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (7, 1, 1), (7, 0, 1), (None, 1, 1), (8, None, 1), (99, 1, 1), (9, 1, 1), (10, 1, 1), (11, 0, 1), (5, 0, 1)], "doc_id long, toxic int, extra int")
    model = toxicity.train(docs, labels)
    logit = toxicity.Scorer(model).logits([toxicity.words_of((r[1] or "").encode()) for r in odd.rows()])[0]
    expected = [(r[0], round(float(s), 4)) for r, s in zip(odd.rows(), model.calibrated(logit.astype(float)), strict=True)]
    assert odd.counted((r.doc_id, round(r.score, 4)) for r in toxicity.score(docs, model).collect()) == odd.counted(expected)
    assert odd.counted((r.doc_id, r.score) for r in toxicity.score(docs, None).collect()) == odd.counted((r[0], 0.0) for r in odd.rows())
    for own in (model, None):
        assert toxicity.score(odd.empty(spark), own).isEmpty()
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None and toxicity.train(odd.empty(spark), labels) is None
    assert list(toxicity.window_starts(0)) == [0] and list(toxicity.window_starts(64)) == [0] and list(toxicity.window_starts(65)) == [0, 48]


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, data).toArrow())
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        assert kept.join(before, "doc_id", "left_anti").isEmpty()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len(set(texts.values())) == len(texts) and not any("password=" in t for t in texts.values())
    mixed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in mixed} <= set(texts)
    assert all(r.words <= r.size for r in mixed) and len({r.shard for r in mixed}) > 1


def test_stages_on_odd_documents(spark, data):
    import corpus_pipeline

    docs, after = odd.docs(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, data).toArrow())
        after[name] = sorted(str(r.doc_id) for r in docs.collect())
    letters = [str(r[0]) for r in odd.rows() if language_id.has_letter((r[1] or "").encode())]
    assert after["language_id"] == sorted(letters)
    # of the repeated text one stays, the one with a word more is a near copy of it
    assert after["simhash_near_dedup"] == sorted(["1", "6", "7", "9", "9", "10", "11"])
    assert after["simhash_near_dedup"] == after["benchmark_decontamination"] == after["secret_scan"]
    assert set(after["mixing"]) <= set(after["secret_scan"]) and after["mixing"]
    docs = odd.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, data).toArrow())
        assert docs.isEmpty()


def _similar_groups(texts):
    sets = [_shingles(t) for t in texts]
    return _roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def test_near_copies_of_other_members_than_leaders(spark):
    """Chains of successive edits, and texts that are mostly passages many others share."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        w = text(rng, 200).split()
        for _ in range(8):
            texts.append(" ".join(w))
            for k in rng.sample(range(200), 3):
                w[k] = text(rng, 1)
    passages = [text(rng, 60) for _ in range(3)]
    for _ in range(60):
        own = [*rng.sample(passages, 2), text(rng, 60)]
        texts.append(" ".join(own))
        texts.append(" ".join([*own, text(rng, 8)]))
    rng.shuffle(texts)
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(odd.of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == _similar_groups(texts)


def test_near_copies_of_short_texts(spark):
    rng = random.Random(12)
    texts = []
    for n in range(4, 15):
        for _ in range(12):
            w = text(rng, n).split()
            texts += [" ".join(w), " ".join([*w, *text(rng, 1).split()]), " ".join([*text(rng, 1).split(), *w])]
    rng.shuffle(texts)
    expected = _similar_groups(texts)
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(odd.of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == expected and len(set(expected)) < len(texts)


def _sets(spark, sets):
    rows = [(k, len(x), near_copies.parity_of(np.array(sorted(x), np.uint64)).tolist()) for k, x in enumerate(sets)]
    return spark.createDataFrame(rows, "row long, n int, parity array<long>")


def test_parities_tell_long_texts_apart(spark):
    """Also those of more shingles than PARITIES, and of texts with different numbers of bits."""
    rng = random.Random(14)
    draw = lambda n: {rng.getrandbits(64) for _ in range(n)}
    sets, similar = [], set()
    for n in (30, 500, 950, 3000, 9000):
        own = draw(n)
        few = {*sorted(own)[: n - n // 11], *draw(n // 11)}  # 0.83
        similar |= {(len(sets), len(sets) + 1), (len(sets), len(sets) + 2)}
        sets += [own, few, own | draw(n // 5), draw(n)]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 0.8 <= len(sets[i]) / len(sets[j]) <= 1.25]
    assert {len(near_copies.parity_of(np.array(sorted(x), np.uint64))) for x in sets} == {8, 16, 32, 64, 256}
    found = near_copies._possible(written(spark.createDataFrame(pairs, "a long, b long")), _sets(spark, sets), 0.8)
    got = {tuple(r) for r in found.collect()}
    assert similar <= got and not {(i, j) for i, j in got if len(sets[i]) > 400 and not sets[i] & sets[j]}


def test_long_texts_of_few_common_shingles_are_no_pairs(spark):
    """All similar pairs come out of the first shingles, and none with one chance shingle."""
    rng = random.Random(15)
    sets = []
    for n in (1, 2, 5, 9, 40, 41, 300, 800):
        for _ in range(4):
            own = sorted(rng.sample(range(10**9), n))
            cut, more = rng.sample(range(10**9), n // 10), rng.sample(range(10**9), n // 4)
            sets += [own, own[n // 5 :], sorted({*own, *more}), sorted({*own[n // 20 :], *cut}), own[: n - n // 5]]
    for k in (-1, -6):  # the very first shingle in common, and no other
        sets[k] = sorted({*sets[k], 7})
    first = lambda x: x[: len(x) - int(np.ceil(0.8 * len(x) - 1e-6)) + 1]
    rows = [(k, len(x), k, at, t) for k, x in enumerate(sets) for at, t in enumerate(first(x))]
    own = near_copies._apart(spark.createDataFrame(rows, "row long, n int, root long, at int, token long"))
    got = {tuple(r) for r in near_copies._rest(own, 0.8).collect()}
    as_sets = [set(x) for x in sets]
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if len(as_sets[i] & as_sets[j]) >= 0.8 * len(as_sets[i] | as_sets[j])}
    assert len(similar) > 100 and similar <= got and (len(sets) - 6, len(sets) - 1) not in got


def test_portions_of_shingles_are_whole(spark):
    placed = spark.createDataFrame([(k, 40, k % 7, [t * 31 - 400 for t in range(k, k + 30)]) for k in range(50)], "row long, n int, root long, tokens array<long>")
    parts = [near_copies._portion(placed, k).collect() for k in range(near_copies.PORTIONS)]
    rows = [tuple(r) for part in parts for r in part]
    assert sorted(rows) == sorted((r.row, 40, r.root, at, t) for r in placed.collect() for at, t in enumerate(r.tokens))
    assert all(not {r.token for r in a} & {r.token for r in b} and a for k, a in enumerate(parts) for b in parts[:k])


def test_shuffle_files_end_with_a_written_table(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"/shuffle_\d+_", disk.getAllFiles().mkString("\n")))
    kept = spark.range(1000).repartition(3)
    kept.count()
    before = shuffles()
    table = written(spark.range(50_000).selectExpr("id % 999 AS k", "id").groupBy("k").sum("id"))
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert before and not shuffles() - before and table.count() == 999


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c, d = (text(rng, 40) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a + " x"), (None, b), (None, c), (None, c), (None, c.upper()), (4, d), (4, d), (4, d + "\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert odd.counted((r.doc_id, " ".join(r.text.lower().split())) for r in got) == odd.counted([(1, a), (3, b), (None, c), (4, d)])
    assert set(map(tuple, got)) <= set(map(tuple, docs.collect()))


def test_no_language_to_learn_from(spark):
    import corpus_pipeline

    own = odd.docs(spark).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language(spark, own, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert odd.counted((r.doc_id, r.text) for r in got.collect()) == odd.counted((r[0], r[1]) for r in odd.rows() if language_id.has_letter((r[1] or "").encode()))
