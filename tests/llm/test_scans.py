"""Operators that look at each text by itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rangewise.llm import decontaminate, license_scan, oracles, quality_rules, queries, secret_scan, token_counts
from tests import duck
from tests.llm import odd

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.PrefixCounter(f.read())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_every_prefix_has_the_library_s_count(counter, tokenizer):
    rng = random.Random(3)
    parts = [*"abe thing's'll're've 12,.!  \n\t éß中文😀'", "<|endoftext|>", "the", " and", "'ll", "  \n", " ", "\x00", "<|end"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(400)]
    for text, table in zip(texts, counter.prefixes(texts), strict=True):
        assert len(table) == len(text.encode())
        for k in range(1, len(text) + 1):
            assert table[len(text[:k].encode()) - 1] == len(tokenizer.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_token_counts_of_odd_documents(spark, tokenizer):
    found = token_counts.prefix_counts(odd.docs(spark), PATH)
    got = odd.counted((r.doc_id, r.n_bytes, r.n) for r in found.select("doc_id", "n_bytes", token_counts.total().alias("n")).collect())
    assert got == odd.counted((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd.rows())
    assert token_counts.prefix_counts(odd.empty(spark), PATH).count() == 0


def test_budgets_of_odd_documents(spark):
    limits = (0, 3, 10, 512)
    tables = token_counts.prefix_counts(odd.docs(spark), PATH)
    expected = tables.select("doc_id", "n_bytes", token_counts.total().alias("n"), F.array(*map(token_counts.fitting_bytes, limits)).alias("f"))
    got = token_counts.budgets(odd.docs(spark), PATH, limits)
    assert odd.counted(map(tuple, got.collect())) == odd.counted(map(tuple, expected.collect()))


def test_long_texts_take_time_in_proportion(counter):
    import time

    piece = "word  and   more \n\n\t text é  "
    took = []
    for n in (2_000, 16_000):
        start = time.perf_counter()
        counter.prefixes([piece * n])
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0] + 0.5


def test_truncation(spark, tokenizer):
    text = "the quick brown fox jumps over the lazy dog " * 5
    row = token_counts.prefix_counts(odd.of(spark, [text, "a"]), PATH).select(token_counts.fitting_bytes(10).alias("n")).collect()
    assert len(tokenizer.encode(text[: row[0].n]).ids) <= 10 < len(tokenizer.encode(text[: row[0].n + 1]).ids) and row[1].n == 1


def _base_sets(text):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_base_secrets_against_plain_expressions():
    rng = random.Random(1)
    parts = ["password", "API_KEY", "apikey", "token", "=", ": ", "'", '"', " ", "abcdef12", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "ſecret=aaaaaaaaaa", "é", "\n", "toKen=deadbeef"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secret_scan.base_spans(text) == _base_sets(text), text


def test_links_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        starts = sorted(rng.randrange(600) for _ in range(rng.randrange(14)))
        parts = sorted(((s, s + rng.randrange(1, 40), rng.choice(secret_scan.KINDS)) for s in starts), key=lambda p: (p[0], secret_scan.KINDS.index(p[2])))
        got = secret_scan.links(parts, 50)
        best = {}
        for i, (a, b, kind) in enumerate(parts):
            for j, (c, d, other) in enumerate(parts):
                gap = max(0, c - b, a - d)
                role = secret_scan.ROLE[other]
                if i != j and role in secret_scan.COMPLETES[secret_scan.ROLE[kind]] and gap <= 50:
                    best[i, role] = min(best.get((i, role), 99), gap)
        assert sorted((i, secret_scan.ROLE[parts[j][2]], d) for i, j, d in got) == sorted((i, r, d) for (i, r), d in best.items())


def test_weak_parts_need_a_complement():
    weak = "x Kq7Zp2Lm9Rt4Vb8Ns3Xw6 y"
    kinds = lambda t: [k for _, _, k in secret_scan.scan_text(t)[0]]
    assert kinds(weak) == [] and kinds("user=alice") == [] and kinds("https://db.example.org/x") == []
    assert kinds("user=alice " + weak) == ["identifier", "candidate"]
    assert kinds(weak + " https://db.example.org/x") == ["candidate", "endpoint"]
    assert kinds("user=alice " + "word " * 100 + weak) == []
    assert kinds("user=alice https://db.example.org") == []


def test_secrets_of_odd_documents(spark):
    texts = [*odd.rows(), (20, "user=alice Kq7Zp2Lm9Rt4Vb8Ns3Xw6 password=abcdefgh1"), (21, "token: " + "a" * 400_000)]
    own = spark.createDataFrame([(r[0], r[1]) for r in texts], "doc_id long, text string")
    got = secret_scan.scan(own).collect()
    expected = [(r[0], [(s, e, k) for s, e, k in secret_scan.scan_text(r[1] or "")[0]]) for r in texts]
    assert odd.counted((r.doc_id, [(s.start, s.end, s.kind) for s in r.spans]) for r in got) == odd.counted(expected)
    assert secret_scan.scan(odd.docs(spark)).count() == len(odd.rows()) and secret_scan.scan(odd.empty(spark)).count() == 0
    own = spark.createDataFrame([(1, "a password=abcdefgh1 b", 3), (2, None, 1), (3, "clean", 5)], "doc_id long, text string, extra int")
    assert [tuple(r) for r in secret_scan.redacted(own).collect()] == [(1, "a [assign] b", 3), (2, None, 1), (3, "clean", 5)]


def test_wu_manber_against_brute_force():
    rng = random.Random(5)
    vocabulary = [b"a", b"b", b"c", b"dd"]
    for _ in range(200):
        items = [(k, b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(14)))) for k in range(5)]
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        expected = set()
        for k, raw in items:
            w = raw.split()
            n = min(10, len(w))
            for s in range(len(w) - n + 1) if n else ():
                expected |= {(i, i + n, k) for i in range(len(own) - n + 1) if own[i : i + n] == w[s : s + n]}
        got = {(s, e, k) for s, e, ids in decontaminate.Patterns(items).occurrences(own) for k in ids}
        assert got == expected


def test_decontamination_of_odd_documents(spark):
    bench = spark.createDataFrame([(1, "w3 W4, w5"), (1, "w3 W4, w5"), (2, None), (None, "x"), (None, " ".join(odd.WORDS[60:72])), (3, ""), (4, " ".join(odd.WORDS[20:40]))], "item_id long, text string")
    found = decontaminate.search(odd.docs(spark), bench)
    got = {(r.doc_id, r.n_words): (r.hits, r.items) for r in found.collect()}
    assert found.count() == len(odd.rows()) and got[1, 120][1] == [1, 4] and [tuple(h) for h in got[1, 120][0]] == [(3, 6), (20, 40), (60, 72)]
    blocks = decontaminate.search(odd.docs(spark), bench, block_bytes=20, keep=("lang", "n_words"))
    whole = decontaminate.search(odd.docs(spark), bench, keep=("lang",))
    assert blocks.columns == ["doc_id", "lang", "n_words", "n_words", "hits", "items"]
    blocks = blocks.toDF("doc_id", "lang", "kept", "n_words", "hits", "items").drop("kept")
    assert odd.counted(map(tuple, blocks.collect())) == odd.counted(map(tuple, whole.collect()))
    assert decontaminate.search(odd.docs(spark), bench.limit(0)).filter("size(hits) > 0").isEmpty()
    assert decontaminate.search(odd.empty(spark), bench).isEmpty()
    named = decontaminate.search(odd.docs(spark), bench.selectExpr("concat('i', item_id) AS item_id", "text"))
    assert {tuple(r["items"]) for r in named.collect() if r["items"]} >= {("i1", "i4")}


def test_licences_of_odd_documents(spark):
    found = license_scan.scan(odd.docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in odd.rows()) and license_scan.scan(odd.empty(spark)).isEmpty()
    texts = ["MIT License", "the apache license and the MIT-license, mit license", "gnu general public license", "license mit", "general license public", "permission is hereby granted, free of charge, to any one person obtaining a copy of this software", "all rights reserved"]
    got = {r.doc_id: r for r in license_scan.scan(odd.of(spark, texts)).collect()}
    assert [(got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels, got[k].labels) for k in range(7)] == [
        (1, 0, 0, "mit", "mit"), (3, 1, 7, "apache,mit", "apache,mit"), (1, 1, 1, "gpl", "gpl"), (0, None, None, "", ""),
        (0, None, None, "", ""), (0, None, None, "", "mit"), (0, None, None, "", "reserved"),
    ]
    assert got[0].score == 1.0 and 0.6 <= got[5].score < 1.0


def test_repeated_licence_lines(spark):
    texts = ["all rights reserved " * n for n in range(1, 8)] + ["all rights " * 9, "x all rights reserved y z all rights reserved all rights reserved"]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(odd.of(spark, texts)).collect()}
    assert [got[k] for k in range(9)] == [("reserved", 1.0)] * 7 + [("", 0.0), ("reserved", 1.0)]
    # occurrences that are not complete
    own = (("short", "granted freely toward users"),)
    got = license_scan.scan(odd.of(spark, ["granted freely toward " * n for n in (1, 2, 5)]), templates=own, base=()).collect()
    assert [(r.labels, r.score) for r in got] == [("short", 2 / 3)] * 3


def test_statistics_against_brute_force():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "#", "|", " "]) for _ in range(rng.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered))
        assert quality_rules.statistics(text.encode())[:5] == expected, text
    assert quality_rules.statistics(None)[0] == 0


def test_mcd_is_not_pulled_by_outliers():
    import numpy as np

    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (700, 7)), rng.normal(9, 1.5, (300, 7))
    mean, _ = quality_rules.mcd(np.concatenate([good, bad]), np.full(7, 0.1))
    assert np.abs(mean).max() < 0.3
    assert abs(quality_rules.chi2_quantile(7, 0.5) - 6.3458) < 1e-3 and abs(quality_rules.chi2_quantile(2, 0.05) - 5.9915) < 1e-3


def test_mcd_is_the_best_half():
    """Hundreds of random starts come to no much smaller determinant."""
    import numpy as np

    rng = np.random.default_rng(3)
    floor = np.full(7, 0.1)
    for n in (40, 150):
        x = np.concatenate([rng.normal(0, 1, (n - n // 4, 7)), rng.normal(5, 0.3, (n // 4, 7))])
        h = (n + 8) // 2
        det = lambda half: np.linalg.slogdet(np.cov(x[half], rowvar=False, bias=True) + np.diag(floor**2))[1]  # noqa: B023, E731
        best = np.inf
        for _ in range(200):
            half = rng.choice(n, 8, replace=False)
            for _ in range(30):
                d = x - x[half].mean(0)
                inverse = np.linalg.inv(np.cov(x[half], rowvar=False, bias=True) + np.diag(floor**2))
                half = np.argsort(np.einsum("ij,jk,ik->i", d, inverse, d))[:h]
            best = min(best, det(half))
        _, cov = quality_rules.mcd(x, floor)
        assert np.linalg.slogdet(cov)[1] <= best + 0.5


def _plain_verdicts(rows):
    """The whole rule in numpy, for groups of one block: (distance2, kept) by row."""
    import numpy as np

    q, floor = quality_rules, np.array(quality_rules.FLOOR)
    found = [q.statistics(None if t is None else t.encode()) for _, t, _, _ in rows]
    x = np.array([f[5] for f in found])
    groups = {}
    for k, (_, _, lang, source) in enumerate(rows):
        groups.setdefault((lang, source), []).append(k)
    of = lambda at: q.mcd(x[at])
    far = lambda x, mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    mixed = lambda n, own, wide: [(n * a + q.PRIOR * b) / (n + q.PRIOR) for a, b in zip(own, wide, strict=True)]
    every, out = of(range(len(rows))), {}
    for (lang, _), at in groups.items():
        own_lang = [k for k, r in enumerate(rows) if r[2] == lang]
        mean, cov = of(at)
        for _ in range(q.STEPS):
            d = far(x[at], mean, cov)
            half = x[at][d <= np.sort(d)[(len(at) + 1) // 2 - 1]]
            mean, cov = half.mean(0), np.cov(half, rowvar=False, bias=True).reshape(7, 7) + np.diag(floor**2)
        mean, cov = mixed(len(at), (mean, cov), mixed(len(own_lang), of(own_lang), every))
        d = far(x[at], mean, cov)
        scale = max(1.0, np.sort(d)[(len(at) + 1) // 2 - 1] / q.chi2_quantile(7, 0.5))
        d /= (len(at) * scale + q.PRIOR) / (len(at) + q.PRIOR)
        for k, v in zip(at, d, strict=True):
            n, repeats = found[k][0], found[k][4]
            out[k] = (float(v), not (n < 50 or 100 * repeats > 50 * n) and v <= q.chi2_quantile(7, q.TAIL))
    return [out[k] for k in range(len(rows))]


def test_verdicts_against_a_plain_computation(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for k in range(260):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 400))]
        if k % 11 == 0:
            words = [w + rng.choice(["##", "$$$", "|||"]) for w in words]
        rows.append((k, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "rare"] if k % 20 else ["one"])))
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    expected = _plain_verdicts(rows)
    assert [k for k, (d, kept) in enumerate(expected) if abs(got[k].distance2 - d) > 0.01 * d + 1e-9 or got[k].kept != kept] == []
    assert {kept for _, kept in expected} == {True, False}


def test_quality_of_odd_documents(spark):
    found = quality_rules.judged(odd.docs(spark)).collect()
    expected = _plain_verdicts([(r[0], r[1], r[2], r[3]) for r in odd.rows()])
    failed = [len((r[1] or "").encode().split()) < 50 for r in odd.rows()]
    assert len(found) == len(odd.rows()) and all(r.distance2 is not None for r in found)
    assert sum(r.kept for r in found) == sum(kept for _, kept in expected) and sum(r.n_words < 50 for r in found) == sum(failed)
    assert quality_rules.judged(odd.empty(spark)).isEmpty()


def test_junk_is_rejected_and_clean_documents_stay(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    found = quality_rules.op1_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) == 0 and n.get((1, False), 0) <= 0.05 * n[1, True]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, data, name):
    duck.same(queries.queries()[name](spark, data), duck.connect(data), queries.oracle_sql()[name])
    assert oracles.OP5 in queries.oracle_sql().values()
