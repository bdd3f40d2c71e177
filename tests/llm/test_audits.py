"""Whitening, divergence audit and decontamination against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableferry.llm import decontamination, divergence, whitening


# -- 11 ---------------------------------------------------------------------------------------
def plain_whitening(x):
    """n, sums, components (a column each) and variances of the distinct rows of x."""
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(0)
    e, v = np.linalg.eigh(y.T @ y / len(fit))
    return len(fit), fit.astype(object).sum(0), v[:, ::-1], e[::-1]


def whitened(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("clash"), "id": F.lit(3), "d": F.lit(1)})
    return whitening.whiten(df.repartition(3), "vec_id", "embedding").collect()


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 7)) @ np.diag([5, 3, 2, 1, 0.5, 0.2, 0.1]) @ rng.normal(size=(7, 7))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(900, vectors[3].tolist()), (3, vectors[3].tolist()), (None, vectors[4].tolist())]  # copies, a repeated id and none
    rows += [(1000, None), (1001, []), (1002, [1.0, None] + [0.0] * 5), (1003, [float("nan")] * 7), (1004, [float("inf")] + [0.0] * 6), (1005, [1.0, 2.0])]
    got = whitened(spark, rows)
    good = {k: v for k, v in rows if v is not None and len(v) == 7 and None not in v and np.isfinite(v).all()}
    x = np.floor(np.array(list(good.values())) * 256).astype(np.int64)
    n, s, axes, e = plain_whitening(x)
    assert len(got) == 403 * 4 and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)
    for c in range(4):
        mine = [r for r in got if r["component"] == c + 1]
        a = np.array([r["whitened"] for r in mine])
        held = np.array([np.floor(np.array(good[r["vec_id"]]) * 256) for r in mine])
        b = (held - s.astype(float) / n) @ axes[:, c] / np.sqrt(e[c])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
        assert mine[0]["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
        assert [r["deviation"] for r in mine] == [sum((n * int(v) - int(t)) ** 2 for v, t in zip(h, s, strict=True)) for h in held]


@pytest.mark.parametrize("live, make", [(2, lambda r: [r[0], r[1], r[0] + r[1], 7.0, 7.0]), (1, lambda r: [r[0]] * 5), (0, lambda r: [1.0, 2.0, 3.0, 4.0, 5.0])])
def test_components_without_variance_have_no_values(spark, live, make):
    rng = random.Random(2)
    got = whitened(spark, [(k, make([round(rng.uniform(-9, 9) * 64) / 64, round(rng.uniform(-1, 1) * 64) / 64])) for k in range(60)])
    assert len(got) == 240 and all((r["whitened"] is not None) == (r["component"] <= live) for r in got)
    assert all(r["identity_error"] < 1e-4 for r in got) and all(r["explained"] < 1e-9 for r in got if r["component"] > live)


def test_whitening_of_few_dimensions_and_of_nothing(spark):
    assert [(r["component"], r["whitened"] is None, r["n"]) for r in whitened(spark, [(1, [2.0]), (2, [3.0]), (2, [3.0])])] == [(1, False, 2)] * 3
    assert whitened(spark, []) == [] and whitened(spark, [(1, None), (2, [])]) == []


def test_deviations_are_exact_up_to_the_largest_long():
    y = np.array([[3 * 10**9, 5 * 10**8], [2 * 10**9, 1], [1, 2]])
    assert whitening.deviations(y).tolist() == [min(whitening.TOP, sum(int(v) ** 2 for v in r)) for r in y]
    big = whitening.offsets(np.array([[1 << 62, -3]]), 1000, (5, 7))
    assert big.tolist() == [[(1000 << 62) - 5, -3007]] and whitening.deviations(big).tolist() == [whitening.TOP]


# -- 12 ---------------------------------------------------------------------------------------
def plain_audit(rows, least=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mates = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in mates:
            whole.update(count[lang, s])

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        mine, q = p(count[lang, source]), p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(s, sum(f(mine[t], other[t]) for t in kept)) for s in mates if s != source for other in [p(count[lang, s])]]
        terms = [(t, f(mine[t], q[t])) for t in kept if count[lang, source][t] and mine[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def audited_rows():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("Be", "da", "Zo", "é", "ß", "一") for b in ("na", "li", "O'x", "ü", "kk")]
    rows = []
    for k in range(700):
        lang = rng.choice(["de", "en", None, ""])
        source = rng.choice(["hot"] * 10 + [f"s{j}" for j in range(20)] + [None, ""])
        most = 5 + hash_of(source) % len(vocabulary)
        rows.append((" ".join(rng.choice(vocabulary[:most]) for _ in range(rng.randrange(12))), lang, source))
    rows += [(None, "de", "silent"), ("", "de", "s1"), ("one two", "xx", "alone"), ("a", "yy", "b"), ("c", "yy", "d"), ("na " * 5000, "en", "s3")]
    return rows + rows[:3]


def hash_of(x):
    return int(hashlib.md5(str(x).encode()).hexdigest(), 16)


@pytest.mark.parametrize("band, strip", [(64, 4096), (5, 4)])
def test_audit_equals_plain_counting(spark, monkeypatch, band, strip):
    monkeypatch.setattr(divergence, "BAND", band)
    monkeypatch.setattr(divergence, "STRIP", strip)
    rows = audited_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit("clash"), "term": F.lit(1), "strip": F.lit(0)})
    got = divergence.audit(df.repartition(3)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_the_walk_skips_quadrants_that_are_empty_in_both():
    rng = np.random.default_rng(6)

    def tree(rows):
        cells = np.unique(rng.integers(0, [rows, 600], (90, 2)), axis=0)
        return divergence.Tree(rows, cells[:, 0], cells[:, 1], rng.integers(1, 9, len(cells)), 10), {tuple(c) for c in cells.tolist()}

    (a, in_a), (b, in_b) = tree(13), tree(9)
    reached = Counter(x for i, j, c in divergence.walked(a, b, False) for x in zip(i.tolist(), j.tolist(), c.tolist(), strict=True))
    want = {(i, j, c) for i in range(13) for j in range(9) for c in range(600) if (i, c) in in_a or (j, c) in in_b}
    assert set(reached) == want and set(reached.values()) == {1}
    once = {x for i, j, c in divergence.walked(a, a, True) for x in zip(i.tolist(), j.tolist(), c.tolist(), strict=True)}
    assert once == {(i, j, c) for i in range(13) for j in range(i + 1, 13) for c in range(600) if (i, c) in in_a or (j, c) in in_a}


def test_shares_stay_exact_with_many_words(spark):
    cases = [(0, 10, 3), (7, 10**13, 10**9), (10**13, 10**13 + 5, 12), (123_456_789_012, 987_654_321_098, 77)]
    got = spark.createDataFrame(cases, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v"))).collect()
    want = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    assert [r[0] for r in got] == want
    assert divergence.shares(np.array([c[0] for c in cases]), np.array([t + 2 * v for _, t, v in cases])).tolist() == want


# -- 13 ---------------------------------------------------------------------------------------
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items, span=12):
    windows = {(str(i) if i is not None else "", tuple(w[k : k + 10])) for i, t in items for w in [plain_words(t)] if w for k in range(max(1, len(w) - 9))}
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found, near = set(), set(), set()
        for item, terms in windows:
            for k in range(len(w) - len(terms) + 1):
                if tuple(w[k : k + len(terms)]) == terms:
                    found.add(item)
                    hit.update(range(k, k + len(terms)))
            if any(set(terms) <= set(w[k : k + span]) for k in range(len(w))):
                near.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit), len(near)))
    return sorted(out, key=str)


def search_cases():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["the"] * 30 + ["Ünï", "x1"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.randrange(8, 25))) for k in range(12)]
    items += [(3, prose(14)), (20, "the the the the the the the the the the the"), (21, "rare w1"), (22, "W1"), (23, None), (24, " .. "), (None, prose(11)), (25, items[0][1]), (26, "absent one two")]
    docs = [(k, prose(rng.randrange(0, 90))) for k in range(60)]
    for k in range(60, 90):
        passage = plain_words(rng.choice(items[:13])[1])
        if k % 3 == 1:  # words in another order, and one more between them
            passage = passage[:4] + ["extra"] + passage[5:6] + passage[4:5] + passage[6:]
        docs.append((k, prose(20) + "; " + ", ".join(passage).upper() + " - " + prose(9)))
    docs += [(100, None), (101, ""), (102, "the " * 3000), (103, "é" * 50), (5, docs[65][1]), (None, docs[66][1]), (104, items[0][1]), (105, " ".join(t for _, t in items[:12]))]
    return docs, items


@pytest.mark.parametrize("size, block", [(1 << 20, 200_000), (300, 17)])
def test_contamination_equals_plain_search(spark, size, block, monkeypatch):
    docs, items = search_cases()
    index = decontamination.index
    monkeypatch.setattr(decontamination, "index", lambda d: index(d, size=size))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"segment": F.lit("clash"), "ids": F.lit(1)}).repartition(2)
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0)).repartition(2)
    got = decontamination.contaminated(df, tests, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_hits(docs, items)


def test_contamination_of_and_by_nothing(spark):
    none, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contaminated(none, items).count() == 0
    assert sorted((r["doc_id"], r["n_hit"], r["contaminated"]) for r in decontamination.contaminated(docs, no_items).collect()) == [(1, 0, False), (2, 0, False)]
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontamination.contaminated(docs, items).collect()) == [(1, 2), (2, 0)]


def test_an_index_takes_several_tests(spark):
    docs, items = search_cases()
    held = decontamination.index(spark.createDataFrame(docs, "doc_id long, text string"), size=500)
    for part in (items[:5], items[5:]):
        tests = decontamination.windows(spark.createDataFrame(part, "item_id long, text string"))
        found = decontamination.matches(held, tests, span=20).where("NOT near").select("segment", "ord").distinct().count()
        assert found == sum(r[5] for r in plain_hits(docs, part))

