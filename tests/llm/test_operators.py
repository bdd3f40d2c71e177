import functools
import hashlib
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tableferry.llm import bpe, compaction, hyperminhash, kd_search, mixing, pii, pu_quality, queries, repeats, sketches, url_templates
from tableferry.llm.common import Bits, scratch_path
from tableferry.llm.shingling import powers

from .doubling import repeated_starts

DOCS = "doc_id long, text string"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(rnd, n):
    return " ".join(rnd.choice(LOREM) + str(rnd.randrange(50)) for _ in range(n))


def corpus():
    """Copies, near copies, nulls, empty, blank, short and very long texts, and repeated rows."""
    rnd = random.Random(5)
    base = [words(rnd, n) for n in (120, 300, 60, 40)]
    rows = [(1, base[0]), (2, base[0]), (3, base[0].replace("alpha", "ALPHA", 1)), (4, base[1])]
    rows += [(10 + k, " ".join(w if rnd.random() > 0.012 * k else "edit" + str(rnd.randrange(10**6)) for w in base[1].split())) for k in range(1, 12)]
    rows += [(30, None), (31, ""), (32, " \t\n "), (33, "one two"), (34, "one  TWO"), (35, "one two three four five"), (36, None), (37, "")]
    rows += [(40, words(rnd, 20_000)), (41, base[2]), (41, base[2]), (42, "x " + base[2] + " y"), (50, "é" * 500), (51, "ab" * 700), (52, base[3])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns({"node": F.lit(1), "h": F.lit("clash"), "score": F.lit(0.5), "kept": F.lit("x")}).repartition(3)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# -- 1 ----------------------------------------------------------------------------------------
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(300, 6)), 2, 0).round(2)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]  # each vector twice: ties
    rows += [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, []), (1500, [1.0, 2.0])]
    base = kd_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in kd_search.top_k(base, base.where("id % 100 = 0")).collect()}
    whole = np.floor(vectors * 1024).astype(np.int64)
    want = {}
    for q in range(0, 600, 100):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:10]
        want |= {(q, r + 1): (int(i), int(scores[i])) for r, i in enumerate(best)}
    assert got == want


def test_a_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(4000, 3)) * 100).astype(np.int32)
    tree = kd_search.build(np.arange(4000), vectors, leaf=50)
    best = kd_search.Best(np.arange(5), vectors[:5], 10)
    best.search(tree)
    for k in range(5):
        want = sorted((vectors.astype(np.int64) @ vectors[k])[np.arange(4000) != k])[-10:]
        assert sorted(best.scores[k]) == want
        assert kd_search.bounds(tree, best.queries)[k].max() >= best.scores[k].max()


def test_blocks_meet_all_shards(spark, monkeypatch):
    """Several blocks, shards and groups, with a shuffled join of the two."""
    monkeypatch.setattr(kd_search, "SHARD", 40)
    monkeypatch.setattr(kd_search, "BLOCK", 7)
    vectors = np.random.default_rng(8).integers(-50, 50, (900, 4))
    base = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in kd_search.top_k(base, base.where("id % 30 = 0")).collect()}
    want = {}
    for q in range(0, 900, 30):
        scores = vectors @ vectors[q]
        best = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:10]
        want |= {(q, r + 1): (int(i), int(scores[i])) for r, i in enumerate(best)}
    assert got == want


def test_large_components_score_exactly(spark):
    rng = random.Random(4)
    vectors = [[rng.choice([1, -1]) * rng.randrange(1 << 27) / 1024 for _ in range(5)] for _ in range(400)]
    vectors[7], vectors[8], vectors[9] = [1e300, -1e300, 0.0, 1.0, 2.0], [1e308] * 5, [3e6] * 5
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    base = kd_search.quantised(rows, "vec_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in kd_search.top_k(base, base.where("id % 100 = 0 OR id = 7")).collect()}
    whole = [[int(x) * 1024 if abs(x) > 1e9 else int(np.floor(x * 1024)) for x in v] for v in vectors]
    whole[8] = [int(1.7976931348623157e308)] * 5
    want = {}
    for q in (0, 7, 100, 200, 300):
        scores = [max(-kd_search.TOP, min(kd_search.TOP, sum(a * b for a, b in zip(v, whole[q], strict=True)))) for v in whole]
        best = [i for i in sorted(range(400), key=lambda i: (-scores[i], i)) if i != q][:10]
        want |= {(q, r + 1): (i, scores[i]) for r, i in enumerate(best)}
    assert got == want


def test_top_k_of_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "id long, v array<double>").selectExpr("id", "transform(v, x -> CAST(x AS INT)) AS v")
    assert [tuple(r) for r in kd_search.top_k(two, two.where("id = 0")).collect()] == [(0, 1, 7, 2)]
    assert kd_search.top_k(two.limit(0), two.limit(0)).count() == 0


# -- 2 ----------------------------------------------------------------------------------------
def test_edited_texts_and_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in sketches.edited_fingerprints(docs.where("doc_id <> 41")).collect()}
    texts = {i: t or "" for i, t in corpus() if i != 41}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        cut = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - cut] + texts[order[(k + 1) % len(order)]][:cut]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(texts[i])
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[4]["fingerprint"]
    assert rows[30]["fingerprint"] == rows[31]["fingerprint"] == ""
    cut = len(texts[40]) // 3
    a, b = (shingle_set(t) for t in (texts[40], texts[40][:-cut] + texts[37][:cut]))
    assert abs(rows[40]["near_edited"] - len(a & b) / len(a | b)) < 0.03
    assert sketches.edited_fingerprints(empty(spark)).count() == 0


def brute_sketch(text):
    """Hashes of the shingles below the bound, and the least, by a hash library."""
    chain = lambda hashes, seed=42: functools.reduce(lambda s, h: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), s), hashes, seed)
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    signed = {h - (1 << 64) if h >> 63 else h for h in (chain(hashes[k : k + 5]) for k in range(max(1, len(hashes) - 4)) if hashes)}
    return sorted({h for h in signed if h < -(1 << 63) + (1 << 61)} | set(sorted(signed)[:1]))


def test_fingerprints_equal_brute_force(spark, docs):
    hexed = lambda sketch: "".join(f"{h % (1 << 64):016x}" for h in sketch)
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
    rows = {r["doc_id"]: r for r in sketches.edited_fingerprints(docs.where("doc_id <> 41")).collect()}
    texts = {i: t or "" for i, t in corpus() if i != 41}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        cut = len(texts[i]) // 3
        own, edited = brute_sketch(texts[i]), brute_sketch(texts[i][: len(texts[i]) - cut] + after[:cut])
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (hexed(own), hexed(edited))
        assert rows[i]["near_edited"] == pytest.approx(like(own, edited)) and rows[i]["near_next"] == pytest.approx(like(own, brute_sketch(after)))
        assert rows[i]["kept_in_edited"] == pytest.approx(len({*own} & {*edited}) / len(own) if own else 1.0)


def test_sketches_merge(spark):
    rnd = random.Random(2)
    a, b = words(rnd, 600), words(rnd, 500)
    made = sketches.fingerprints(spark.createDataFrame([(1, a), (1, b), (2, a)], DOCS))
    one = {r["doc_id"]: set(r["sketch"]) for r in sketches.merged(made, "doc_id").collect()}
    assert one[2] < one[1]


def test_next_wraps_and_takes_nulls_last(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b")], DOCS)
    got = {r["doc_id"]: r["next"]["text"] for r in sketches.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {3: "b", 2: "a", 1: "n", None: "c"}


# -- 3 ----------------------------------------------------------------------------------------
def test_urls(spark):
    urls = [
        (1, "http://A.Example.NET/en/1?x"), (2, "https://m.example.net/de/2"), (3, "http://shop.example.com/de/x#y"), (4, "http://b.org/fr/"), (5, None), (6, "no scheme"),
        (7, "http://net"), (8, "http://x.com/a://b/c"), (9, "http://x.com"), (9, "http://x.com"), (10, "http://internet/"),
    ]
    rows = {r["page_id"]: r for r in url_templates.judge(spark.createDataFrame(urls, "page_id long, url string"), queries.URL_RULES).collect()}
    assert [rows[k]["rule"] for k in range(1, 11)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert (rows[1]["host"], rows[1]["path"], rows[1]["verdict"]) == ("a.example.net", "/en/1", "allow")
    assert (rows[5]["host"], rows[5]["path"]) == (rows[6]["host"], rows[6]["path"]) == ("", "")
    assert (rows[8]["host"], rows[8]["path"]) == ("x.com", "/a://b/c")
    assert url_templates.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_bad_templates_are_rejected_beyond_the_labels(spark):
    pages = [(k, f"http://h.com/{'spam' if k % 2 else 'news'}/{k}") for k in range(60)]
    labels = [(u, 1 if "spam" in u else 0) for k, u in pages if k < 40]
    got = url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), [], spark.createDataFrame(labels, "url string, bad int"))
    verdicts = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert all(verdicts[k] == ("block" if k % 2 else "allow") for k in range(60))


def test_templates_that_part_at_the_sixth_level(spark):
    pages = [(k, f"http://h.com/a/b/c/d/e/{'spam' if k % 2 else 'news'}/{k}/end") for k in range(60)]
    pages += [(60, "http://h.com/a/b"), (61, "http://h.com/a/b/c/d/e/f/g/h/i/j/k"), (62, "http://one.com/7/" + "x/" * 40), (63, "http://h.com")]
    labels = [(u, 1 if "spam" in u else 0) for k, u in pages[:40]]
    got = url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), [], spark.createDataFrame(labels, "url string, bad int"))
    rows = {r["page_id"]: r for r in got.collect()}
    assert all(rows[k]["verdict"] == ("block" if k % 2 else "allow") for k in range(60)) and len(rows) == 64
    assert [rows[k]["template"] for k in (0, 1)] == ["/a/b/c/d/e/news/*/end", "/a/b/c/d/e/spam/*/end"]
    assert [rows[k]["template"] for k in (60, 61, 62, 63)] == ["/a/b", "/a/b/c/d/e/f/g/h/i/j/k", "/*" + "/x" * 40, ""]


def test_many_children_become_a_wildcard(spark):
    rows = spark.createDataFrame([("h", f"/u/{hashlib.md5(str(k).encode()).hexdigest()[:6]}x/about", None) for k in range(80)], "host string, path string, bad int")
    assert {r["template"] for r in url_templates.templates(rows).collect()} == {"/u/*/about"}


def brute_templates(rows):
    """host and form to (template, n_labelled, n_bad, purity, rejected), by walking the tree of each host."""
    wild = re.compile(r"[0-9]+(\.[A-Za-z]+)?|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9A-Fa-f-]{16,}(\.[A-Za-z]+)?|.{65,}")
    forms = {}
    for host, path, bad in rows:
        form = tuple("*" if wild.fullmatch(s) else s for s in path.split("/") if s)
        c = forms.setdefault((host, form), [0, 0, 0])
        c[0] += 1
        c[1] += bad is not None
        c[2] += bad or 0
    at = {k: "" for k in forms}
    level, live = 0, set(forms)
    while live:
        nodes = {}
        for k in live:
            nodes.setdefault((k[0], at[k]), []).append(k)
        for k in list(live):
            if len(nodes[k[0], at[k]]) == 1 or len(k[1]) <= level:
                live.discard(k)
        for (host, node), held in nodes.items():
            held = [k for k in held if k in live]
            branches = {}
            for k in held:
                if k[1][level] != "*":
                    b = branches.setdefault(k[1][level], [0, 0, 0])
                    for x in range(3):
                        b[x] += forms[k][x]
            total = [sum(b[x] for b in branches.values()) for x in range(3)]
            for k in held:
                s = k[1][level]
                if s != "*":
                    n, seen, bad = branches[s]
                    others, rate = max(1, total[1] - seen), total[2] / max(1, total[1])
                    error = (rate * (1 - rate) * (1 / max(1, seen) + 1 / others)) ** 0.5
                    alike = seen > 0 and total[1] > seen and abs(bad / max(1, seen) - (total[2] - bad) / others) <= 1.96 * error
                    if alike or len(branches) > 24 and total[0] / len(branches) < 8:
                        s = "*"
                at[k] = f"{node}/{s}"
        level += 1
    out, own, nodes, hosts = {}, {}, {}, {}
    for k, (_, seen, bad) in forms.items():
        rest = k[1][at[k].count("/") :]
        at[k] += "".join(f"/{s}" for s in rest)
        for d, key in ((own, (k[0], at[k])), (nodes, (k[0], at[k].rpartition("/")[0])), (hosts, k[0])):
            c = d.setdefault(key, [0, 0])
            c[0] += seen
            c[1] += bad
    overall = sum(b for _, b in hosts.values()) / max(1, sum(n for n, _ in hosts.values()))
    for k in forms:
        n, bad = own[k[0], at[k]]
        parent = at[k].rpartition("/")[0]
        (host_n, host_bad), (node_n, node_bad) = hosts[k[0]], nodes[k[0], parent]
        rate = (host_bad + 4 * overall) / (host_n + 4)
        rate = (node_bad + 4 * rate) / (node_n + 4)
        purity = (bad + 4 * rate) / (n + 4)
        out[k[0], "/".join(k[1])] = (at[k], n, bad, round(purity, 9), (node_n if parent else n) >= 5 and purity >= 0.9)
    return out


def test_templates_equal_a_plain_walk(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(3000):
        host = rnd.choice(["a.org", "b.org", "c.net"])
        depth = rnd.randrange(6)
        path = "/" + "/".join(rnd.choice(["news", "spam", str(rnd.randrange(99)), "u" + str(rnd.randrange(60)), "x.html"]) for _ in range(depth))
        bad = None if host == "c.net" or rnd.random() < 0.3 else int(("spam" in path) == (rnd.random() < 0.97))
        rows.append((host, path + rnd.choice(["", "/"]), bad))
    got = url_templates.templates(spark.createDataFrame(rows, "host string, path string, bad int")).collect()
    want = brute_templates(rows)
    assert {(r["host"], r["form"]): (r["template"], r["n_labelled"], r["n_bad"], round(r["purity"], 9), r["rejected"]) for r in got} == want
    assert any(v[4] for v in want.values()) and len({v[0] for v in want.values()}) < len(want)
    assert not any(v[4] for (host, _), v in want.items() if host == "c.net")  # a host without labels


def test_rules_of_other_hosts_do_not_reach_a_host(spark):
    """A rule for all of a domain says nothing about its paths: pages of other hosts with the same paths stay."""
    pages = [(k, f"http://h{k}.net/es/{k}") for k in range(46)] + [(100, "http://good.edu/es/1"), (101, "http://good.edu/es/2")]
    pages += [(200 + k, f"http://shop.example.com/de/{k}") for k in range(30)] + [(300, "http://shop.example.com/en/1"), (301, "http://example.com/")]
    got = {r["page_id"]: r["verdict"] for r in url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), queries.URL_RULES).collect()}
    assert all(got[k] == "block" for k in [*range(46), *range(200, 230)])
    assert [got[k] for k in (100, 101, 300, 301)] == ["allow"] * 4


def test_labels_reach_pages_under_the_same_node(spark):
    pages = [(k, f"http://h.com/ads/{'ab'[k % 2]}{k}x/v") for k in range(60)] + [(60, "http://h.com/ads/new"), (61, "http://h.com/other"), (62, "http://i.com/ads/new")]
    labels = spark.createDataFrame([(u, 1) for _, u in pages[:50]] + [("http://h.com/other/y", 0)] * 9, "url string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), [], labels).collect()}
    assert [got[k] for k in (0, 55, 61, 62)] == ["block", "block", "allow", "allow"]


# -- 4 ----------------------------------------------------------------------------------------
def shingle_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(docs).collect()}
    assert got == brute_components(corpus())
    assert hyperminhash.near_duplicates(empty(spark)).count() == 0


def test_a_family_of_near_copies_equals_brute_force(spark):
    rnd = random.Random(8)
    base = words(rnd, 100).split()
    rows = [(k, " ".join(w if rnd.random() > rate else words(rnd, 1) for w in base)) for k in range(120) for rate in [rnd.random() * 0.06]]
    rows += [(500 + k, " ".join(base[: 100 - 3 * (k % 12)])) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)


def test_null_ids_link_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], DOCS)
    got = [tuple(r) for r in hyperminhash.near_duplicates(df).orderBy("doc_id").collect()]
    assert got == [(None, 2, None, True), (1, 2, 1, True)]


# -- 5 ----------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_pu_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right > 0.93


def test_the_risk_is_the_non_negative_one_and_its_slope_is_right():
    rnd = np.random.default_rng(3)
    p, u = rnd.normal(0.4, 1, (40, pu_quality.WIDTH)), rnd.normal(0, 1, (90, pu_quality.WIDTH))
    loss = lambda x, sign, w, b: np.mean([np.log1p(np.exp(-sign * (r @ w + b))) for r in x])
    signs = set()
    for prior, mean in ((0.3, 0.0), (0.9, 0.2)):  # the second: weights that find the positives too well
        w, b = rnd.normal(mean, 0.01, pu_quality.WIDTH), 0.2
        negative = lambda w, b: loss(u, -1, w, b) - prior * loss(p, -1, w, b)  # noqa: E731, B023
        whole = lambda w, b: prior * loss(p, 1, w, b) + negative(w, b)  # noqa: E731, B023
        value, gw, gb = pu_quality.risk(p, u, prior, w, b)
        below = negative(w, b) < 0
        signs.add(below)
        assert value == pytest.approx(prior * loss(p, 1, w, b) + max(0, negative(w, b)))
        of, to = (negative, -1) if below else (whole, 1)  # below zero the step goes back on the negatives' risk
        for k in (0, 7, pu_quality.WIDTH - 1):
            e = np.zeros(pu_quality.WIDTH)
            e[k] = 1e-5
            assert gw[k] == pytest.approx(to * (of(w + e, b) - of(w - e, b)) / 2e-5, abs=1e-7)
        assert gb == pytest.approx(to * (of(w, b + 1e-5) - of(w, b - 1e-5)) / 2e-5, abs=1e-7)
    assert signs == {True, False}


def test_quality_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (33, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = pu_quality.quality(docs, labels).collect()
    assert len(rows) == len(corpus()) and all(0 <= r["score"] <= 1 for r in rows)
    none = pu_quality.quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert pu_quality.quality(empty(spark), labels).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.4, 0.85])
def test_the_prior_is_that_of_a_known_mixture(share):
    rng = np.random.default_rng(int(share * 100))

    def rows(n, good):
        x = rng.normal(size=(n, pu_quality.WIDTH)).astype(np.float32)
        x[:, :4] += 1.5 if good else -1.0
        return x

    mixed = np.concatenate([rows(int(4000 * share), True), rows(4000 - int(4000 * share), False)])
    got = pu_quality.class_prior(rows(1500, True), rng.permutation(mixed))
    assert abs(got - share) < 0.08  # it errs upwards
    assert pu_quality.class_prior(rows(15, True), mixed) == 0.5


def test_positive_labels_alone_are_enough(spark):
    """Negative labels change nothing: they are never learnt from."""
    rnd = random.Random(12)
    texts = [words(rnd, 60) if k % 3 else "".join(rnd.choice("#$%&*0123") for _ in range(300)) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    ones = [(k, 1) for k in range(600) if k % 3 and k % 2]
    with_zeros = ones + [(k, 0) for k in range(600) if k % 3 == 0]
    models = [pu_quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (ones, with_zeros)]
    assert models[0].prior == models[1].prior and abs(models[0].prior - 2 / 3) < 0.1
    scores = models[0].scores(pu_quality.matrix(texts))
    assert all((s >= 0.3) == bool(k % 3) for k, s in enumerate(scores))


# -- 6 ----------------------------------------------------------------------------------------
def test_compaction_keeps_rows_and_versions(spark, docs):
    table = compaction.ShardedTable(spark, scratch_path(spark, "t"), docs.schema, target_bytes=1 << 20)
    for k in range(5):
        table.append(docs.where(F.col("doc_id") % 5 == k).repartition(2))
    before = table.manifest().count()
    version = table.compact()
    assert version == 6 and table.manifest().count() < before
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, table.read().collect())) == want == sorted(map(str, table.read(5).collect()))
    assert table.vacuum() == 0 and table.vacuum(hours=0) > 0
    assert sorted(map(str, table.read().collect())) == want


def test_a_version_is_committed_once(spark):
    df = spark.createDataFrame([(1, "a")], DOCS)
    table = compaction.ShardedTable(spark, scratch_path(spark, "t"), df.schema)
    assert table.read().count() == 0 and table.compact() == 0
    table.append(df)
    with pytest.raises(RuntimeError):
        table.commit(table.manifest(), after=0)
    assert table.append(df.limit(0)) == 2 and table.read().count() == 1


def test_of_two_writers_one_commits(spark):
    """Both read version 1, and one is too late; what a dead writer left is no version. Arrivals and merges wait for none."""
    df = spark.createDataFrame([(1, "a")], DOCS)
    root = scratch_path(spark, "t")
    table, other = (compaction.ShardedTable(spark, root, df.schema) for _ in range(2))
    table.append(df)
    first = table.manifest()
    table.append(df)
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit(first, after=1)
    table._versions.write("private-left", "{")
    assert other.append(df) == 3 and table.version() == 3 and table.read().count() == 3 and table.sound()


def test_what_arrives_while_others_commit_is_kept(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], DOCS).coalesce(1)
    root = scratch_path(spark, "t")
    table, other = (compaction.ShardedTable(spark, root, df.schema) for _ in range(2))
    for _ in range(4):
        table.append(df)
    staged, calls = compaction.ShardedTable._staged, []

    def slow(self, shards):
        out = staged(self, shards)
        if self is table and len(calls) < 2:
            calls.append(other.append(df))  # before each of the first two commits of the table
        return out

    monkeypatch.setattr(compaction.ShardedTable, "_staged", slow)
    assert table.append(df) > 5 and table.read().count() == 7
    calls.clear()
    assert table.compact() > 8 and table.read().count() == 9 and table.sound() and table.manifest().count() < 9
    calls.extend([0, 0])
    for _ in range(4):
        table.append(df)
    merge = compaction.ShardedTable._merge

    def beaten(self, paths, folder):
        merge(self, paths, folder)
        if self is table:
            other.compact()

    monkeypatch.setattr(compaction.ShardedTable, "_merge", beaten)
    with pytest.raises(RuntimeError, match="another writer"):
        table.compact()
    assert table.read().count() == 13 and table.sound()


def test_merges_fill_the_next_tier_and_names_may_clash(spark):
    """Three tiers: what one merge writes is the fourth shard of the next tier."""
    blob = lambda n: F.expr(f"array_join(transform(sequence(1, {n}), k -> md5(concat('{n}-', id, '-', k))), '')")
    rows = lambda n, k=0: spark.range(k, k + 1).select(F.col("id").alias("doc_id"), blob(n).alias("text"), F.lit("x").alias("arrival"), F.lit(1).alias("_arrival"), F.lit(2).alias("tier"))
    table = compaction.ShardedTable(spark, scratch_path(spark, "t"), rows(1).schema, target_bytes=1 << 30)
    for n in (1000, 4000, 16000):
        for k in range(4 if n == 1000 else 3):
            table.append(rows(n, k).coalesce(1))
    tiers = sorted(r["tier"] for r in table.manifest().collect())
    assert tiers == sorted(3 * [tiers[4]] + 4 * [tiers[0]] + 3 * [tiers[-1]]) and tiers[0] + 2 == tiers[4] + 1 == tiers[-1]
    assert table.compact() == 11
    assert table.manifest().count() == 1 and table.read().count() == 10 and table.sound()
    assert table.compact() == 11  # nothing is left to do
    both = table.append_all(rows(10).union(rows(10)), F.col("tier"))
    assert both == 12 and table.read().count() == 12 and table.read().columns == rows(1).columns


# -- 7 ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(queries.rank_file(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.rank_file()), special_tokens={})


def random_text(rnd):
    alphabets = ["abcdefghij klmnop'st", "ab", "éèç漢字かкир 12\n\t", "aeiou  .,!'s 😀", "0123456789 "]
    return "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(80)))


def test_codec_equals_the_library(codec, reference):
    rnd = random.Random(4)
    for text in [*(random_text(rnd) for _ in range(1500)), "<|endoftext|>", "x" * 5000]:
        ids = codec.encode(text)
        assert ids == np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert codec.decode(ids) == text.encode()


def test_prefixes_extend_from_any_place(codec, reference):
    """Last tokens filled in two parts equal those filled at once, and give the encoding of every prefix."""
    rnd = random.Random(5)
    for _ in range(60):
        piece = random_text(rnd).encode("utf-8")[:200]
        n, cut = len(piece), rnd.randrange(len(piece) + 1)
        once = codec.bpe.extend(piece, [-1] * (n + 1), 0, n)
        parts = codec.bpe.extend(piece, [-1] * (n + 1), 0, cut)
        assert codec.bpe.extend(piece, parts, cut, n) == once
        for k in range(1, n + 1, 7):
            assert codec.bpe.unwind(once, k) == reference._encode_single_piece(piece[:k])


def test_appends_and_edits(codec):
    rnd = random.Random(9)
    for _ in range(400):
        kept = bpe.Encoding(codec, random_text(rnd))
        for _ in range(4):
            a = rnd.randrange(len(kept.text) + 1)
            kept.edit(a, min(len(kept.text), a + rnd.randrange(6)), random_text(rnd)[:8])
            kept.append(random_text(rnd)[:5])
            assert kept.ids() == codec.encode(kept.text)


def test_round_trip_of_odd_rows(spark, docs, reference):
    rows = bpe.round_trip(docs, queries.rank_file(), public_tokenizers.PATTERN).collect()
    want = Counter((i, len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus())
    assert Counter(tuple(r)[:4] for r in rows) == want
    encoded = bpe.encode(docs, queries.rank_file(), public_tokenizers.PATTERN)
    assert encoded.columns == [*docs.columns, "ids"] and encoded.count() == len(corpus())
    assert bpe.round_trip(empty(spark), queries.rank_file(), public_tokenizers.PATTERN).count() == 0


# -- 8 ----------------------------------------------------------------------------------------
def brute_repeats(rows, length=repeats.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeats_equal_brute_force(spark, docs):
    rows = [r for r in corpus() if r[0] != 40]
    got = repeats.deduplicated(docs.where("doc_id <> 40"))
    found = got.collect()
    assert Counter(tuple(r)[:5] for r in found) == brute_repeats(rows)
    for r in found:  # the text that is left has the digest's bytes, but for characters cut in two
        assert r["n_kept"] == r["n_bytes"] - r["n_removed"]
        assert "\ufffd" in r["text"] or hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    assert repeats.deduplicated(empty(spark)).count() == 0


def test_repeats_at_every_offset(spark):
    rnd = random.Random(1)
    blob = lambda n: "".join(rnd.choice("abcdefghijklmnop é") for _ in range(n))
    rows = []
    for k in range(60):
        passage = blob(rnd.choice([380, 399, 400, 401, 450, 700, 1500]))
        rows += [(3 * k, blob(rnd.randrange(300)) + passage + blob(rnd.randrange(300))), (3 * k + 1, passage[rnd.randrange(40) :] + blob(rnd.randrange(9))), (3 * k + 2, blob(5) + passage + passage)]
    got = repeats.deduplicated(spark.createDataFrame(rows, DOCS))
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute_repeats(rows)


def test_sparse_ranks_equal_doubling_over_every_position(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    starts = repeated_starts(rows).groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
    want = {r["doc_id"]: repeats.removed_runs([(p, p) for p in r["at"]]) for r in starts.collect()}
    got = repeats.repeated_runs(repeats._keyed(rows.where("text IS NOT NULL"))).collect()
    assert want and {r["id"]: [(x["a"], x["b"]) for x in r["runs"]] for r in got} == want


def brute_passages(rows, length=50):
    """Runs of words that lie in windows which another document has too: their number and words, by document."""
    split = [(i, [w for w in re.split("[ \\t-\\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]) for i, t in rows]
    held = Counter(x for _, ws in split for x in {tuple(ws[k : k + length]) for k in range(len(ws) - length + 1)})
    out = Counter()
    for i, ws in split:
        hit = np.zeros(len(ws) + 2, int)
        for k in range(len(ws) - length + 1):
            if held[tuple(ws[k : k + length])] > 1:
                hit[k + 1 : k + 1 + length] = 1
        out[(i, int((np.diff(hit) == 1).sum()), int(hit.sum()))] += 1
    return out


def test_shared_passages_equal_brute_force(spark, docs):
    got = repeats.deduplicated(docs).select("doc_id", "n_passages", "n_passage_words").collect()
    assert Counter(map(tuple, got)) == brute_passages(corpus())
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = repeats.deduplicated(real).select("doc_id", "n_passages", "n_passage_words").collect()
    assert Counter(map(tuple, got)) == brute_passages([tuple(r) for r in real.collect()])


def test_passages_too_short_to_be_removed_are_told(spark):
    """Passages around 50 words and under 400 bytes, at every place, in other documents, twice in one, and in both."""
    rnd = random.Random(8)
    some = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(1000)) for _ in range(n)]
    rows = []
    for k in range(80):
        x = some(rnd.choice([40, 49, 50, 51, 52, 55, 60, 75]))
        there = [some(rnd.randrange(90)) + x + some(rnd.randrange(90)), some(5) + x + some(3) + x, some(200), some(7) + x[rnd.randrange(9) :] + some(1)]
        there.append(some(120) + (y := some(rnd.choice([60, 90]))) + some(k) + y)  # just within one document
        rows += [(5 * k + n, rnd.choice([" ", "\n", " \t"]).join(ws).replace("a", rnd.choice("aA"))) for n, ws in enumerate(there)]
    got = repeats.deduplicated(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    want = brute_passages(rows)
    assert Counter((r["doc_id"], r["n_passages"], r["n_passage_words"]) for r in got) == want
    assert sum(n > 0 for _, n, _ in want) > 100 and Counter(tuple(r)[:5] for r in got) == brute_repeats(rows)


def test_repeats_hold_one_worker_a_task(spark, docs, monkeypatch):
    """No stage has Python on both sides of a join: what filters documents is shuffled to the ranges, however few these are."""
    plans = []
    for name in ("_rank", "_left_over"):
        run = getattr(repeats, name)
        monkeypatch.setattr(repeats, name, lambda rows, *a, run=run, **b: plans.append(run(rows, *a, **b)) or plans[-1])
    repeats.deduplicated(docs.where("doc_id <> 40"))
    joined = [x for x in ("\n".join(df._jdf.queryExecution().executedPlan().toString() for df in plans)).split("MapInArrow") if "Join" in x]
    assert len(joined) == 5  # two for bytes, two for words, one for what is left
    assert all("SortMergeJoin" in x and "Broadcast" not in x for x in joined)


@pytest.mark.parametrize("kind", [repeats.BYTES, repeats.WORDS])
def test_repeats_hold_little_at_once(kind):
    """Arrays of one task over 4 MB of texts: they follow the piece that is worked on, not the batch."""
    rnd = random.Random(2)
    texts = [words(rnd, 300) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(texts)], names=["id", "h", "text"])

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = repeats._rank(Rows(), kind, 0)
    powers.cache_clear()
    tracemalloc.start()
    ranges = sum(x.num_rows for x in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ranges > 10_000 and most < 32 << 20


def test_bits_miss_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = Bits(keys.union(keys))
    assert keys.where(bits.test("k")).count() == 5000
    others = spark.range(5000, 50_000).select(F.xxhash64("id").alias("k"))
    assert others.where(bits.test("k")).count() < 45_000 / 8
    assert Bits(keys.limit(0)).may_hold(np.arange(9)).sum() == 0


# -- 9 ----------------------------------------------------------------------------------------
def base_rule(text):
    out = []
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for kind, rule in rules:
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            if kind == "card":
                total = sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d)))
                if not 16 <= len(d) <= 19 or total % 10:
                    continue
            out.append((kind, *m.span()))
    return out


def test_plain_spans_equal_the_rules():
    rnd = random.Random(6)
    pieces = ["a@b.c", "@", ".", "1", "255", "256", "4111 1111 1111 1111", "+1 (555) 010-9999", "+", " ", "-", "x_y", "%", "é", "10.0.0.1", "0001.2.3.4", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(14)))
        assert pii.plain_spans(text) == base_rule(text), text


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write to ann.lee (at) mail dot example dot com today", "email", "ann.lee (at) mail dot example dot com"),
        ("bob at example dot org.", "email", "bob at example dot org"),
        ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
        ("tel plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
        ("host １９２.168.0.1 up", "ip", "１９２.168.0.1"),
        ("card four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
        ("escribe a ana arroba correo punto es hoy", "email", "ana arroba correo punto es"),
        ("écrire à luc arobase exemple.fr merci", "email", "luc arobase exemple.fr"),
        ("an max (ät) beispiel punkt de bitte", "email", "max (ät) beispiel punkt de"),
        ("an max at beispiel punkt de bitte", "email", "max at beispiel punkt de"),
        ("mail john @ example . com now", "email", "john @ example . com"),
        ("ruf plus vier neun eins fünf eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun eins fünf eins zwei drei vier fünf sechs sieben"),
        ("tel +33 un deux trois quatre cinq six sept huit neuf fin", "phone", "+33 un deux trois quatre cinq six sept huit neuf"),
        ("tel +34 nueve uno dos tres cuatro cinco seis siete ocho.", "phone", "+34 nueve uno dos tres cuatro cinco seis siete ocho"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    spans = pii.all_spans(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in spans
    assert part not in pii.redacted_text(text)


@pytest.mark.parametrize("text", ["look at the dot on it", "we met at noon, one or two of us", "version two dot zero", "at five or six", "Straße über · den Fluß", "le point final. un deux trois", "see john @ work . Come soon", "Er sah ihn at home . It rained", "uno punto dos", "look at example.com now", "am Punkt null eins sieben", "x 5 Un autre"])
def test_clean_texts_have_no_spans(text):
    assert pii.all_spans(text) == [] and pii.redacted_text(text) == text


@pytest.mark.parametrize(
    "text, span",
    [
        ("call plus 49 151 23456789 now", "phone:5:25"),
        ("ip 192.168.0.one", "ip:3:16"),
        ("card 4111 1111 1111 111 one", "card:5:27"),
        ("tel +one 555 010 9999", "phone:4:21"),
        ("tel +4 nine 151 2345678", "phone:4:23"),
        ("tel:\n+4 nine 151 2345678", "phone:5:24"),
        ("tel +1 (848) 555-1373 Un autre", "phone:4:21"),
        ("card (four one 11 1111 1111 1111)", "card:6:32"),
        ("bob at example dot museum", "email:0:25"),
        ("bob at example dot se", "email:0:21"),
        ("ip 192.168.0.\u017fix", "ip:3:16"),
    ],
)
def test_single_disguises_pass_the_gate(text, span):
    assert span in pii.joined(pii.all_spans(text)).split(",")


def test_the_gate_passes_all_that_is_rewritten(monkeypatch):
    rnd = random.Random(8)
    pieces = [*pii.SPELLED, *map(str.upper, pii.SPELLED), *"0123456789", "plus", "Plus", "+", " at ", "(at)", "[ @ ]", "{AT}", " dot ", "DOT", "(dot)", " @ ", " . ", "arroba", "ÄT", "klammeraffe", " punto ", ".es", "<punkt>", "[punto]", "point", ".", "@"]
    pieces += [" ", " ", " ", "\t", "-", ", ", "\n", "(", ")", "x", "bob", "example", "com", "se", "4111 1111 1111 111", "192.168.0.", "+49 151 234567", "\u200b", "\u00ad", "\u00a0", "\u0435", "\uff11", "\u017fix", "f\u0130ve", "\u00e9"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 9))) for _ in range(60_000)]
    gated = [pii.all_spans(t) for t in texts]
    changed = [pii.Rewritten(t).text != t for t in texts]
    assert all(pii.disguised(t) for t, c in zip(texts, changed, strict=True) if c) and 0.3 < sum(changed) / len(texts) < 1
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    assert gated == [pii.all_spans(t) for t in texts]


def test_pii_of_odd_rows(spark, docs):
    rows = pii.detect(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in corpus())
    assert {r["spans"] for r in rows} == {""}
    kept = pii.redact(docs)
    assert kept.schema == docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert pii.detect(empty(spark)).count() == 0


# -- 10 ---------------------------------------------------------------------------------------
def test_raking_meets_the_margins(spark):
    rows = [(s, lang, t, 100 + 13 * i + 7 * j + 3 * k, 1) for i, s in enumerate("abc") for j, lang in enumerate(["en", "de"]) for k, t in enumerate(["x", "y"])]
    cell = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long, n_docs long")
    shares = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"en": 0.6, "de": 0.4}, {"x": 0.7, "y": 0.3}]
    targets = [spark.createDataFrame(list(s.items()), "value string, share double") for s in shares]
    got = mixing.raked(cell, targets).collect()
    total = sum(r["weight"] for r in got)
    assert abs(total - sum(r[3] for r in rows)) < 1e-6 * total
    for m, s in zip(("_source", "_lang", "_topic"), shares, strict=True):
        for v, share in s.items():
            assert abs(sum(r["weight"] for r in got if r[m] == v) / total - share) < 1e-4
    # the same fit by plain arrays
    w = {r[:3]: float(r[3]) for r in rows}
    for _ in range(200):
        for d, s in enumerate(shares):
            sums = Counter()
            for key, x in w.items():
                sums[key[d]] += x
            w = {key: x * s[key[d]] * total / sums[key[d]] for key, x in w.items()}
    assert all(abs(r["weight"] - w[(r["_source"], r["_lang"], r["_topic"])]) < 1e-6 * total for r in got)


def test_mixing_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, weight string"
    rows = [(k, None if k % 7 == 0 else "word " * (k % 9), None if k % 5 == 0 else "en", None if k % 11 == 0 else f"s{k % 3}", k, "own") for k in range(200)]
    out = mixing.mixed(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 200 and all(0 <= r["chance"] <= 1 for r in out)
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    extra = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("ratio", "row", "_source", "cell", "n_docs", "tokens", "off", "now", "given", "share_lang")})
    clash = mixing.mixed(extra)
    assert clash.columns == [c for c in extra.columns if c not in mixing.ADDED] + list(mixing.ADDED)
    assert sorted((r["doc_id"], r["chance"], r["kept"]) for r in clash.collect()) == sorted((r["doc_id"], r["chance"], r["kept"]) for r in out)


def test_raking_ends_when_the_margins_are_met_or_cannot_be(spark, monkeypatch):
    cells = [("a", "en", "x", 50, 1), ("a", "de", "x", 10, 1), ("b", "en", "x", 40, 1), ("c", "fr", "x", 5, 1)]
    cell = spark.createDataFrame(cells, "_source string, _lang string, _topic string, tokens long, n_docs long")
    target = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    writes = []
    monkeypatch.setattr(mixing, "written", lambda df, name, keep=mixing.written: writes.append(name) or keep(df, name))
    own = [target(d) for d in ({"a": 60 / 105, "b": 40 / 105, "c": 5 / 105}, {"en": 90 / 105, "de": 10 / 105, "fr": 5 / 105}, {"x": 1.0})]
    met = mixing.raked(cell, own)
    assert all(abs(r["weight"] - r["tokens"]) < 1e-9 for r in met.collect()) and len(writes) == 3  # one round
    torn = [target({"a": 0.5, "b": 0.25, "c": 0.25, "nowhere": 9.0}), target({"en": 0.9, "de": 0.1}), target({"x": 1.0})]
    got = mixing.raked(cell, torn, most=5)  # source c has only language fr, which is asked to have nothing
    assert len(writes) == 3 + 2 + 5 and all(r["weight"] >= 0 for r in got.collect())


def test_rare_cells_do_not_set_the_rate(spark):
    rows = [(k, "w " * 400, "en", "big") for k in range(990)] + [(k, "w " * 400, "en", "rare") for k in range(990, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shares = [{"big": 0.98, "rare": 0.02}, {"en": 1.0}, {"article": 1.0, "note": 1.0}]
    targets = [spark.createDataFrame(list(s.items()), "value string, share double") for s in shares]
    strict, loose = (mixing.mixed(docs, targets=targets, short=x).groupBy("source").agg(F.min("chance").alias("c")).collect() for x in (0.0, 0.05))
    assert {r["source"]: round(r["c"], 3) for r in strict} == {"big": round(0.98 / 0.99 / 2, 3), "rare": 1.0}
    assert {r["source"]: round(r["c"], 3) for r in loose} == {"big": 1.0, "rare": 1.0}


def test_other_cells_make_up_for_those_that_have_too_little(spark):
    cells = [("a", "en", "x", 1000, 1), ("a", "de", "x", 10, 1), ("b", "en", "x", 1000, 1), ("b", "de", "x", 1000, 1)]
    cell = spark.createDataFrame(cells, "_source string, _lang string, _topic string, tokens long, n_docs long")
    target = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = [target({"a": 0.45, "b": 0.55}), target({"en": 0.5, "de": 0.5}), target({"x": 1.0})]
    free = mixing.raked(cell, targets)
    assert max(r["weight"] / r["tokens"] for r in free.collect()) > 2 and mixing.residual(free) < 1e-5
    held = mixing.raked(free.select("_source", "_lang", "_topic", "tokens", "n_docs", "weight"), targets, held=1.6)
    assert max(r["weight"] / r["tokens"] for r in held.collect()) < 1.6 + 1e-9 and mixing.residual(held) < 1e-5
    never = mixing.raked(free.select("_source", "_lang", "_topic", "tokens", "n_docs", "weight"), targets, held=1.2)
    assert mixing.residual(never) > 0.01  # b can't give so much: rounds end all the same


def test_given_tokens_count(spark):
    rows = [(k, "word", "en", "ab"[k % 2], 1 + k % 2) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    targets = [spark.createDataFrame([("a", 0.5), ("b", 0.5)], "v string, share double"), spark.createDataFrame([("en", 1.0)], "v string, share double"), spark.createDataFrame([("list", 1.0), ("note", 1.0)], "v string, share double")]
    out = mixing.mixed(docs, targets=targets, tokens="n").collect()
    assert {r["source"]: round(r["chance"], 6) for r in out} == {"a": 1.0, "b": 0.5} and max(r["residual"] for r in out) < 1e-6


# -- queries ----------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    from ..oracle import oracle, rows_of

    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows_of(df.columns, df.collect()) == oracle(queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_all_operators_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert os.path.exists(public_tokenizers.path(queries.RANK_FILE))
