import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from tableferry.llm import bpe, hyperminhash, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that each stage got and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        out.append((docs, new))
        docs = new
    return out


def test_all_but_the_last_return_documents(spark, steps):
    for docs, new in steps[:-1]:
        assert new.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes and 0 < new.count() <= docs.count()


def test_quality_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"  # sf0.001 has eleven bad documents
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    new = corpus_pipeline.quality(spark, docs, sf).cache()
    good, bad = (docs.join(labels.where(f"quality = {q}"), "doc_id") for q in (1, 0))
    kept = lambda df: df.join(new.select("doc_id"), "doc_id", "left_semi").count() / max(1, df.count())
    assert kept(good) > 0.95 and kept(bad) < 0.3


def test_dedup_keeps_one_of_each_group(spark, steps):
    docs, new = steps[1]
    groups = hyperminhash.near_duplicates(docs, threshold=corpus_pipeline.NEAR).groupBy("component_id").count().count()
    assert new.count() == groups
    assert hyperminhash.near_duplicates(new, threshold=corpus_pipeline.NEAR).where("NOT kept").count() == 0


def test_dedup_equals_brute_force_at_four_fifths(spark):
    rows, want = [], []
    for family in range(24):
        n = 90 + 17 * family
        words = [f"w{family}x{k}" for k in range(n)]
        sets = []
        for copy in range(6):
            edited = [f"e{copy}" if k % (n // 8) == 3 and k // (n // 8) < copy * (1 + family % 2) else w for k, w in enumerate(words)]
            rows.append((10 * family + copy, " ".join(edited), "en", "s", 0))
            sets.append(set(zip(*(edited[k:] for k in range(5)), strict=False)))
        group = list(range(6))
        for _ in group:  # the least copy that links reach
            group = [min(group[j] for j in range(6) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in range(6)]
        want += [10 * family + k for k in range(6) if group[k] == k]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    strict = hyperminhash.near_duplicates(docs).where("kept").count()
    assert got == want and len(want) < strict


def test_personal_data_is_gone_and_clean_texts_stay(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2][0].collect()}
    after = {r["doc_id"]: r for r in steps[2][1].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (after[i]["text"] == text) == (not pii.all_spans(text))
        assert pii.all_spans(after[i]["text"]) == [] and after[i]["n_chars"] == len(after[i]["text"])


def test_mixture_thins_what_is_over_its_share_and_no_more(spark):
    text = "An article of some length on nothing much. " * 20
    rows = [(k, text, *(("en", "large") if k % 5 else ("de", "small")), len(text)) for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["source"]: r["count"] for r in corpus_pipeline.mixture(spark, docs, SF).groupBy("source").count().collect()}
    wanted = 2500 * 2000**0.7 / (2000**0.7 + 500**0.7)  # 1813: of the small one 687 are wanted, more than there are
    assert kept["small"] == 500 and abs(kept["large"] - wanted) < 50


def test_tokens_decode_to_the_texts(steps):
    codec = bpe.Codec(queries.rank_file(), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in steps[4][0].collect()}
    rows = steps[4][1].collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert codec.decode(bytes(r["ids"])).decode() == texts[r["doc_id"]]
        assert r["n_tokens"] == len(np.frombuffer(bytes(r["ids"]), "<u4"))


def test_odd_tables_pass_all_stages(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, weight string, kept string, score string"
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else "s", None, "w", "k", "s") for k, t in enumerate([None, "", "  ", "a b c", "a b c", "word " * 30_000, "x@y.org mail", "Plain words of a short note."] * 2)]
    for df in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
            docs = docs.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_applies_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[4][1].count()
