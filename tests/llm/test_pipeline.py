"""Every stage against a plain version on its own input."""

import zlib
from collections import Counter

import corpus_pipeline
import pytest
import tiktoken
from helpers import AWKWARD, SF, docs, read
from pyspark.sql import functions as F
from signals.llm import bpe, language, toxicity
from signals.llm.common import fold
from test_minhash import brute

JUNK = "xqzj wvkqx zzjqw kxvbq jwqzx qvkjz xwzqk vjqxz qkzwj zxvqk " * 3


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input rows, output frame)] of all stages, each written and read again."""
    df, out = read(spark, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, df, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, df, after))
        df = after
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "language_id", "near_dedup", "mix_sources", "byte_bpe"]
    assert all(set(after.columns) == {"doc_id", "text", "lang", "source", "n_chars"} for _, _, after in stages[:-1])


def test_decisions_take_effect(spark, stages):
    _, before, after = stages[0]
    rejected = {r["doc_id"] for r in toxicity.tag(before, toxicity.fit(before, read(spark, "labels"))).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - rejected
    _, before, after = stages[1]
    judged = language.identify(before, language.fit(before)).collect()
    keep = {r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {r["doc_id"] for r in after.collect()} == keep
    _, before, after = stages[2]
    want = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, x in want.items() if x[2])
    _, before, after = stages[3]
    n = Counter(r["doc_id"] for r in after.collect())
    assert set(n) <= {r["doc_id"] for r in before.collect()} and max(n.values()) > 1


def test_toxic_documents_go(spark):
    """On a table with enough toxic documents to learn from (sf0.001 has nine)."""
    sf = "/root/testdata/sf0.01"
    before = read(spark, "documents", sf)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, before, sf).select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, "labels", sf).collect()}
    toxic = [i for i, t in labels.items() if t]
    clean = [i for i, t in labels.items() if not t]
    assert sum(i not in kept for i in toxic) > 0.6 * len(toxic) and sum(i in kept for i in clean) > 0.98 * len(clean)


def test_encoded(stages):
    ranks, pattern = bpe.default_vocabulary()
    lib = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    _, before, after = stages[-1]
    rows = after.collect()
    assert len(rows) == before.count()
    assert all(r["token_ids"] == lib.encode_ordinary(r["text"]) and r["round_trip"] for r in rows)


def test_run_equals_the_stages(spark, stages):
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter(r["doc_id"] for r in stages[-1][2].collect())


def test_awkward_and_empty_tables_pass_every_stage(spark):
    ids = [*range(len(AWKWARD) - 2), None, None]
    for df in (docs(spark, AWKWARD, ids=ids, sources=[None, *["s"] * (len(AWKWARD) - 1)]), docs(spark, [])):
        for name, f in corpus_pipeline.STAGES:
            df = f(spark, df, SF)
            assert df.count() >= 0
    assert corpus_pipeline.drop_unknown_language(spark, docs(spark, ["the cat is here"] * 9 + ["", None, "123"]), SF).count() == 9


def test_texts_in_unlearned_languages_go(spark):
    """Rows without a language teach nothing; the learned languages' held-out documents stay."""
    sf = "/root/testdata/sf0.01"
    d = read(spark, "documents", sf).where("text rlike '\\\\p{L}'")
    for foreign in ("fr", "en"):
        before = d.withColumn("lang", F.when(F.col("lang") != foreign, F.col("lang")))
        before = before.unionByName(docs(spark, [JUNK, JUNK.upper()], ids=[-1, -2], langs=[None, None]))
        kept = {r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, before, sf).select("doc_id").collect()}
        rows = d.select("doc_id", "lang", (fold("doc_id", 4) == 2).alias("held_out")).collect()
        gone = [r["doc_id"] not in kept for r in rows if r["lang"] == foreign]
        assert sum(gone) > 0.95 * len(gone)
        assert all(r["doc_id"] in kept for r in rows if r["lang"] != foreign and r["held_out"])
        assert not {-1, -2} & kept
    one = docs(spark, ["the cat is here", "a cat is there"] * 9 + [JUNK], langs=["en"] * 18 + [None])
    assert corpus_pipeline.drop_unknown_language(spark, one, sf).count() == 18


def test_without_a_language_to_learn_documents_with_letters_stay(spark):
    texts = ["some text", "é", "漢字", "", None, "0123 !!!"]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2][:6]
    for df in (docs(spark, texts, langs=[None] * 6), docs(spark, texts, ids=held)):
        assert language.fit(df) is None
        assert [r["text"] for r in corpus_pipeline.drop_unknown_language(spark, df, SF).orderBy("doc_id").collect()] == texts[:3]
