import hashlib

import corpus_pipeline
import public_tokenizers
import test_op7_minhash
import test_op8_packing
import test_op9_suffix
from pyspark.sql import functions as F

from paxcast.llm import op4_toxicity, op10_quality

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_take_effect_and_feed_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, DIR)
    kept = {r.doc_id for r in op10_quality.quality_rules(docs).where("kept").collect()}
    assert first.columns == COLUMNS and {r[0] for r in rows(first)} == kept and 0 < len(kept) < docs.count()

    second = stages["toxicity"](spark, first, DIR)
    model = op4_toxicity.train(first, spark.read.parquet(f"{DIR}/labels.parquet"))
    fine = {r.doc_id for r in op4_toxicity.score(first, model).where("predicted = 0").collect()}
    assert second.columns == COLUMNS and {r[0] for r in rows(second)} == fine

    third = stages["minhash_near_dedup"](spark, second, DIR)
    want = {r[0] for r in test_op7_minhash.brute(rows(second), corpus_pipeline.PERCENT, corpus_pipeline.WIDTH) if r[3]}
    assert sorted(third.columns) == sorted(COLUMNS) and {r[0] for r in rows(third)} == want

    fourth = stages["suffix_array_dedup"](spark, third, DIR)
    before = dict(rows(third))
    want = {r[0]: r[4] for r in test_op9_suffix.brute(rows(third))}
    assert sorted(fourth.columns) == sorted(COLUMNS) and len(rows(fourth)) == len(want)
    for doc_id, text in rows(fourth):
        if "�" not in text and len(text.encode()) == len(before[doc_id].encode()):
            assert hashlib.sha256(text.encode()).hexdigest() == want[doc_id]
    assert fourth.where(F.length("text") != F.col("n_chars")).count() == 0

    last = stages["packing"](spark, fourth, DIR)
    test_op8_packing.check(fourth.collect(), last.collect(), test_op8_packing.library())


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    got = corpus_pipeline.run(spark, DIR)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_defined_cases(spark):
    text = " ".join(f"word{i} and more" for i in range(40))
    docs = spark.createDataFrame(
        [(1, text, "en", None, 3), (1, text, "en", None, 3), (2, None, None, "s", None), (None, text + " tail", "en", "s", 1), (4, "", "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        table = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, DIR)
        assert {r.doc_id for r in table.collect()} == (set() if empty else {1})


def test_near_dedup_drops_true_repeats_only(spark):
    def text(seed, n=60):
        return " ".join(f"{seed}{i}" for i in range(n))

    table = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (7, text("d")),
             (None, text("e")), (None, text("e", 63)), (3, text("f")), (None, text("f", 63)), (None, ""), (None, None), (8, None), (8, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in table], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.minhash_dedup(spark, docs, DIR).select("doc_id", "text").collect()), key=str)
    (e,) = [r for r in got if (r[1] or "").startswith("e")]  # one of the near copies without an id
    assert e in table and got == sorted(
        [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), e, (3, text("f")), (None, ""), (None, None), (8, None)], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = " ".join(f"word{i} and more" for i in range(40))
JUNK = "spam spam " * 60


def test_a_verdict_holds_for_its_own_row(spark):
    docs = spark.createDataFrame([(None, PLAIN, "en", "s", 1), (None, JUNK, "en", "s", 1), (5, JUNK, "en", "s", 1), (5, PLAIN + " end", "en", "s", 1)], SCHEMA)
    got = corpus_pipeline.quality(spark, docs, DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, PLAIN), (5, PLAIN + " end")], key=str)


def test_columns_of_any_name_come_through(spark):
    names = ["spans", "_key", "_kept", "_row", "kept", "predicted", "component_id", "carried_0", "text_key", "row"]
    docs = spark.createDataFrame([(i, PLAIN + f" tail{i} " * (i + 1) * 30, "en", "s", 1) for i in range(3)], SCHEMA)
    docs = docs.select(*(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names), *docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    assert corpus_pipeline.packing(spark, docs, DIR).count() >= 3


def test_a_very_long_text_passes_whole(spark):
    long = " ".join(f"w{i}x{i * 7919 % 10007}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, PLAIN, "en", "s", 1)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    totals = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert totals == {1: len(test_op8_packing.library()(long)) + 1, 2: len(test_op8_packing.library()(PLAIN)) + 1}
