import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paxcast.llm import op10_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


CASES = [None, "", " \n\t ", "a", "a\na\na\n\n b", "x y z # $ <b>", "é ü x   ñ\r\nq",
         " ".join("abcdefgh") + " " + " ".join("abcdefgh") + " tail", ("w " * 40).strip(), "l 1\nl 1\nl 2\n" * 9,
         "\n".join(["same line here"] * 3) + "\n", "\nstart", "word " * 60000]


def frame(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t in enumerate(texts)], SCHEMA)


def test_statistics_match_brute_force(spark):
    rows = op10_quality.quality_rules(frame(spark, CASES)).orderBy("doc_id").collect()
    got = [tuple(r)[1:6] for r in rows]
    assert got == [brute(t) for t in CASES]
    for r, t in zip(rows, CASES):
        n, _, _, _, rep = brute(t)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_statistics_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:6] for r in op10_quality.quality_rules(docs).collect()}
    assert got == want


def test_limits_adapt_to_the_group(spark):
    """The same text is normal in one source and rejected in another."""
    prose = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(80)]
    code = [" ".join(f"a{j} #$%& {i}" for j in range(30)) for i in range(80)]
    odd = " ".join(f"a{j} #$%& 5" for j in range(31))
    docs = frame(spark, prose + [odd], source="prose").unionByName(
        frame(spark, code + [odd], source="code").withColumn("doc_id", F.col("doc_id") + 1000))
    kept = {r.doc_id: r.kept for r in op10_quality.quality_rules(docs).collect()}
    assert not kept[80] and kept[1080]
    assert sum(kept.values()) == len(kept) - 1


def test_null_groups_ties_extra_columns_and_empty_table(spark):
    docs = frame(spark, ["some plain words " * 10] * 3, lang=None, source=None)
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    rows = op10_quality.quality_rules(docs).collect()
    assert len(rows) == 3 and rows[0].n_words == 30
    assert op10_quality.quality_rules(docs.limit(0)).count() == 0
    with_null_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert op10_quality.quality_rules(with_null_id).count() == 3


@pytest.mark.parametrize("tail", ["", "\n", " ", "\n\n"])
def test_line_ends(spark, tail):
    texts = ["one two\none two" + tail, "x" + tail]
    got = [tuple(r)[1:6] for r in op10_quality.quality_rules(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [brute(t) for t in texts]


def prose(i, n=60, length=4):
    return " ".join("".join(chr(97 + (i * 31 + j * 17 + k * 7) % 26) for k in range(length + (j + i) % 3)) for j in range(n))


PLANTED = {
    "mean_word, short": " ".join(chr(97 + (i * i * i + i // 26 * 5) % 25) for i in range(25)) + " " + " ".join(chr(65 + (i * 7) % 26) for i in range(26)),
    "mean_word, long": prose(3, length=30),
    "symbol_share": prose(5) + " # $ % | < > # $ % |",
    "dup_line_share": "\n".join([prose(7, 12), "short line here"] + [f"{prose(k, 4)}\nshort line here" for k in range(8, 14)]),
    "repeat_share": prose(9, 58) + " " + " ".join(prose(9, 58).split()[:8]),
    "echo_share": prose(11, 40) + " aa aa bb bb cc cc dd dd ee ee ff ff gg gg",
}


@pytest.mark.parametrize("rule", sorted(PLANTED))
def test_each_rule_rejects_what_the_base_rule_keeps(spark, rule):
    docs = frame(spark, [prose(100 + i, 50 + i % 30) for i in range(80)] + [PLANTED[rule]])
    got = {r.doc_id: r for r in op10_quality.quality_rules(docs).collect()}
    assert not got[80].base_failed and not got[80].kept
    assert all(r.kept for i, r in got.items() if i < 80)


def test_limits_differ_by_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = op10_quality.common.materialise(op10_quality.measure(docs))
    limits = op10_quality.limits(op10_quality.sketches(measured, 400), "own", 6.0).collect()
    for column in ("own_mean_word_low", "own_mean_word_high", "own_echo_share_high"):
        assert len({round(r[column], 6) for r in limits}) > len(limits) // 2


def test_good_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = op10_quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {x.quality: x.kept for x in r}
    assert share[1] > 0.99 and share[0] < 0.05
