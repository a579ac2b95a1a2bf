import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paxcast.llm import op11_spelling as op

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def brute_words(docs, every=97):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    """All strings one edit away from the word."""
    for i in range(len(word) + 1):
        yield word[:i] + word[i + 1:]
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1:]


def brute(words):
    letters = {c for w in words for c in w}
    near = {w: ({v for v in edits(w, letters) if v in words} if len(w) < 1000 else {v for v in words if v in (w[:-1], w + w[-1], w + "x")}) - {w}
            for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = brute_words([(r.doc_id, r.text) for r in docs.collect()])
    assert len(words) > 300
    want = brute(words)
    assert sum(v[0] is not None for v in want.values()) > 5
    assert got(op.spelling_variants(docs, drop_every=97)) == want


def chains():
    """Words with chains of forms, ties, edits at both ends and repeated letters."""
    base = ["letter", "lettter", "leter", "letters", "xletter", "better", "aaaaa", "aaaaaa", "aaaab", "baaaa", "éclair", "éclaire",
            "eclair", "straße", "strasse", "strase", "ÿÿÿÿÿ", "ÿÿÿÿÀ", "abcdefghij", "abcdefghijk", "bcdefghij", "abcdXfghij".lower(), "zzzzz"]
    return {w: 3 + (7 * i * i) % 41 for i, w in enumerate(base)} | {"letters": 400, "letter": 200, "leter": 100, "lettter": 100}


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_blocks_of_any_size_find_the_same(spark, block):
    words = chains()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(op.variants(df, block=block)) == brute(words)
    assert got(op.variants(df, block=block))["leter"][:2] == ("letter", "letters")


def test_random_words_over_a_small_alphabet(spark):
    import random
    rng = random.Random(11)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randint(5, 9))): rng.randint(3, 40) for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(op.variants(df, block=64)) == brute(words)


def test_nulls_empty_long_ties_repeats_extra_columns(spark):
    long = "q" * 70_000
    rows = [(1, None), (2, ""), (None, "Wörter wörter wörter wörteR"), (3, f"{long} {long} {long} {long}x {long}x {long}x"),
            (4, "hello hello hello hallo hallo hallo hullo hullo hullo"), (4, "hello hello hello hallo hallo hallo hullo hullo hullo"), (5, "a×b÷c " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("word", "n", "tile", "root", "form")))
    want = brute(brute_words(rows))
    assert got(op.spelling_variants(clash, drop_every=97)) == want
    assert want["hello"][3] == 2 and want["hello"][0] is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.spelling_variants(docs).count() == 0
    assert op.spelling_variants(spark.createDataFrame([(1, "one two")], docs.schema)).count() == 0


def test_counts_survive_small_buffers(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    want = {r.word: r.n for r in op.count_words(docs).collect()}
    monkeypatch.setattr(op, "HELD_WORDS", 50)
    assert {r.word: r.n for r in op.count_words(docs).collect()} == want
