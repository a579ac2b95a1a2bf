import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.llm import op9_suffix


def brute(rows, span=200):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i:i + span] for i in range(len(b) - span + 1))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - span + 1):
            if count[b[i:i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in op9_suffix.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(30, 120)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:a + rng.randrange(len(p))], prose(rng.randrange(50))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1][:-1]), (102, "x" + rows[4][1]), (103, rows[5][1] + rows[5][1]),
             (104, "a" * 700), (105, "a" * 199), (106, "a" * 200), (107, "ab" * 300), (108, ("line of text\n" * 40)), (109, None), (110, ""),
             (111, passages[0][:199]), (112, passages[0][:200] * 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(op9_suffix, "TASK_STRETCHES", 16)
        monkeypatch.setattr(op9_suffix, "LARGEST", 3)
    assert run(spark, made(seed)) == brute(made(seed))


@pytest.mark.parametrize("largest", [2, 40])
def test_an_anchor_in_most_stretches_is_split_by_context(spark, largest, monkeypatch):
    """One phrase stands in nearly every text, between shared and own surroundings."""
    monkeypatch.setattr(op9_suffix, "LARGEST", largest)
    monkeypatch.setattr(op9_suffix, "TASK_STRETCHES", 16)
    rounds = []
    cut = op9_suffix.cut_at_bands
    monkeypatch.setattr(op9_suffix, "cut_at_bands", lambda pieces, width, span: rounds.append(width) or cut(pieces, width, span))
    rng = random.Random(largest)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = "the very same phrase that stands in all of the texts, word for word"
    before, after = [own(170) for _ in range(3)], [own(170) for _ in range(3)]
    rows = []
    for i in range(150):
        a, b = rng.randrange(170), rng.randrange(170)
        rows.append((i, own(rng.randrange(200)) + rng.choice(before)[a:] + phrase + rng.choice(after)[:b] + own(rng.randrange(200))))
    rows += [(200, rows[5][1]), (201, "z" + rows[6][1] + "z"), (202, phrase * 9)]
    assert run(spark, rows) == brute(rows)
    assert rounds[:2] == [128, 64]


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op9_suffix.dedup_digests(docs).collect()) == brute(rows)


def test_defined_cases(spark):
    assert run(spark, [(1, "q" * 150), (2, None)]) == brute([(1, "q" * 150), (2, None)])
    text = " ".join(f"word{i}" for i in range(100))
    twice = spark.createDataFrame([(1, text), (1, text), (None, text + "!"), (4, "own " + text[::-1])], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_removed) for r in op9_suffix.dedup_digests(twice).collect())
    assert got == [(0, len(text)), (1, len(text)), (1, len(text)), (4, 0)]
    assert op9_suffix.dedup_digests(twice.limit(0)).count() == 0


def test_texts_keep_their_other_columns(spark):
    shared = "é" * 150
    rows = [(1, "a" + shared + "start", "en"), (2, "bb" + shared, "de"), (3, None, "fr")]
    got = {r.doc_id: (r.text, r.lang) for r in op9_suffix.dedup_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: ("astart", "en"), 2: ("bb", "de"), 3: (None, "fr")}


def test_column_rounds_on_random_strings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        span, n = 6, 12
        group = np.sort(rng.integers(0, 3, n))
        lead, count = rng.integers(0, 4, n), rng.integers(1, 5, n)
        core = bytes(rng.integers(97, 99, 20).astype(np.uint8))
        texts = [bytes(np.concatenate([rng.integers(97, 99, lead[i]).astype(np.uint8), np.frombuffer(core, np.uint8)]))[:count[i] + span - 1] for i in range(n)]
        count = np.array([len(t) - span + 1 for t in texts])
        got = op9_suffix.repeated_starts(group, texts, lead, count, span)
        for i in range(n):
            for s in range(count[i]):
                mine = texts[i][s:s + span]
                want = any(
                    j != i and group[j] == group[i] and 0 <= s - lead[i] + lead[j] < count[j] and texts[j][s - lead[i] + lead[j]:][:span] == mine
                    for j in range(n))
                assert got[i, s] == want
