import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.llm import eliasfano, op1_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), "</s>"]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows, mass=200.0):
    """The base score and the unquantised model, with words in place of hashes."""
    single, pairs, starts = Counter(), Counter(), 0
    for doc_id, text in rows:
        if not held_out(doc_id):
            t = tokens(text)
            single.update(t)
            pairs.update(zip(["<s>", *t], t))
            starts += 1
    n, v = sum(single.values()), len(single)
    once, twice = (sum(c == k for c in single.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    p = lambda w: max(single[w] - d, 0) / n + d * v / n / (v + 1) if n else 1.0
    out = []
    for doc_id, text in rows:
        t = tokens(text)
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t)
        score = sum(
            math.log10((pairs[u, w] + mass * p(w)) / ((starts if u == "<s>" else single[u]) + mass)) for u, w in zip(["<s>", *t], t))
        out.append((doc_id, held_out(doc_id), len(t), sum(single[w] > 0 for w in t), n, base, score))
    return out


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3, abs=0.05)


def test_documents_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    compare(op1_lm.score(docs).collect(), want)
    held = [w for w in want if w[1]]
    assert sum(w[6] for w in held) > sum(w[5] for w in held)
    monkeypatch.setattr(op1_lm, "BLOCK_TOKENS", 2000)
    compare(op1_lm.score(docs, shard_tokens=3000).collect(), want)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "The the THE"), (3, "The the THE"), (None, "the end"), (5, "unseen"), (6, "x " * 50000), (7, "a\x1cb é É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    compare(op1_lm.score(docs).collect(), brute(rows))
    assert op1_lm.score(docs.limit(0)).count() == 0
    only = next(i for i in range(100) if held_out(i))
    alone = spark.createDataFrame([(only, "no training rows")], "doc_id long, text string")
    row = op1_lm.score(alone).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (4, 0, 0, 0.0) and row.score == pytest.approx(0.0)


def test_elias_fano_finds_what_it_holds():
    rng = np.random.default_rng(3)
    for n, highs in ((0, 5), (1, 1), (50, 7), (3000, 400), (5000, 3)):
        high = np.sort(rng.integers(0, highs, n))
        low = rng.integers(0, 1 << 47, n, dtype=np.uint64)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        levels = eliasfano.Mapped({"x": eliasfano.encode(high, low, highs)}).levels["x"]
        first, beyond = eliasfano.children(levels, np.arange(highs))
        assert (first == np.searchsorted(high, np.arange(highs))).all() and (beyond == np.searchsorted(high, np.arange(highs), side="right")).all()
        if n:
            assert (eliasfano.find(levels, high, low) == np.arange(n)).all()
            assert (eliasfano.find(levels, high, low + np.uint64(1)) < 0).sum() >= n - 5


def test_quantised_values_stay_close():
    values = np.random.default_rng(1).normal(size=20_000)
    q = op1_lm.quantised(values, np.ones(len(values)))
    assert q["code"].dtype == np.uint8 and np.abs(q["book"][q["code"]] - values).mean() < 0.02 and np.abs(q["book"][q["code"]] - values).max() < 0.1
