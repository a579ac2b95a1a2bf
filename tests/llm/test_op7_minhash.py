import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.llm import graph, op7_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def brute(rows, percent=85, width=3):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def run(spark, rows):
    return sorted(tuple(r) for r in op7_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op7_minhash.near_duplicates(docs).collect()) == brute(rows)


def test_large_near_copy_group(spark, monkeypatch):
    """A threshold graph inside one group, larger than a bucket's pair list and a block."""
    monkeypatch.setattr(op7_minhash, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert len({r[2] for r in want}) > 1
    assert run(spark, rows) == want


def test_defined_cases(spark):
    rows = [(9, None), (8, ""), (7, " \n "), (6, "one"), (5, "ONE"), (4, "one two"), (3, "two one"), (2, "one two"), (1, "a b c"), (0, "A B C "),
            (20, "word " * 30000), (21, "word " * 30001)]
    assert run(spark, rows) == brute(rows)
    twice = spark.createDataFrame([(1, "a b c d")] * 2 + [(None, "a b c d"), (None, None)], "doc_id long, text string").withColumn("set_id", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in op7_minhash.near_duplicates(twice).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    assert op7_minhash.near_duplicates(twice.limit(0)).count() == 0


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(1)
    far = []
    for _ in range(200):
        values = rng.integers(0, 2**63, 1150, dtype=np.uint64)
        a, b = np.unique(values[:1075]), np.unique(np.concatenate([values[:1000], values[1075:]]))
        x, y = (np.frombuffer(op7_minhash.signature(s), np.uint8) for s in (a, b))
        far.append((x != y).sum())
    assert 5 < np.mean(far) < 12 and max(far) <= op7_minhash.DISTANCE


@pytest.mark.parametrize("n", [1, 5, 40])
def test_components_of_paths_and_stars(spark, n):
    path = [(i, i + 1) for i in range(n)]
    star = [(1000, 1001 + i) for i in range(n)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(path + star + [(7000, 7000)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, **{1001 + i: 1000 for i in range(n)}}
