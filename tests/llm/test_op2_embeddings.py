import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.llm import op2_embeddings, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    n = len(rows)
    good = [l is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v, l in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                link[i, j] = link[j, i] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
    comp = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for k in np.flatnonzero(link[stack.pop()]):
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        comp[i] = min(rows[k][0] for k in seen)
    return sorted((rows[i][0], int(link[i].sum()), comp[i], comp[i] == rows[i][0]) for i in range(n))


def run(spark, rows):
    return sorted(tuple(r) for r in op2_embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("cell", [512, 8])
def test_made_up_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(op2_embeddings, "CELL", cell)
    monkeypatch.setattr(op2_embeddings, "BLOCK", 1024 if cell == 512 else 16)
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1):
        centers = rng.normal(size=(12, 8))
        for i in range(110):
            v = centers[i % 12] + rng.normal(size=8) * rng.choice([0.05, 0.12, 0.3])
            rows.append((label * 1000 + i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), label))
        rows += [(label * 1000 + 200 + i, rows[-1][1], label) for i in range(5)]
    want = brute(rows)
    assert len({r[2] for r in want}) not in (1, len(rows))
    assert run(spark, rows) == want


def test_defined_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [0.0, -0.0, 0.0], 1),
            (10, [1.0, None, 3.0], 1), (11, [float("nan")] * 3, 1), (12, [float("inf"), 1.0, 1.0], 1), (13, v + [0.0], 1), (14, [0.0, 0.0, 5.0], 1), (15, [-0.0, 0.0, 5.0], 1)]
    assert run(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1)], SCHEMA).withColumn("class_id", F.lit(0))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in op2_embeddings.near_duplicates(docs).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert op2_embeddings.near_duplicates(docs.limit(0)).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    name = "op2_embedding_range_join"
    want = sorted(con.execute(queries.ORACLES[name]).fetchall())
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").select("vec_id", "n_links", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == want
