import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.llm import op12_secrets as op


def base(text):
    """The base spans, straight from the patterns' wording."""
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(f"({key})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def digest(text):
    spans = base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return tuple(sum(k == kind for k, *_ in spans) for kind in op.KINDS[:3]) + (hashlib.sha256(joined.encode()).hexdigest(),)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def results(df):
    rows = {r.doc_id: r for r in op.secret_digests(df).collect()}
    return {k: ((r.n_assign, r.n_access, r.n_hex, r.base_sha256), [s for s in r.spans.split(",") if s]) for k, r in rows.items()}


HARD = [None, "", "token=secret:longvalue1", "PassWord : 'abcdefgh' passwd='short'", "apikey==abcdefg api_key = \"=abcdefgh", "ſecret=abcdefgh1 toKen=abcdefgh1",
        "é😀 token: 12345678é AKIAABCDEFGHIJKL AKIAAKIA AKIAAKIAABCDEFGH12", "ab" * 16 + "g" + "ab" * 15 + "a", "AKIA" + "0" * 40 + " token=" + "0123456789abcdef" * 3,
        "secret\n=abcdefgh secret=\nabcdefgh", "my_token_secret:abcdefghi", "x" * 100_000 + " token=abcdefgh"]


def test_base_spans_of_hard_texts(spark):
    found = results(frame(spark, HARD))
    for i, text in enumerate(HARD):
        assert found[i][0] == digest(text), text[:60]
        kept = [s for s in found[i][1] if not s.startswith("markov")]
        assert kept == [f"{k}:{a}:{b}" for k, a, b in base(text)]


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with secrets of kinds that the patterns don't know."""
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    texts, where = [r.text or "" for r in docs], {}
    for i in range(0, 400, 10):
        raw = rng.randbytes(30)
        value = (base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), base64.b32encode(raw).decode())[i // 10 % 3]
        texts[i] = "see é " + value + " end. " + texts[i]
        where[i] = (6, 6 + len(value))
    return texts, where, results(frame(spark, texts))


def test_every_base_span_of_documents_is_kept(planted):
    texts, _, found = planted
    for i, text in enumerate(texts):
        assert found[i][0] == digest(text)
    assert sum(f[0][0] + f[0][2] for f in found.values()) > 10


def test_models_find_other_random_strings_and_leave_words_alone(planted):
    texts, where, found = planted
    hits = 0
    for i, (a, b) in where.items():
        hits += any(int(s.split(":")[1]) < b - 8 and int(s.split(":")[2]) > a + 8 for s in found[i][1] if s.startswith("markov"))
    assert hits >= 0.95 * len(where)
    others = [texts[i][int(a):int(b)] for i in range(len(texts)) if i not in where for k, a, b in (s.split(":") for s in found[i][1]) if k == "markov"]
    assert len(others) <= 0.01 * len(texts)
    assert not [o for o in others if o.isalpha() and o.islower()]


def test_segments_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        values = np.round(rng.normal(size=rng.integers(1, 14)), 3)

        def maximal(a, b):
            """The best segments of [a, b), each the best of what the others leave."""
            best = max(((values[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return [*maximal(a, i), (i, j), *maximal(j, b)]

        assert [(a, b) for a, b, _ in op.scored_segments(values)] == maximal(0, len(values))


def test_model_counts_are_those_of_the_samples(spark):
    df = frame(spark, ["token=abcdefgh ordinaryword other", "plainwords AKIAABCDEFGHIJKL", "short é"])
    total = op.scan(df).where("random is not null").agg(F.sum("n_random").alias("r"), F.sum("n_ordinary").alias("o")).first()
    assert (total.r, total.o) == (2, 2)
    matrices = [np.frombuffer(r.ordinary, np.int64) for r in op.scan(df).where("random is not null").collect()]
    assert sum(matrices).sum() == len("ordinaryword") + 1 + len("plainwords") + 1


def test_empty_table_nulls_repeats_and_extra_columns(spark):
    docs = frame(spark, ["token=abcdefgh1"]).withColumn("spans", F.lit(1)).withColumn("row", F.lit("r")).withColumn("kind", F.lit(None).cast("int"))
    assert op.secret_digests(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    rows = op.secret_digests(twice).collect()
    assert len(rows) == 2 and rows[0].spans == "assign:0:15" and rows[0].doc_id is None
