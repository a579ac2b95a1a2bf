import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from paxcast.llm import bpe, op3_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


def texts():
    rng = random.Random(7)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "漢", "🙂", "'s", "'ll", "1", "23", ".", ",", " ", " ", "\x1c", "\x85", "<|endoftext|>", "\x00"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    return made + ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "aaaaaaaa", "a" * 5000, "ab" * 3000, " " * 4000, "\n" * 100 + "x",
                   "".join(rng.choice("abcdefgh") for _ in range(20000)), "don't we'll I'm 'S x's", "word, word. word\nword word"]


def test_ids_equal_the_library(reference, ranks):
    encode, decode = op3_bpe.encoder(ranks, P.PATTERN), op3_bpe.decoder(ranks)
    for text in texts():
        raw = encode(text)
        ids = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        assert ids == reference.encode_ordinary(text), text[:80]
        assert decode(ids) == text.encode()


def test_small_caches_change_nothing(reference, ranks):
    from paxcast.llm.pretoken import Encoder
    merge = bpe.Merger(ranks)
    encode = Encoder(P.PATTERN, lambda p: struct.pack(f"<{len(x := merge(p.encode()))}I", *x), limit=3)
    for text in texts()[:200]:
        assert list(struct.unpack(f"<{len(r := encode(text)) // 4}I", r)) == reference.encode_ordinary(text)


def test_many_texts_share_a_queue_and_caches(reference, ranks):
    from paxcast.llm.pretoken import BatchEncoder
    merge, calls = bpe.Merger(ranks).many, []

    def encode_pieces(pieces):
        calls.append(len(pieces))
        return merge([p.encode() for p in pieces])

    want = [struct.pack(f"<{len(ids)}I", *ids) for ids in map(reference.encode_ordinary, texts())]
    encode = BatchEncoder(P.PATTERN, encode_pieces)
    assert encode.many(texts()) == want and len(calls) <= 3
    learnt = sum(calls)
    assert encode.many(texts()) == want and sum(calls) == learnt
    small = BatchEncoder(P.PATTERN, encode_pieces, limit=20)  # turns over and over, both halves in use
    for at in range(0, len(want), 7):
        assert small.many(texts()[at:at + 7]) == want[at:at + 7]
    assert encode.many([]) == [] and encode.many(["", "a"])[0] == b""


def test_merger_equals_the_library_on_any_ranks():
    rng = random.Random(5)
    for _ in range(30):
        # tokens in any order: a longer one may rank before the parts it is made of
        made = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(40)}
        tokens = [bytes([b]) for b in range(256)] + sorted(made, key=lambda t: rng.random())
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        library = tiktoken.Encoding("made", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(50)] + [b"a" * 3000]
        got = bpe.Merger(ranks).many(pieces)
        assert [list(struct.unpack(f"<{len(r) // 4}I", r)) for r in got] == [library.encode_ordinary(p.decode()) for p in pieces]


def test_query_digests(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "a b"), (None, "a b")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 as n_tokens")
    got = sorted((tuple(r) for r in op3_bpe.encode_digests(both, PATH, P.PATTERN).collect()), key=str)
    want = []
    for r in both.collect():
        ids = reference.encode_ordinary(r.text or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert op3_bpe.encode_digests(both.limit(0), PATH, P.PATTERN).count() == 0


def test_general_interface_returns_ids(spark, reference):
    df = spark.createDataFrame([("k", "héllo wörld  x"), ("n", None)], "key string, body string")
    rows = {r.key: r for r in op3_bpe.encode(df, PATH, P.PATTERN, "key", "body").collect()}
    assert rows["k"].ids == reference.encode_ordinary("héllo wörld  x")
    assert bytes(rows["k"].decoded).decode() == "héllo wörld  x"
    assert rows["n"].ids == [] and bytes(rows["n"].decoded) == b""
