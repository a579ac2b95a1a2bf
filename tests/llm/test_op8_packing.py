import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paxcast.llm import op8_packing

PATH = P.path("byte_bpe_50k.json")


def library(special_as_text=False):
    """The untouched library, unless special tokens are to be text."""
    t = Tokenizer.from_file(PATH)
    if special_as_text:
        t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(docs, rows, encode, capacity=2048):
    texts = defaultdict(list)
    for r in docs:
        texts[r.doc_id].append(r.text or "")
    places, total = defaultdict(list), 0
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for doc_id, copies in texts.items():
        want = []
        for text in copies:
            ids = [*encode(text), 1]
            for at in range(0, len(ids), capacity):
                part = ids[at:at + capacity]
                want.append((at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]) == sorted(want)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), total


def test_packs_every_token_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "a  b\n\n c <|endoftext|>"), (10**9 + 3, "x y " * 20000),
                                   (10**9 + 4, "same"), (10**9 + 4, "same")], "doc_id long, text string")
    docs = docs.unionByName(extra).withColumn("offset", F.lit("clash"))
    rows = op8_packing.pack_documents(docs, PATH).collect()
    sequences, total = check(docs.collect(), rows, library())
    assert sequences <= 1.02 * total / 2048 + 1


def test_groups_are_independent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = op8_packing.pack_documents(docs, PATH, group_pieces=40).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 2
    check(docs.collect(), rows, library())
    assert op8_packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_tree_equals_plain_first_fit():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 200):
        lengths = rng.integers(1, 101, n)
        bins, offsets = op8_packing.first_fit_decreasing(lengths, 100)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            for b, left in enumerate(room):
                if left >= lengths[i]:
                    break
            else:
                b = len(room)
                room.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - room[b])
            room[b] -= lengths[i]


def test_sequences_hold_the_ids(spark):
    texts = {1: "x y " * 3000, 2: "short text", 3: None, 4: "another one, " * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    encode = library()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in op8_packing.pack_documents(docs, PATH).collect():
        ids = list(struct.unpack(f"<{r.length}H", r.ids))
        by_doc[r.doc_id].append((r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, ids))
    for doc_id, text in texts.items():
        assert [i for _, ids in sorted(by_doc[doc_id]) for i in ids] == [*encode(text or ""), 1]
    assert all(sum(len(ids) for _, ids in spans) <= 2048 for spans in by_sequence.values())


HARD = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, " " * 5000 + "y", "\n" * 3000 + "z  z", "it's we'LL 12345 \u00a0 ÿ漢字😀 \r\n\t end ",
        "é" * 2500 + " tail", "<|endoftext", "ab" * 999 + " " + "c" * 1999]


def test_ids_are_those_of_the_untouched_library(spark):
    encode, as_text = op8_packing.Encoder(PATH), op8_packing.Encoder(PATH, True)
    plain, text_only = library(), library(True)
    assert encode.ranked is not None and plain("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    rng = np.random.default_rng(8)
    letters = list("abc 1'\n\t.,<|>éß漢😀\u2003") + ["<|endoftext|>", "'re", "  "]
    random = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    for text in HARD + random:
        assert encode(text).tolist() == plain(text)
        assert as_text(text).tolist() == text_only(text)


def test_other_tokenizer_files_go_through_their_library():
    path = P.path("word_bpe_49k.json")
    encode = op8_packing.Encoder(path)
    assert encode.ranked is None and op8_packing.id_width(path) == 2 and op8_packing.id_width(PATH) == 2
    want = Tokenizer.from_file(path)
    assert all(encode(t).tolist() == want.encode(t, add_special_tokens=False).ids for t in ("Some Words here", "a <|startoftext|> b"))


def test_null_ids_and_special_tokens_are_packed(spark):
    rows = [(None, HARD[0]), (None, HARD[0]), (7, None), (8, HARD[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("ids", F.lit(1))
    out = op8_packing.pack_documents(docs, PATH).collect()
    check(docs.collect(), out, library())
    assert sum(r.doc_id is None for r in out) == 2
    check(docs.collect(), op8_packing.pack_documents(docs, PATH, special_as_text=True).collect(), library(True))


def test_a_row_repeated_very_often_is_dealt_over_all_groups(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text again").alias("text"))
    out = op8_packing.pack_documents(docs, PATH, group_pieces=100)
    sizes = [r["count"] for r in out.groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 160 and sum(sizes) == 3000
