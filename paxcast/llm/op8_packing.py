"""Packing by first-fit decreasing with a tournament tree (operator 8).

Documents become token ids plus an end id; each is cut at every ``capacity``
ids, so a document leaves at most one short piece. Pieces, with their ids, are
dealt at random over groups of bounded expected size, whatever document or
source they come from, in one exchange, and every group is packed by itself: pieces
in order of falling length go to the first bin with room, found by walking a
tournament tree whose inner nodes hold the largest room below them.

Ids are kept as little-endian integers of :func:`id_width` bytes: two where the
vocabulary ends below 65,536, else four.

Defined cases: a null or empty text is the end id alone; a null id is kept; repeated
rows are packed one by one; an empty table gives no pieces; other columns are ignored;
a text of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common, pretoken

END_ID = 1
CAPACITY = 2048
#: Pieces, and bytes of text, that a group holds on average; the bound of a packing task.
GROUP_PIECES, GROUP_BYTES = 20_000, 24 << 20

PIECES = "row long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
DIGESTS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Bytes of ids in an Arrow batch.
BATCH_BYTES = 1 << 20
#: Texts whose runs, of visible characters or of white space, are shorter than 2,000
#: characters. Others are left to the tokenizer file's own library, whose merging
#: doesn't slow down with the length of a pre-token.
SHORT_RUNS = re.compile(r"\s{0,1999}+(?:\S{1,1999}+\s{1,1999}+)*+\S{0,1999}+")


def id_width(path: str) -> int:
    """Bytes of an id: 2 if all ids of the tokenizer file (and the end id) fit, else 4."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    top = max([END_ID, *held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])])
    return 2 if top < 1 << 16 else 4


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand
    for themselves, the others for code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as the tokenizer file's library gives them, as an array.

    A byte-level vocabulary whose ids are in the order of its merges is encoded by
    rank, which is several times faster; texts with an added token in them
    or with very long runs, and other kinds of files, go through the library.
    ``special_as_text`` takes the strings of special tokens for ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.added = [t["content"] for t in held["added_tokens"] if not (special_as_text and t["special"])]
        model, before = held["model"], held["pre_tokenizer"] or {}
        letters, vocab = byte_letters(), model["vocab"]
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model.get("merges", [])]
        plain = (model["type"] == "BPE" and held["normalizer"] is None and not model.get("byte_fallback") and not model.get("ignore_merges")
                 and model.get("dropout") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
                 and merged == sorted(merged) and min(merged, default=0) >= 0 and all(set(word) <= letters.keys() for word in vocab))
        self.ranked = tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, special_tokens={},
            mergeable_ranks={bytes(letters[c] for c in word): i for word, i in vocab.items()}) if plain else None

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is None or any(word in text for word in self.added) or not SHORT_RUNS.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(array("I", self.ranked.encode_ordinary(text)), np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """Each document's ids cut at every ``capacity``: the number of its row, place,
    length, the ids and their checksum as four-byte integers."""
    kind = {2: "<u2", 4: "<u4"}[id_width(path)]

    def batch_of(rows):
        *numbers, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in numbers), pa.array(ids, pa.binary())], names=[c.split()[0] for c in PIECES.split(", ")])

    def run(batches):
        encode = pretoken.kept(("packing", path, special_as_text), lambda: Encoder(path, special_as_text))
        for batch in batches:
            rows, held = [], 0
            number, doc_ids, texts = (batch.column(k) for k in range(3))
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py() or "")
                ids = np.append(ids, ids.dtype.type(END_ID)).astype("<u4")
                row, doc_id = number[i].as_py(), doc_ids[i].as_py()
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    rows.append((row, doc_id, at, len(part), len(ids), zlib.crc32(part), part.astype(kind).tobytes()))
                    held += len(part) * part.itemsize
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return numbered.mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (in the given order of the array)."""
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * size)  # leaves: bins; inner nodes: the largest room below
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        node = 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


PACKED = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, sequence_id long, offset long"


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for a table of pieces, dealt over ``groups``.

    The group of a piece is a random draw seeded by its row and start, so a retried
    task deals alike; ``sequence_id`` is the group in the high bits and the group's bin
    in the low 32.
    """
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("row", "start", F.lit(20261203)), F.lit(groups)))
    order = [c.split()[0] for c in PACKED.split(", ")]

    def one_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=frame["_group"].astype("int64") * (1 << 32) + bins, offset=offsets)[order]

    return dealt.groupBy("_group").applyInPandas(one_group, PACKED)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
                   group_bytes: int = GROUP_BYTES, special_as_text: bool = False) -> DataFrame:
    """Token pieces of whole documents packed into sequences: where each piece
    stands, its ``ids`` and their checksum. A sequence is padded to ``capacity``;
    one whose ids come to a power of two stays as it is. Ids take :func:`id_width`
    bytes; ``special_as_text`` is that of :class:`Encoder`."""
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    groups = max(common.bucket_count(spark, size.rows, group_pieces), common.bucket_count(spark, size.bytes, group_bytes), 1)
    return pack(pieces(docs, path, capacity, special_as_text), groups, capacity).select(*DIGESTS, "ids")
