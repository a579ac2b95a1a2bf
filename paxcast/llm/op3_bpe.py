"""Byte-level BPE encoding and decoding (operator 3).

Every task loads the rank file by its path (a parameter), cuts each text with
the pre-token pattern and merges the new pre-tokens of a stretch of rows with
the rank queue of ``bpe.Merger``. Nothing is shuffled.

Defined cases: a null text is empty; an empty text has no ids; repeated rows are
encoded one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import bpe, common, pretoken


def encoder(ranks: dict[bytes, int], pattern: str) -> pretoken.BatchEncoder:
    merge = bpe.Merger(ranks).many
    return pretoken.BatchEncoder(pattern, lambda pieces: merge([piece.encode() for piece in pieces]))


def decoder(ranks: dict[bytes, int]):
    """``ids -> bytes``: each id's token, joined."""
    tokens = {rank: token for token, rank in ranks.items()}
    return lambda ids: b"".join(map(tokens.__getitem__, ids))


def coders(path: str, pattern: str):
    """Encoder and decoder of a rank file, made once in a Python worker."""

    def make():
        ranks = bpe.load_ranks(path)
        return encoder(ranks, pattern), decoder(ranks)

    return pretoken.kept(("bpe", path, pattern), make)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and ``decoded`` (binary) of every row."""

    def run(batches):
        to_ids, to_bytes = coders(path, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                ids = [np.frombuffer(raw, np.int32) for raw in to_ids.many([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([to_bytes(x.tolist()) for x in ids], pa.binary())],
                    names=[id_col, "ids", "decoded"])

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = dict(source.dtypes)[id_col]
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, made inside the task
    that encodes, so the ids themselves never leave it."""

    def run(batches):
        to_ids, to_bytes = coders(path, pattern)
        for batch in batches:
            for chunk in common.chunks([batch], limit=1 << 20):
                part = chunk.batch
                counts, ids_sha, decoded_sha = [], [], []
                for raw in to_ids.many([t or "" for t in part.column(1).to_pylist()]):
                    counts.append(len(raw) // 4)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    decoded_sha.append(hashlib.sha256(to_bytes(array("I", raw))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
