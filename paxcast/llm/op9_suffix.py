"""Removal of repeated 200-byte passages by column-wise BWT (operator 9).

A byte goes if a 200-byte string that covers it also starts anywhere else. The
work is cut so that strings which may be equal meet in one task:

* Every 200-byte string is filed under its anchor, the 32-byte substring of
  smallest hash (the leftmost one, if several tie). Neighbouring starts with one
  anchor form a stretch; equal strings have equal anchors at equal distances, so
  only stretches of the same anchor can hold equal strings, and no stretch holds
  a string twice.
* Anchors found once are done with. Stretches that occur twice as a whole are
  repeated from end to end; of each, one copy stays to compare others with.
* The different stretches of an anchor are compared by building their collection
  BWT column by column: the stretches stand aligned at the anchor, and each round
  inserts one symbol per stretch in front of the suffixes sorted so far, by a
  stable sort on the inserted symbols (which are the BWT of the round before) and
  a range minimum over the common prefixes. Two neighbours with a common prefix of
  200 or more are a repeat. The rounds are bounded by the stretch's length (at
  most 367 bytes), not by the documents'.
* An anchor with more different stretches than ``LARGEST`` (a task's worth) is split
  by more context first: strings whose distance from the anchor lies in one band of a
  width share all but width - 1 of their bytes, so stretches are cut at the bands and
  only pieces of one band with equal shared bytes stay together; pieces that are equal
  as a whole are settled there, one of each going on. Widths are halved while a group
  is too large; at width 1 a group is one string. Every piece is then compared column
  by column like any stretch.

The tables between these steps are files in the shared folder, read and written
sequentially.

Defined cases: a null or empty text has no bytes and nothing to remove; texts
under 200 bytes keep all; rows with equal ids are judged by their texts; an empty
table gives an empty result; other columns are ignored. Equal hashes (64 bits,
beside an equal anchor hash) are taken for equal strings.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common

ANCHOR = 32  # a power of two
PLACE_BITS = np.int64((1 << 31) - 1)
#: Stretches that a column-wise task holds on average, and of one anchor at most.
TASK_STRETCHES = 8192
LARGEST = 32768
#: An anchor is heavy if it has more than one in ``HEAVY`` of all stretches; so there
#: are fewer than ``HEAVY`` of them, whatever the input.
HEAVY = 1000


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` (a power of two) bytes from each place, by doubling."""
    out = data.astype(np.uint64) + np.uint64(1)
    factor, step = common.BASE, 1
    while step < width:
        if len(out) <= step:
            return out[:0]
        out = out[:-step] * np.uint64(factor) + out[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    return common.mix(out)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place that has them."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(values) - width + 1], out[width - have:])
    return out


def stretches(chunk: common.Chunk, span: int):
    """(anchor, content, row, start, count, lead) of each stretch: hashes of the
    anchor and the whole, first start in its row, number of starts, and the
    anchor's distance from the first start."""
    data, offsets = chunk.data, chunk.offsets
    hashes = rolling(data, ANCHOR)
    ranked = (hashes >> np.uint64(1)).view(np.int64) & ~PLACE_BITS | np.arange(len(hashes), dtype=np.int64)
    least = window_minimum(ranked, span - ANCHOR + 1)
    starts = np.arange(len(least))
    row = np.searchsorted(offsets, starts, side="right") - 1
    whole = starts + span <= offsets[row + 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    if not len(at):
        return None
    # A stretch ends before the next one or before the row's last whole string ends.
    last_start = offsets[row[at] + 1] - span
    following = np.append(at[1:], len(least))
    count = np.minimum(following, last_start + 1) - at
    place = least[at] & PLACE_BITS
    content = common.segment_hashes(data, at, at + count + span - 1)
    return hashes[place], content, row[at], at - offsets[row[at]], count, place - at


STRETCH = "anchor long, content long, text_key long, start int, count int, lead int"


def stretch_table(docs: DataFrame, span: int) -> DataFrame:
    def run(batches):
        for chunk in common.chunks(batches):
            found = stretches(chunk, span)
            if found is not None:
                anchor, content, row, start, count, lead = found
                keys = chunk.column("text_key").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [common.signed(anchor), common.signed(content), pa.array(keys[row]), *(pa.array(x.astype(np.int32)) for x in (start, count, lead))],
                    names=[f.split()[0] for f in STRETCH.split(", ")])

    return docs.where(f"octet_length(text) >= {span}").select("text", F.xxhash64("text").alias("text_key")).mapInArrow(run, STRETCH)


def repeated_starts(group: np.ndarray, texts: list[bytes], lead: np.ndarray, count: np.ndarray, span: int) -> np.ndarray:
    """Which starts of which stretches begin a string that another stretch of the
    same group holds too: a table [stretch, start].

    Columns are numbered from the anchor. A round holds the suffixes that begin in
    its column, in sorted order within each group, and the common prefix of each
    with the one before it.
    """
    n = len(texts)
    left = int(lead.max())
    lengths = np.array([len(t) for t in texts])
    right = int((lengths - lead).max())
    symbols = np.zeros((left + right, n), np.uint8)  # a row of this table is a column of the collection
    for i, text in enumerate(texts):
        symbols[left - lead[i]:left - lead[i] + len(text), i] = np.frombuffer(text, np.uint8)
    begins, ends = left - lead, left - lead + lengths
    ending = np.argsort(-ends, kind="stable")
    joined = 0
    order, shared = np.zeros(0, np.int64), np.zeros(0, np.int32)
    found = np.zeros((n, int(count.max())), bool)
    base = group.astype(np.int64) * 256
    for column in range(left + right - 1, -1, -1):
        more = joined
        while more < n and ends[ending[more]] > column:
            more += 1
        fresh = ending[joined:more]
        joined = more
        here = begins[order] <= column
        if not here.all():  # stretches that begin further right leave; prefixes across them shrink
            shared, order = without_leavers(shared, here), order[here]
        order = np.concatenate([fresh, order])
        shared = np.concatenate([np.zeros(len(fresh), np.int32), shared])
        inserted = base[order] + symbols[column, order]
        moved = np.argsort(inserted, kind="stable")
        same = inserted[moved[1:]] == inserted[moved[:-1]]
        prefix = np.zeros(len(order), np.int32)
        prefix[1:][same] = 1
        old = np.flatnonzero(same & (moved[:-1] >= len(fresh)))
        if len(old):
            ranges = np.stack([moved[old] + 1, moved[old + 1] + 1], axis=1).ravel()
            prefix[old + 1] += np.minimum.reduceat(np.append(shared, 0), ranges)[::2]
        order, shared = order[moved], prefix
        twin = shared >= span
        twin[:-1] |= shared[1:] >= span
        rows = order[twin]
        starts = column - begins[rows]
        inside = starts < count[rows]
        found[rows[inside], starts[inside]] = True
    return found


def without_leavers(shared: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Common prefixes of those that stay: the minimum over what leaves between."""
    kept = np.flatnonzero(here)
    if not len(kept):
        return shared[:0]
    begin = np.concatenate([[0], kept[:-1] + 1])
    ranges = np.stack([begin, kept + 1], axis=1).ravel()
    return np.minimum.reduceat(np.append(shared, 0), ranges)[::2]


def runs(mask: np.ndarray):
    """(row, first, last) of the runs of True in each row of a table."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, first = np.nonzero(change == 1)
    _, beyond = np.nonzero(change == -1)
    return rows, first, beyond - 1


def compared(pieces: DataFrame, tasks: int, span: int) -> DataFrame:
    """(anchor, content, first, last): repeated starts of each stretch, from the
    column-wise construction over buckets of groups."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, group = np.unique(frame["part"].to_numpy(), return_inverse=True)
        texts = [bytes(t) for t in frame["bytes"]]
        found = repeated_starts(group, texts, frame["lead"].to_numpy(), frame["count"].to_numpy(), span)
        rows, first, last = runs(found)
        shift = frame["shift"].to_numpy()[rows]
        return pd.DataFrame({
            "anchor": frame["anchor"].to_numpy()[rows], "content": frame["content"].to_numpy()[rows],
            "first": (first + shift).astype(np.int32), "last": (last + shift).astype(np.int32)})

    bucket = F.pmod(F.xxhash64("part", F.lit(9)), F.lit(tasks))
    return pieces.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "anchor long, content long, first int, last int")


PIECE = "part long, anchor long, content long, shift int, count int, lead int, bytes binary"


def cut_at_bands(pieces: DataFrame, width: int, span: int) -> DataFrame:
    """The pieces cut where their starts' distance from the anchor passes a multiple of
    ``width``; ``part`` is then of the band and the bytes that all its strings share,
    ``own`` of the whole piece and its place."""

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        names = [f.split()[0] for f in PIECE.split(", ")] + ["own"]
        for batch in batches:
            rows = []
            for anchor, content, shift, count, lead, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                at = 0
                while at < count:
                    band = (lead - at) // width  # of the distances band * width and up
                    to = min(count, lead - band * width + 1)
                    shared = data[lead - band * width:lead - (band + 1) * width + 1 + span]
                    piece = data[at:to - 1 + span]
                    rows.append((
                        xxhash.xxh3_64_intdigest(shared, band) - (1 << 63), anchor, content, shift + at, to - at, lead - at, piece,
                        xxhash.xxh3_64_intdigest(piece, lead - at) - (1 << 63)))
                    at = to
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows[i:i + 10_000], strict=True), kinds, strict=True)], names=names)

    return pieces.select("anchor", "content", "shift", "count", "lead", "bytes").mapInArrow(run, PIECE + ", own long")


def narrowed(pieces: DataFrame, span: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pieces in groups of at most ``LARGEST``, and tables of ranges (anchor,
    content, first, last) settled on the way. At most eight rounds for a span of 200;
    none where no group is too large."""
    settled = []
    width = 1 << max((span - ANCHOR).bit_length() - 1, 0)
    columns = pieces.columns
    while width:
        large = common.materialise(pieces.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(f"n > {LARGEST}").select("part"))
        if large.isEmpty():
            break
        cut = common.materialise(cut_at_bands(pieces.join(large, "part", "left_semi"), width, span))
        often = cut.groupBy("part", "own").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        settled.append(cut.join(often, ["part", "own"], "left_semi").select(
            "anchor", "content", F.col("shift").alias("first"), (F.col("shift") + F.col("count") - 1).alias("last")))
        pieces = common.materialise(pieces.join(large, "part", "left_anti").select(columns).union(
            cut.dropDuplicates(["part", "own"]).select(columns)))
        width //= 2
    return pieces, settled


def bytes_of(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The wanted stretches' bytes, each cut from one text."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(p["anchor"], p["content"], p["count"], p["lead"], text[p["start"]:p["start"] + p["count"] + span - 1]) for p in parts]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows[at:at + 10_000], strict=True), kinds, strict=True)],
                    names=["anchor", "content", "count", "lead", "bytes"])

    texts = docs.where(f"octet_length(text) >= {span}").select(
        F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = wanted.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "content", "start", "count", "lead")).alias("parts"))
    # One row answers for a text that many rows share.
    chosen = texts.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).join(parts.select("text_key"), "text_key", "left_semi")
    single = texts.join(
        chosen.withColumnsRenamed({"text_key": "k", "doc_id": "d"}), (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    out = single.select("text_key", "text").join(parts, "text_key").select(F.col("text").cast("binary"), "parts").mapInArrow(
        run, "anchor long, content long, count int, lead int, bytes binary")
    return out.dropDuplicates(["anchor", "content"])


def repeated_spans(docs: DataFrame, span: int = 200) -> DataFrame:
    """``text_key`` and ``spans`` (array of [from, to) in bytes) of every text with
    something to remove; spans of a text may overlap."""
    spark = docs.sparkSession
    table = common.materialise(stretch_table(docs, span))
    anchors = table.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    repeated = common.materialise(anchors.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"), "n"))
    # Rows of heavy anchors are joined where they are read, the others by key.
    limit = table.count() / HEAVY
    heavy = F.broadcast(repeated.where(F.col("n") > limit).select("anchor", "mixed"))
    light = repeated.where(F.col("n") <= limit).select("anchor", "mixed")
    hits = common.materialise(table.join(heavy.select("anchor"), "anchor", "left_anti").join(light, "anchor").unionByName(
        table.join(heavy, "anchor")))

    kinds = common.materialise(hits.groupBy("anchor", "content", "count", "lead", "mixed").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "start")).alias("place")))
    wanted = kinds.where("mixed").select("anchor", "content", "count", "lead", "place.*")
    contents = common.materialise(bytes_of(docs, wanted, span))
    pieces, settled = narrowed(contents.select(
        F.col("anchor").alias("part"), "anchor", "content", F.lit(0).alias("shift"), "count", "lead", "bytes"), span)
    tasks = common.bucket_count(spark, pieces.count(), TASK_STRETCHES)
    partly = reduce(DataFrame.union, settled, compared(pieces, tasks, span))
    # What occurs twice as a whole is repeated from its first start to its last.
    wholly = kinds.where("n > 1").select("anchor", "content", F.lit(0).alias("first"), (F.col("count") - 1).alias("last"))
    ranges = common.materialise(wholly.union(partly))
    marked = hits.join(ranges, ["anchor", "content"]).select(
        "text_key", (F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("last") + span).alias("to"))
    return marked.distinct().groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal covered runs of sorted spans."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["from"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["to"]))
        else:
            out.append((s["from"], s["to"]))
    return out


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for first, beyond in gone:
        parts.append(text[at:first])
        at = beyond
    return b"".join([*parts, text[at:]])


def with_spans(docs: DataFrame, span: int) -> DataFrame:
    """Every row with its text's spans (null without any)."""
    spans = repeated_spans(docs, span).withColumnRenamed("text_key", "_key")
    return docs.join(spans, F.xxhash64("text") == F.col("_key"), "left").drop("_key")


def dedup_digests(docs: DataFrame, span: int = 200) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of the rest of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, gone = text or b"", merged(spans or [])
                rest = without(text, gone)
                rows.append((doc_id, len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    source = docs.select(F.col("doc_id").cast("long"), "text")
    return with_spans(source, span).select("doc_id", F.col("text").cast("binary"), "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, span: int = 200) -> DataFrame:
    """The rows with what repeats cut out of ``text``; characters that a cut
    splits are dropped. Other columns stay as they are."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            t if s is None or t is None else without(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    columns = docs.columns
    return with_spans(docs, span).withColumn("text", cut("text", "spans")).select(*columns)
