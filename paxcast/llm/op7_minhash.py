"""MinHash near-duplicates by a multi-index Hamming join (operator 7).

A document's set of word shingles gets a signature of 60 symbols of 8 bits, each
from the minimum of one hash function. The signature is split into 12 chunks of
5 symbols. Two signatures that differ in at most 23 symbols have a chunk with at
most one error (pigeonhole: 24 errors would be needed for two in each), so every
chunk is indexed once for each place an error may stand, with that place left
out. All pairs within the distance meet under some key. At a similarity of 0.85
a pair's expected distance is 9 symbols; 24 or more has a chance of about 1e-6.

Pairs that meet and are within the distance are confirmed on their full sets.
Equal sets are one class from the start. Pairs are listed only in small buckets;
the members of larger ones are gathered into clusters, whose members are compared
by blocks: every pair of blocks is a task that compares full sets in bulk and
emits a spanning forest. No bucket is capped.

Defined cases: null, empty and wordless texts have the empty set, link with
nothing and are their own component; a text with fewer words than a shingle has
its whole sequence as its one shingle; rows with equal ids are judged by their
texts; a component of rows without ids has a null id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common, graph

CHUNKS, SYMBOLS = 12, 5
LENGTH = CHUNKS * SYMBOLS
#: Largest signature distance at which all pairs are found with one chunk error.
DISTANCE = 2 * CHUNKS - 1
SMALL_BUCKET = 8
BLOCK = 256
SEEDS = common.mix(np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(chunk: common.Chunk, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    words = common.Words(chunk, lower=True)
    hashes = common.window_hashes(words.hashes, width)
    out = []
    for start, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if end - start >= width:
            out.append(np.unique(hashes[start:end - width + 1]))
        elif end > start:
            out.append(common.mix(common.window_hashes(words.hashes[start:end], end - start) ^ np.uint64(end - start)))
        else:
            out.append(hashes[:0])
    return out


def signature(shingles: np.ndarray) -> bytes:
    """One byte from the smallest value under each hash function."""
    least = np.full(LENGTH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at:at + 2048, None] * SEEDS[None, :]).min(axis=0), out=least)
    return (common.mix(least) >> np.uint64(24)).astype(np.uint8).tobytes()


def features(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set id, signature and the text's key for every row."""

    def run(batches):
        for chunk in common.chunks(batches):
            sets = shingle_sets(chunk, width)
            yield pa.RecordBatch.from_arrays([
                chunk.column("doc_id"), chunk.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], pa.int64()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_id", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, set_id long, signature binary")


def index(classes: DataFrame) -> DataFrame:
    """(key, set_id): every chunk with each of its places left out."""
    slots = classes.select("set_id", "signature", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))).alias("slot"))
    first = F.expr(f"slot - slot % {SYMBOLS} + 1")
    place = F.expr(f"slot % {SYMBOLS}")
    rest = F.concat(F.substring("signature", first, place), F.substring("signature", first + place + 1, F.lit(SYMBOLS - 1) - place))
    return slots.select(F.xxhash64("slot", rest).alias("key"), "set_id")


def close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures are within the distance."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LENGTH) for c in (2, 3))
                near = (a != b).sum(axis=1) <= DISTANCE
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    marks = classes.select("set_id", "signature")
    return pairs.join(marks.toDF("a", "mark_a"), "a").join(marks.toDF("b", "mark_b"), "b").select(
        "a", "b", "mark_a", "mark_b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of the wanted classes, from one text of each."""

    def run(batches):
        for chunk in common.chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [chunk.column("set_id"), pa.array([s.tobytes() for s in shingle_sets(chunk, width)], pa.binary())], names=["set_id", "shingles"])

    places = classes.join(wanted, "set_id", "left_semi").select("set_id", F.col("place.text_key").alias("text_key"), F.col("place.doc_id").alias("doc_id"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long"), "text")
    found = texts.join(places, (texts.text_key == places.text_key) & texts.doc_id.eqNullSafe(places.doc_id))
    # Rows that repeat an id and a text both answer for their class.
    return found.select("set_id", "text").mapInArrow(run, "set_id long, shingles binary").dropDuplicates(["set_id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                common_part = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(100 * common_part >= percent * (len(x) // 8 + len(y) // 8 - common_part))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select(
        "a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar: counts of common elements by products of
    0/1 matrices, a slab of elements at a time."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [first, first + 4096])
        slab = np.zeros((n, 4096), np.float32)
        slab[owner[lo:hi], column[lo:hi] - first] = 1
        both += slab @ slab.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric 0/1 matrix."""
    waiting = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:
            at = front.pop()
            found = np.flatnonzero(linked[at] & waiting)
            waiting[found] = False
            out += [(at, int(f)) for f in found]
            front += found.tolist()
    return out


def block_edges(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning edges inside clusters, every pair of blocks compared in a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["set_id"].to_numpy()
        linked = similar([np.frombuffer(s, np.uint64) for s in frame["shingles"]], percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in forest(linked)], columns=["a", "b"], dtype="int64")

    blocks = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "set_id").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_id", "shingles",
    ).groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """Set size, component and verdict of every row: documents link if
    100 * common >= ``percent`` * union over shingles of ``width`` words."""
    found = common.materialise(features(docs, width))
    classes = common.materialise(found.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("place"), F.min("signature").alias("signature")))
    keys = index(classes)
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("set_id").alias("center")).where("size > 1")
    held = common.materialise(keys.join(buckets, "key"))

    small = held.where(f"size <= {SMALL_BUCKET}").groupBy("key").agg(F.sort_array(F.collect_list("set_id")).alias("ids"))
    pairs = small.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b").distinct()
    pairs = common.materialise(close_pairs(pairs, classes))

    stars = held.where(f"size > {SMALL_BUCKET}").select(F.col("set_id").alias("a"), F.col("center").alias("b")).distinct()
    stars = common.materialise(stars)
    joined = graph.components(stars)
    members = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    members = common.materialise(members.join(joined, "id", "left").select(
        F.col("id").alias("set_id"), F.coalesce("component", "id").alias("cluster")))

    wanted = pairs.select("a").union(pairs.select("b")).union(members.select("set_id")).distinct().toDF("set_id")
    sets = common.materialise(sets_of(docs, classes, wanted, width))
    edges = confirmed(pairs, sets, percent).union(block_edges(members, sets, percent))
    joined = graph.components(edges).withColumnRenamed("id", "set_id")
    labelled = classes.select("set_id", "least_id").join(joined, "set_id", "left").select(
        "set_id", "least_id", F.coalesce("component", "set_id").alias("component"))
    labelled = common.materialise(labelled)
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = labelled.join(least, "component").select("set_id", "component_id")
    return found.join(ids, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
