"""Spelling variants by dense prefix-suffix tiling (operator 11).

Two words differ by exactly one inserted, deleted or replaced code point when their
common prefix and common suffix together reach the longer length minus one. Words are
compared in tiles: for a longer length M the M places of the edit are cut into ``CUTS``
segments, and words that share everything before and behind a segment form a tile.
Every near pair has its edit in one segment, so it meets in exactly one tile and is
found once. A tile is a padded matrix of code points, aligned at the left for prefixes
and at the right for suffixes; its words are dealt into blocks and every pair of blocks
is compared by itself, so a large tile becomes many tasks' work.

Only distinct words travel: documents are counted inside the task that reads them, and
counts are added up before and after the shuffle, so a word that fills a third of the
corpus is one row per task.

Defined cases: a null or empty text has no words; repeated rows count again; a null id
counts as the empty text in the id rule of :func:`count_words`; ties between equally
frequent near words go to the smallest in code-point order; an empty table gives an
empty result; other columns are ignored. A word may be of any length: blocks are
bounded by code points, not by words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common

#: Letters of a run, after lower-casing A-Z (fixed by the contract).
LETTERS = "a-zÀ-ÿ"
#: Segments that the places of an edit are cut into.
CUTS = 4
#: Words of a block of a tile.
BLOCK = 1024
#: Code points that a padded matrix of word pairs may hold.
CELLS = 4 << 20
#: Words and characters that a task counts before it hands them on.
HELD_WORDS, HELD_CHARS = 300_000, 8 << 20


def count_words(docs: DataFrame, least_chars: int = 5, least_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """``word``, ``n``: the lower-cased letter runs of whole texts of at least
    ``least_chars`` code points that occur ``least_count`` times or more.

    ``drop_every``: where it divides crc32 of ``<doc_id>:<run>``, the run loses the
    code point at that number modulo its length; None leaves runs as they are.
    """
    lower = bytes(common.LOWER.tolist())
    run = re.compile(f"[{LETTERS}]{{{least_chars},}}")

    def batch_of(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        total: Counter = Counter()
        chars = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                found = Counter(run.findall(text.encode().translate(lower).decode()))
                if drop_every:
                    found = dropped(found, f"{batch.column(0)[i].as_py() or ''}:", drop_every, least_chars)
                before = len(total)
                total.update(found)
                if len(total) > before:
                    chars += sum(map(len, found))
                if len(total) > HELD_WORDS or chars > HELD_CHARS:
                    yield batch_of(total)
                    total.clear()
                    chars = 0
        if total:
            yield batch_of(total)

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def dropped(found: Counter, prefix: str, every: int, least: int) -> Counter:
    """The runs of one document after the id rule, with their counts."""
    out: Counter = Counter()
    start = zlib.crc32(prefix.encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        out[word] += n
    return out


def members(words: DataFrame) -> DataFrame:
    """A row for each tile a word lies in: once per segment as one of the longer
    words of the tile's length, once as one of the shorter."""
    sizes = words.select("word", "n", F.length("word").alias("size")).where("size > 0")
    longer = sizes.withColumn("longer", F.explode(F.array("size", F.col("size") + 1)))
    cut = longer.withColumn("segment", F.explode(F.array(*(F.lit(i) for i in range(CUTS)))))
    low = F.floor(F.col("segment") * F.col("longer") / CUTS).cast("int")
    high = F.floor((F.col("segment") + 1) * F.col("longer") / CUTS).cast("int")
    cut = cut.withColumn("low", low).withColumn("high", high).where("low < high")
    tail = F.col("longer") - F.col("high")
    head = F.expr("substring(word, 1, low)")
    back = F.expr("substring(word, size - (longer - high) + 1, longer - high)")
    # A hash suffices for the tile: words that only share the hash fail the comparison.
    return cut.withColumn("tile", F.xxhash64("longer", "segment", head, F.lit("\0"), F.when(tail > 0, back).otherwise("")))


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks of their tile; a tile of up to ``block`` words
    is one block, compared with itself."""
    spark = rows.sparkSession
    large = common.materialise(rows.groupBy("tile").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block))
    split = large.select(F.col("tile").alias("_tile"), F.ceil(F.col("m") / block).cast("int").alias("parts"))
    if not split.head(1):
        split = spark.createDataFrame([], split.schema)
    dealt = rows.join(split, F.col("tile") == F.col("_tile"), "left").drop("_tile")
    own = F.pmod(F.xxhash64("word", F.lit(11)), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))


def matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Words as rows of code points, padded with -1 to ``width``."""
    out = np.full((len(words), width), -1, np.int32)
    for i, word in enumerate(words):
        points = np.frombuffer(word.encode("utf-32-le"), np.int32)
        if right:
            out[i, width - len(points):] = points
        else:
            out[i, :len(points)] = points
    return out


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading entries rows of ``a`` and ``b`` have in common; padding,
    where both have it, isn't common."""
    same = (a == b) & (a >= 0)
    return np.where(same.all(1), same.shape[1], (~same).argmax(1))


def near_in(words: list[str], left: np.ndarray, right: np.ndarray, longer: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs (left[k], right[k]) of places in ``words``, those that differ by one
    edit in [low, high): dense comparison of padded matrices."""
    step = max(1, CELLS // longer)
    for at in range(0, len(left), step):
        i, j = left[at:at + step], right[at:at + step]
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        chosen = [words[k] for k in used.tolist()]
        sizes = np.array([len(w) for w in chosen])
        x, y = place[:len(i)], place[len(i):]
        fits = np.maximum(sizes[x], sizes[y]) == longer
        table = matrix(chosen, longer, False)
        prefix = shared(table[x], table[y])
        table = matrix(chosen, longer, True)[:, ::-1]
        suffix = shared(table[x], table[y])
        edit = np.minimum(prefix, longer - 1)
        hit = fits & (prefix + suffix >= longer - 1) & (edit >= low) & (edit < high)
        yield i[hit], j[hit]


def pairs_of(cell: np.ndarray, own: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a cell to compare: all pairs inside one block, or those across two."""
    if first == second:
        i, j = np.triu_indices(len(cell), 1)
        return cell[i], cell[j]
    x, y = cell[own == first], cell[own == second]
    return np.repeat(x, len(y)), np.tile(y, len(x))


CELL = ["tile", "first", "second"]


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``near``, ``near_n`` for each ordered pair of words (``word``, ``n``;
    words distinct) that are one edit apart."""
    rows = common.materialise(members(words))
    cells = blocks(rows, block).select(*CELL, "own", "longer", "low", "high", "word", "n")

    def batch_of(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.string()), pa.array([p[2] for p in out], pa.int64())],
            names=["word", "near", "near_n"])

    def compare(frames):
        """Sorted rows in runs of whole cells; the last, unfinished cell is kept."""
        held = None
        for batch in frames:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([table.column(c).to_numpy() for c in CELL])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if not len(change):
                held = table
                continue
            yield from whole(table.slice(0, int(change[-1])), np.concatenate([[0], change]))
            held = table.slice(int(change[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield from whole(held, np.array([0, held.num_rows]))

    def whole(table, bounds):
        words = table.column("word").to_pylist()
        counts = table.column("n").to_pylist()
        own, first, second, longer, low, high = (table.column(c).to_numpy() for c in ("own", "first", "second", "longer", "low", "high"))
        # Cells of one word have nothing to compare; those alike in length and
        # segment are compared in one matrix.
        jobs: dict[tuple, list] = {}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            shape = (int(longer[a]), int(low[a]), int(high[a]))
            jobs.setdefault(shape, []).append(pairs_of(np.arange(a, b), own[a:b], first[a], second[a]))
        out: list = []
        for shape, parts in jobs.items():
            left, right = (np.concatenate([p[s] for p in parts]) for s in (0, 1))
            for i, j in near_in(words, left, right, *shape):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    out.append((words[x], words[y], counts[y]))
                    out.append((words[y], words[x], counts[x]))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(compare, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms (``word``, ``form``), by pointer jumping:
    every round doubles the steps taken. A form is at least twice as frequent as
    its word, so chains are short and never close."""
    jumps = common.materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = common.materialise(jumps.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        jumps = jumped.select("word", "root")
        if not jumped.where("moved").head(1):
            return jumps


def variants(words: DataFrame, factor: int = 2, block: int = BLOCK) -> DataFrame:
    """Each of ``words`` (``word``, ``n``) with its number of near words, its form - the
    most frequent near word, if that is ``factor`` times as frequent or more - and
    the root that its forms lead to (itself if it has no form)."""
    words = common.materialise(words.select("word", F.col("n").cast("long")))
    near = near_pairs(words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    takes = F.col("near_n") >= factor * F.col("n")
    judged = common.materialise(judged.select(
        "word", F.when(takes, F.col("near")).alias("form"), "n", "n_near", F.when(takes, F.col("near_n")).alias("form_n")))
    found = roots(judged.where("form is not null"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_chars: int = 5, least_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """The variants among the words of ``docs``."""
    return variants(count_words(docs, least_chars, least_count, drop_every))
