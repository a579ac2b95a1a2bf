"""Quality rules with adaptive thresholds (operator 10).

Each document gets word and line statistics. For every (language, source) a
mergeable KLL quantile sketch of each statistic is built with map-side partial
sketches, so a source with a third of all rows costs one sketch per task. The
sketch gives the group's own limits (quartiles widened by a multiple of the
inter-quartile range); groups with too few documents use the sketch merged over
the language, then the one merged over everything. The limits are joined back
and documents outside them are rejected.

Defined cases: a null or empty text has no words and fails the base rule; null
``lang`` or ``source`` are groups of their own; repeated rows are judged one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common

#: Characters counted as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_echoes long"


def statistics(chunk: common.Chunk) -> dict[str, np.ndarray]:
    """The statistics of every row of a chunk."""
    data, offsets, n = chunk.data, chunk.offsets, len(chunk)
    words = common.Words(chunk, lower=False)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": words.counts,
        "word_chars": common.per_row(words.solid & lead, offsets),
        "n_symbols": common.per_row(symbol[data], offsets),
        "n_dup_lines": duplicate_lines(data, offsets, words.solid, n),
        "n_repeat_words": repeated_words(words, n),
        "n_echoes": echoes(words, n),
    }


def duplicate_lines(data, offsets, solid, n) -> np.ndarray:
    """Lines holding a word that equal an earlier line of their row."""
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(breaks + 1, offsets[:-1])
    starts = edges[edges < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    ends = np.concatenate([starts[1:], [len(data)]])
    ends = ends - (data[ends - 1] == 10)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    held = filled[ends] > filled[starts]
    starts, ends = starts[held], ends[held]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    hashes = common.segment_hashes(data, starts, ends)
    order = np.lexsort((hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return np.bincount(rows[order][1:][same], minlength=n)


def echoes(words: common.Words, n: int) -> np.ndarray:
    """Words equal to the word before them."""
    same = (words.hashes[1:] == words.hashes[:-1]) & (words.rows[1:] == words.rows[:-1])
    return np.bincount(words.rows[1:][same], minlength=n)


def repeated_words(words: common.Words, n: int) -> np.ndarray:
    """Words in windows of eight words found twice or more in their row."""
    hashes = common.window_hashes(words.hashes, WINDOW)
    if not len(hashes):
        return np.zeros(n, np.int64)
    whole = words.rows[:len(hashes)] == words.rows[WINDOW - 1:]
    at = np.flatnonzero(whole)
    keyed = common.mix(hashes[at] ^ common.mix(words.rows[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    ordered = keyed[order]
    same = np.zeros(len(ordered), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= ordered[1:] == ordered[:-1]
    found = at[order[same]]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return np.bincount(words.rows[np.cumsum(cover[:-1]) > 0], minlength=n)


def measure(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """One row of statistics for each document row; whole texts. ``carry`` names a
    string column that goes along."""
    own = [carry] if carry else []

    def run(batches):
        for chunk in common.chunks(batches):
            found = statistics(chunk)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("lang"), chunk.column("source"), *(pa.array(v.astype(np.int64)) for v in found.values()), *map(chunk.column, own)],
                names=["doc_id", "lang", "source", *found, *own])

    schema = SCHEMA + "".join(f", {c} string" for c in own)
    return docs.select(F.col("doc_id").cast("long"), "lang", "source", "text", *own).mapInArrow(run, schema)


#: Statistics judged adaptively: name, expression, the side on which a value is
#: suspect, and the least spread taken for a group, on the rule's own scale (so that a
#: group of equal values doesn't reject the slightest difference). Word lengths are
#: compared by their logarithms: a text of letters is as far off as one of long junk.
RULES = (
    ("mean_word", "ln(try_divide(word_chars, n_words))", "both", 0.06),
    ("symbol_share", "try_divide(n_symbols, n_words)", "high", 0.02),
    ("dup_line_share", "try_divide(n_dup_lines, n_words)", "high", 0.01),
    ("repeat_share", "try_divide(n_repeat_words, n_words)", "high", 0.04),
    ("echo_share", "try_divide(n_echoes, n_words)", "high", 0.015),
)


def sketches(measured: DataFrame, k: int) -> DataFrame:
    """One mergeable KLL sketch per (language, source) and rule."""
    return measured.where("n_words > 0").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.expr(f"kll_sketch_agg_double(cast({rule} as double), {k})").alias(name) for name, rule, _, _ in RULES))


def merged(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged over coarser groups, without another look at the rows."""
    return groups.groupBy(*keys).agg(
        F.sum("n").alias("n"), *(F.expr(f"kll_merge_agg_double({name})").alias(name) for name, *_ in RULES))


def limits(groups: DataFrame, prefix: str, spread: float) -> DataFrame:
    """Lower and upper limit of each rule from the group's sketches."""
    out = groups.withColumnRenamed("n", f"{prefix}_n")
    for name, _, _, least in RULES:
        low, high = (F.expr(f"case when {prefix}_n > 0 then kll_sketch_get_quantile_double({name}, {q}D) end") for q in (0.25, 0.75))
        reach = spread * F.greatest(high - low, F.lit(least))
        out = out.withColumn(f"{prefix}_{name}_low", low - reach).withColumn(f"{prefix}_{name}_high", high + reach)
    return out.drop(*(name for name, *_ in RULES))


def quality_rules(docs: DataFrame, spread: float = 6.0, min_group: int = 50, k: int = 400, carry: str | None = None) -> DataFrame:
    """Statistics, base rule and adaptive verdict of every document.

    ``spread``: how many inter-quartile ranges beyond the quartiles are normal;
    ``min_group``: documents a (language, source) needs for limits of its own,
    below that the language's, then the whole corpus's limits hold;
    ``k``: size of the KLL sketches (rank error about 2.3 / k);
    ``carry``: a string column that goes along with each row's verdict.
    """
    measured = common.materialise(measure(docs, carry))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    groups = common.materialise(sketches(measured, k))
    own = limits(groups, "own", spread)
    tongue = limits(merged(groups, ["lang"]), "tongue", spread).withColumnRenamed("lang", "_t")
    every = limits(merged(groups, []), "every", spread).first()  # one row, whatever the input
    own = own.withColumnsRenamed({"lang": "_l", "source": "_s"}).join(tongue, F.col("_l").eqNullSafe(F.col("_t")))
    sides = [f"{name}_{side}" for name, *_ in RULES for side in ("low", "high")]
    groups = own.select("_l", "_s", *(
        F.when(F.col("own_n") >= min_group, F.col(f"own_{c}")).when(F.col("tongue_n") >= min_group, F.col(f"tongue_{c}"))
        .otherwise(F.lit(every[f"every_{c}"]).cast("double")).alias(c) for c in sides))
    judged = measured.join(groups, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    outside = F.lit(False)
    for name, rule, side, _ in RULES:
        value = F.expr(f"cast({rule} as double)")
        outside = outside | (value > F.col(f"{name}_high"))
        if side == "both":
            outside = outside | (value < F.col(f"{name}_low"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~F.coalesce(outside, F.lit(False))).alias("kept"),
        *([carry] if carry else []))
