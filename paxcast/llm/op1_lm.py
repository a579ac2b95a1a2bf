"""Language-model scoring with an Elias-Fano trie (operator 1).

The model is a bigram model with a Dirichlet prior: the probability of a word w
after a word u is (c(u, w) + mass * p(w)) / (c(u) + mass), where p discounts the
counts of single words and leaves the rest to unknown ones, evenly. Its logarithm
splits into a part of (u, w), stored in the trie under w, and a normaliser of u,
stored with u as a word; so all that a token needs stands in the shard of its word.

Each shard is a trie of two levels: words, and below each word the words that came
before it. Both are Elias-Fano sequences with quantised logarithms beside them,
in a memory-mapped file; the second is searched among one word's children only.

Words are 64-bit hashes. A pass over the training rows counts words, which gives
the corpus's size, its vocabulary and the commonest words. A second pass sends, per
block of documents and shard, the distinct (word, word before) pairs with training
counts and the documents they stand in; a pair that is frequent in a block is sent
once. Words with more than a shard's fair part of the corpus (at most
``HOT_SHARE`` times the number of shards) are dealt over the shards by the word
before. A shard's task builds its trie and answers its pairs, and the documents'
partial sums are added up. All sizes follow the input; nothing is cut off.

Defined cases: a null or empty text is the end token alone; rows with equal id and
text get equal results; without training rows every count is 0 and every token has
the probability of the one unknown word, 1; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common, eliasfano

END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
BEFORE_BITS = np.uint64(40)  # bits of the hash of the word before, under its word
WORD_LOW = np.uint64(48)
BLOCK_TOKENS = 300_000
#: Text bytes turned into tokens at a time, and bytes of postings handed on at a time.
TEXT_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
SHARD_TOKENS = 2_000_000
HOT_SHARE = 16
LEVELS = 256


def token_runs(batches, limit: int):
    """Blocks of about ``limit`` tokens: token hashes with each row's end token,
    the hashes before them, the row of each, and the rows' columns."""
    held: list = []
    size = 0
    for chunk in common.chunks(batches, limit=TEXT_BYTES):
        words = common.Words(chunk, lower=True)
        n = len(chunk)
        tokens = np.empty(len(words.hashes) + n, np.uint64)
        rows = np.empty(len(tokens), np.int64)
        ends = words.bounds[1:] + np.arange(n)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = words.hashes, END
        rows[inner], rows[ends] = words.rows, np.arange(n)
        before = np.empty(len(tokens), np.uint64)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = START
        held.append((tokens, before, rows, chunk.column("row_key").to_numpy(zero_copy_only=False), chunk.column("training").to_numpy(zero_copy_only=False)))
        size += len(tokens)
        if size >= limit:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(held):
    first = np.cumsum([0, *(len(h[3]) for h in held)])
    return (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]),
            np.concatenate([h[2] + f for h, f in zip(held, first, strict=False)]), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]))


def totals(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with summed counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts[order], first)


def word_counts(source: DataFrame, buckets: int) -> DataFrame:
    """Per bucket of words: tokens, distinct words, words seen once and twice, and
    its most frequent words."""

    def count(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def parcels():
            place = common.mix(words ^ np.uint64(77)) % np.uint64(buckets)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(buckets + 1).astype(np.uint64))
            spans = [(b, order[cuts[b]:cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in spans], pa.int32()), pa.array([words[i].tobytes() for _, i in spans], pa.binary()),
                 pa.array([counts[i].astype(np.uint32).tobytes() for _, i in spans], pa.binary())], names=["bucket", "words", "counts"])

        for tokens, _, rows, _, training in token_runs(batches, BLOCK_TOKENS):
            used = tokens[training[rows]]
            more, n = np.unique(used, return_counts=True)
            words, counts = totals(np.concatenate([words, more]), np.concatenate([counts, n]))
            if len(words) > BLOCK_TOKENS:
                yield parcels()
                words, counts = words[:0], counts[:0]
        if len(words):
            yield parcels()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        words, counts = totals(
            np.concatenate([np.frombuffer(w, np.uint64) for w in frame["words"]]),
            np.concatenate([np.frombuffer(c, np.uint32).astype(np.int64) for c in frame["counts"]]))
        top = np.argsort(-counts, kind="stable")[:4 * HOT_SHARE]
        return pd.DataFrame([(
            int(counts.sum()), len(words), int((counts == 1).sum()), int((counts == 2).sum()),
            words[top].view(np.int64).tolist(), counts[top].tolist())], columns=["tokens", "words", "once", "twice", "top", "top_counts"])

    parts = source.where("training").mapInArrow(count, "bucket int, words binary, counts binary")
    return parts.groupBy("bucket").applyInPandas(
        merge, "tokens long, words long, once long, twice long, top array<long>, top_counts array<long>")


PACKED = {"words": np.uint64, "per_word": np.uint32, "low": np.uint32, "more": np.uint8, "train": np.uint32, "per_pair": np.uint32, "rows": np.uint32, "keys": np.uint64}


def postings(source: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """Per block and shard the distinct pairs, sorted by word and word before,
    with training counts and the rows they stand in."""

    def batch_of(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(out["shard"], pa.int32()), *(pa.array(out[name], pa.binary()) for name in PACKED)], names=list(out))

    def run(batches):
        for tokens, before, rows, keys, training in token_runs(batches, BLOCK_TOKENS):
            words, word = np.unique(tokens, return_inverse=True)
            prior = common.mix(before) >> (np.uint64(64) - BEFORE_BITS)
            spread = common.mix(tokens ^ np.uint64(5))
            if len(hot):
                dealt = np.isin(words, hot)[word]
                spread[dealt] = common.mix(tokens[dealt] ^ common.mix(prior[dealt]))
            shard = (spread % np.uint64(shards)).astype(np.int32)
            pair = word.astype(np.uint64) << BEFORE_BITS | prior
            order = np.lexsort((pair, shard))
            shard, pair, word, prior, rows = shard[order], pair[order], word[order], prior[order], rows[order]
            learnt = training[rows]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            del tokens, before, order, spread
            out: dict[str, list] = {name: [] for name in ("shard", *PACKED)}
            held = 0
            for s in range(shards):
                lo, hi = cuts[s], cuts[s + 1]
                if lo == hi:
                    continue
                first = np.flatnonzero(np.concatenate([[True], pair[lo + 1:hi] != pair[lo:hi - 1]])) + lo
                owner = word[first]
                lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                present, local = np.unique(rows[lo:hi], return_inverse=True)
                arrays = {
                    "words": words[owner[lead]], "per_word": np.diff(np.append(lead, len(owner))), "low": prior[first],
                    "more": prior[first] >> np.uint64(32), "train": np.add.reduceat(learnt[lo:hi].astype(np.int64), first - lo),
                    "per_pair": np.diff(np.append(first, hi)), "rows": local, "keys": keys[present].view(np.uint64)}
                out["shard"].append(s)
                for name, kind in PACKED.items():
                    out[name].append(arrays[name].astype(kind).tobytes())
                    held += len(out[name][-1])
                if held >= BATCH_BYTES:
                    yield batch_of(out)
                    out, held = {name: [] for name in out}, 0
            if held:
                yield batch_of(out)

    return source.mapInArrow(run, "shard int, " + ", ".join(f"{name} binary" for name in PACKED))


def quantised(values: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Codes of one byte and the codebook of weighted means. Half of the edges
    fill bins evenly by weight, so that what text is made of is told apart well;
    the others divide the range evenly, so that no bin is wide."""
    if not len(values):
        return {"code": np.zeros(0, np.uint8), "book": np.zeros(1)}
    order = np.argsort(values, kind="stable")
    filled = np.cumsum(weights[order])
    cuts = np.searchsorted(filled, np.linspace(0, filled[-1], LEVELS // 2 + 1)[1:-1])
    edges = np.unique(np.concatenate([values[order][cuts], np.linspace(values[order[0]], values[order[-1]], LEVELS // 2)]))[:LEVELS - 1]
    code = np.searchsorted(edges, values, side="left")
    total = np.bincount(code, weights, minlength=len(edges) + 1)
    return {"code": code.astype(np.uint8), "book": np.bincount(code, values * weights, minlength=len(edges) + 1) / np.maximum(total, 1e-300)}


class Trie:
    """A shard's model: words, the words before them, and their logarithms."""

    def __init__(self, words, prior, counts, corpus: dict, hot: dict[int, int]):
        """Training pairs, sorted by word and word before, each pair once."""
        # A dealt word is in every shard, whether or not a pair of it is.
        names = np.union1d(words, np.array(sorted(hot), np.uint64))
        owner = np.searchsorted(names, words)
        per_word = np.bincount(owner, minlength=len(names))
        seen = np.bincount(owner, counts, minlength=len(names)).astype(np.int64)
        for word, count in hot.items():
            seen[np.searchsorted(names, np.uint64(word))] = count
        self.mass, self.corpus = corpus["mass"], corpus
        single = self.single(seen)
        pair = np.log10(counts + self.mass * np.repeat(single, per_word))
        word_levels = eliasfano.encode((names >> WORD_LOW).astype(np.int64), names & np.uint64((1 << 48) - 1), 1 << 16)
        self.mapped = eliasfano.Mapped({
            "words": word_levels | {"counts": seen.astype(np.uint64)},
            "single": quantised(np.log10(single), seen), "norm": quantised(-np.log10(seen + self.mass), seen),
            "before": eliasfano.encode(owner, prior, max(1, len(names))), "pair": quantised(pair, counts)})

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Discounted probability of words by count, over the vocabulary and one unknown word."""
        n, v, d = self.corpus["tokens"], self.corpus["words"], self.corpus["discount"]
        if not n:
            return np.ones(len(counts))
        return np.maximum(counts - d, 0) / n + d * v / n / (v + 1)

    def read(self, level: str, at: np.ndarray) -> np.ndarray:
        arrays = self.mapped.levels[level]
        return arrays["book"][arrays["code"][at]]

    def answer(self, words, per_word, prior):
        """Per word its training count and normaliser, per pair its logarithm."""
        levels = self.mapped.levels
        at = eliasfano.find(levels["words"], (words >> WORD_LOW).astype(np.int64), words & np.uint64((1 << 48) - 1))
        known = at >= 0
        counts = np.zeros(len(words), np.int64)
        counts[known] = levels["words"]["counts"][at[known]]
        norm = np.full(len(words), -np.log10(self.mass))
        norm[known] = self.read("norm", at[known])
        single = np.full(len(words), np.log10(self.single(np.zeros(1))[0]))
        single[known] = self.read("single", at[known])
        owner = np.repeat(np.arange(len(words)), per_word)
        logs = np.log10(self.mass) + single[owner]
        ask = np.flatnonzero(known[owner])
        below = eliasfano.find(levels["before"], at[owner[ask]], prior[ask])
        hit = below >= 0
        logs[ask[hit]] = self.read("pair", below[hit])
        return counts, norm, logs


def before_of(block: dict) -> np.ndarray:
    """The hashes of the words before, of a block's pairs."""
    return block["more"].astype(np.uint64) << np.uint64(32) | block["low"]


def learnt_pairs(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words before and counts of a shard's training pairs, sorted, each pair
    once. A pair is sorted as one number: its word's place and the 40 bits below it."""
    used = [b["train"] > 0 for b in blocks]
    owner = [np.repeat(np.arange(len(b["words"]), dtype=np.int32), b["per_word"])[u] for b, u in zip(blocks, used, strict=True)]
    names = np.unique(np.concatenate([b["words"][np.unique(o)] for b, o in zip(blocks, owner, strict=True)]))
    if len(names) >= 1 << 24:
        raise ValueError("a shard has too many words; take fewer tokens a shard")
    key = np.concatenate([
        np.searchsorted(names, b["words"])[o].astype(np.uint64) << BEFORE_BITS | before_of(b)[u] for b, o, u in zip(blocks, owner, used, strict=True)])
    counts = np.concatenate([b["train"][u] for b, u in zip(blocks, used, strict=True)])
    del owner, used
    key, counts = totals(key, counts)
    return names[key >> BEFORE_BITS], key & np.uint64((1 << int(BEFORE_BITS)) - 1), counts.astype(np.int64)


SUMS = {"tokens": np.uint32, "known": np.uint32, "copies": np.uint32, "log_counts": np.float64, "logs": np.float64}


def shard_sums(packed: DataFrame, corpus: dict, hot: dict[int, int], buckets: int) -> DataFrame:
    """Every document's sums over a shard's tokens, packed by buckets of documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [{name: np.frombuffer(row[name], kind) for name, kind in PACKED.items()} for row in frame.to_dict("records")]
        words, prior, counts = learnt_pairs(blocks)
        trie = Trie(words, prior, counts, corpus, hot)
        del words, prior, counts
        keys, sums = [], {name: [] for name in SUMS}
        for b in blocks:
            seen, norm, logs = trie.answer(b["words"], b["per_word"].astype(np.int64), before_of(b))
            last = b["words"] == END
            norm = np.where(last, 0.0, norm)  # nothing follows the end
            owner = np.repeat(np.repeat(np.arange(len(b["words"])), b["per_word"]), b["per_pair"])
            n = len(b["keys"])
            add = lambda weights, b=b, n=n: np.bincount(b["rows"], weights, minlength=n)
            keys.append(b["keys"])
            sums["tokens"].append(np.bincount(b["rows"], minlength=n))
            sums["known"].append(add((seen > 0)[owner]))
            sums["copies"].append(add(last[owner]))
            sums["log_counts"].append(add(np.log10(seen + 1)[owner]))
            sums["logs"].append(add(norm[owner] + np.repeat(logs, b["per_pair"])))
        keys = np.concatenate(keys)
        place = common.mix(keys) % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1).astype(np.uint64))
        joined_sums = {name: np.concatenate(parts).astype(SUMS[name]) for name, parts in sums.items()}
        out = []
        for bucket in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            rows = order[cuts[bucket]:cuts[bucket + 1]]
            out.append((bucket, keys[rows].tobytes(), *(joined_sums[name][rows].tobytes() for name in SUMS)))
        return pd.DataFrame(out, columns=["bucket", "keys", *SUMS])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in frame["keys"]])
        distinct, row = np.unique(keys, return_inverse=True)
        out = {"row_key": distinct.view(np.int64)}
        for name, kind in SUMS.items():
            values = np.concatenate([np.frombuffer(v, kind) for v in frame[name]])
            out[name] = np.bincount(row, values, minlength=len(distinct)).astype(np.float64 if kind is np.float64 else np.int64)
        return pd.DataFrame(out)

    kinds = ", ".join(f"{name} {'double' if kind is np.float64 else 'long'}" for name, kind in SUMS.items())
    parts = packed.groupBy("shard").applyInPandas(run, "bucket int, keys binary, " + ", ".join(f"{name} binary" for name in SUMS))
    return parts.groupBy("bucket").applyInPandas(total, f"row_key long, {kinds}")


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, mass: float = 200.0,
          shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of every whole text by a model of the rows outside the held-out fold."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    # Equal rows share a key; their sums are divided by their number.
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    source = rows.select("text", "row_key", (~F.col("held_out")).alias("training"))
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = common.materialise(word_counts(source, spread))
    known = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "once", "twice"))).first()
    shards = max(8, -(-known.tokens // shard_tokens))
    # At most HOT_SHARE * shards words can have more than this part of the corpus.
    frequent = counted.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t")).select("t.*").where(
        F.col("top_counts") * HOT_SHARE * shards > known.tokens).collect()
    hot = {r.top % (1 << 64): r.top_counts for r in frequent}
    discount = known.once / (known.once + 2 * known.twice) if known.once else 0.5
    corpus = {"tokens": known.tokens, "words": known.words, "discount": min(max(discount, 0.1), 0.9), "mass": mass}
    packed = postings(source, shards, np.array(sorted(hot), np.uint64))
    sums = shard_sums(packed, corpus, hot, shards)
    starts = rows.where("not held_out").count()
    size = float(np.log10(known.tokens + known.words + 1))
    found = rows.select("doc_id", "held_out", "row_key").join(sums, "row_key", "left")
    return found.select(
        "doc_id", "held_out", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        ((F.col("log_counts") - F.col("tokens") * size) / F.col("copies")).alias("base_score"),
        (F.col("logs") / F.col("copies") - float(np.log10(starts + mass))).alias("score"))
