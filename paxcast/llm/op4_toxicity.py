"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A window of text (a word with its borders; longer runs in overlapping parts) is
compressed once with each; the bytes that the toxic dictionary saves are the
window's gain. Gains are weighed by how much likelier they are in toxic texts,
and a document's weights are turned into a probability; both calibrations use
labelled rows that the dictionaries have not seen.

The fit takes a bounded, documented sample of labelled training rows
(``toxic_limit`` and ``ordinary_limit`` documents of at most ``fit_bytes``
bytes) and runs in one task. Every whole text is scored, in its own task, without a shuffle.

Defined cases: a null or empty text has no window and gets the score of a text
without gains; repeated rows are scored one by one; rows without a label, or
with another label than 0 and 1, aren't learnt from; without training rows of
both labels every score is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common

#: Bytes that border words: everything in ASCII but letters; upper case is lowered.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
LONGEST, STRIDE = 48, 24  # a longer run of letters is windowed in overlapping parts
GAINS = np.arange(-3, 9)  # gains beyond these count as the outermost
CACHE_ENTRIES = 500_000
#: Toxic training texts that a window must occur in to be learnt: a number, or a share of them.
MIN_DOCS, MIN_PERCENT = 2, 2
ORDINARY_BYTES, SPECIAL_BYTES = 100_000, 6_000


def windows(text: str) -> list[bytes]:
    """Words of a text; a word that is too long for one window in parts."""
    words = text.encode().translate(FOLD).split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i:i + LONGEST] for w in words for i in range(0, max(1, len(w) - STRIDE), STRIDE)]
    return words


class Gauge(dict):
    """Gain of each window, remembered as long as there is room."""

    def __init__(self, ordinary: bytes, toxic: bytes, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit = limit
        # Both dictionaries share the ordinary text and are equally long, so
        # that offsets cost alike; they differ in what stands nearest.
        near = ordinary[:len(toxic)]
        settings = zs.ZstdCompressionParameters(
            window_log=18, strategy=zs.STRATEGY_GREEDY, min_match=4, hash_log=17, chain_log=18, search_log=6,
            format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        # A block must be worth compressing, and no match is sought at its end:
        # text that both dictionaries hold follows, behind a byte of no text.
        self.tail = b" \x00" + ordinary[len(ordinary) // 2:][:64]
        self.packers = []
        for nearest in (near, toxic):
            content = zs.ZstdCompressionDict(ordinary + nearest, dict_type=zs.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.packers.append(zs.ZstdCompressor(dict_data=content, compression_params=settings).compress)

    def __missing__(self, window: bytes) -> int:
        text = b" " + window + self.tail
        plain, toxic = self.packers
        gain = min(max(len(plain(text)) - len(toxic(text)), int(GAINS[0])), int(GAINS[-1])) - int(GAINS[0])
        if len(self) >= self.limit:
            self.clear()
        self[window] = gain
        return gain


def counts(gauge: Gauge, words: list[bytes]) -> np.ndarray:
    """How many windows have each gain."""
    return np.bincount(list(map(gauge.__getitem__, words)), minlength=len(GAINS))


def train_dictionary(size: int, words: list[bytes], rng: random.Random, **options) -> bytes:
    """A zstandard dictionary of shuffled words in lines of sixteen."""
    words = list(words)
    rng.shuffle(words)
    lines = [b" " + b"  ".join(words[i:i + 16]) + b" " for i in range(0, len(words), 16)]
    try:
        return zs.train_dictionary(size, lines, **options).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(lines)[-size:]


def fit_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], rng: random.Random) -> tuple[bytes, bytes]:
    """Dictionaries of ordinary text and of what only toxic texts say.

    The toxic one is trained on windows much commoner in toxic texts. Ordinary
    windows on which it still wins are then added to the ordinary one.
    """
    in_toxic, in_ordinary = Counter(), Counter()
    for words in toxic:
        in_toxic.update(set(words))
    for words in ordinary:
        in_ordinary.update(set(words))
    least = max(MIN_DOCS, len(toxic) * MIN_PERCENT // 100)
    share = len(ordinary) / len(toxic)
    telling = {w for w, n in in_toxic.items() if n >= least and in_ordinary[w] <= 0.05 * n * share}
    told = Counter(w for words in toxic for w in words if w in telling)
    whole = b" " + b"  ".join(sorted(told, key=lambda w: (told[w], w))) + b" "
    samples = [w for w, n in told.items() for _ in range(min(n, 20))]
    everything = [w for words in ordinary for w in words]
    rng.shuffle(everything)
    base = train_dictionary(ORDINARY_BYTES, everything[:1_500_000], rng)
    if not samples:
        return base, base[:256]
    # The trainer picks what to keep; windows that all fit need no picking.
    special = whole if len(whole) <= SPECIAL_BYTES else train_dictionary(SPECIAL_BYTES, samples, rng, k=16, d=6)
    common_words = Counter(everything)
    for _ in range(2):
        gauge = Gauge(base, special)
        wrong = [(n, w) for w, n in common_words.items() if n >= 2 and gauge[w] + GAINS[0] >= 2]
        wrong = [w for _, w in sorted(wrong, reverse=True)][:1500]
        if not wrong:
            break
        base = base + b" " + b"  ".join(wrong) + b" "
        base = base[-ORDINARY_BYTES - 12_000:]
    return base, special


def features(count: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the document's probability is drawn from."""
    n = max(1, int(count.sum()))
    total = float(count @ weights)
    strong = float(count[weights > 1.0].sum())
    return np.array([1.0, np.clip(total, -20, 20) / 5, min(strong / n, 0.05) * 50, np.log1p(min(strong, 50)), np.log1p(n) / 5])


def fit(toxic: list[str], ordinary: list[str], toxic_rows: int, ordinary_rows: int, seed: int = 11) -> dict | None:
    """The model: dictionaries, gain weights and probability coefficients."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    rng = random.Random(seed)
    parts, known = [], {}
    for texts in (toxic, ordinary):
        words = [[known.setdefault(w, w) for w in windows(t)] for t in texts]  # equal windows are one object
        rng.shuffle(words)
        parts.append((words[::2], words[1::2]))
    base, special = fit_dictionaries(parts[0][0], parts[1][0], rng)
    gauge = Gauge(base, special)
    seen = [np.array([counts(gauge, w) for w in part[1]]) for part in parts]
    rates = [(s.sum(0) + 0.5) / (s.sum() + 0.5 * len(GAINS)) for s in seen]
    weights = np.maximum.accumulate(np.log(rates[0] / rates[1]))  # a larger gain never speaks less for label 1
    x = np.array([features(c, weights) for s in seen for c in s])
    y = np.repeat([1.0, 0.0], [len(s) for s in seen])
    importance = np.repeat([toxic_rows / len(seen[0]), ordinary_rows / len(seen[1])], [len(s) for s in seen])
    return {"base": base, "special": special, "weights": weights, "coefficients": logistic(x, y, importance / importance.mean())}


def logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (importance * (y - p)) - ridge * beta
        hessian = (x * (importance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scorer(model: dict):
    """``text -> probability`` with the model's dictionaries."""
    gauge = Gauge(model["base"], model["special"])
    weights, coefficients = model["weights"], model["coefficients"]
    return lambda text: float(1 / (1 + np.exp(-np.clip(features(counts(gauge, windows(text)), weights) @ coefficients, -30, 30))))


def sampled(docs: DataFrame, labels: DataFrame, toxic_limit: int, ordinary_limit: int, fit_bytes: int):
    """A random sample of labelled training rows, bounded per label, as ``toxic``,
    ``doc_id``, ``text``, and the number of training rows of each label."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~common.held_out("doc_id", 4, 2))
    rows = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", "text").where(f"octet_length(text) between 1 and {fit_bytes}")
    usable = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [
        usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("toxic", "doc_id")
        for label, limit in ((1, toxic_limit), (0, ordinary_limit))]
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return found.groupBy("toxic", "doc_id").agg(F.min("text").alias("text")), rows.get(1, 0), rows.get(0, 0)


def training_sample(docs: DataFrame, labels: DataFrame, toxic_limit: int, ordinary_limit: int, fit_bytes: int):
    """The sample's texts of label 1 and of label 0, collected, and the number of
    training rows of each label."""
    found, *rows = sampled(docs, labels, toxic_limit, ordinary_limit, fit_bytes)
    found = found.orderBy("doc_id").collect()
    return [r.text for r in found if r.toxic == 1], [r.text for r in found if r.toxic == 0], *rows


def train(docs: DataFrame, labels: DataFrame, toxic_limit: int = 1600, ordinary_limit: int = 4000, fit_bytes: int = 40_000) -> dict | None:
    """The model, fitted to the sample by one task; the driver gets the model alone."""
    found, toxic_rows, ordinary_rows = sampled(docs, labels, toxic_limit, ordinary_limit, fit_bytes)

    def run(batches):
        texts = {1: [], 0: []}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts[label].append(text)
        model = fit(texts[1], texts[0], toxic_rows, ordinary_rows)
        if model:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model["base"]], pa.binary()), pa.array([model["special"]], pa.binary()),
                 *(pa.array([model[c].tolist()], pa.list_(pa.float64())) for c in ("weights", "coefficients"))],
                names=["base", "special", "weights", "coefficients"])

    fitted = found.repartition(1).sortWithinPartitions("doc_id").select("toxic", "text").mapInArrow(
        run, "base binary, special binary, weights array<double>, coefficients array<double>").collect()
    if not fitted:
        return None
    row = fitted[0]
    return {"base": bytes(row.base), "special": bytes(row.special), "weights": np.array(row.weights), "coefficients": np.array(row.coefficients)}


def score(docs: DataFrame, model: dict | None, threshold: float = 0.3, carry: str | None = None) -> DataFrame:
    """Probability of label 1 and the prediction for every row; ``carry`` names a
    string column that goes along."""
    own = [carry] if carry else []

    def run(batches):
        rate = scorer(model) if model else lambda text: 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = np.array([rate(t or "") for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), *([part.column(3)] if own else [])],
                    names=["doc_id", "held_out", "score", "predicted", *own])

    return docs.select(F.col("doc_id").cast("long"), common.held_out("doc_id", 4, 2).alias("held_out"), "text", *own).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int" + "".join(f", {c} string" for c in own))
