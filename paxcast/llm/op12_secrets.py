"""Secret scan with character Markov models (operator 12).

Three plain patterns find secrets that name themselves (assignments, access keys, long
hexadecimal strings). The rest is judged by two Markov models over the credential
alphabet: one of random strings, learnt from the values that the patterns label, one of
ordinary identifiers, learnt from the other runs of credential characters. Long runs
that mix letters and digits are what is to be judged; they label nothing. Along a run
each character has a log-likelihood ratio given the one before it; the maximal-scoring
segments of the run that reach the threshold are reported.

Texts are read once. Every task leaves what it found - base spans and long runs, a few
bytes per document - and its transition counts, one small matrix per class; the sums
of the matrices are the models, so they are learnt from all labelled rows of the input
whatever its size, and what reaches the driver is fixed by the alphabet.

The threshold on the ratio is the prior odds of the labelled samples (ordinary runs per
random one) times ``margin``; without labelled samples of either class no run is judged.

Defined cases: a null or empty text has no spans; repeated rows are judged one by one
and count again as samples; equal starts are ordered by kind; a text of any length is
scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common

#: Kinds of spans in their order (the first three and their patterns are fixed by the contract).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
#: Every match of ASSIGN holds one of these, in either case.
KEYWORDS = ("passw", "secret", "token", "api")

#: The credential alphabet; code 0 stands for the border of a run.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODES = np.zeros(256, np.uint8)
CODES[list(ALPHABET)] = np.arange(1, len(ALPHABET) + 1)
STATES = len(ALPHABET) + 1
LOWER_HEX = np.zeros(256, bool)
LOWER_HEX[list(b"0123456789abcdef")] = True
#: Bytes that end a sentence or a path rather than belong to a secret.
EDGES = ".=-/"

FOUND = ("row long, doc_id long, starts array<int>, ends array<int>, kinds array<int>, run_starts array<int>, runs array<string>, "
         "random binary, ordinary binary, n_random long, n_ordinary long")


def base_spans(text: str, hexadecimal: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the pattern matches, by start and kind."""
    out = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        out += [(*m.span(), 0, m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(*m.span(), 1, m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if hexadecimal:
        out += [(*m.span(), 2, m.group()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def stretches(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of set bytes of at least ``least``; a run never
    crosses rows."""
    n = len(mask)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    last[inner] = mask[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    held = ends - starts >= least
    return starts[held], ends[held]


def transitions(codes: np.ndarray) -> np.ndarray:
    """Counts of (code, next code) along a sequence of runs set apart by zeros."""
    pairs = codes[:-1].astype(np.int64) * STATES + codes[1:]
    return np.bincount(pairs, minlength=STATES * STATES)


def scan(docs: DataFrame, least: int = 16, sample_least: int = 8) -> DataFrame:
    """Per document row its base spans and the runs of ``least`` credential characters
    or more that touch none; beside them, once per task, the transition counts
    of the labelled samples (ordinary runs of ``sample_least`` or more, those of
    ``least`` or more only if they don't mix letters and digits)."""

    def read(batches):
        random, ordinary = np.zeros(STATES * STATES, np.int64), np.zeros(STATES * STATES, np.int64)
        n_random = n_ordinary = 0
        for chunk in common.chunks(batches):
            data, offsets, n = chunk.data, chunk.offsets, len(chunk)
            codes = CODES[data]
            place = np.zeros(len(data) + 1, np.int64)  # code points before each byte
            np.cumsum((data & 0xC0) != 0x80, out=place[1:])
            hex_rows = set((np.searchsorted(offsets, stretches(LOWER_HEX[data], offsets, 32)[0], side="right") - 1).tolist())
            texts = chunk.column("text")
            spans: list[list] = []
            for i in range(n):
                text = texts[i].as_py() or ""
                found = base_spans(text, i in hex_rows)
                spans.append(found)
                for start, end, _, value in found:
                    values = CODES[np.frombuffer(value.encode(), np.uint8)]
                    random += transitions(np.concatenate([[0], values, [0]]))
                    n_random += 1
                    at = offsets[i] + len(text[:start].encode())
                    codes[at:at + len(text[start:end].encode())] = 0  # no sample of ordinary runs
            every = stretches(codes > 0, offsets, sample_least)
            mixed = np.zeros((2, len(data) + 1), np.int64)  # letters and digits before each byte
            np.cumsum((codes > 0) & (codes <= 52), out=mixed[0, 1:])
            np.cumsum((codes > 52) & (codes <= 62), out=mixed[1, 1:])
            labelled = (every[1] - every[0] < least) | (mixed[:, every[1]] == mixed[:, every[0]]).any(0)
            starts, ends = every[0][labelled], every[1][labelled]
            used = np.zeros(len(data) + 2, bool)
            np.logical_xor.at(used, starts + 1, True)
            np.logical_xor.at(used, ends + 1, True)
            used = np.logical_xor.accumulate(used)
            # A border on either side of every run, also of runs that meet where rows do.
            apart = np.zeros(int((ends - starts).sum()) + len(starts) + 1, np.uint8)
            inside = np.ones(len(apart), bool)
            inside[np.cumsum(np.concatenate([[0], ends - starts + 1]))] = False
            apart[inside] = codes[used[1:len(data) + 1]]
            ordinary += transitions(apart)
            n_ordinary += len(starts)
            held = every[1] - every[0] >= least
            starts, ends = every[0][held], every[1][held]
            rows = np.searchsorted(offsets, starts, side="right") - 1
            cuts = np.searchsorted(rows, np.arange(n + 1))
            begin = place[starts] - place[offsets[rows]]
            runs = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            empty = pa.nulls(n, pa.binary())
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                chunk.column("row"), chunk.column("doc_id"),
                *(pa.array([[s[k] for s in found] for found in spans], pa.list_(pa.int32())) for k in range(3)),
                pa.array([begin[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int32())),
                pa.array([runs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.string())),
                empty, empty, none, none], names=[c.split()[0] for c in FOUND.split(", ")])
        if n_random or n_ordinary:
            lists = [pa.nulls(1, pa.list_(pa.int32()))] * 4 + [pa.nulls(1, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *lists, pa.array([random.tobytes()], pa.binary()),
                pa.array([ordinary.tobytes()], pa.binary()), pa.array([n_random]), pa.array([n_ordinary])],
                names=[c.split()[0] for c in FOUND.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(read, FOUND)


def learn(found: DataFrame, random_mix: float = 0.5, ordinary_mix: float = 0.001, margin: float = 100.0):
    """The log-likelihood ratio of every transition and the threshold.

    ``random_mix``, ``ordinary_mix``: share of a uniform choice of characters in the
    two models. Random strings may use any alphabet, not only the one the
    labelled ones happen to have; ordinary identifiers hardly ever leave theirs.
    """

    def add(batches):
        sums = np.zeros((2, STATES * STATES), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for k in (0, 1):
                    sums[k] += np.frombuffer(batch.column(k)[i].as_py(), np.int64)
                    n[k] += batch.column(2 + k)[i].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([sums[0].tobytes()], pa.binary()), pa.array([sums[1].tobytes()], pa.binary()), pa.array(n[:1]), pa.array(n[1:])],
            names=["random", "ordinary", "n_random", "n_ordinary"])

    kinds = "random binary, ordinary binary, n_random long, n_ordinary long"
    counts = found.where("random is not null").select("random", "ordinary", "n_random", "n_ordinary")
    # One small row per partition is left before the last step adds them up.
    total = counts.mapInArrow(add, kinds).coalesce(1).mapInArrow(add, kinds).first()
    if not total or not total.n_random or not total.n_ordinary:
        return None
    models = []
    for raw, mix in ((total.random, random_mix), (total.ordinary, ordinary_mix)):
        counts = np.frombuffer(raw, np.int64).reshape(STATES, STATES)[:, 1:].astype(float)
        single = (counts.sum(0) + 1.0) / (counts.sum() + STATES - 1)
        given = (counts + single * STATES) / (counts.sum(1, keepdims=True) + STATES)
        models.append((1 - mix) * given + mix / (STATES - 1))
    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = np.log(models[0] / models[1])
    return ratio, log(max(1.0, total.n_ordinary / total.n_random)) + log(margin)


def scored_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score): no segment can be made better
    by stretching, shrinking or joining it with others."""
    total, kept = 0.0, []  # kept: (start, end, sum before it, sum at its end)
    for i, value in enumerate(values.tolist()):
        before, total = total, total + value
        if value <= 0:
            continue
        start, left, right = i, before, total
        while kept:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= left:
                k -= 1
            if k < 0 or kept[k][3] >= right:
                break
            start, left = kept[k][0], kept[k][2]
            del kept[k:]
        kept.append((start, i + 1, left, right))
    return [(a, b, right - left) for a, b, left, right in kept]


def segments(run: str, ratio: np.ndarray, threshold: float, least: int) -> list[tuple[int, int]]:
    """Segments of a run that the models take for random strings."""
    codes = CODES[np.frombuffer(run.encode(), np.uint8)]
    values = ratio[np.concatenate([[0], codes[:-1]]), codes]
    out = []
    for a, b, score in scored_segments(values):
        while a < b and run[a] in EDGES:
            a += 1
        while a < b and run[b - 1] in EDGES:
            b -= 1
        if score >= threshold and b - a >= least:
            out.append((a, b))
    return out


def find_secrets(docs: DataFrame, least: int = 16, margin: float = 100.0) -> DataFrame:
    """``row``, ``doc_id`` and the ``spans`` (kind, start, end in code points) of every
    document row; models are learnt from the same rows. ``least``: characters that a
    segment found by the models must have."""
    found = common.materialise(scan(docs, least))
    model = learn(found, margin=margin)

    def judge(batches):
        for batch in batches:
            starts, ends, kinds, begins, runs = (batch.column(k).to_pylist() for k in range(2, 7))
            out = []
            for i in range(batch.num_rows):
                spans = list(zip(starts[i], kinds[i], ends[i], strict=True))
                if model:
                    for begin, run in zip(begins[i], runs[i], strict=True):
                        spans += [(begin + a, 3, begin + b) for a, b in segments(run, *model, least)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
                names=["row", "doc_id", "spans"])

    rows = found.where("row is not null").select(*(c.split()[0] for c in FOUND.split(", ")[:7]))
    return rows.mapInArrow(judge, "row long, doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of :func:`find_secrets`."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", *(number(kind).alias(f"n_{kind}") for kind in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Per document the counts, the digest of the base spans and all spans."""
    return digests(find_secrets(docs))

