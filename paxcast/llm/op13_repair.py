"""Conversation structure repair by weighted interval parsing (operator 13).

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Faulty rows
are deleted, others kept or given another role, and empty turns inserted, at the least
cost. The repair grammar in Chomsky normal form has a nonterminal for each pair of
places p, q in that pattern: it derives a span of rows whose repaired roles lead
from p to q. Its rules are (p, q) -> (p, r) (r, q), and for single rows the edits with
their weights; what can be inserted around a row is closed into its cells. A cell
holds the least (cost, audit) of its nonterminal over a span, and charts are filled
bottom-up by span length. Of two audits of one span and cost neither is the start of the
other (they have a letter per row, and every further one costs), so the
least of the parts gives the least of the whole.

Rows are laid out by range of (conversation, turn), so that a conversation of any length is
spread over tasks. A task parses stretches of ``STRETCH`` rows and joins neighbouring
spans of doubling length; one span per task and conversation remains, and these are
joined per conversation. Only marks of rows travel for that, not their texts.

Defined cases: a null role or text is one space, so a null text is blank; a null turn
comes first; a null id is a conversation of its own; rows of equal turn are taken by
role and text, equal rows side by side; an empty table gives an empty result; other
columns are ignored. A conversation's audit is one string, so it has fewer than 2**31 rows.
"""

from __future__ import annotations

import hashlib
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common

# The pattern's moves between its places (start, after system, user,
# assistant), the places where it may end, and the weights of the edits.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GIVEN = {"u": "user", "a": "assistant"}

#: Nonterminals, and the rules that derive each from two.
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [(PAIRS.index((p, q)), PAIRS.index((p, r)), PAIRS.index((r, q)))
         for p, r, q in product(range(4), repeat=3) if {(p, q), (p, r), (r, q)} <= set(PAIRS)]
#: Rows of a stretch that is parsed in one chart.
STRETCH = 12
#: Charts that a task keeps for spans it meets again.
CHARTS = 100_000

Cell = tuple[int, str] | None


def joined(left: list[Cell], right: list[Cell]) -> list[Cell]:
    """The cells of two neighbouring spans taken together, at this one split."""
    out: list[Cell] = [None] * len(PAIRS)
    for whole, a, b in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            cost = x[0] + y[0]
            held = out[whole]
            if held is None or cost <= held[0]:
                new = (cost, x[1] + y[1])
                if held is None or new < held:
                    out[whole] = new
    return out


def least(a: list[Cell], b: list[Cell]) -> list[Cell]:
    return [y if x is None else x if y is None else min(x, y) for x, y in zip(a, b, strict=True)]


def insertions() -> list[Cell]:
    """What insertions alone derive: the closure of none and one inserted turn."""
    cells: list[Cell] = [(0, "") if p == q else (INSERT, "I") if any(MOVES.get((p, role)) == q for role in GIVEN) else None for p, q in PAIRS]
    while (more := least(cells, joined(cells, cells))) != cells:
        cells = more
    return cells


INSERTED = insertions()


def leaf(mark: str) -> list[Cell]:
    """The cells of one row: ``d`` must go; else the initial of its role (``x``: none
    that is legal), in upper case if the row is truncated."""
    cells: list[Cell] = [(DELETE, "D") if p == q else None for p, q in PAIRS]
    if mark != "d":
        extra = TRUNCATED if mark.isupper() else 0
        kept = [(KEEP + extra, "K") if MOVES.get((p, mark.lower())) == q else None for p, q in PAIRS]
        given = [(REROLE + extra, "R") if any(MOVES.get((p, role)) == q for role in GIVEN) else None for p, q in PAIRS]
        cells = least(cells, least(kept, given))
    return joined(joined(INSERTED, cells), INSERTED)


class Charts:
    """Parses stretches of marks. Spans of equal marks have equal cells, so these are kept."""

    def __init__(self, limit: int = CHARTS):
        self.cells: dict[str, list[Cell]] = {}
        self.limit = limit

    def parse(self, marks: str) -> list[Cell]:
        if len(self.cells) > self.limit:
            self.cells.clear()
        for size in range(1, len(marks) + 1):
            for at in range(len(marks) - size + 1):
                span = marks[at:at + size]
                if span in self.cells:
                    continue
                if size == 1:
                    self.cells[span] = leaf(span)
                    continue
                best = joined(self.cells[span[:1]], self.cells[span[1:]])
                for cut in range(2, size):
                    best = least(best, joined(self.cells[span[:cut]], self.cells[span[cut:]]))
                self.cells[span] = best
        return self.cells[marks] if marks else INSERTED


FAULTS = ("blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}


class Span:
    """Cells and figures of consecutive rows of a conversation."""

    def __init__(self, cells, figures, first, last):
        self.cells, self.figures, self.first, self.last = cells, figures, first, last

    def before(self, other: Span) -> Span:
        figures = [a + b for a, b in zip(self.figures, other.figures, strict=True)]
        figures[3] += self.last + other.first not in LEGAL
        return Span(joined(self.cells, other.cells), figures, self.first, other.last)


class Fold:
    """Joins spans that come in order, neighbours of like length first."""

    def __init__(self):
        self.held: list[tuple[int, Span]] = []

    def add(self, span: Span):
        size = 1
        while self.held and self.held[-1][0] == size:
            span = self.held.pop()[1].before(span)
            size *= 2
        self.held.append((size, span))

    def all(self) -> Span:
        span = self.held.pop()[1]
        while self.held:
            span = self.held.pop()[1].before(span)
        return span


def prepared(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` with nulls as defined."""
    return rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


ORDER = ["conv", "turn", "role", "text"]  # Spark sorts nulls first


def marked(rows: DataFrame) -> DataFrame:
    """Each row's place in the order of all rows, its conversation, the initial of its
    role and its first fault; without its text."""
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    laid = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(
        F.monotonically_increasing_id().alias("place"), "conv", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("content"))
    laid = common.materialise(laid)
    seen = laid.where("not blank").groupBy("conv", "content").agg(F.min("place").alias("place"))
    fresh = seen.select("place", F.lit(True).alias("fresh"))
    # Places are distinct, so no conversation or text, however common, weighs on this join.
    joined_rows = laid.drop("content").join(fresh, "place", "left")
    fault = F.when(F.col("blank"), 0).when(F.col("fresh").isNull(), 1).when(F.col("truncated"), 2).otherwise(3)
    return joined_rows.select("place", "conv", "initial", fault.alias("fault"))


CELLS = "costs array<int>, audits array<string>, figures array<long>, first string, last string"


def spans(marks: DataFrame) -> DataFrame:
    """One span per conversation and task of the layout."""
    part = F.shiftright("place", 33)

    def run(batches):
        charts, out = Charts(), []
        now, fold, stretch, initials = None, Fold(), [], []
        figures = [0, 0, 0, 0]

        def close():
            nonlocal stretch, initials, figures
            if stretch:
                figures[3] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
                fold.add(Span(charts.parse("".join(stretch)), figures, initials[0], initials[-1]))
                stretch, initials, figures = [], [], [0, 0, 0, 0]

        def end():
            nonlocal fold
            close()
            if fold.held:
                span = fold.all()
                out.append((now[0], now[1], [c and c[0] for c in span.cells], [c and c[1] for c in span.cells], span.figures, span.first, span.last))
                fold = Fold()

        for batch in batches:
            for key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                conv, place, initial, fault = key
                if now is None or now != (conv, place >> 33):
                    end()
                    now = (conv, place >> 33)
                stretch.append("d" if fault < 2 else initial.upper() if fault == 2 else initial)
                initials.append(initial)
                if fault < 3:
                    figures[fault] += 1
                if len(stretch) == STRETCH:
                    close()
            if out:
                yield span_batch(out)
                out.clear()
        end()
        if out:
            yield span_batch(out)

    rows = marks.select("conv", "place", "initial", F.col("fault").cast("int"))
    return rows.repartition(part).sortWithinPartitions("place").mapInArrow(run, "conv string, part long, " + CELLS)


def span_batch(out) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv", "part", "costs", "audits", "figures", "first", "last"])


PLAN = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """Per conversation (``conv``) the faults, the illegal neighbours, and the cheapest
    repair: its cost and its audit, the initials of its edits in order."""
    found = spans(marked(rows))

    def total(batches):
        now, fold, out, started = None, Fold(), [], False

        def end():
            if fold.held:
                span = fold.all()
                cost, audit = min(span.cells[PAIRS.index((0, e))] for e in ENDS)
                out.append((now, *span.figures, cost, audit))

        def batch_of():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.int64() if 0 < k < 6 else pa.string()) for k in range(7)], names=[c.split()[0] for c in PLAN.split(", ")])

        for batch in batches:
            for conv, _, costs, audits, figures, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != now:
                    end()
                    now, fold, started = conv, Fold(), True
                fold.add(Span([None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)], figures, first, last))
            if out:
                yield batch_of()
                out.clear()
        end()
        if out:
            yield batch_of()

    return found.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(total, PLAN)


TURNS = "conv string, position long, edit string, role string, text string"


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns of every conversation after its plan: position, edit, role and text.
    The turns of a conversation follow each other in one partition; they are streamed,
    never held."""
    orders = plan.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    turns = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text")

    def run(batches):
        audit, at, position, after = "", 0, 0, ""
        out: list = []

        def put(edit, role, text):
            nonlocal position, after
            out.append((conv, position, edit, role, text))
            position, after = position + 1, role[:1]

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put("I", GIVEN["a" if after == "u" else "u"], "")

        conv = None
        for batch in batches:
            for conv_now, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                conv = conv_now
                if not kind:
                    audit, at, position, after = text, 0, 0, ""
                    inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    put("K", role, text)
                elif edit == "R":
                    put("R", GIVEN["a" if after == "u" else "u"], text)
                inserted()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], pa.int64() if k == 1 else pa.string()) for k in range(5)], names=[c.split()[0] for c in TURNS.split(", ")])
                out.clear()

    both = orders.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text")
    return both.select("conv", "kind", "role", "text").mapInArrow(run, TURNS)


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its ``role:text`` lines, of turns that stand in order
    as :func:`repaired` leaves them. The digest chains over the whole text, so a
    conversation is read by one task, in a stream."""

    def run(batches):
        now, digest, started = None, None, False
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and conv == now:
                    digest.update(b"\n")
                else:
                    if started:
                        out.append((now, digest.hexdigest()))
                    now, digest, started = conv, hashlib.sha256(), True
                digest.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_pylist([{"conv": c, "repaired_sha256": h} for c, h in out], schema=KIND)
        if started:
            yield pa.RecordBatch.from_pylist([{"conv": now, "repaired_sha256": digest.hexdigest()}], schema=KIND)

    return turns.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


KIND = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def damage_draw() -> Column:
    """crc32 of ``conv_id:turn`` modulo 20, nulls as one space."""
    return F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage of the contract: dropped, emptied, without sentence ends,
    repeated, or given to the user."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    draw = F.col("_draw")
    rows = conversations.select("conv_id", "turn", "role", "text", damage_draw().alias("_draw")).where("_draw <> 0")
    rows = rows.withColumn("_copy", F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Per original conversation its faults after damage, the repair and its digest."""
    rows = prepared(damaged(conversations))
    plan = common.materialise(plans(rows))
    turn = F.when(damage_draw() != 0, F.col("turn").cast("long"))
    every = conversations.groupBy("conv_id").agg(F.max(turn).alias("_high"), F.min(turn).alias("_low"), F.countDistinct(turn).alias("_turns"))
    gaps = F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0))
    every = every.select("conv_id", F.col("conv_id").cast("string").alias("_conv"), gaps.cast("long").alias("gaps"))
    digest = text_digests(repaired(rows, plan))
    out = every.join(plan, F.col("_conv").eqNullSafe(plan["conv"]), "left").drop("conv")
    out = out.join(digest, F.col("_conv").eqNullSafe(digest["conv"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*FAULTS, "illegal", "cost")]
    return out.select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
