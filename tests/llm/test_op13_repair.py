import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paxcast.llm import op13_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """Python rows (conv, turn, role, text) after the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Shortest path over (row, place in the pattern), with all audits compared."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def insert(best):
        for _ in range(4):
            for p, (cost, audit, text) in list(best.items()):
                for name in ("user", "assistant"):
                    q = moves.get((p, name[0]))
                    if q is not None:
                        new = (cost + 2, audit + "I", [*text, name + ":"])
                        if q not in best or new[:2] < best[q][:2]:
                            best[q] = new
        return best

    best = insert({0: (0, "", [])})
    for (_, _, role, text), fault in zip(rows, found):
        after = {}

        def offer(q, new):
            if q is not None and (q not in after or new[:2] < after[q][:2]):
                after[q] = new

        for p, (cost, audit, done) in best.items():
            offer(p, (cost + 3, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            offer(moves.get((p, role[:1])), (cost + extra, audit + "K", [*done, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                offer(moves.get((p, name[0])), (cost + 2 + extra, audit + "R", [*done, f"{name}:{text}"]))
        best = insert(after)
    return min((best[p] for p in (0, 3) if p in best), key=lambda b: b[:2])


def brute(rows):
    convs, out = {r[0] for r in rows}, {}
    hurt = damage(rows)
    for conv in convs:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(mine)
        cost, audit, text = cheapest(mine, found)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def got(df):
    rows = op.repair_digests(df).collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_conversations_match_shortest_paths(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got(df) == want
    assert len({v[6] for v in want.values()}) > 10


def test_charts_match_enumeration_of_all_edits():
    """Every way to edit up to three rows, with up to three insertions at each place."""
    charts = op.Charts()
    fill = [""] + ["".join(p) for n in (1, 2, 3) for p in itertools.product("ua", repeat=n) if "uu" not in "".join(p) and "aa" not in "".join(p)]
    legal = re.compile("(s?(ua)+)?")
    for n in range(4):
        every = list(itertools.product("suaxUAd", repeat=n))
        for marks in every if n < 3 else random.Random(3).sample(every, 40):
            options = []
            for m in marks:
                t = int(m.isupper())
                options.append([("D", 3, "")] + ([] if m == "d" else [("K", t, m.lower()), ("R", 2 + t, "u"), ("R", 2 + t, "a")]))
            best = (99, "")
            for picks in itertools.product(*options):
                # Insertions between two kept rows never exceed three in a cheapest repair.
                gaps = fill if n < 2 else [f for f in fill if len(f) <= 2]
                base = sum(p[1] for p in picks)
                for ins in itertools.product(gaps, repeat=n + 1):
                    cost = base + 2 * sum(map(len, ins))
                    if cost > best[0]:
                        continue
                    roles = ins[0] + "".join(p[2] + i for p, i in zip(picks, ins[1:]))
                    if legal.fullmatch(roles):
                        best = min(best, (cost, "I" * len(ins[0]) + "".join(p[0] + "I" * len(i) for p, i in zip(picks, ins[1:]))))
            cells = charts.parse("".join(marks))
            assert min(cells[op.PAIRS.index((0, e))] for e in op.ENDS) == best, marks


def test_any_split_gives_the_same_cells():
    rng = random.Random(13)
    charts = op.Charts()
    for _ in range(40):
        marks = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(2, 14)))
        whole = charts.parse(marks)
        for cut in range(1, len(marks)):
            assert op.joined(charts.parse(marks[:cut]), charts.parse(marks[cut:])) == whole


def random_rows(rng, conv, n):
    texts = ["Yes.", "No!", "", " \n", "cut off", "why? ", "long " * 30 + ".", None]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    return [(conv, rng.choice([i, i, i + 3, None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {i}.") for i in range(n)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_long_conversations_split_over_tasks(spark, partitions):
    rng = random.Random(7)
    rows = random_rows(rng, 1, 700) + [r for c in range(2, 40) for r in random_rows(rng, c, rng.randint(1, 9))] + random_rows(rng, None, 30)
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_repaired_turns_are_legal_and_keep_their_texts(spark):
    rows = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate([("assistant", "Hi."), ("assistant", "Again."), ("tool", "Out."), ("user", "Why?")][:c])]
    df = op.prepared(spark.createDataFrame(rows or [], SCHEMA))
    turns = op.repaired(df, op.plans(df)).collect()
    for conv in range(1, 5):
        mine = sorted((t for t in turns if t.conv == str(conv)), key=lambda t: t.position)
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in mine))
        assert [t.position for t in mine] == list(range(len(mine)))


def test_nulls_ties_repeats_long_texts_extra_columns_and_empty_table(spark):
    rows = [(None, None, None, None), (1, None, "user", "x" * 300_000 + "."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 1, "user", "No."), (2, 5, "system", "S.")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("conv", "cost", "audit", "gaps", "place", "kind")))
    assert got(df) == brute(rows)
    assert op.repair_digests(df.limit(0)).count() == 0
