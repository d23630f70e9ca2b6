"""Conversation repair against a plain search over edits, and on edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import conversation_repair as cr

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def edits(rows):
    """(cost, audit) of rows (initial, must go, truncated) by trying every edit."""
    @cache
    def best(i, last, added):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if added < 3:
            c, e = best(i, NEXT[last], added + 1)
            found.append((c + 2, "I" + e))
        if i < len(rows):
            initial, gone, late = rows[i]
            c, e = best(i + 1, last, 0)
            found.append((c + 3, "D" + e))
            if not gone:
                if initial == NEXT[last] or initial == "s" and last == "":
                    c, e = best(i + 1, initial, 0)
                    found.append((c + late, "K" + e))
                c, e = best(i + 1, NEXT[last], 0)
                found.append((c + 2 + late, "R" + e))
        return min(found, default=(10**9, ""))
    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays shallow
        for last in NEXT:
            best(i, last, 0)
    return best(0, "", 0)


def brute(rows):
    """The contract's digest, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, seq in out.items():
        same = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        seq.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), same(r)))
        seen, faults, given = set(), [], []
        for _, role, text in seq:
            strip = text.strip(" \t\n\v\f\r")
            fault = "b" if not strip else "d" if (role, text) in seen else "t" if strip[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            given.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault in ("b", "d"), int(fault == "t")))
        cost, audit = edits(tuple(given))
        lines, last, k = [], "", 0
        for e in audit:
            if e == "I":
                last = NEXT[last]
                lines.append({"u": "user", "a": "assistant"}[last] + ":")
                continue
            _, role, text = seq[k]
            k += 1
            if e == "R":
                last = NEXT[last]
                lines.append({"u": "user", "a": "assistant"}[last] + ":" + text)
            elif e == "K":
                last = role[0]
                lines.append(role + ":" + text)
        assert k == len(seq) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = [t for t, _, _ in seq if t is not None]
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
               sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(seq, seq[1:])), cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def digest(df):
    return sorted([tuple(r) for r in cr.repair_digest(cr.damaged(df)).select(*COLS).collect()], key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("size", [1, 2, 4])
def test_tables_find_the_least_of_all_edits(size):
    """Every short conversation, and long ones, for blocks of several sizes."""
    kinds = [("o", True, 0)] + [(i, False, late) for i in "suao" for late in (0, 1)]
    tables, rng = cr.BlockTables(size), random.Random(size)
    rows = [r for n in range(4) for r in itertools.product(range(len(kinds)), repeat=n)]
    rows += [tuple(rng.choices(range(len(kinds)), weights=[2, 1, 1, 4, 2, 4, 2, 1, 1], k=rng.randint(4, 40))) for _ in range(400)]
    for row in rows:
        assert tables.repair(np.array(row, np.int64)) == edits(tuple(kinds[k] for k in row)), row


def test_few_vectors():
    assert len(cr.BlockTables().vectors) < 40 and all(min(v) == 0 for v in cr.BlockTables().vectors)


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("kind", F.lit(5)).withColumn("audit", F.lit("x"))
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert digest(df) == sorted(brute(rows), key=repr)


def test_edge_cases(spark):
    """Nulls in every column, ties, repeated rows, odd roles, conversations of which all rows
    are dropped, and one that spans many partitions."""
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in [None, None, *range(rng.randint(0, 9)), 3, 3]:
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "tool", "", None, "User", "é"]),
                         rng.choice(["Yes.", "No", "", None, " \t\n", "é!", "what? ", "Long " * 5000 + "."])))
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", "a b c." if t % 11 else f"more {t}") for t in range(3000)]
    rows += [(78, 1, "user", "Equal.")] * 500
    dropped = [c for c in range(100, 300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "Gone.") for c in dropped]
    got = digest(frame(spark, rows).repartition(5))
    assert got == sorted(brute(rows), key=repr)
    assert [r for r in got if r[0] == dropped[0]] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_extreme_turns_and_nothing(spark):
    rows = [(5, -(1 << 63), "user", "A."), (5, (1 << 63) - 1, "assistant", "B.")]
    full = cr.repair_digest(frame(spark, rows).withColumn("copies", F.lit(1)))
    assert full.first()["gaps"] == (1 << 63) - 1
    assert digest(frame(spark, []).limit(0)) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "tool", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And?")]
    got = cr.repaired_rows(frame(spark, rows).withColumn("copies", F.lit(1))).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "R", "user", "Hi."), (1, 1, "K", "assistant", "Yes."), (1, 2, "K", "user", "And?"), (1, 3, "I", "assistant", "")]
