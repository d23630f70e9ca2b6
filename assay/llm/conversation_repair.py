"""Conversation structure repair: the cheapest edits that give a conversation the shape
``(system? (user assistant)+)?``, by Four-Russians block tables.

A row's symbol is the initial of its role (system, user, assistant, other) and its first fault:
blank, duplicate (role and text seen earlier), truncated. Edits: Keep 0, Rerole to user or
assistant 2, Delete 3 (blank and duplicate rows must go), Insert an empty user or assistant
row 2; a truncated row that stays adds 1.

What is left to pay from a place of the conversation is a vector over the four states of the
shape. Less its least entry, such a vector is one of few (they are bounded by the costs of two
insertions), so for every vector and every block of ``BLOCK`` symbols the vector before the
block and its cost are tabled once. A conversation is read from its end, one look-up a
block; then its blocks are expanded again, each from the vector behind it, and walked forward
taking at each step the ASCII-least edit that keeps the least cost. So ties are safe, and the
tracing of a block is looked up as well when it recurs.

On the cluster a conversation may hold any share of the rows. Copies are told by sorting
(conversation, role and text, turn) in ranges, rows are brought in order by sorting
(conversation, turn) in ranges; neither gathers a conversation in a task, and what crosses a
range's end is settled with one row a partition. A conversation's symbols, one byte a row (as
long as the audit that is returned), are read by one task. Repaired texts are streamed row by
row in the conversation's order, as a hash over them must be; no task holds a conversation's
texts.

Defined cases: a null role or text is one space; rows without conv_id are one conversation, of
id null; rows without a turn come first; rows of one turn are ordered by role, then by a hash of
role and text; repeated rows are duplicates; a role's initial is its first character, case as it
is; a conversation without rows has an empty audit and an empty repair; gaps beyond 64 bits are
the greatest long; extra columns are not read; an empty table gives an empty result. Texts are
taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import written
from assay.session import ship_package

#: States of the shape: nothing yet, a system row, a user row last, an assistant row last.
E, S, U, A = range(4)
FOLLOWS = (U, U, A, U)  # state after the row that may come next
KEEP = {"s": {E: S}, "u": {E: U, S: U, A: U}, "a": {U: A}, "o": {}}
INITIALS = "suao"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Symbols of the tables: a row that must go, then initial by initial whole and truncated.
SYMBOLS = 1 + 2 * len(INITIALS)
#: Symbols of a block.
BLOCK = 4
#: Audits and traced blocks that a worker remembers.
REMEMBERED = 1 << 16


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of rows coded as 4 * initial + fault."""
    initial, fault = codes >> 2, codes & 3
    gone = (fault == BLANK) | (fault == DUPLICATE)
    return np.where(gone, 0, 1 + 2 * initial + (fault == TRUNCATED))


def _choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row, in ASCII order."""
    yield "D", 3, state
    if symbol:
        initial, late = divmod(symbol - 1, 2)
        if state in KEEP[INITIALS[initial]]:
            yield "K", late, KEEP[INITIALS[initial]][state]
        yield "R", 2 + late, FOLLOWS[state]


def _inserted(cost: list[int]) -> list[int]:
    for _ in range(3):
        cost = [min(c, 2 + cost[FOLLOWS[s]]) for s, c in enumerate(cost)]
    return cost


def before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """What is left to pay before a row, by state, from what is left after it."""
    return _inserted([min(c + after[t] for _, c, t in _choices(symbol, s)) for s in range(4)])


#: What is left to pay behind the last row (no state waits longer than two insertions).
END = tuple(_inserted([0, 9, 9, 0]))


class BlockTables:
    """Transitions of normalised cost vectors over blocks of 1 to ``size`` symbols."""

    def __init__(self, size: int = BLOCK):
        self.size = size
        self.vectors = [END]
        number, step = {END: 0}, []
        for vector in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                cost = before(symbol, vector)
                least = min(cost)
                to = tuple(c - least for c in cost)
                if to not in number:
                    number[to] = len(self.vectors)
                    self.vectors.append(to)
                row.append((number[to], least))
            step.append(row)
        one = np.array(step, np.int64)
        to, cost = [np.arange(len(step))[:, None]], [np.zeros((len(step), 1), np.int64)]
        for _ in range(size):  # a symbol before the blocks of one symbol less
            last, paid = to[-1], cost[-1]
            to.append(np.swapaxes(one[last, :, 0], 1, 2).reshape(len(step), -1))
            cost.append(np.swapaxes(one[last, :, 1] + paid[:, :, None], 1, 2).reshape(len(step), -1))
        self.to, self.cost = [t.tolist() for t in to], [c.tolist() for c in cost]
        self._traced: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def _trace(self, length: int, block: int, behind: int, state: int) -> tuple[str, int]:
        """(ASCII-least cheapest edits, state after) of a block from the vector behind it."""
        key = (length, block, behind, state)
        if key in self._traced:
            return self._traced[key]
        row = [block // SYMBOLS ** (length - 1 - k) % SYMBOLS for k in range(length)]
        left = [self.vectors[behind]]
        for symbol in reversed(row):
            left.append(tuple(before(symbol, left[-1])))
        left.reverse()
        edits = []
        for k, symbol in enumerate(row):
            while True:
                due = left[k][state]
                choices = [*_choices(symbol, state)]
                found = choices[0] if choices[0][1] + left[k + 1][choices[0][2]] == due else None
                if found is None and 2 + left[k][FOLLOWS[state]] == due:
                    edits.append("I")
                    state = FOLLOWS[state]
                    continue
                edit, _, state = found or next(c for c in choices if c[1] + left[k + 1][c[2]] == due)
                edits.append(edit)
                break
        if len(self._traced) >= REMEMBERED:
            self._traced.clear()
        self._traced[key] = "".join(edits), state
        return self._traced[key]

    def repair(self, row: np.ndarray) -> tuple[int, str]:
        """(least cost, ASCII-least cheapest edits) of a conversation's symbols."""
        whole = len(row) // self.size
        weights = SYMBOLS ** np.arange(self.size - 1, -1, -1)
        blocks = [(self.size, b) for b in (row[:whole * self.size].reshape(whole, self.size) @ weights).tolist()]
        rest = row[whole * self.size:]
        if len(rest):
            blocks.append((len(rest), int(rest @ weights[-len(rest):])))
        vector, cost, behind = 0, 0, []
        for length, block in reversed(blocks):
            behind.append(vector)
            cost += self.cost[length][vector][block]
            vector = self.to[length][vector][block]
        cost += self.vectors[vector][E]
        state, audit = E, []
        for (length, block), vector in zip(blocks, reversed(behind), strict=True):
            edits, state = self._trace(length, block, vector, state)
            audit.append(edits)
        while END[state]:
            audit.append("I")
            state = FOLLOWS[state]
        return cost, "".join(audit)


WHITE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows after the planted damage: by
    crc32('conv_id:turn') % 20, 0 drops a row (no copy), 1 empties its text, 2 removes its
    [.!?], 3 repeats it (two copies), 4 makes it the user's. Nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    code = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    ends = F.replace(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit("!"), F.lit("")), F.lit("?"), F.lit(""))
    return rows.select(
        "conv_id", "turn",
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, ends).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with 16 bytes of a hash of role and text, by which copies are told."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    same = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        F.col("copies").cast("int").alias("copies"), F.substring(F.unhex(F.sha2(same.cast("binary"), 256)), 1, 16).alias("same"))


def _repeats(batches):
    """Rows in order of (conv_id, same): whether the row before is its copy."""
    part, last = TaskContext.get().partitionId(), None
    for b in batches:
        conv, same = b.column("conv_id").to_pylist(), b.column("same").to_pylist()
        again = []
        for key in zip(conv, same, strict=True):
            again.append(key == last)
            last = key
        head = np.zeros(b.num_rows, bool)
        if b.num_rows and part >= 0:
            head[0], part = True, -1 - part
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(again), pa.array(head), pa.array(np.full(b.num_rows, -1 - part), pa.int32())],
                                         [*b.schema.names, "again", "head", "part"])


NARROW = "conv_id bigint, turn bigint, role string, same binary, code int, copies int, place bigint"


def coded(marked: DataFrame) -> DataFrame:
    """conv_id, turn, role, same, code, copies, place and again (an earlier copy exists)."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = (F.when(~F.col("text").rlike(f"[^{WHITE}]"), BLANK)
             .when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), TRUNCATED).otherwise(NONE))
    narrow = written(marked.select("conv_id", "turn", "role", "same", (initial * 4 + fault).alias("code"), "copies"), "turns")
    live = narrow.filter("copies > 0").withColumn("place", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("conv_id", "same", "turn", "place")]
    told = written(live.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(_repeats, NARROW + ", again boolean, head boolean, part int"), "copies")
    ends = told.groupBy("part").agg(F.min(F.struct("conv_id", "same")).alias("first"), F.max(F.struct("conv_id", "same")).alias("last"))
    across, last = [], None  # one row for each partition
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        if row["first"] == last:
            across.append(row["part"])
        last = row["last"]
    again = F.col("again") | (F.col("head") & F.col("part").isin(across)) if across else F.col("again")
    told = told.withColumn("again", again).drop("head", "part")
    gone = narrow.filter("copies = 0").select("conv_id").distinct().select(
        "conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("same", "binary"))],
        F.lit(-1).alias("code"), F.lit(0).alias("copies"), F.lit(-1).cast("bigint").alias("place"), F.lit(False).alias("again"))
    return told.unionByName(gone)


PIECES = "conv_id bigint, part int, codes binary, first bigint, last bigint, turns bigint"


def _pieces(batches):
    """One row for each conversation of a partition sorted by conversation and turn: its codes
    and its turns (first, last, how many)."""
    part, open_ = TaskContext.get().partitionId(), None
    out = []

    def row(piece):
        conv, codes, first, last, turns = piece
        return conv, part, b"".join(codes), first, last, turns

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
            ["conv_id", "part", "codes", "first", "last", "turns"])

    for b in batches:
        conv = b.column("conv_id")
        known, ids = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1
        code, copies = b.column("code").to_numpy(), b.column("copies").to_numpy()
        again = b.column("again").to_numpy(zero_copy_only=False)
        has_turn, turn = b.column("turn").is_valid().to_numpy(zero_copy_only=False), b.column("turn").fill_null(0).to_numpy()
        first = np.where(again & (code & 3 != BLANK), (code & ~3) | DUPLICATE, code)
        second = np.where(code & 3 == BLANK, code, (code & ~3) | DUPLICATE)
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if a == z:
                continue
            own = int(ids[a]) if known[a] else None
            if open_ is None or open_[0] != own:
                if open_ is not None:
                    out.append(row(open_))
                    if len(out) >= 4096:
                        yield table(out)
                        out = []
                open_ = [own, [], None, None, 0]
            both = np.stack([first[a:z], second[a:z]], axis=1)
            open_[1].append(both[np.arange(2) < copies[a:z, None]].astype(np.uint8).tobytes())
            turns = turn[a:z][has_turn[a:z]]
            if len(turns):
                open_[4] += int(np.count_nonzero(turns[1:] != turns[:-1])) + (open_[3] != int(turns[0]))
                open_[2] = int(turns[0]) if open_[2] is None else open_[2]
                open_[3] = int(turns[-1])
    if open_ is not None:
        out.append(row(open_))
    if out:
        yield table(out)


FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LEGAL = np.zeros((4, 4), bool)
for _pair in ("su", "ua", "au"):
    LEGAL[INITIALS.index(_pair[0]), INITIALS.index(_pair[1])] = True


def _audits(batches):
    tables, known = BlockTables(), {}
    for b in batches:
        rows = []
        for conv, pieces in zip(b.column("conv_id").to_pylist(), b.column("pieces").to_pylist(), strict=True):
            raw = b"".join(p["codes"] for p in pieces)
            codes = np.frombuffer(raw, np.uint8).astype(np.int64)
            turned = [p for p in pieces if p["turns"]]
            gaps = 0
            if turned:
                meet = sum(x["last"] == y["first"] for x, y in zip(turned, turned[1:]))
                gaps = min((1 << 63) - 1, turned[-1]["last"] - turned[0]["first"] + 1 - sum(p["turns"] for p in turned) + meet)
            if raw not in known or len(raw) > 64:
                if len(known) >= REMEMBERED:
                    known.clear()
                initial, fault = codes >> 2, codes & 3
                illegal = int(np.count_nonzero(~LEGAL[initial[:-1], initial[1:]]))
                cost, audit = tables.repair(symbols(codes))
                found = (*(int(np.count_nonzero(fault == f)) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit)
                if len(raw) <= 64:
                    known[raw] = found
            else:
                found = known[raw]
            rows.append((conv, gaps, *found))
        names = [c.split()[0] for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if c == "audit" else pa.int64())
                                          for k, c in enumerate(names)], names)


def audits(marked: DataFrame) -> DataFrame:
    """Counts of faults, least cost and cheapest edits of each conversation."""
    order = [F.col(c) for c in ("conv_id", "turn", "role", "same", "again", "place")]
    pieces = coded(marked).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, PIECES)
    return (pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "codes", "first", "last", "turns"))).alias("pieces"))
            .mapInArrow(_audits, FOUND))


def _repaired(batches) -> Iterator[tuple]:
    """(audit row or None, (edit, role, text) or None) in each conversation's order: the audit
    row first, then the rows that stay or are inserted."""
    audit, at, state = "", 0, E
    names = {U: "user", A: "assistant"}

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, FOLLOWS[state]
            yield None, ("I", names[state], "")

    for b in batches:
        for row in b.to_pylist():
            if row["audit"] is not None:
                yield from inserts()
                audit, at, state = row["audit"], 0, E
                yield row, None
                continue
            for _ in range(row["copies"]):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEEP[row["role"][0]][state]
                    yield None, ("K", row["role"], row["text"])
                elif edit == "R":
                    state = FOLLOWS[state]
                    yield None, ("R", names[state], row["text"])
    yield from inserts()


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's audit row and then its rows, in one partition and in order."""
    ship_package(rows.sparkSession)
    marked = _marked(rows)
    found = written(audits(marked), "audits")
    counts = [c.split() for c in FOUND.split(", ")][1:]
    nulls = [F.lit(None).cast(t).alias(c) for c, t in counts]
    texts = marked.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "same", "text", "copies", *nulls)
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("same"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("copies"),
                         *[c for c, _ in counts])
    return texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "same").drop("same", "kind")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of the repaired conversations. ``rows`` has
    conv_id, turn, role, text and copies (how often the row stands there)."""
    def run(batches):
        conv, place, out = None, 0, []
        for head, kept in _repaired(batches):
            if head is not None:
                conv, place = head["conv_id"], 0
                continue
            out.append((conv, place, *kept))
            place += 1
            if len(out) >= 1024:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    def _table(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "place", "edit", "role", "text"])
    return _in_order(rows).mapInArrow(run, "conv_id bigint, place bigint, edit string, role string, text string")


def repair_digest(rows: DataFrame) -> DataFrame:
    """Each conversation's counts, cost and audit with the SHA-256 of its repaired rows, written
    ``role:text`` and joined by line feeds."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        head, digest, lines, out = None, None, 0, []

        def done():
            return tuple(head[c] for c in names) + (digest.hexdigest(),)

        for begins, kept in _repaired(batches):
            if begins is not None:
                if head is not None:
                    out.append(done())
                head, digest, lines = begins, hashlib.sha256(), 0
            else:
                digest.update((b"\n" if lines else b"") + f"{kept[1]}:{kept[2]}".encode())
                lines += 1
            if len(out) >= 1024:
                yield _table(out)
                out = []
        if head is not None:
            out.append(done())
        if out:
            yield _table(out)

    def _table(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if 0 <= k < len(names) - 1 else pa.string())
                                           for k in range(len(names) + 1)], [*names, "repaired_sha256"])
    return _in_order(rows).mapInArrow(run, FOUND + ", repaired_sha256 string")
