"""Conversation structure repair by iterative-deepening A*.

A conversation should read ``(system? (user assistant)+)?``. Rows are kept, given another role, deleted, or joined by
an inserted row; the search walks the edits depth first in ASCII order under growing cost bounds, remembers the
states that failed and with how much money, and the first path that ends well is the cheapest, ASCII-least one.

Rows are range-partitioned in conversation order, so a huge conversation spreads over tasks. Each task solves the
conversations it holds whole. What crosses a border, or is longer than a segment, is solved once for every state in
which the segment may begin and end, and the segments are put together by their costs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteworks.llm.common import SPACE_CHARS
from noteworks.session import cut_lineage

RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5  # costs; CUT_OFF for a truncated row that stays
SEGMENT_ROWS = 256
SEGMENT_BYTES = 1 << 20

# States: nothing yet, after the system row, after a user row, after an assistant row (where it may end).
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {"su", "ua", "au"}
SPACE_CLASS = r"[^\x20\x09-\x0D]"

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
RESULT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def least_costs(rows: str) -> list[int]:
    """For each place a lower bound of what the rest costs. ``rows`` has a letter per row: the role's initial
    (``x`` for others), in upper case if truncated, ``-`` if the row must go. Neighbours that may not follow each
    other need an edit, too; such pairs count once a row."""
    n = len(rows)
    bound, pairs, after = [0] * (n + 1), [0] * (n + 1), n  # after: the next row that stays
    for i in range(n - 1, -1, -1):
        c = rows[i]
        bound[i] = bound[i + 1] + (DELETE if c == "-" or c.isupper() else RELABEL if c == "x" else 0)
        pairs[i] = pairs[i + 1]
        if c == "-":
            continue
        if after < n and c in "sua" and rows[after] in "sua" and c + rows[after] not in LEGAL:
            pairs[i] = max(pairs[i], 1 + pairs[after + 1])
        after = i
    return [b + p for b, p in zip(bound, pairs)]


def search(rows: str, entry: int = START, exit: int | None = None) -> tuple[int, str] | None:
    """Cheapest cost and ASCII-least edits from ``entry``. Without ``exit`` the conversation must end well and rows
    may be inserted behind the last one; with it, the last row leads to that state. None: impossible."""
    n, guess = len(rows), least_costs(rows)
    if exit is not None and ((exit == START and entry != START) or (exit == SYSTEM and entry > SYSTEM) or (not n and exit != entry)):
        return None
    if exit == START:  # only by deleting all
        return DELETE * n, "D" * n
    failed: dict[tuple[int, int], int] = {}  # the money with which a state failed
    bound = guess[0]
    while True:
        beyond, path = None, []
        stack = [(0, entry, 0, 0)]  # place, state, cost, edits tried
        while stack:
            i, state, cost, tried = stack.pop()
            if i == n and cost <= bound and (state == exit if exit is not None else state in (START, ASSISTANT)):
                return cost, "".join(path)
            if tried == 0:
                need = max(guess[i], failed.get((i, state), -1) + 1)
                if cost + need > bound:
                    beyond = cost + need if beyond is None else min(beyond, cost + need)
                    if path:
                        path.pop()
                    continue
            row = rows[i] if i < n else None
            move = None
            while tried < 4 and move is None:
                if tried == 0 and row:
                    move = ("D", i + 1, state, DELETE)
                elif tried == 1 and (row or exit is None):
                    move = ("I", i, NEXT[state], INSERT)
                elif tried > 1 and row and row != "-":
                    extra = CUT_OFF if row.isupper() else 0
                    if tried == 3:
                        move = ("R", i + 1, NEXT[state], RELABEL + extra)
                    elif (state, row.lower()) in KEEP:
                        move = ("K", i + 1, KEEP[state, row.lower()], extra)
                tried += 1
                if move is not None and exit == SYSTEM and move[2] > SYSTEM:  # no way back
                    move = None
            if move is None:
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                if path:
                    path.pop()
                continue
            stack.append((i, state, cost, tried))
            path.append(move[0])
            stack.append((move[1], move[2], cost + move[3], 0))
        if beyond is None:
            return None
        bound = beyond


def segment_table(rows: str) -> list[list[tuple[int, str] | None]]:
    return [[search(rows, a, b) for b in range(4)] for a in range(4)]


def join_tables(tables: list[list[list[tuple[int, str] | None]]]) -> tuple[int, list[str]]:
    """Cheapest cost and the edits of each segment, ASCII-least. Backwards: the cheapest rest from each state.
    Edits of one segment to different states differ in a letter before either ends, so they alone decide ties."""
    rest = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
    costs, choices = {s: c for s, (c, _) in rest.items()}, []
    for table in reversed(tables):
        best: dict[int, tuple[int, str, int]] = {}
        for a in range(4):
            ways = [(t[0] + costs[b], t[1], b) for b, t in enumerate(table[a]) if t is not None and b in costs]
            if ways:
                best[a] = min(ways)
        choices.append(best)
        costs = {a: way[0] for a, way in best.items()}
    state, edits = START, []
    for best in reversed(choices):
        edits.append(best[state][1])
        state = best[state][2]
    return costs[START], [*edits, rest[state][1]]


def apply_edits(edits: str, roles: list[bytes], texts: list[bytes], state: int = START) -> tuple[list[bytes], int]:
    """The repaired lines, and the state after them."""
    out, i = [], 0
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out.append(ROLE[state] + b":")
            continue
        if e == "R":
            state = NEXT[state]
            out.append(ROLE[state] + b":" + texts[i])
        elif e == "K":
            state = KEEP[state, roles[i][:1].decode()]
            out.append(roles[i] + b":" + texts[i])
        i += 1
    return out, state


class Segment:
    """Successive rows of one conversation, and what can be said of them without the others."""

    def __init__(self, conv):
        self.conv, self.rows, self.roles, self.texts, self.turns, self.size = conv, "", [], [], [], 0
        self.initials: list[str] = []
        self.faults = [0, 0, 0]

    def add(self, turn, role: bytes, text: bytes, initial: str, fault: int) -> None:
        letter = initial if initial in ("s", "u", "a") else "x"
        self.rows += "-" if fault in (1, 2) else letter.upper() if fault == 3 else letter
        self.initials.append(letter)
        if fault:
            self.faults[fault - 1] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.size += len(role) + len(text)

    def counts(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        illegal = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:]))
        return {"blank": self.faults[0], "duplicate": self.faults[1], "truncated": self.faults[2], "illegal": illegal,
                "low": min(turns, default=None), "high": max(turns, default=None), "n_turns": len(set(turns))}


def gaps(low: int | None, high: int | None, n_turns: int) -> int:
    return 0 if low is None else high - low + 1 - n_turns


SEGMENT = ("conv long, whole boolean, part int, seq int, blank long, duplicate long, truncated long, illegal long, low long, high long, "
           "n_turns long, first string, last string, cost long, audit string, repaired_sha256 string, tables binary, roles array<binary>, texts array<binary>")
_SEGMENT_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
                  "array<binary>": pa.list_(pa.binary())}
_SEGMENT_SCHEMA = pa.schema([(c.split()[0], _SEGMENT_TYPES[c.split()[1]]) for c in SEGMENT.split(", ")])


def _write_tables(rows: str) -> bytes:
    cells = [f"{c[0]}:{c[1]}" if c else "" for line in segment_table(rows) for c in line]
    return zlib.compress(",".join(cells).encode())


def _read_tables(data: bytes) -> list[list[tuple[int, str] | None]]:
    cells = zlib.decompress(data).decode().split(",")
    parsed = [(int(c.split(":")[0]), c.split(":")[1]) if c else None for c in cells]
    return [parsed[4 * a : 4 * a + 4] for a in range(4)]


def _segment_batches(rows_limit: int, bytes_limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, []

        def close(segment: Segment, whole: bool) -> dict:
            nonlocal seq
            seq += 1
            row = {"conv": segment.conv, "whole": whole, "part": part, "seq": seq, **segment.counts(),
                   "first": segment.initials[0], "last": segment.initials[-1]}
            if whole:
                row["cost"], row["audit"] = search(segment.rows)
                lines, _ = apply_edits(row["audit"], segment.roles, segment.texts)
                row["repaired_sha256"] = hashlib.sha256(b"\n".join(lines)).hexdigest()
            else:
                row |= {"tables": _write_tables(segment.rows), "roles": segment.roles, "texts": segment.texts}
            return row

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pylist(out, schema=_SEGMENT_SCHEMA)
            out.clear()
            return rows

        now, begun_inside, held = None, False, 0
        for batch in batches:
            for conv, turn, role, text, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        held += now.size
                        out.append(close(now, begun_inside))
                        begun_inside = True
                    now = Segment(conv)
                elif len(now.rows) >= rows_limit or now.size >= bytes_limit:
                    held += now.size
                    out.append(close(now, False))
                    begun_inside, now = False, Segment(conv)
                now.add(turn, role, text, initial, fault)
                if held > 8 * bytes_limit or len(out) >= 2000:
                    held = 0
                    yield flush()
        if now is not None:
            out.append(close(now, False))
        yield flush()

    return work


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Edits of every segment of one conversation, and its counts on its first row."""
    g = group.sort_values(["part", "seq"], kind="stable").reset_index(drop=True)
    cost, edits = join_tables([_read_tables(t) for t in g["tables"]])
    edits[-2:] = [edits[-2] + edits[-1]]
    illegal = int(g["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(g["last"], g["first"][1:]))
    seen = g[g["low"].notna()]
    shared = int((seen["high"].to_numpy()[:-1] == seen["low"].to_numpy()[1:]).sum())
    span = gaps(int(seen["low"].min()), int(seen["high"].max()), int(seen["n_turns"].sum()) - shared) if len(seen) else 0
    return pd.DataFrame({"conv": g["conv"], "part": g["part"], "seq": g["seq"], "edits": edits, "cost": cost, "gaps": span, "illegal": illegal,
                         **{c: int(g[c].sum()) for c in COUNTS[:3]}})


_PLAN = "conv long, part int, seq int, edits string, cost long, gaps long, illegal long, blank long, duplicate long, truncated long"


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, one conversation after the other: joined edits and the digest of the repaired lines."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    now, state, digest, edits, lines = None, START, hashlib.sha256(), [], 0

    def out() -> pa.RecordBatch:
        done = {**now, "audit": "".join(edits), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([{c: done[c] for c in names}], schema=pa.schema(
            [(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names]))

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now["conv"]:
                if now is not None:
                    yield out()
                now, state, digest, edits, lines = row, START, hashlib.sha256(), [], 0
            found, state = apply_edits(row["edits"], row["roles"], row["texts"], state)
            for line in found:
                digest.update(b"\n" + line if lines else line)
                lines += 1
            edits.append(row["edits"])
    if now is not None:
        yield out()


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``initial`` and ``fault``: 1 blank, 2 role and text seen earlier in the conversation, 3 truncated."""
    earlier = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE_CHARS)), F.lit(1))
    fault = F.when(~F.col("text").rlike(SPACE_CLASS), 1).when(F.col("_again"), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    return rows.withColumn("_again", earlier).select("conv", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def repair(rows: DataFrame, rows_limit: int = SEGMENT_ROWS, bytes_limit: int = SEGMENT_BYTES) -> DataFrame:
    """Each conversation of ``rows(conv, turn, role, text)``: gaps, fault counts, cost, edits and digest of the repair.

    ``conv`` and ``turn`` are whole numbers, null ones are values like others (a null turn comes first); ``role``
    and ``text`` must not be null. Rows of the same turn follow role and text, so repeated rows are neighbours. A
    role without a first letter can't be kept. An empty table gives no rows. Texts of a conversation meet in one
    task only as a stream for its digest; the search sees segments of at most ``rows_limit`` rows.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    marked = faults(rows).withColumn("_role", F.left("role", F.lit(16))).withColumn("_text", F.left("text", F.lit(32)))
    dealt = marked.repartitionByRange(order[0], order[1], "_role", "_text").sortWithinPartitions(*order)
    binary = [F.col(c).cast("binary").alias(c) for c in ("role", "text")]
    segments = cut_lineage(dealt.select("conv", "turn", *binary, "initial", "fault").mapInArrow(_segment_batches(rows_limit, bytes_limit), SEGMENT))
    gap = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns"))
    names = [c.split()[0] for c in RESULT.split(", ")]
    whole = segments.where("whole").withColumn("gaps", gap.cast("long")).select(*names)
    cut = segments.where("NOT whole")
    plan = cut.select("conv", "part", "seq", *COUNTS, "low", "high", "n_turns", "first", "last", "tables").groupBy("conv").applyInPandas(_plan, _PLAN)
    texts = cut.select("part", "seq", "roles", "texts")
    met = plan.join(texts, ["part", "seq"]).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return whole.unionByName(met.mapInArrow(_write_batches, RESULT))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows that a checksum of ``conv_id:turn`` leaves, damaged by rule: one in twenty each is dropped, emptied,
    robbed of its full stops, repeated, or given to the user. Null fields read as one space."""
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    rule = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    ruled = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                 text.alias("text"), rule.alias("_rule")).where("_rule <> 0")
    copies = F.explode(F.when(F.col("_rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("_rule") == 1, "").when(F.col("_rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return ruled.select("conv", "turn", F.when(F.col("_rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every ``conv_id`` of the table with the repair of its damaged rows; one without rows has zeros and no edits."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = repair(damage(conversations))
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}

    def value(name: str) -> Column:
        return F.coalesce(F.col(name), empty.get(name, F.lit(0).cast("long"))).alias(name)

    names = [c.split()[0] for c in RESULT.split(", ")][1:]
    return ids.join(done, ids["conv_id"].eqNullSafe(done["conv"]), "left").select("conv_id", *[value(c) for c in names])
