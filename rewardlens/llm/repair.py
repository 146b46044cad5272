"""Conversation structure repair as a shortest path, found by an auction.

The rows of a conversation in order of turn are columns of a lattice; a node is
(rows consumed, state), the states being nothing said, ``s`` said, ``u`` said and
``a`` said, so that the role initials kept so far read ``s?(ua)*u?``. Arcs are
the edits: Keep 0, Rerole 2, Delete 3, Insert 2, one more for a truncated row
that stays. Every edit has one target, so an audit names one repair.

Node prices are bounds from below of the cost still to come. A path is extended
along the arc of least cost plus price (edits in ASCII order among equals); where
even that exceeds the price of its end, the price rises to it and the path is
contracted by one node. Origins are taken from the last column backwards and
prices stay, so a path stops at a node whose price has converged. Converged
prices make the arcs of all shortest paths tight, and the least tight edit from
each node on traces the least audit.

Rows are range-partitioned by conversation and turn, and each partition is read
as a stream in that order. A conversation that lies in one partition and has at
most ``CHUNK`` rows is repaired there. Longer or divided ones become segments of
at most ``CHUNK`` rows: each gives the least cost between any two states as
a 4 x 4 table, these are combined backwards to the cost after every segment, and
segments are traced from every state, of which one chain holds. So the rows of
one conversation are worked on by many tasks, and only a few numbers for each
segment come together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize
from rewardlens.session import ship_package

CHUNK = 4096
#: A segment also ends at this many bytes of text (or holds one row).
CHUNK_BYTES = 4 << 20

DELETE, INSERT, KEEP, REROLE = "DIKR"
STATES = range(4)
UNREACHED = 1 << 60
#: Cost from each state to a well-formed end, and the edits that lead there.
END_COST = [0, 4, 2, 0]
END_EDITS = ["", INSERT * 2, INSERT, ""]
#: The state after a user or assistant turn, from each state: what Insert and Rerole add.
NEXT = [2, 2, 3, 2]
ADDED = ["user", "user", "assistant", "user"]
#: Where Keep leads from each state, by role initial.
KEPT = {"s": [1, None, None, None], "u": [2, 2, None, 2], "a": [None, None, 3, None]}
FAULTS = ("blank", "duplicate", "truncated")

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_TRAILING = " \t\n\x0b\x0c\r"

#: One row as the lattice sees it: where Keep leads, the extra cost of staying, whether it must go.
Step = tuple[list, int, bool]


def steps_of(initials: list[str], faults: list[str | None]) -> list[Step]:
    none = [None] * 4
    return [(KEPT.get(r, none), int(f == "truncated"), f in ("blank", "duplicate")) for r, f in zip(initials, faults)]


def _arcs(step: Step, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, column, state) of every arc out of a node before the last column, in ASCII order."""
    keep, extra, must_go = step
    out = [(DELETE, 3, i + 1, q), (INSERT, 2, i, NEXT[q])]
    if not must_go:
        if keep[q] is not None:
            out.append((KEEP, extra, i + 1, keep[q]))
        out.append((REROLE, 2 + extra, i + 1, NEXT[q]))
    return out


def auction(steps: list[Step], end: list[int]) -> list[list[int]]:
    """Converged prices of all nodes: the least cost to the last column plus its state's ``end`` cost."""
    n = len(steps)
    price = [[0] * 4 for _ in range(n)] + [list(end)]
    settled = [[False] * 4 for _ in range(n)] + [[True] * 4]
    for i in range(n - 1, -1, -1):
        after, step = price[i + 1], steps[i]
        arcs = [_arcs(step, i, q) for q in STATES]
        # a node whose arcs all lead to unreachable ones has no path; Delete and Insert always exist, so columns tell
        open_ = [any(c == i + 1 and after[r] < UNREACHED for _, _, c, r in arcs[q]) for q in STATES]
        open_[2] = open_[3] = open_[2] or open_[3]
        base = min(after) + (3 if step[2] else step[1])  # no path costs less
        for q in STATES:
            if open_[q] or open_[NEXT[q]]:
                price[i][q] = base
            else:
                price[i][q], settled[i][q] = UNREACHED, True
        for q in STATES:
            path = [q]  # states of this column; a path that leaves it has arrived
            while path:
                at = path[-1]
                if settled[i][at]:
                    for x in path:
                        settled[i][x] = True
                    break
                best, to = UNREACHED, None
                for _, cost, c, r in arcs[at]:
                    total = cost + price[c][r]
                    if total < best:
                        best, to = total, (c, r)
                if price[i][at] < best:
                    price[i][at] = best
                    if len(path) > 1:
                        path.pop()
                elif to[0] > i:
                    for x in path:
                        settled[i][x] = True
                    break
                else:
                    path.append(to[1])
    return price


def trace(steps: list[Step], price: list[list[int]], state: int) -> tuple[str, int]:
    """The least edits along tight arcs from ``state`` at the first column, and the state at the last."""
    out, i = [], 0
    while i < len(steps):
        for edit, cost, c, r in _arcs(steps[i], i, state):
            if price[i][state] == cost + price[c][r]:
                out.append(edit)
                i, state = c, r
                break
    return "".join(out), state


def apply_edits(edits: str, roles: list[str], texts: list[str], state: int) -> list[dict]:
    """The turns that ``edits`` leave, from ``state`` on."""
    out, i = [], 0
    for e in edits:
        if e == DELETE:
            i += 1
            continue
        if e == KEEP:
            role, text = roles[i], texts[i]
            state = KEPT[role[:1]][state]
        else:
            role, text = ADDED[state], "" if e == INSERT else texts[i]
            state = NEXT[state]
        i += e != INSERT
        out.append({"edit": e, "role": role, "text": text})
    return out


def _key(role: str, text: str) -> bytes:
    h = hashlib.blake2b(role.encode("utf-8", "surrogatepass"), digest_size=16, person=b"role+text")
    h.update(b"\0" + text.encode("utf-8", "surrogatepass"))
    return h.digest()


def faults_of(roles: list[str], texts: list[str], seen: set | None = None) -> list[str | None]:
    """Each row's first fault: blank, duplicate (role and text seen before), truncated."""
    seen = set() if seen is None else seen
    out: list[str | None] = []
    for role, text in zip(roles, texts):
        if not _VISIBLE.search(text):
            out.append("blank")
        elif (key := _key(role, text)) in seen:
            out.append("duplicate")
        else:
            seen.add(key)
            out.append(None if text.rstrip(_TRAILING)[-1] in ".!?" else "truncated")
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


class Repaired(NamedTuple):
    """``report``: one row for each conversation. ``turns``: its repaired turns, in pieces of at most ``CHUNK`` rows."""

    report: DataFrame
    turns: DataFrame


_LINES = "array<struct<edit: string, role: string, text: string>>"
_COUNTS = "n_rows long, distinct_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long"


def _counts(turns: list, roles: list[str], faults: list[str | None]) -> list[int | None]:
    own = [t for t in turns if t is not None]
    return [len(roles), len(set(own)), min(own, default=None), max(own, default=None), *[sum(f == x for f in faults) for x in FAULTS],
            _illegal([r[:1] for r in roles])]


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk: int = CHUNK) -> Repaired:
    """The cheapest edits that give every conversation the role initials ``(s?(ua)+)?``.

    ``report`` has ``(id_col, n_rows, gaps, blank, duplicate, truncated, illegal,
    cost, audit)``; ``turns`` has ``(id_col, part, seq, whole, lines)`` with ``lines`` an
    array of ``(edit, role, text)``, (part, seq) the order of the pieces, and ``whole``
    true where a piece is surely all of its conversation.

    Rows are taken by turn, null turns first, equal turns by role and text. Null
    roles and texts count as one space. A null conversation id is a conversation
    of its own; repeated rows are duplicates; a text of any length is one row; an
    empty table gives no rows. Other columns are not read.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))
    # the beginning of a text and its digest order equal turns; equal rows are dealt out by a number of their own
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.md5("text"), "n": F.monotonically_increasing_id()})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "digest", "n"]
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    schema = (f"conv {kind}, part int, seq long, whole boolean, {_COUNTS}, cost long, audit string, lines {_LINES}, "
              "turns array<long>, roles array<string>, texts array<string>")

    segments = materialize(ordered.mapInArrow(_segments(chunk), schema), "repair-segments")
    whole = segments.filter("whole").select("conv", "part", "seq", *[c.split()[0] for c in _COUNTS.split(", ")], "cost", "audit", "lines")
    divided = segments.filter("not whole").select("conv", "part", "seq", "turns", "roles", "texts")
    report = whole.withColumn("shared_turns", F.lit(0).cast("long")).drop("part", "seq", "lines")
    pieces = whole.select("conv", "part", "seq", F.lit(True).alias("whole"), "lines")
    if not divided.isEmpty():
        more_report, more_pieces = _repair_divided(divided, kind)
        report, pieces = report.unionByName(more_report), pieces.unionByName(more_pieces.withColumn("whole", F.lit(False)))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns") + F.col("shared_turns"), F.lit(0))
    return Repaired(
        report.select(F.col("conv").alias(id_col), "n_rows", gaps.alias("gaps"), *FAULTS, "illegal", "cost", "audit"),
        pieces.withColumnRenamed("conv", id_col))


def _segments(chunk: int):
    """A task's rows, in order, as one output row for each conversation or segment."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, True
        held: list[tuple] = []  # rows of one conversation
        size, cut, conv = 0, False, None
        out: list[dict] = []
        out_size = 0
        schema: pa.Schema | None = None

        def emit(last: bool, ends: bool) -> None:
            """What is held; ``ends``: the conversation ends here, ``last``: the partition does."""
            nonlocal seq, first, held, size, cut, out_size
            turns, roles, texts = map(list, zip(*held))
            row = {"conv": conv, "part": part, "seq": seq, "whole": ends and not (first or last or cut)}
            if row["whole"]:
                faults = faults_of(roles, texts)
                steps = steps_of([r[:1] for r in roles], faults)
                price = auction(steps, END_COST)
                audit, state = trace(steps, price, 0)
                audit += END_EDITS[state]
                row |= dict(zip(names, _counts(turns, roles, faults))) | {"cost": price[0][0], "audit": audit, "lines": apply_edits(audit, roles, texts, 0)}
            else:
                row |= {"turns": turns, "roles": roles, "texts": texts}
            out.append(row)
            seq += 1
            out_size += size + len(held)
            held, size = [], 0
            cut = not ends
            first = first and not ends

        names = [c.split()[0] for c in _COUNTS.split(", ")]
        for batch in batches:
            if schema is None:
                line = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
                schema = pa.schema([
                    ("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in names],
                    ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.list_(line)),
                    ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
            ids, turns, roles, texts = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))
            for own, turn, role, text in zip(ids, turns, roles, texts):
                if held and own != conv:
                    emit(False, True)
                elif held and (len(held) >= chunk or size >= CHUNK_BYTES):
                    emit(False, False)
                conv = own
                held.append((turn, role, text))
                size += len(text)
                if out_size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, out_size = [], 0
        if held:
            emit(True, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return task


def _repair_divided(divided: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Report and pieces of conversations that lie in several segments (or at the edge of a partition)."""
    place = ["part", "seq"]

    def each(fn, fields: list[tuple[str, pa.DataType]]):
        """A task that turns one segment at a time into columns."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types = [batch.schema.field("conv").type, pa.int32(), pa.int64(), *[t for _, t in fields]]
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    found = fn(row)
                    head = [[row[c]] * len(found) for c in ("conv", *place)]
                    columns = [*head, *([list(c) for c in zip(*found)] or [[] for _ in fields])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", *place, *[n for n, _ in fields]])

        return task

    def keys(row: dict) -> list[tuple]:
        own: dict[bytes, int] = {}
        for i, (role, text) in enumerate(zip(row["roles"], row["texts"])):
            if _VISIBLE.search(text):
                own.setdefault(_key(role, text), i)
        return [(i, key) for key, i in own.items()]

    # rows that are the first of their kind in a segment but not in the conversation
    seen = materialize(divided.select("conv", *place, "roles", "texts").mapInArrow(each(keys, [("i", pa.int32()), ("key", pa.binary())]), f"conv {kind}, part int, seq long, i int, key binary"), "repair-keys")
    firsts = seen.groupBy("conv", "key").agg(F.min(F.struct(*place)).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = (seen.join(firsts.select(F.col("conv").alias("c"), F.col("key").alias("k"), "f"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
             .filter(F.struct(*place) != F.col("f")).groupBy(*place).agg(F.collect_list("i").alias("seen_before")))
    marked = materialize(divided.join(later, place, "left").withColumn("seen_before", F.coalesce("seen_before", F.array().cast("array<int>"))), "repair-marked")

    def step_rows(row: dict) -> tuple[list[str | None], list[Step]]:
        faults = faults_of(row["roles"], row["texts"])
        for i in row["seen_before"]:
            faults[i] = "duplicate"
        return faults, steps_of([r[:1] for r in row["roles"]], faults)

    names = [c.split()[0] for c in _COUNTS.split(", ")]

    def summaries(row: dict) -> list[tuple]:
        faults, steps = step_rows(row)
        to = [auction(steps, [0 if q == e else UNREACHED for q in STATES])[0] for e in STATES]
        roles = row["roles"]
        return [(*_counts(row["turns"], roles, faults), roles[0][:1], roles[-1][:1], [to[e][q] for q in STATES for e in STATES])]

    fields = [*[(c, pa.int64()) for c in names], ("first_role", pa.string()), ("last_role", pa.string()), ("cost", pa.list_(pa.int64()))]
    summary = materialize(marked.mapInArrow(each(summaries, fields), f"conv {kind}, part int, seq long, {_COUNTS}, first_role string, last_role string, cost array<long>"), "repair-summaries")

    def backwards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place)
        after, ends = END_COST, []
        for table in rows["cost"].to_list()[::-1]:
            ends.append(after)
            after = [min(min(int(table[4 * q + e]) + after[e] for e in STATES), UNREACHED) for q in STATES]
        return pd.DataFrame({"part": rows["part"], "seq": rows["seq"], "after": ends[::-1], "total": after[0]})

    # a few numbers for each segment of CHUNK rows
    ends = materialize(summary.groupBy("conv").applyInPandas(backwards, "part int, seq long, after array<long>, total long"), "repair-ends")

    def traces(row: dict) -> list[tuple]:
        _, steps = step_rows(row)
        price = auction(steps, row["after"])
        ways = [trace(steps, price, q) if price[0][q] < UNREACHED else ("", q) for q in STATES]
        return [tuple(map(list, zip(*ways)))]

    fields = [("edits", pa.list_(pa.string())), ("to", pa.list_(pa.int32()))]
    traced = materialize(marked.join(ends.select(*place, "after"), place).mapInArrow(each(traces, fields), f"conv {kind}, part int, seq long, edits array<string>, to array<int>"), "repair-traces")

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place)
        state, states = 0, []
        for to in rows["to"]:
            states.append(state)
            state = int(to[state])
        return pd.DataFrame({"part": rows["part"], "seq": rows["seq"], "state": states, "closing": [""] * (len(rows) - 1) + [END_EDITS[state]]})

    entered = traced.select("conv", *place, "to").groupBy("conv").applyInPandas(chain, "part int, seq long, state int, closing string")
    chosen = materialize(
        traced.join(entered, place).select("conv", *place, "state", F.concat(F.element_at("edits", F.col("state") + 1), "closing").alias("edits")), "repair-edits")

    def applied(row: dict) -> list[tuple]:
        return [(apply_edits(row["edits"], row["roles"], row["texts"], row["state"]),)]

    line = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    pieces = (divided.select(*place, "roles", "texts").join(chosen, place).select("conv", *place, "roles", "texts", "state", "edits")
              .mapInArrow(each(applied, [("lines", line)]), f"conv {kind}, part int, seq long, lines {_LINES}"))
    neighbour = Window.partitionBy("conv").orderBy(*place)  # one row a segment
    joint = summary.withColumns({"before_role": F.lag("last_role").over(neighbour), "before_turn": F.lag("last_turn").over(neighbour)})
    pair = F.concat("before_role", "first_role")
    sums = joint.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "distinct_turns", *FAULTS)], F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"),
        (F.sum("illegal") + F.sum(F.when(pair.isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0))).alias("illegal"),
        F.sum(F.when(F.col("before_turn") == F.col("first_turn"), 1).otherwise(0)).alias("shared_turns"))
    start = F.row_number().over(neighbour) == 1
    cost = summary.select("conv", *place).withColumn("start", start).filter("start").join(ends.select(*place, "total"), place).select(F.col("conv").alias("c"), F.col("total").alias("cost"))
    audits = chosen.groupBy(F.col("conv").alias("d")).agg(F.array_sort(F.collect_list(F.struct(*place, "edits"))).alias("e"))
    report = (sums.join(cost, F.col("conv").eqNullSafe(F.col("c"))).join(audits, F.col("conv").eqNullSafe(F.col("d")))
              .withColumn("audit", F.array_join(F.transform("e", lambda e: e["edits"]), "")).drop("c", "d", "e"))
    return report, pieces


def digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(id_col, sha256)`` of each conversation's ``role:text`` lines joined by newlines.

    A conversation known to be in one piece is hashed where it is. The others are hashed
    as streams, piece after piece, by the task that owns the conversation: a
    SHA-256 has one order of reading, but no more than a piece is held.
    """
    spark = turns.sparkSession
    ship_package(spark)
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    text = turns.select(F.col(id_col).alias("conv"), "part", "seq", "whole", lines.alias("text"), (F.size("lines") > 0).alias("some"))
    kind = text.schema["conv"].dataType.simpleString()
    one = text.filter("whole").select("conv", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, some, type_ = None, None, False, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([digest.hexdigest()])], ["conv", "sha256"])

        for batch in batches:
            type_ = batch.schema.field("conv").type
            for own, piece, has in zip(batch.column("conv").to_pylist(), batch.column("text").to_pylist(), batch.column("some").to_pylist()):
                if digest is None or own != conv:
                    if digest is not None:
                        yield done()
                    conv, digest, some = own, hashlib.sha256(), False
                if has:
                    digest.update((b"\n" if some else b"") + piece.encode("utf-8"))
                    some = True
        if digest is not None:
            yield done()

    split = text.filter("not whole").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")
    many = split.select("conv", "text", "some").mapInArrow(task, f"conv {kind}, sha256 string")
    return one.unionByName(many).withColumnRenamed("conv", id_col)


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by ``crc32(conv_id:turn) % 20``.

    0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes
    its role user. A null id, turn, role or text counts as one space in the key and
    in role and text; a null id or turn itself stays null.
    """
    blank = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = part("role"), part("text")
    rows = conversations.select(
        "conv_id", "turn", h.alias("h"), F.when(h == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text")).filter("h != 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "copy")
