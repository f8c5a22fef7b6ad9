"""Conversation repair: the cheapest edits that make the roles alternate, by Knuth's lightest-derivation agenda.

Repair items are (rows taken, state of the roles).  A deduction takes an item and the next row and derives an item one row on: the
row is kept, its role is set, it is deleted, or a turn is inserted before it.  The weight of a derivation is (cost, audit), the audit
being the initials of its edits.  Both only grow along a deduction, and items of equal cost are popped by rows taken, so the item popped from the
agenda first has its least weight and is final; the agenda stops when the goal is.  An insertion belongs to the edit after it, so audits
of items at one row have equally many rows and none begins another; which of two comes first is decided where their derivations
part, and kept.  Time and memory are linear in the conversation.

Spark gathers a few bytes a row for the agenda.  Texts stay out of it: they are sorted by conversation with the audit ahead of them and hashed in one
pass, so no task holds a conversation's texts.  Both passes take a conversation in one task, as its hash demands.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs and legal order (fixed values): roles begin with s?(ua)+ or there are none.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
TURN = {"": "u", "s": "u", "u": "a", "a": "u"}  # the user or assistant turn that may follow
AT_END = {"": "", "a": "", "u": "I", "s": "II"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")


def lightest_repair(initials: str, gone: Sequence[bool], truncated: Sequence[bool]) -> tuple[int, str]:
    """Least cost and, of its audits, the least in ASCII order.

    ``initials`` are those of the rows' roles, ``gone`` marks rows that must go, ``truncated`` rows that cost more unless deleted.
    """
    n = len(initials)
    back: dict[tuple[int, str], tuple[str, str]] = {}  # how an item was derived: from which state, by which edits
    weight = {(0, ""): 0}
    done: set[tuple[int, str]] = set()
    parted: dict[tuple[int, str, str], bool] = {}
    agenda = [(0, 0, "")]

    def ahead(row: int, one: str, other: str) -> bool:
        """Whether the audit of one final item of a row comes before the other's."""
        asked = []
        while (known := parted.get((row, one, other))) is None:
            asked.append((row, one, other))
            (one_from, one_by), (other_from, other_by) = back[row, one], back[row, other]
            if one_from == other_from:
                known = one_by < other_by
                break
            row, one, other = row - 1, one_from, other_from
        for row, one, other in asked:
            parted[row, one, other], parted[row, other, one] = known, not known
        return known

    def derive(row: int, state: str, new: str, edits: str, cost: int) -> None:
        item = (row + 1, new)
        best = weight.get(item)
        if best is not None and cost >= best:
            if cost > best:
                return
            before, by = back[item]
            if (edits >= by) if before == state else not ahead(row, state, before):
                return
        back[item] = (state, edits)
        if best != cost:
            weight[item] = cost
            heapq.heappush(agenda, (cost, row + 1, new))

    while True:
        cost, row, state = heapq.heappop(agenda)
        if row > n:
            break
        if (row, state) in done:
            continue
        done.add((row, state))
        if row == n:
            derive(n, state, "goal", AT_END[state], cost + INSERT * len(AT_END[state]))
            continue
        derive(row, state, state, "D", cost + DELETE)
        if gone[row]:
            continue
        extra = TRUNCATED * truncated[row]
        for inserted, at in ("", state), ("I", TURN[state]):
            spent = cost + extra + INSERT * len(inserted)
            derive(row, state, TURN[at], inserted + "R", spent + REROLE)
            kept = NEXT.get((at, initials[row]))
            if kept:
                derive(row, state, kept, inserted + "K", spent + KEEP)
    edits = []
    while row:
        state, by = back[row, state]
        edits.append(by)
        row -= 1
    return cost, "".join(reversed(edits))


def damaged(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` after the damage that the CRC-32 of conversation and turn chooses; null roles and texts are one space."""

    def said(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    chosen = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), chosen.alias("how"))
    rows = rows.where("how <> 0").select(
        "conv", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of each conversation come to."""
    for batch in batches:
        rows, found = batch.column("rows"), []
        offsets = rows.offsets.to_pylist()
        for start, end in zip(offsets, offsets[1:], strict=False):
            turns, a, b, initials, blank, cut = (rows.values.field(k).slice(start, end - start).to_pylist() for k in range(6))
            seen, gone, truncated, counts = set(), [], [], [0, 0, 0]
            for key, is_blank, is_cut in zip(zip(a, b, strict=True), blank, cut, strict=True):
                fault = 0 if is_blank else 1 if key in seen else 2 if is_cut else None
                seen.add(key)
                if fault is not None:
                    counts[fault] += 1
                gone.append(fault in (0, 1))
                truncated.append(fault == 2)
            illegal = sum(x + y not in LEGAL_PAIRS for x, y in zip(initials, initials[1:], strict=False))
            numbers = set(turns) - {None}
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            found.append((gaps, *counts, illegal, *lightest_repair([x or " " for x in initials], gone, truncated)))
        columns = list(zip(*found, strict=True)) or [()] * (len(COUNTS) + 1)
        kinds = [pa.int64()] * len(COUNTS) + [pa.string()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), *arrays], ["conv", *COUNTS, "audit"])


class Rewriter:
    """Hashes the lines of one repaired conversation as its rows come by."""

    def __init__(self, audit: str) -> None:
        self.digest, self.edits, self.state, self.first = hashlib.sha256(), iter(audit), "", True

    def line(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.state, self.first = role[:1], False

    def next_edit(self) -> str:
        """The next edit of a row; insertions before it are carried out."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.line(ROLES[TURN[self.state]], "")
        return ""

    def row(self, role: str, text: str) -> None:
        edit = self.next_edit()
        if edit == "K":
            self.line(role, text)
        elif edit == "R":
            self.line(ROLES[TURN[self.state]], text)

    def finish(self) -> str:
        self.next_edit()
        return self.digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's counts and audit, which come ahead of its rows, with the digest of what it becomes."""
    names, head, work = ["conv", *COUNTS, "audit"], None, None

    def row() -> pa.RecordBatch:
        arrays = [head.column(k) for k in names]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([work.finish()], pa.string())], [*names, "repaired_sha256"])

    for batch in batches:
        for k, (audit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("audit", "role", "text")), strict=True)):
            if audit is None:
                work.row(role, text)
                continue
            if work is not None:
                yield row()
            head, work = batch.slice(k, 1), Rewriter(audit)
    if work is not None:
        yield row()


def repaired(turns: DataFrame) -> DataFrame:
    """A row per conversation of ``conv``, ``turn``, ``role``, ``text``: its faults, least cost, audit and the digest of what it becomes.

    Null turns come first, rows of one turn in the order of hashes of role and text (equal rows are interchangeable).  Null roles and texts are
    one space, so such a text is blank.  A role that is empty or begins with anything but s, u, a is never kept.  Null
    conversation ids are one conversation.  A row that repeats an earlier role and text is a duplicate; an empty table gives no
    rows.  Other columns are ignored.
    """
    spaced = [F.coalesce(F.col(k).cast("string"), F.lit(" ")).alias(k) for k in ("role", "text")]
    hashes = [F.xxhash64(F.lit(lane), "role", "text").alias(name) for lane, name in ((1, "a"), (2, "b"))]
    rows = turns.select("conv", F.col("turn").cast("long").alias("turn"), *spaced).select("*", *hashes)
    solid = F.rtrim("text", F.lit(WHITE))
    one = F.struct(
        "turn", "a", "b", F.substring("role", 1, 1).alias("initial"), (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(*ENDS)).alias("cut"),
    )
    gathered = rows.select("conv", one.alias("one")).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("rows"))
    counts = ", ".join(f"{name} long" for name in COUNTS)
    kind = turns.schema["conv"].dataType.simpleString()
    audits = gathered.mapInArrow(_audits, f"conv {kind}, {counts}, audit string")
    both = audits.unionByName(rows, allowMissingColumns=True).repartition("conv")
    ordered = both.sortWithinPartitions("conv", F.col("audit").isNull(), "turn", "a", "b")
    return ordered.mapInArrow(_hashed, f"conv {kind}, {counts}, audit string, repaired_sha256 string")
