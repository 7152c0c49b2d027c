"""Repair of the structure of conversations, by cheapest edits.

A conversation is well formed if the initials of its roles read (s?(ua)+)?: perhaps a system row, then user and
assistant in turn. Its rows are read by turn (null first; rows of one turn by role, then text). Each row has one fault
at most: blank (no sign but x20 and x09-x0D), duplicate (an earlier row of the conversation has its role and text) or
truncated (its last sign is none of . ! ?). A row is kept (0), given the role that its place needs (2) or deleted (3,
a must for blank and duplicate ones); an empty row is inserted anywhere for 2; a truncated row that stays costs 1.
The cheapest edits are taken, of several the ASCII-least string of initials (D, I, K, R).

Rows are dealt by conversation, sorted by turn, and streamed: between rows only the cheapest way to each of four states
is held (nothing said, system spoke, user spoke, assistant spoke), with the running hash of what it says. Ways end with
a row's own edit, insertions lead the next one, so no way is the beginning of another and their order never changes by
what follows. One byte a row and state says where each way came from; they go to an unnamed scratch file of the task
once a conversation has many rows. The hash of a conversation's text can only be taken in one place, so one task
streams each conversation, at bounded memory: text is held a batch at a time, and repeats are found by hash beforehand
rather than remembered. What grows with a conversation is the audit string of the result alone.

Null role or text: one space (so blank). Null turns come first and count for no gap; null conv_id is a conversation of
its own. Rows repeated whole are duplicates of their first. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPILL_BYTES = 4 << 20  # of backpointers that a conversation holds in memory
OUT_ROWS = 1000
_FAR = 1 << 60
_EDITS = b"KRD"
_COSTS = {"I": 2, "R": 2, "D": 3, "K": 0}
#: States: 0 nothing said, 1 system spoke, 2 user spoke, 3 assistant spoke.
_NEXT = (2, 2, 3, 2)
_SAYS = {2: b"user", 3: b"assistant"}


def _ways(initial: str) -> list[list[tuple[int, int, str, list[bytes], int, bool]]]:
    """For each state after a row of this initial: (state before, cost, edits, roles inserted, edit, keeps its role)."""
    out: list[list] = [[] for _ in range(4)]
    for q in range(4):
        out[q].append((q, _COSTS["D"], "D", [], 2, False))  # an insertion before it is no cheaper than one after it, and later by name
        at, roles = q, []
        for k in range(3):
            if k:
                at = _NEXT[at]
                roles = [*roles, _SAYS[at]]
            to = _NEXT[at]
            keeps = 1 if initial == "s" and at == 0 else to if initial and _SAYS[to].startswith(initial.encode()) else None
            if keeps is not None:
                out[keeps].append((q, 2 * k, "I" * k + "K", roles, 0, True))
            out[to].append((q, 2 * k + _COSTS["R"], "I" * k + "R", roles, 1, False))
    return out


WAYS = {c: _ways(c) for c in ("s", "u", "a", "")}


class _Trail:
    """Bytes appended in order and read from the end; all but the newest in a scratch file once they are many."""

    def __init__(self, limit: int):
        self.limit, self.tail, self.file, self.spilled = limit, bytearray(), None, []

    def add(self, four: bytes) -> None:
        self.tail += four
        if len(self.tail) >= self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.spilled.append(len(self.tail))
            self.file.write(self.tail)
            self.tail = bytearray()

    def blocks(self) -> Iterator[bytes]:
        """The last block first."""
        yield bytes(self.tail)
        end = sum(self.spilled)
        for n in reversed(self.spilled):
            end -= n
            self.file.seek(end)
            yield self.file.read(n)
        if self.file:
            self.file.close()


class Repair:
    """The cheapest edits of one conversation whose rows come one by one."""

    def __init__(self, spill: int = SPILL_BYTES):
        self.cost, self.rank, self.hash = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3], [hashlib.sha256() for _ in range(4)]
        self.trail = _Trail(spill)

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        if must_go:  # every way has one more deletion
            self.cost = [c + _COSTS["D"] if c < _FAR else c for c in self.cost]
            self.trail.add(bytes(q << 4 | 2 for q in range(4)))
            return
        said: bytes | None = None
        best, names = [], bytearray()
        for to, ways in enumerate(WAYS[role[:1] if role[:1] in ("s", "u", "a") else ""]):
            found = min(((self.cost[w[0]] + w[1] + (truncated and w[4] != 2), self.rank[w[0]], w[2], n) for n, w in enumerate(ways) if self.cost[w[0]] < _FAR), default=None)
            if found is None:
                best.append((_FAR, 9, str(to), None))
                names.append(0xFF)
                continue
            source, _, edits, roles, edit, keeps = ways[found[3]]
            digest = self.hash[source]
            if edit != 2:
                said = text.encode("utf-8", "surrogatepass") if said is None else said
                digest = digest.copy()
                head = b"" if source == 0 else b"\n"
                for r in roles:
                    digest.update(head + r + b":")
                    head = b"\n"
                digest.update(head + (role.encode("utf-8", "surrogatepass") if keeps else _SAYS[to]) + b":")
                digest.update(said)
            best.append((*found[:3], digest))
            names.append(source << 4 | len(roles) << 2 | edit)
        order = sorted(range(4), key=lambda q: best[q][1:3])
        self.rank = [order.index(q) for q in range(4)]
        self.cost = [b[0] for b in best]
        self.hash = [b[3] for b in best]
        self.trail.add(bytes(names))

    def done(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the repaired conversation."""
        more = (0, 4, 2, 0)  # what is inserted at the end: user and assistant, assistant
        q = min((x for x in range(4) if self.cost[x] < _FAR), key=lambda x: (self.cost[x] + more[x], self.rank[x]))
        cost, digest, audit = self.cost[q] + more[q], self.hash[q].copy(), bytearray(b"I" * (more[q] // 2))
        if q == 1:
            digest.update(b"\nuser:")
        if more[q]:
            digest.update(b"\nassistant:")
        for block in self.trail.blocks():
            for at in range(len(block) - 4, -1, -4):
                b = block[at + q]
                audit.append(_EDITS[b & 3])
                audit += b"I" * (b >> 2 & 3)
                q = b >> 4
        audit.reverse()
        return cost, audit.decode(), digest.hexdigest()


def _rows(conversations: DataFrame) -> DataFrame:
    """The read columns with a key for any type of id, and each row's digest and faults that it has alone."""
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    bare = F.rtrim("text", F.lit(SPACE))
    same = F.concat_ws(":", F.coalesce(F.length("key"), F.lit(-1)).cast("string"), "key", F.length("role").cast("string"), "role", "text")
    return rows.withColumns({"digest": F.unhex(F.sha2(same, 256)), "blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?")})


def _place(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def _repeats(rows: DataFrame) -> DataFrame:
    """(key, turn, digest) of turns that repeat a role and text of an earlier one; no text is dealt out for it."""
    narrow = rows.select("key", "turn", "digest")
    first = narrow.groupBy("digest").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("last > first").select("digest", "first")
    return narrow.join(first, "digest").where(_place() > F.col("first")).select("key", "turn", "digest").distinct()


def _streamed(parts: list[DataFrame]) -> DataFrame:
    """Rows with their kind, dealt by conversation and sorted by turn; what marks a turn comes before its rows."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "kind", "role", "text")
    # an integer with nulls would come as a float
    return rows.withColumns({"known": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0)), "blank": F.coalesce("blank", F.lit(False)), "truncated": F.coalesce("truncated", F.lit(False))})


REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in REPORT.split(", ")]
_LEGAL = {"su", "ua", "au"}


def audits(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    every: (conv_id) of conversations that get a row even without rows of their own: zeros, no audit, the hash of nothing.
    """
    rows = _rows(conversations)
    parts = [rows.withColumn("kind", F.lit(2)), _repeats(rows).withColumn("kind", F.lit(1))]
    if every is not None:
        parts.append(every.select(F.col("conv_id").cast("string").alias("key"), F.lit(0).alias("kind")))
    spill = SPILL_BYTES

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, repair, counts, turns, before, marks = None, None, [], [], None, set()

        def finished() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            out.append((key, gaps, *counts, *repair.done()))

        for batch in batches:
            for k, turn, known, kind, role, text, digest, blank, truncated in zip(*(batch[c].array for c in ("key", "turn", "known", "kind", "role", "text", "digest", "blank", "truncated")), strict=True):
                k = None if pd.isna(k) else k
                if repair is None or k != key:
                    if repair is not None:
                        finished()
                        if len(out) >= OUT_ROWS:
                            yield pd.DataFrame(out, columns=_NAMES)
                            out.clear()
                    key, repair, counts, turns, before, marks = k, Repair(spill), [0, 0, 0, 0], [], None, set()
                    here = None
                if kind == 0:
                    continue
                if here != (known, turn):
                    here, marks, last = (known, turn), set(), None
                    if known and kind:
                        turn = int(turn)
                        turns = [turns[0], turn, turns[2] + 1] if turns else [turn, turn, 1]
                if kind == 1:
                    marks.add(digest)
                    continue
                duplicate = not blank and (digest in marks or digest == last)
                last = digest
                truncated = truncated and not blank and not duplicate
                initial = role[:1]
                if before is not None and before + initial not in _LEGAL:
                    counts[3] += 1
                before = initial
                counts[0] += blank
                counts[1] += duplicate
                counts[2] += truncated
                repair.add(role, text, blank or duplicate, truncated)
        if repair is not None:
            finished()
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    found = _streamed(parts).select("key", "turn", "known", "kind", "role", "text", "digest", "blank", "truncated").mapInPandas(stream, REPORT)
    return found.select(F.col("key").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *_NAMES[1:])


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text, edit (K, R or I). Conversations of which nothing stays have no row."""
    plans = audits(conversations).select(F.col("conv_id").cast("string").alias("key"), F.lit(0).alias("kind"), F.col("audit").alias("text"))
    rows = _rows(conversations).select("key", "turn", "role", "text", F.lit(2).alias("kind"), "blank", "truncated")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, audit, at, state, place = None, "", 0, 0, 0

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                out.append((key, place, _SAYS[state].decode(), "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            for k, kind, role, text in zip(*(batch[c].array for c in ("key", "kind", "role", "text")), strict=True):
                if kind == 0:  # comes before the rows of its conversation
                    insert()
                    key, audit, at, state, place = None if pd.isna(k) else k, text, 0, 0, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = 1 if edit == "K" and state == 0 and role[:1] == "s" else _NEXT[state]
                    out.append((key, place, role if edit == "K" else _SAYS[state].decode(), text, edit))
                    place += 1
            yield pd.DataFrame(out, columns=["key", "place", "role", "text", "edit"])
            out.clear()
        insert()
        yield pd.DataFrame(out, columns=["key", "place", "role", "text", "edit"])

    streamed = _streamed([rows, plans.withColumn("turn", F.lit(None).cast("bigint"))]).select("key", "kind", "role", "text")
    found = streamed.mapInPandas(stream, "key string, place long, role string, text string, edit string")
    return found.select(F.col("key").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), "place", "role", "text", "edit")


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with faults put in by the CRC-32 of `conv_id:turn` modulo 20, and the (conv_id) of rows that were dropped.

    0 drops the row, 1 empties its text, 2 takes out its . ! ?, 3 repeats it, 4 makes its role user. Nulls read as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("_code"))
    body = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1)))
    kept = rows.where("_code <> 0").select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), copies.alias("_copy"))
    return kept.drop("_copy"), rows.where("_code = 0").select("conv_id")
