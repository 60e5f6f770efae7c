"""Conversation structure repair: generalised LR repair over the role grammar.

The grammar is an optional system turn and then pairs of user and assistant turns, or nothing.
Its automaton has four states, so a graph-structured stack has at most four tops: nothing yet,
after system, after user, after assistant. Each turn moves every top by keep, rerole or delete,
an insertion moves a top without a turn, and tops that meet are merged to the smaller
(cost, audit); the audit is the string of edits. Two audits of one cost for the same turns never
begin one another (they would differ in insertions, which cost), so merging early is safe.

A turn reaches the parser as one letter. Letters are strung by conversation and range of turns,
ranges are cut into blocks of ``BLOCK`` turns, and a block's whole effect is the least
(cost, audit) from each state to each other one. Blocks are parsed where they lie and folded
per conversation, so a conversation of any length is parsed in parallel; only its letters and
audit are ever together, not its texts. Rebuilding texts streams a conversation's sorted turns
through one task in bounded memory, as a running digest of them must.

Defined results: a NULL role or text is one space; turns come by number (NULL first), those of
one number by role and a hash of the text, equal rows adjacent; a NULL conv_id is a
conversation; a role counts by its first letter and an empty one fits nowhere; a conversation
without turns, or an empty table, gives zeros or no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
BLOCK = 512
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> letter -> state
_MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_FINAL = (START, ASSISTANT)
_WORDY = r"[^\x20\x09-\x0D]"
_Best = dict[int, tuple[int, str]]


# --- the parser --------------------------------------------------------------------------

def _put(tops: _Best, state: int, way: tuple[int, str]) -> bool:
    if state in tops and tops[state] <= way:
        return False
    tops[state] = way
    return True


def _inserted(tops: _Best) -> _Best:
    """The tops with any insertions after them."""
    work = list(tops)
    while work:
        state = work.pop()
        cost, audit = tops[state]
        for letter, to in _MOVES[state].items():
            if letter != "s" and _put(tops, to, (cost + INSERT, audit + "I")):
                work.append(to)
    return tops


def step(tops: _Best, turn: str) -> _Best:
    """The tops after one turn: ``s u a -`` by role, upper case where its text is cut short
    (``+`` for ``-``), ``x`` where it must go."""
    out: _Best = {}
    for state, (cost, audit) in tops.items():
        _put(out, state, (cost + DELETE, audit + "D"))
        if turn != "x":
            more = CUT_SHORT if turn in "SUA+" else 0
            for letter, to in _MOVES[state].items():
                if letter == turn.lower():
                    _put(out, to, (cost + KEEP + more, audit + "K"))
                elif letter != "s":
                    _put(out, to, (cost + REROLE + more, audit + "R"))
    return _inserted(out)


@lru_cache(maxsize=8_000)
def effect(turns: str, start: int) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, audit) that the turns of one block lead to."""
    tops = _inserted({start: (0, "")})
    for turn in turns:
        tops = step(tops, turn)
    return tuple((s, c, a) for s, (c, a) in sorted(tops.items()))


class Fold:
    """Blocks of one conversation in order. What the audits of all tops share is set aside, so
    the work follows the letters."""

    def __init__(self):
        self.tops: _Best = {START: (0, "")}
        self.shared: list[str] = []

    def add(self, ways: list[dict]) -> None:
        out: _Best = {}
        for way in ways:
            if way["s"] in self.tops:
                cost, audit = self.tops[way["s"]]
                _put(out, way["t"], (cost + way["cost"], audit + way["audit"]))
        same = commonprefix([audit for _, audit in out.values()])
        self.shared.append(same)
        self.tops = {s: (c, a[len(same):]) for s, (c, a) in out.items()}

    def best(self) -> tuple[int, str]:
        cost, audit = min(self.tops[s] for s in _FINAL if s in self.tops)
        return cost, "".join(self.shared) + audit


def illegal_pairs(roles: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


# --- rows --------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, stripped of stops, repeated or set to
    user by a checksum of conversation and turn; roles and texts without NULL."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = (F.when(F.col("_c") == 1, F.lit("")).when(F.col("_c") == 2, F.regexp_replace(space("text"), "[.!?]", ""))
            .otherwise(space("text")))
    rows = conversations.withColumn("_c", code).filter("_c <> 0").select(
        "conv_id", "turn", F.when(F.col("_c") == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_c") == 3, 2).otherwise(1))).alias("_n"))
    return rows.drop("_n")


def _plain(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))


def _digest() -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(977), "text").alias("h2")]


def _order(*first: Column) -> list[Column]:
    """Conversations, and in each its turns in order."""
    return [F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, n, first, fault) staged: equal rows of one turn counted, not
    gathered; ``first`` says that role and text were not seen before; fault is ``blank``,
    ``truncated`` or NULL by the text alone."""
    blank = ~F.col("text").rlike(_WORDY)
    short = ~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(short, "truncated")
    per = (_plain(rows).select("conv_id", "turn", "role", *_digest(), fault.alias("fault"))
           .groupBy("conv_id", "turn", "role", "h1", "h2", "fault").agg(F.count("*").alias("n")))
    per = stage_shared(per, "turns")
    key = ["conv_id", "role", "h1", "h2"]
    seen = F.struct(F.col("turn").isNotNull().alias("real"), F.col("turn").alias("turn"))
    first = per.groupBy(*key).agg(F.min(seen).alias("_first"))
    both = per.alias("p").join(first.alias("f"), (F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.role") == F.col("f.role"))
                                                  & (F.col("p.h1") == F.col("f.h1")) & (F.col("p.h2") == F.col("f.h2"))))
    return stage_shared(both.select("p.*", F.col("p.turn").eqNullSafe(F.col("f._first.turn")).alias("first")), "faults")


def _strings(turns: DataFrame) -> DataFrame:
    """(conv_id, part, block, roles, ways) staged: turns strung in order, ``BLOCK`` at a time, and
    what each block does to the states it may be met in. Ranges are cut inside conversations too,
    so a long one is strung and parsed by many tasks."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("-"))
    rows = turns.select("conv_id", "turn", "role", "h1", "h2", "n", initial.alias("role1"), F.coalesce("fault", F.lit("")).alias("fault"), "first")
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(partitions, *_order()).sortWithinPartitions(*_order())

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, block, out = TaskContext.get().partitionId(), 0, []
        own, roles, letters, seen, begins = None, [], [], 0, False

        def close() -> None:
            nonlocal block, roles, letters, begins
            if roles:
                # only where a conversation surely begins is the state known
                turns = "".join(letters)
                ways = [{"s": s, "t": t, "cost": c, "audit": a} for s in ([START] if begins else range(4)) for t, c, a in effect(turns, s)]
                out.append((own, part, block, "".join(roles), ways))
                block, roles, letters, begins = block + 1, [], [], False

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            way = pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(way)]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "block", "roles", "ways"])

        for batch in batches:
            for conv, n, role, fault, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "role1", "fault", "first"))):
                if not seen or conv != own:
                    close()
                    own, seen, begins = conv, seen + 1, seen > 0
                head = "x" if fault == "blank" or not first else role if not fault else "+" if role == "-" else role.upper()
                left = n
                while left:
                    take = min(left, BLOCK - len(roles))
                    roles += [role] * take
                    letters += [head] + ["x"] * (take - 1)
                    head, left = "x", left - take
                    if len(roles) == BLOCK:
                        close()
                if len(out) >= 1000:
                    yield ready()
        close()
        if out:
            yield ready()

    strung = rows.select("conv_id", "n", "role1", "fault", "first").mapInArrow(
        string, "conv_id bigint, part int, block bigint, roles string, ways array<struct<s:int,t:int,cost:bigint,audit:string>>")
    return stage_shared(strung, "letters")


def _parsed(strings: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit): blocks folded in order."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nothing, state, bad, last, out = None, True, Fold(), 0, "", []

        def close() -> None:
            if not nothing:
                out.append((own, bad, *state.best()))

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "illegal", "cost", "audit"])

        for batch in batches:
            for conv, roles, ways in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "roles", "ways"))):
                if nothing or conv != own:
                    close()
                    own, nothing, state, bad, last = conv, False, Fold(), 0, ""
                bad += illegal_pairs(last + roles)
                last = roles[-1]
                state.add(ways)
            if len(out) >= 1000:
                yield ready()
        close()
        if out:
            yield ready()

    order = [F.col("conv_id").asc_nulls_first(), "part", "block"]
    return (strings.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "roles", "ways")
            .mapInArrow(fold, "conv_id bigint, illegal bigint, cost bigint, audit string"))


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation
    with a turn, staged."""
    turns = faults(rows)
    times = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    blank, kept = F.coalesce(F.col("fault") == "blank", F.lit(False)), F.col("first").cast("long")
    again = F.when(~blank, F.col("n") - kept).otherwise(0)
    counts = turns.groupBy("conv_id").agg(
        times(blank).alias("blank"), F.sum(again).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", kept).otherwise(0)).alias("truncated"),
        F.max("turn").alias("_hi"), F.min("turn").alias("_lo"))
    numbers = turns.filter("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("_turns"))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    gaps = F.coalesce(F.col("c._hi") - F.col("c._lo") + 1 - F.col("t._turns"), F.lit(0).cast("long"))
    out = (counts.alias("c").join(numbers.alias("t"), same("c", "t"), "left").join(_parsed(_strings(turns)).alias("p"), same("c", "p"))
           .select("c.conv_id", gaps.alias("gaps"), "c.blank", "c.duplicate", "c.truncated", "p.illegal", "p.cost", "p.audit"))
    return stage_shared(out, "repairs")


_REPAIRED = "conv_id bigint, place bigint, edit string, role string, text string"


def _stream(digest: bool):
    """Task body over a conversation's audit and then its turns in order: the repaired turns, or
    one checksum of them."""
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, audit, at, place, expect, sha, out, size = None, None, 0, 0, "u", None, [], 0

        def ready() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*out))
            out.clear()
            size = 0
            if digest:
                return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], ["conv_id", "repaired_sha256"])
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:]]],
                                   ["conv_id", "place", "edit", "role", "text"])

        def turn(edit: str, role: str | None, text: str) -> None:
            nonlocal place, expect, size
            if edit != "K":
                role = "user" if expect == "u" else "assistant"
            expect = "a" if role[0] == "u" else "u"
            if digest:
                sha.update((("\n" if place else "") + f"{role}:{text}").encode())
            else:
                out.append((own, place, edit, role, text))
                size += len(text) + 64
            place += 1

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                turn("I", None, "")
                at += 1

        def close() -> None:
            if audit is not None:
                insertions()
                if digest:
                    out.append((own, sha.hexdigest()))

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))
            for conv, header, role, text in zip(*cols):
                if header is not None:
                    close()
                    own, audit, at, place, expect, sha = conv, header, 0, 0, "u", hashlib.sha256()
                    continue
                insertions()
                edit = audit[at]
                at += 1
                if edit != "D":
                    turn(edit, role, text)
                if size >= 1 << 22:
                    yield ready()
            if out:
                yield ready()
        close()
        if out:
            yield ready()
    return follow


def _followed(rows: DataFrame, found: DataFrame, digest: bool, schema: str) -> DataFrame:
    text = _plain(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", *_digest())
    none = lambda kind: F.lit(None).cast(kind)
    head = found.select("conv_id", "audit", none("bigint").alias("turn"), none("string").alias("role"), none("string").alias("text"),
                        none("bigint").alias("h1"), none("bigint").alias("h2"))
    both = head.unionAll(text).repartition("conv_id").sortWithinPartitions(*_order(F.col("audit").isNull()))
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_stream(digest), schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every repaired conversation, by the
    staged result ``found`` of :func:`repairs` on the same rows."""
    return _followed(rows, found, False, _REPAIRED)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired ``role:text`` lines."""
    return _followed(rows, found, True, "conv_id bigint, repaired_sha256 string")
