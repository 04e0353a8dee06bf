"""Repair of conversation structure by weighted interval parsing.

A repaired conversation has the role initials `(s?(ua)+)?`. Its grammar is in Chomsky
normal form over the places that lie between two messages: nothing yet, after the system
message, after a user's, after an assistant's. A nonterminal [p q] derives a span that
leads from place p to place q, so the rules are [p q] -> [p r] [r q], and a message is
kept, given another role or deleted by a rule of its own. Insertions are closed over: a
message's cell already holds the cheapest insertions before it, the end holds those after
the last. A cell keeps for every [p q] the least (cost, audit); of equal costs no audit
begins another one of the same span, so the least of a whole is made of the least of its
parts. Nonterminals fix both ends, so every split of a span gives the same cell, and spans
are combined bottom-up by length 1, 2, 4, ..., all spans of a length at once.

Messages are sorted over ranges of conversation and turn. A task combines what of each
conversation lies in its range; the few that reach over its ends are joined to others'
afterwards, one cell per range. So a conversation may hold any share of the rows. Only
writing out a repaired conversation, whose digest is a chain, is done conversation by
conversation; its messages are streamed, never held.

Null roles and texts count as one space. A conversation's messages stand in the order of
turn (nulls first), role and a digest of role and text; equal messages are alike. Null is
a conversation of its own. A role whose initial is none of s, u, a, or which is empty, can
only be given another role or deleted. Conversations without messages give zeros, an empty
audit and the digest of nothing. Further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from termwarden.llm.common import pieces
from termwarden.sources.scratch import WorkFolder

SPACE = " "
FILLED = r"[^\x20\x09-\x0D]"

#: Costs of edits, and what a truncated message that stays costs besides.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40

#: Initials by number; 3 stands for all others. Steps lead from place to place.
INITIALS = "sua"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may stand side by side, by number.
LEGAL = ((0, 1), (1, 2), (2, 1))

#: Nonterminals: places with a way from the first to the second.
SPANS = [(p, q) for p in range(4) for q in range(4) if q in ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))[p]]
INDEX = {span: at for at, span in enumerate(SPANS)}
#: For every nonterminal the pairs its span can be made of.
RULES = [
    [(INDEX[p, r], INDEX[r, q]) for r in range(4) if (p, r) in INDEX and (r, q) in INDEX] for p, q in SPANS
]

Cells = tuple[np.ndarray, np.ndarray]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of spans that adjoin pairwise."""
    rows = len(left[0])
    width = left[1].dtype.itemsize + right[1].dtype.itemsize
    costs = np.full((rows, len(SPANS)), NEVER, np.int64)
    audits = np.zeros((rows, len(SPANS)), f"S{width}")
    for at, rules in enumerate(RULES):
        tried = np.stack([left[0][:, a] + right[0][:, b] for a, b in rules])
        costs[:, at] = np.minimum(tried.min(axis=0), NEVER)
        written = np.zeros(rows, bool)
        for (a, b), cost in zip(rules, tried, strict=True):
            best = np.flatnonzero((cost == costs[:, at]) & (cost < NEVER))
            if not best.size:
                continue
            audit = np.strings.add(left[1][best, a], right[1][best, b])
            least = ~written[best] | (audit < audits[best, at])
            audits[best[least], at] = audit[least]
            written[best] = True
    return costs, audits


def _cell(entries: dict[tuple[int, int], tuple[int, str]]) -> Cells:
    costs = np.full((1, len(SPANS)), NEVER, np.int64)
    audits = np.zeros((1, len(SPANS)), "S3")
    for span, (cost, audit) in entries.items():
        costs[0, INDEX[span]], audits[0, INDEX[span]] = cost, audit
    return costs, audits


def _insertions() -> Cells:
    """The cheapest insertions alone from any place to any other."""
    best = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit) in list(best.items()):
            for (at, initial), to in STEPS.items():
                if at == q and initial in ROLES:
                    best[p, to] = min(best.get((p, to), (NEVER, "")), (cost + INSERT, audit + "I"))
    return _cell(best)


def _message(initial: int, fault: int) -> Cells:
    """A message after the cheapest insertions; fault 0 none, 1 must go, 2 truncated."""
    entries = {(p, p): (DELETE, "D") for p in range(4)}
    if fault != 1:
        more = TRUNCATED if fault == 2 else 0
        for (p, letter), q in STEPS.items():
            edits = [(RENAME + more, "R")] if letter in ROLES else []
            if initial < 3 and INITIALS[initial] == letter:
                edits.append((more, "K"))
            if edits:
                entries[p, q] = min([*edits, entries.get((p, q), (NEVER, ""))])
    return combined(_insertions(), _cell(entries))


def _table(cells: list[Cells]) -> Cells:
    return np.concatenate([c for c, _ in cells]), np.concatenate([a for _, a in cells])


#: The twelve kinds of messages: initial * 3 + fault.
MESSAGES = _table([_message(initial, fault) for initial in range(4) for fault in range(3)])
END = _insertions()


def span_cells(kinds: np.ndarray, run: np.ndarray) -> Cells:
    """One cell per run of messages; `run` numbers them from 0 in order."""
    cells = MESSAGES[0][kinds], MESSAGES[1][kinds]
    while len(run) and len(run) > run[-1] + 1:
        first = np.searchsorted(run, run)
        place = np.arange(len(run)) - first
        joins = np.flatnonzero((place[:-1] % 2 == 0) & (run[:-1] == run[1:]))
        costs, audits = combined(
            (cells[0][joins], cells[1][joins]), (cells[0][joins + 1], cells[1][joins + 1])
        )
        stays = np.ones(len(run), bool)
        stays[joins + 1] = False
        wider = cells[1].astype(audits.dtype)
        cells[0][joins], wider[joins] = costs, audits
        cells, run = (cells[0][stays], wider[stays]), run[stays]
    return cells


def cheapest(cell: Cells) -> tuple[int, str]:
    """Cost and audit of a whole conversation, of its cell (one row)."""
    costs, audits = combined(cell, END)
    whole = [(int(costs[0, at]), audits[0, at].decode()) for at in (INDEX[0, 0], INDEX[0, 3])]
    return min(whole)


@dataclass
class Stretch:
    """Adjoining messages of a conversation: what to know of them to join others."""

    conv: object
    messages: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: int
    last: int
    least_turn: int | None
    most_turn: int | None
    turns: int
    cell: Cells

    def joined(self, other: Stretch) -> Stretch:
        turns = self.turns + other.turns
        if self.turns and other.turns and self.most_turn == other.least_turn:
            turns -= 1
        return Stretch(
            self.conv,
            self.messages + other.messages,
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + ((self.last, other.first) not in LEGAL),
            self.first,
            other.last,
            self.least_turn if self.turns else other.least_turn,
            other.most_turn if other.turns else self.most_turn,
            turns,
            combined(self.cell, other.cell),
        )

    def summary(self) -> tuple:
        gaps = self.most_turn - self.least_turn + 1 - self.turns if self.turns else 0
        counts = (self.messages, gaps, self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv, *counts, *cheapest(self.cell))


_COUNTS = ("messages", "blank", "duplicate", "truncated", "illegal")
_ENDS = ("first", "last", "least_turn", "most_turn", "turns")
_RESULT = ("messages", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stretches(batch: pa.RecordBatch) -> list[Stretch]:
    """The runs of equal conversations in a batch of sorted messages."""
    ids = batch.column("conv_id").to_pylist()
    number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
    initial, fault = number("initial"), number("fault")
    fresh = np.array([True] + [a != b for a, b in zip(ids, ids[1:])])
    starts, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    ends = np.append(starts[1:], len(ids))
    costs, audits = span_cells(initial * 3 + np.choose(fault, (0, 1, 1, 2)), run)
    pair = initial[:-1] * 4 + initial[1:]
    illegal = np.concatenate([[0], ~np.isin(pair, [a * 4 + b for a, b in LEGAL])]).astype(np.int64)
    illegal[fresh] = 0
    turns = batch.column("turn").to_pylist()
    sums = [np.add.reduceat(values, starts) for values in (fault == 1, fault == 2, fault == 3, illegal)]
    out = []
    for at, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        known = [t for t in turns[start:end] if t is not None]
        out.append(
            Stretch(
                ids[start],
                end - start,
                *(int(s[at]) for s in sums),
                int(initial[start]),
                int(initial[end - 1]),
                known[0] if known else None,
                known[-1] if known else None,
                len(set(known)),
                (costs[at : at + 1], audits[at : at + 1]),
            )
        )
    return out


def _key_of(df: DataFrame):
    return df.schema["conv_id"].dataType


def _parsed_schema(df: DataFrame) -> StructType:
    schema = StructType().add("conv_id", _key_of(df)).add("part", "integer")
    for name in dict.fromkeys((*_RESULT, *_COUNTS, *_ENDS)):
        schema = schema.add(name, "long")
    return schema.add("audit", "string").add("costs", ArrayType(LongType())).add("audits", ArrayType(StringType()))


def _parse(schema: StructType):
    """Task: summaries of the conversations inside a range, stretches of those at its ends."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def rows(done: list[Stretch], part: int, whole: bool) -> pa.RecordBatch:
        out = []
        for s in done:
            row = {"conv_id": s.conv, "part": part}
            if whole:
                names = ("conv_id", *_RESULT, "audit")
                row |= dict(zip(names, s.summary(), strict=True))
            else:
                row |= {n: getattr(s, n) for n in (*_COUNTS, *_ENDS)}
                row["costs"] = s.cell[0][0].tolist()
                row["audits"] = [a.decode() for a in s.cell[1][0]]
            out.append(row)
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, open_one, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _stretches(batch)
            if open_one is not None and open_one.conv == found[0].conv:
                found[0] = open_one.joined(found[0])
            elif open_one is not None:
                found.insert(0, open_one)
            *ended, open_one = found
            if first and ended:
                yield rows(ended[:1], part, False)
                ended, first = ended[1:], False
            if ended:
                yield rows(ended, part, True)
        if open_one is not None:
            yield rows([open_one], part, False)

    return parse


def _joined(schema: StructType):
    """Task: the stretches of one conversation, one per range, to its summary."""
    names = schema.names

    def join(found: pd.DataFrame) -> pd.DataFrame:
        whole: Stretch | None = None
        for row in found.sort_values("part").to_dict("records"):
            turn = {n: int(row[n]) if row["turns"] else None for n in ("least_turn", "most_turn")}
            numbers = {n: int(row[n]) for n in (*_COUNTS, "first", "last", "turns")}
            audits = np.array([[a.encode() for a in row["audits"]]])
            cell = np.array([row["costs"]], np.int64), audits
            conv = None if pd.isna(row["conv_id"]) else row["conv_id"]
            stretch = Stretch(conv=conv, cell=cell, **numbers, **turn)
            whole = stretch if whole is None else whole.joined(stretch)
        return pd.DataFrame([whole.summary()], columns=names).astype({"conv_id": found["conv_id"].dtype})

    return join


def messages(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text)` with nulls of the last two as one space."""
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(SPACE)).alias("role"),
        F.coalesce("text", F.lit(SPACE)).alias("text"),
    )


def _digest() -> Column:
    return F.substring(F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)), 1, 16)


def parsed(conversations: DataFrame, work: WorkFolder) -> DataFrame:
    """`(conv_id, messages, gaps, blank, duplicate, truncated, illegal, cost, audit)`.

    One row per conversation that has messages. Each message's first fault counts: blank,
    equal to an earlier one, or not ended by a full stop, question or exclamation mark.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    initial = F.expr("substring(role, 1, 1)")
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    # All but the texts: what is sorted and parsed is small.
    light = work.write(
        "light",
        messages(conversations).select(
            "conv_id",
            "turn",
            "role",
            _digest().alias("digest"),
            number.alias("initial"),
            F.when(~F.col("text").rlike(FILLED), 1).when(~ended, 3).otherwise(0).alias("fault"),
            F.monotonically_increasing_id().alias("_row"),
        ),
    )
    place = F.struct("turn", "_row")
    repeated = (
        light.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"))
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    repeated = work.write("repeated", repeated)
    same = light["conv_id"].eqNullSafe(repeated["_conv"]) & (light["digest"] == repeated["_digest"])
    fault = F.when(F.col("fault") == 1, 1).when(place > F.col("_first"), 2).otherwise(F.col("fault"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "_row"]
    ranged = (
        light.join(repeated, same, "left")
        .withColumn("fault", fault)
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("conv_id", "turn", "initial", "fault")
    )
    schema = _parsed_schema(conversations)
    found = work.write("parsed", ranged.mapInArrow(_parse(schema), schema))
    names = ["conv_id", *_RESULT, "audit"]
    result = StructType([schema[n] for n in names])
    # At most two stretches of each range, whatever the conversations' sizes.
    across = found.where("costs IS NOT NULL").groupBy("conv_id").applyInPandas(_joined(result), result)
    return work.write("summaries", found.where("costs IS NULL").select(*names).unionByName(across))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """`(conv, place, edit, role, text)` of repaired messages, in order.

    A conversation's audit comes before its messages. Deleted ones are left out; the
    message after the last one of a conversation is `(conv, None, ...)`.
    """
    conv, audit, at, place, here = None, "", 0, 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, here
        while at < len(audit) and audit[at] == "I":
            letter = "a" if here == 2 else "u"
            here = STEPS[here, letter]
            yield conv, place, "I", ROLES[letter], ""
            at, place = at + 1, place + 1

    started = False
    for batch in batches:
        for piece in pieces(batch):
            rows = zip(*(piece.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True)
            for new, head, role, text in rows:
                if head is not None:
                    if started:
                        yield from inserted()
                        yield conv, None, None, None, None
                    started, conv, audit, at, place, here = True, new, head, 0, 0, 0
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    here = STEPS[here, role[0]]
                else:
                    letter = "a" if here == 2 else "u"
                    here, role = STEPS[here, letter], ROLES[letter]
                yield conv, place, edit, role, text
                place += 1
    if started:
        yield from inserted()
        yield conv, None, None, None, None


def _streamed(conversations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each conversation's audit and then its messages, conversation by conversation."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = summaries.select(
        "conv_id",
        "audit",
        F.lit(0).alias("_kind"),
        none("long").alias("turn"),
        none("string").alias("role"),
        none("string").alias("text"),
        none("binary").alias("digest"),
    )
    rows = messages(conversations).select(
        "conv_id",
        none("string").alias("audit"),
        F.lit(1).alias("_kind"),
        "turn",
        "role",
        "text",
        _digest().alias("digest"),
    )
    order = ["conv_id", "_kind", F.asc_nulls_first("turn"), "role", "digest"]
    dealt = heads.unionByName(rows).repartition(parts, "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "audit", "role", "text")


def repaired(conversations: DataFrame, summaries: DataFrame) -> DataFrame:
    """The repaired messages, `(conv_id, place, edit, role, text)`; places start at 0."""
    schema = StructType().add("conv_id", _key_of(conversations)).add("place", "long")
    for name in ("edit", "role", "text"):
        schema = schema.add(name, "string")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, size = to_arrow_schema(schema), [], 0
        for row in _edited(batches):
            if row[1] is not None:
                held.append(row)
                size += len(row[4])
            if len(held) >= 10_000 or size >= 1 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=arrow)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=arrow)

    return _streamed(conversations, summaries).mapInArrow(write, schema)


def repaired_digests(conversations: DataFrame, summaries: DataFrame) -> DataFrame:
    """`(conv_id, repaired_sha256)`: of the repaired `role:text`, joined by newlines."""
    schema = StructType().add("conv_id", _key_of(conversations)).add("repaired_sha256", "string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, done, sha = to_arrow_schema(schema), [], hashlib.sha256()
        for conv, place, _, role, text in _edited(batches):
            if place is None:
                done.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                sha = hashlib.sha256()
            else:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return _streamed(conversations, summaries).mapInArrow(digest, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Messages with faults put in, as a hash of conversation and turn says.

    Of twenty messages one each is dropped, emptied, stripped of `[.!?]`, repeated, or
    given the role user.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(SPACE))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = messages(conversations).withColumn("_fate", fate).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(
        F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")
    )
    times = F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("_copy"),
    ).drop("_copy")


def summarised(original: DataFrame, conversations: DataFrame, work: WorkFolder) -> DataFrame:
    """Summary and digest of every conversation of `original`, repaired from `conversations`."""
    summaries = parsed(conversations, work)
    digests = repaired_digests(conversations, summaries).withColumnRenamed("conv_id", "_conv")
    both = summaries.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    both = both.withColumnRenamed("conv_id", "_conv")
    nothing = hashlib.sha256().hexdigest()
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in _RESULT if n != "messages"]
    return (
        original.select("conv_id")
        .distinct()
        .join(both, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .select(
            "conv_id",
            *numbers,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
