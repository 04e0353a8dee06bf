from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwarden.llm import conversations
from termwarden.llm.common import work_folder

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = {"u": "user", "a": "assistant"}
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


@pytest.fixture(scope="module")
def convs_of(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def ordered(rows):
    """Messages of one conversation in order, with nulls as one space."""
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    digest = lambda m: hashlib.sha256(f"{m[1]}\0{m[2]}".encode()).digest()[:16]
    return sorted(filled, key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), digest(m)))


def faults_of(messages):
    out, seen = [], set()
    for _, role, text in messages:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        if not stripped:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """Message after message, the cheapest way to every place of the pattern."""
    messages = ordered(rows)
    faults = faults_of(messages)
    turns = sorted({t for t, _, _ in messages if t is not None})
    initials = [role[:1] for _, role, _ in messages]
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def inserted(ways):
        for _ in range(3):
            for place, (cost, audit, out) in list(ways.items()):
                for (p, letter), q in STEPS.items():
                    if p == place and letter in ROLES:
                        more = (cost + 3, audit + "I", [*out, f"{ROLES[letter]}:"])
                        ways[q] = min(ways.get(q, (10**9, "", [])), more, key=lambda w: w[:2])
        return ways

    ways = {0: (0, "", [])}
    for (_, role, text), fault in zip(messages, faults):
        following = {}

        def add(q, cost, audit, out):
            following[q] = min(following.get(q, (10**9, "", [])), (cost, audit, out), key=lambda w: w[:2])

        for place, (cost, audit, out) in inserted(ways).items():
            add(place, cost + 4, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            for (p, letter), q in STEPS.items():
                if p == place and role[:1] == letter:
                    add(q, cost + more, audit + "K", [*out, f"{role}:{text}"])
                if p == place and letter in ROLES:
                    add(q, cost + 3 + more, audit + "R", [*out, f"{ROLES[letter]}:{text}"])
        ways = following
    ends = [w for place, w in inserted(ways).items() if place in (0, 3)]
    cost, audit, out = min(ends, key=lambda w: w[:2])
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def found_of(spark, rows, original=None):
    df = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    result = conversations.summarised(original or df, df, work_folder(df)).collect()
    assert len({r.conv_id for r in result}) == len(result)
    return {r.conv_id: tuple(r)[1:] for r in result}


def check(spark, rows):
    found = found_of(spark, rows)
    groups = {}
    for conv, *message in rows:
        groups.setdefault(conv, []).append(message)
    assert found.keys() == groups.keys()
    for conv, messages in groups.items():
        assert found[conv] == plain(messages), conv


def some_message(rng, turn):
    role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    return (turn, role, rng.choice(["Yes.", "No", "Why?  ", "", " \t", None, "Well!", f"It is {turn}."]))


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, *some_message(rng, rng.choice([turn, turn, turn + 1, None]))))
    rng.shuffle(rows)
    check(spark, rows)


def test_conversations_over_many_ranges_and_batches(spark):
    """One conversation holds most rows, so every range has a part of it."""
    rng = random.Random(2)
    rows = [(7, *some_message(rng, turn)) for turn in range(3000)]
    rows += [(None, *some_message(rng, turn)) for turn in range(40)]
    rows += [(c, *some_message(rng, 0)) for c in range(5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_messages_over_several_ranges(spark):
    """All rows alike: one stays in question, all others are duplicates, wherever they lie."""
    check(spark, [(1, 3, "user", "Same.")] * 50 + [(1, None, "user", "Same.")] * 9)


def exhaustive(rows):
    """All edits of all messages with all insertions between them."""
    messages = ordered(rows)
    faults = faults_of(messages)
    choices = []
    for (_, role, _), fault in zip(messages, faults):
        more = 3 if fault == "truncated" else 0
        one = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            one += [(more, "K", role[:1] or "?"), (3 + more, "R", "u"), (3 + more, "R", "a")]
        choices.append(one)
    fill = [(3 * len(s), "I" * len(s), s) for s in ("", "u", "a", "ua", "au")]
    steps = [fill]
    for one in choices:
        steps += [one, fill]
    best = min(
        (sum(c for c, _, _ in way), "".join(a for _, a, _ in way))
        for way in product(*steps)
        if re.fullmatch("(s?(ua)+)?", "".join(s for _, _, s in way))
    )
    return best


def test_the_cheapest_of_all_repairs(spark):
    rng = random.Random(3)
    rows, groups = [], {}
    for conv in range(60):
        groups[conv] = [some_message(rng, t) for t in range(rng.randrange(1, 4))]
        rows += [(conv, *m) for m in groups[conv]]
    found = found_of(spark, rows)
    for conv, messages in groups.items():
        assert found[conv][5:7] == exhaustive(messages)


def test_spans_do_not_depend_on_where_they_are_split():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 7, 33):
        kinds = rng.integers(0, 12, size)
        whole = conversations.span_cells(kinds, np.zeros(size, np.int64))
        for cut in range(1, size):
            run = np.zeros(size, np.int64)
            run[cut:] = 1
            costs, audits = conversations.span_cells(kinds, run)
            again = conversations.combined((costs[:1], audits[:1]), (costs[1:], audits[1:]))
            assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()


def test_repaired_messages_follow_the_pattern(spark):
    rng = random.Random(5)
    rows = [(c, *some_message(rng, t)) for c in range(30) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    summaries = conversations.parsed(df, work_folder(df))
    audits = {r.conv_id: r.audit for r in summaries.collect()}
    groups = {}
    for r in conversations.repaired(df, summaries).orderBy("conv_id", "place").collect():
        groups.setdefault(r.conv_id, []).append(r)
    for conv, audit in audits.items():
        kept = groups.get(conv, [])
        assert [r.place for r in kept] == list(range(len(kept)))
        assert "".join(r.edit for r in kept) == audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))


def test_damage_is_what_the_hash_says(spark):
    rows = [(c, t, "assistant", f"One. Two {c}?") for c in range(40) for t in range(5)]
    rows += [(None, 3, None, None), (3, None, "user", "x.")]
    found = sorted(map(str, conversations.damaged(spark.createDataFrame(rows, SCHEMA)).collect()))
    expected = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = role or " ", " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        expected += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    made = spark.createDataFrame(expected, SCHEMA).collect()
    assert found == sorted(map(str, made))


def test_conversations_that_lose_all_messages(spark):
    original = spark.createDataFrame([(1, 0, "user", "A."), (None, 0, "user", "B.")], SCHEMA)
    nothing = hashlib.sha256().hexdigest()
    found = found_of(spark, original.limit(0), original)
    assert found == {c: (0, 0, 0, 0, 0, 0, "", nothing) for c in (1, None)}
    empty = original.limit(0)
    assert conversations.summarised(empty, conversations.damaged(empty), work_folder(empty)).count() == 0


def test_long_texts_text_ids_and_further_columns(spark):
    rows = [("a", 0, "user", "word " * 400_000 + "."), ("a", 1, "assistant", "x" * 100), ("b", 0, "user", "Hm?")]
    df = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    df = df.withColumns({n: F.lit(n) for n in ("initial", "fault", "digest", "_row", "audit", "place")})
    found = found_of(spark, df)
    for conv in "ab":
        assert found[conv] == plain([r[1:] for r in rows if r[0] == conv])
