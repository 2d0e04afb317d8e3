"""Conversation repair against an alignment of the rows with every well formed sequence of roles."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_repair as repair
from quire.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
FAR = (1 << 60, "")
SPACE = " \t\n\x0b\x0c\r"


def by_hand(rows):
    """All results of one conversation, rows being (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    best = (*FAR, "")
    for pairs, system in itertools.product(range(len(rows) + 2), ("", "s")):
        target = (system + "ua" * pairs) if pairs else ""

        @lru_cache(None)
        def least(i, j):
            ways = []
            if i == len(rows) and j == len(target):
                return 0, ""
            if j < len(target) and target[j] in "ua":
                c, a = least(i, j + 1)
                ways.append((c + 2, "I" + a))
            if i < len(rows):
                c, a = least(i + 1, j)
                ways.append((c + 3, "D" + a))
                if faults[i] not in ("blank", "duplicate") and j < len(target):
                    c, a = least(i + 1, j + 1)
                    c += faults[i] == "truncated"
                    if target[j] in "ua":
                        ways.append((c + 2, "R" + a))
                    if target[j] == initials[i]:
                        ways.append((c, "K" + a))
            return min(ways, default=FAR)

        best = min(best, (*least(0, 0), target))
    cost, audit, target = best
    assert re.fullmatch("(s?(ua)+)?", target)
    lines, i, j = [], 0, 0
    names = {"s": "system", "u": "user", "a": "assistant"}
    for letter in audit:
        if letter != "D":
            lines.append(f"{rows[i][1] if letter == 'K' else names[target[j]]}:{'' if letter == 'I' else rows[i][2]}")
            j += 1
        i += letter != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines)


def random_rows(rng, n):
    text = lambda: rng.choice(["Yes.", "No", " ", "", "Well then!", "What? ", "a.b", "x\n"])
    role = lambda: rng.choice(["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "User", "admin", " "])
    return [(i, role(), text() + (str(i) + "." if rng.random() < 0.5 else "")) for i in range(n)]


def results(spark, rows, segment):
    repaired, report = repair.repair(spark.createDataFrame(rows, SCHEMA), segment)
    lines = defaultdict(list)
    for r in repaired.orderBy("conv_id", "seg", "place").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["sha256"] for r in repair.digests(repaired).collect()}
    for conv, said in lines.items():
        assert digests[conv] == hashlib.sha256("\n".join(said).encode()).hexdigest()
    return {r["conv_id"]: (*tuple(r)[1:], "\n".join(lines[r["conv_id"]])) for r in report.collect()}


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_least_edits_by_alignment(spark, segment):
    rng = random.Random(segment)
    rows, want = [], {}
    for conv in range(120):
        said = random_rows(rng, rng.randrange(1, 9))
        want[conv] = by_hand(said)
        rows += [(conv, *r) for r in said]
    rng.shuffle(rows)
    assert results(spark, rows, segment) == want


def test_null_ids_turns_and_ties(spark):
    said = [(None, "assistant", "b."), (None, "user", "a?"), (4, "user", "a?"), (4, "user", "a?"), (9, None, None), (9, "user", "z.")]
    ordered = sorted(((t, r or " ", x or " ") for t, r, x in said), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    got = results(spark, [(None, *r) for r in said], 2)
    assert got == {None: by_hand(ordered)}
    assert got[None][0] == 4


def test_long_conversation_in_pieces_equals_one_piece(spark):
    rng = random.Random(5)
    rows = [(1, *r) for r in random_rows(rng, 700)]
    assert results(spark, rows, 7) == results(spark, rows, 700) == results(spark, rows, 512)


def test_empty_table_and_clashing_columns(spark):
    repaired, report = repair.repair(spark.createDataFrame([], SCHEMA))
    assert repaired.count() == report.count() == 0
    rows = [(1, 0, "user", "a.", 5, True), (1, 1, "assistant", "b.", 6, False)]
    odd = spark.createDataFrame(rows, SCHEMA + ", pos int, no_conv boolean")
    repaired, report = repair.repair(odd)
    assert report.select("cost", "audit").collect()[0] == (0, "KK") and repaired.count() == 2


def test_query_against_damage_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    convs, ids = defaultdict(list), set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        ids.add(r["conv_id"])
        harm = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"], r["text"]
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        if harm:
            convs[r["conv_id"]] += [(r["turn"], "user" if harm == 4 else role, text)] * (1 + (harm == 3))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, sf).collect()}
    want = {}
    for conv in ids:
        hand = by_hand(sorted(convs[conv])) if convs[conv] else (0, 0, 0, 0, 0, 0, "", "")
        want[conv] = (*hand[:-1], hashlib.sha256(hand[-1].encode()).hexdigest())
    assert got == want and len(want) > 10


def test_a_conversation_that_loses_all_rows(spark):
    rows = [(c, t, "user", "a.") for c in range(400) for t in range(1)]
    gone = {c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0}
    left = {r["conv_id"] for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).select("conv_id").distinct().collect()}
    assert gone and left == set(range(400)) - gone
    nulls = queries.damaged(spark.createDataFrame([(None, None, None, None)], SCHEMA))
    assert zlib.crc32(b" : ") % 20 > 4 and nulls.select("role", "text").collect() == [(" ", " ")]
    assert nulls.filter(F.col("conv_id").isNull()).count() == 1
