"""Conversation structure repair: the cheapest edits that make a conversation well formed, with an audit of them.

A well formed conversation is an optional system turn and then one or more user-assistant pairs, or nothing at all. Rows
are kept, given another role or deleted, and empty turns may be inserted anywhere. One ordinary integer orders all
repairs: its high digits are the cost and its low digits, three bits for each letter from the first on, are the audit
with zeros after its end, so the smaller integer is the cheaper repair and among equals the one whose audit comes first.
The edits form a DAG over (row, state of the pattern), solved from the last row back by integer minima alone.

A conversation is solved in segments of ``SEGMENT`` rows at once. A segment becomes a matrix from the state before it to
the state after it, and the matrices of a conversation are folded from its end. Two audits of one entry and one cost never
are a prefix of each other (a longer one would hold an insertion more, which costs), so the smallest entry of each pair
of states is all that a later segment can need. Texts do not take part: a row enters the DAG as one small code, and the
edits are joined back to the rows by place. A task holds a segment's codes, or the audits of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

#: Rows solved in one piece.
SEGMENT = 512

#: Costs of the edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1

#: Audit letters by digit; zero is the padding behind the end.
LETTERS = "\0DIKR"
D, I, K, R = 1, 2, 3, 4
BITS = 3

#: States of the pattern: nothing yet, after system, after user, after assistant; where each role leads.
STATES = range(4)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: The role that an insertion or a new role takes in each state: the pattern leaves no choice.
TURN_OF = {0: "u", 1: "u", 2: "a", 3: "u"}
LEGAL = ("su", "ua", "au")

#: A row's code: 0 to 3 for the initials s, u, a and any other, +4 if truncated, 8 where it must go.
INITIALS = "sua"
MUST_GO = 8


def _before(letter: int, cost: int, rest: int, width: int) -> int:
    """The integer of an edit followed by ``rest``: costs add up, the letters move one place to the right."""
    low = rest & ((1 << width) - 1)
    return (((rest >> width) + cost) << width) + (letter << (width - BITS)) + (low >> BITS)


def _insertions(values: list, width: int) -> list:
    """Least integers where up to two turns may be inserted first; a third would lead back to a state already left."""
    first = values
    for _ in range(2):
        more = []
        for q in STATES:
            then = values[NEXT[TURN_OF[q]][q]]
            more.append(first[q] if then is None else min(x for x in (first[q], _before(I, INSERT, then, width)) if x is not None))
        values = more
    return values


def _letters(value: int, width: int) -> tuple[int, str]:
    low = value & ((1 << width) - 1)
    digits = [(low >> shift) & 7 for shift in range(width - BITS, -1, -BITS)]
    return value >> width, "".join(LETTERS[d] for d in digits if d)


@lru_cache(maxsize=4096)
def segment_matrix(codes: bytes) -> tuple[tuple[int, str] | None, ...]:
    """(cost, audit) from each state before a run of rows to each state after it, 16 entries by rows; None: no way."""
    width = BITS * 3 * max(1, len(codes))
    columns = []
    for end in STATES:
        values = [0 if q == end else None for q in STATES]
        for code in reversed(codes):
            after, initial, extra = values, INITIALS[code & 3] if (code & 3) < 3 else "", LEFT_TRUNCATED if code & 4 else 0
            values = []
            for q in STATES:
                ways = [(D, DELETE, after[q])]
                if code != MUST_GO:
                    ways.append((R, REROLE + extra, after[NEXT[TURN_OF[q]][q]]))
                    if q in NEXT.get(initial, {}):
                        ways.append((K, KEEP + extra, after[NEXT[initial][q]]))
                values.append(min((_before(letter, cost, rest, width) for letter, cost, rest in ways if rest is not None), default=None))
            values = _insertions(values, width)
        columns.append([None if v is None else _letters(v, width) for v in values])
    return tuple(columns[end][q] for q in STATES for end in STATES)


def _tail() -> list[tuple[int, str]]:
    """(cost, audit) behind the last row, by state."""
    width = BITS * 2
    return [_letters(v, width) for v in _insertions([0 if q in ENDS else None for q in STATES], width)]


class _Chain:
    """An audit kept as a piece and the chain behind it, so that long conversations are not copied at every segment."""

    __slots__ = ("piece", "rest")

    def __init__(self, piece: str, rest: _Chain | None):
        self.piece, self.rest = piece, rest

    def __lt__(self, other: _Chain) -> bool:
        a, b, x, y = self, other, 0, 0
        while a is not None and b is not None:
            if a is b and x == y:
                return False
            n = min(len(a.piece) - x, len(b.piece) - y)
            if a.piece[x : x + n] != b.piece[y : y + n]:
                return a.piece[x : x + n] < b.piece[y : y + n]
            x, y = x + n, y + n
            while a is not None and x == len(a.piece):
                a, x = a.rest, 0
            while b is not None and y == len(b.piece):
                b, y = b.rest, 0
        return a is None and b is not None


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"illegal": [], "costs": [], "audits": [], "initials": []}
        for codes, initials in zip(batch.column("codes").to_pylist(), batch.column("initials").to_pylist()):
            matrix = segment_matrix(bytes(codes))
            out["illegal"].append(sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1)))
            out["costs"].append([-1 if m is None else m[0] for m in matrix])
            out["audits"].append(["" if m is None else m[1] for m in matrix])
            out["initials"].append(initials)
        keys = [batch.column(c) for c in ("no_conv", "conv", "seg", "first")]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=["no_conv", "conv", "seg", "first", *out])


EDIT = pa.struct([("rid", pa.int64()), ("edit", pa.string()), ("role", pa.string())])
FOLDED = [
    ("seg", pa.int64()), ("edits", pa.list_(EDIT)), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
]


def _edits(piece: str, state: int, first: int, initials: str) -> tuple[list[dict], int]:
    """The edits of a piece with the roles that they give; kept rows show their own."""
    out, at = [], 0
    for letter in piece:
        if letter in "IR":
            turn = TURN_OF[state]
            out.append({"rid": first + at, "edit": letter, "role": ROLES[turn]})
            state = NEXT[turn][state]
        else:
            out.append({"rid": first + at, "edit": letter, "role": None})
            if letter == "K":
                state = NEXT[initials[at]][state]
        at += letter != "I"
    return out, state


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation, its last segment first; a row per segment goes out, the first with the totals."""
    key, values, illegal, follower, kept = None, [], 0, "", []

    def close():
        cost, chain = values[0]
        pieces, state, node = [], 0, chain
        rows = {name: [] for name, _ in FOLDED}
        for seg, first, initials in reversed(kept):
            edits, state = _edits(node.piece, state, first, initials)
            pieces.append(node.piece)
            rows["seg"].append(seg)
            rows["edits"].append(edits)
            node = node.rest
        last, _ = _edits(node.piece, state, kept[0][1] + len(kept[0][2]), "")
        pieces.append(node.piece)
        rows["edits"][-1] += last
        rows["audit"] = ["".join(pieces)] + [None] * (len(kept) - 1)
        rows["cost"] = [cost] + [None] * (len(kept) - 1)
        rows["illegal"] = [illegal] + [None] * (len(kept) - 1)
        return rows

    def batch_of(done, keys, schema):
        columns = [pa.array([k[i] for k, d in zip(keys, done) for _ in d["seg"]], schema.field(name).type) for i, name in enumerate(("no_conv", "conv"))]
        columns += [pa.array([x for d in done for x in d[name]], t) for name, t in FOLDED]
        return pa.RecordBatch.from_arrays(columns, names=["no_conv", "conv", *(name for name, _ in FOLDED)])

    schema = None
    for batch in batches:
        schema, done, keys = batch.schema, [], []
        columns = [batch.column(c).to_pylist() for c in ("no_conv", "conv", "seg", "first", "illegal", "costs", "audits", "initials")]
        for no_conv, conv, seg, first, bad, costs, audits, initials in zip(*columns):
            if (no_conv, conv) != key:
                if key is not None:
                    done.append(close())
                    keys.append(key)
                key, illegal, follower, kept = (no_conv, conv), 0, "", []
                values = [(cost, _Chain(audit, None)) for cost, audit in _tail()]
            illegal += bad + (bool(follower) and initials[-1] + follower not in LEGAL)
            follower = initials[0]
            kept.append((seg, first, initials))
            values = [
                min((costs[4 * q + e] + values[e][0], _Chain(audits[4 * q + e], values[e][1])) for e in STATES if costs[4 * q + e] >= 0)
                for q in STATES
            ]
        if done:
            yield batch_of(done, keys, schema)
    if key is not None:
        yield batch_of([close()], [key], schema)


def laid_out(turns: DataFrame) -> DataFrame:
    """``turns`` in order: no_conv, conv, rid, turn, role, text, said, initial, blank, truncated.

    Rows are range-partitioned and sorted by conversation, turn (null first), role and text, and numbered as they are
    written, so ``rid`` rises along a conversation and texts are sorted once. Null roles and texts are read as one space;
    rows without conv_id form one conversation.
    """
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"), "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = ["no_conv", "conv", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    return written(
        rows.select(
            "*", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("said"),
            F.when(initial.isin(*INITIALS), initial).otherwise("-").alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        ),
        "turns",
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows laid out, without their texts: no_conv, conv, rid, turn, initial, fault (blank, duplicate, truncated or null).

    A row's first fault counts; a duplicate repeats role and text of any earlier row of its conversation.
    """
    # Only what is said more than once goes back to the rows: a table of its own, so that one said very often is split.
    again = rows.groupBy("no_conv", "conv", "said").agg(F.min("rid").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    rows = rows.select("no_conv", "conv", "rid", "turn", "initial", "said", "blank", "truncated").join(written(again, "said-again"), ["no_conv", "conv", "said"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("rid") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    return rows.select("no_conv", "conv", "rid", "turn", "initial", fault.alias("fault"))


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and a report of ``turns`` (conv_id, turn, role, text).

    Repaired: conv_id, seg, place (order within a conversation: seg, then place), edit (K, R or I), role, text.
    Report, a row per conversation: conv_id, gaps (turn numbers missing between the least and the greatest; null turns
    are not counted), blank, duplicate, truncated (rows by first fault), illegal (neighbours whose initials are not su, ua
    or au), cost, audit. Roles go by their initials s, u and a; a row of another role, an empty one included, can only
    be given a new role or deleted. Order and nulls are as in ``laid_out``, repeated rows are duplicates; an empty table
    gives two empty ones. Columns other than the four are not read. Texts are only joined back by row, so their length
    does not matter here; the audit of a conversation is one value, a letter or little more for each of its rows.
    """
    rows = laid_out(turns)
    key = ["no_conv", "conv"]
    narrow = written(faults(rows), "faults")
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(
        F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3) + F.when(F.col("fault") == "truncated", 4).otherwise(0)
    )
    # A conversation has neighbouring numbers within a partition, so a segment is what it has of a run of them.
    coded = narrow.select(*key, "rid", F.expr(f"rid div {segment}").alias("seg"), "initial", code.alias("code"))
    whole = coded.groupBy(*key, "seg").agg(F.sort_array(F.collect_list(F.struct("rid", "code", "initial"))).alias("r"))
    whole = whole.select(*key, "seg", F.array_min("r.rid").alias("first"), F.col("r.code").alias("codes"), F.array_join("r.initial", "").alias("initials"))
    kind = rows.schema["conv"].dataType.simpleString()
    head = f"no_conv boolean, conv {kind}, seg long"
    solved = whole.mapInArrow(_solve, f"{head}, first long, illegal long, costs array<long>, audits array<string>, initials string")
    # One row for up to SEGMENT turns; a conversation is folded by one task, which holds its audits alone.
    solved = solved.repartition(*key).sortWithinPartitions(*key, F.desc("seg"))
    folded = solved.mapInArrow(_fold, f"{head}, edits array<struct<rid:long,edit:string,role:string>>, audit string, cost long, illegal long")
    folded = written(folded, "repair")
    edits = folded.select(*key, "seg", F.posexplode("edits").alias("place", "e")).select(*key, "seg", "place", "e.rid", "e.edit", F.col("e.role").alias("new_role"))
    kept = edits.filter("edit in ('K', 'R')").join(rows.select("rid", "role", "text"), "rid")
    kept = kept.select(*key, "seg", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    put_in = edits.filter("edit = 'I'").select(*key, "seg", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    conv_id = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    repaired = kept.unionByName(put_in).select(conv_id, "seg", "place", "edit", "role", "text")
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1))
    turn = F.col("turn")
    by_turn = narrow.groupBy(*key, "turn").agg(*(count(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    totals = by_turn.groupBy(*key).agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).cast("long").alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    ends = folded.filter("audit is not null").select(*key, "illegal", "cost", "audit")
    report = totals.join(ends, key).select(conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return repaired, report


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, running, schema, done = None, None, None, []

    def batch_of(rows):
        kinds = [schema.field("no_conv").type, schema.field("conv").type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["no_conv", "conv", "sha256"])

    for batch in batches:
        schema, done = batch.schema, []
        for no_conv, conv, line in zip(*(batch.column(c).to_pylist() for c in ("no_conv", "conv", "line"))):
            if (no_conv, conv) != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (no_conv, conv), hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(line.encode())
        if done:
            yield batch_of(done)
    if key is not None:
        yield batch_of([(*key, running.hexdigest())])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of a conversation's repaired ``role:text`` lines; read as a stream, so no conversation is held whole."""
    kind = repaired.schema["conv_id"].dataType
    lines = repaired.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"), "seg", "place",
        F.concat("role", F.lit(":"), "text").alias("line"),
    )
    lines = lines.repartition("no_conv", "conv").sortWithinPartitions("no_conv", "conv", "seg", "place").select("no_conv", "conv", "line")
    out = lines.mapInArrow(_digests, f"no_conv boolean, conv {kind.simpleString()}, sha256 string")
    return out.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "sha256")
