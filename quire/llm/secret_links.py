"""Secret scans with multipart credential linking.

Strong spans (assigned secrets, access identifiers, long hexadecimal strings) are reported wherever they stand. Weak
candidates (user and client names, high-entropy strings, endpoints) mean little alone; they are reported only where a
credential's complementary parts stand together: an identifier, a secret and an endpoint, or two of these of which one is
strong. Together is an interval join: the candidate's interval widened by the scope meets another part's interval.

Python only finds the spans of one text. The join is Spark's, on (text digest, cell of the text), so a text with any number
of parts spreads over many tasks, equal texts are joined once, and a part meets only the few that fit into its cells.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty
from quire.session import written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "name", "entropy", "endpoint")
#: What a kind is a part of.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "name": "identifier", "entropy": "secret", "endpoint": "endpoint"}
STRONG = ("assign", "access", "hex")
#: Code points by which a candidate's interval is widened, and the width of a join cell.
SCOPE, CELL = 160, 320
#: Bits a character that a string of high entropy has at least.
ENTROPY = 3.2

#: The patterns of the strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
# Weak kinds, this method's own.
NAME = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
ENTROPIC = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?<![a-z0-9+])[a-z][a-z0-9+]{1,9}://[^\s"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b""", re.A)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all parts of one text, strong and weak; weak ones that lie wholly inside a strong one are left out."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    strong = sorted((a, b) for _, a, b in found)
    weak = [(3, m.start(), m.end()) for m in NAME.finditer(text)]
    weak += [(4, m.start(), m.end()) for m in ENTROPIC.finditer(text) if _entropy(m[0]) >= ENTROPY]
    weak += [(5, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    at, reach = 0, 0
    for kind, a, b in sorted(weak, key=lambda w: w[1:]):
        while at < len(strong) and strong[at][0] <= a:
            reach = max(reach, strong[at][1])
            at += 1
        if b > reach:
            found.append((kind, a, b))
    return sorted(found, key=lambda f: (f[1], f[0], f[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        parts = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, kind)], names=["doc_id", "digest", "parts"])


def _cells(start, end):
    return F.explode(F.sequence(F.expr(f"greatest(0, {start}) div {CELL}"), F.expr(f"({end}) div {CELL}")))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """digest, kind, start, end of the weak parts that complementary parts stand near.

    ``parts`` has digest, kind, start, end. A weak part is linked if a strong part of another role is within ``scope``,
    or parts of both other roles are.
    """
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("kind") + 1)
    parts = parts.withColumn("role", role).withColumn("strong", F.col("kind") < len(STRONG))
    weak = parts.filter("not strong").select("digest", "kind", "start", "end", "role", _cells(f"start - {scope}", f"end + {scope}").alias("cell"))
    near = parts.select("digest", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("role").alias("role2"), "strong", _cells("start", "end").alias("cell"))
    met = weak.join(near, ["digest", "cell"]).filter(
        (F.col("role") != F.col("role2")) & (F.col("start2") <= F.col("end") + scope) & (F.col("end2") + scope >= F.col("start"))
    )
    sides = met.groupBy("digest", "kind", "start", "end").agg(F.max("strong").alias("strong"), (F.min("role2") != F.max("role2")).alias("both"))
    return sides.filter("strong or both").select("digest", "kind", "start", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, digest, base and all: the strong spans and these with the linked weak ones, arrays of (start, kind, end).

    One row per row of ``docs``. Offsets are code points of the whole text, ends exclusive. Null and empty texts have no
    spans; equal texts and repeated rows have equal spans; ids may be null or repeat; an empty table gives an empty
    result. Only doc_id and text are read.
    """
    rows = docs.select("doc_id", F.unhex(F.md5(text_or_empty("text"))).alias("digest"), text_or_empty("text").alias("text"))
    rows = rows.mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, parts array<struct<kind:int,start:long,end:long>>")
    rows = written(rows, "parts")
    own = F.transform(F.filter("parts", lambda p: p["kind"] < len(STRONG)), lambda p: F.struct(p["start"], p["kind"], p["end"]))
    rows = rows.withColumn("base", F.sort_array(own))
    # Only texts that hold a weak part and another can have a link; the others, empty ones among them, join nothing.
    some = F.exists("parts", lambda p: p["kind"] >= len(STRONG)) & (F.size("parts") > 1)
    once = rows.filter(some).groupBy("digest").agg(F.first("parts").alias("parts"))
    more = linked(once.select("digest", F.inline("parts")), scope)
    # A table of its own, so that the join of a text with very many copies can be split.
    more = written(more.groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")), "linked")
    everything = F.sort_array(F.concat("base", F.coalesce("more", F.filter("base", lambda _: F.lit(False)))))
    met = rows.filter(some).join(more, "digest", "left").select("doc_id", "digest", "base", everything.alias("all"))
    return met.unionByName(rows.filter(~some).select("doc_id", "digest", "base", F.col("base").alias("all")))


def joined(parts):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = F.transform(parts, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string")))
    return F.array_join(one, ",")
