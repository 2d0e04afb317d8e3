"""Steps that move their rows as seldom as the work allows, and hand Python many small groups at once."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import align as al
from quire.operators import compare as cp
from quire.operators import layout as ly
from quire.operators import structure as st
from quire.operators.ordered import grouped_batches
from quire.session import cut_lineage
from tests.test_bounded_tasks import folded, rows
from tests.test_jobs import SPAN, line


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines(spark):
    rng = random.Random(4)
    spans = [line(b, n, rng.choice(["Said a line.", "HEAD", " ", "more"]), 50 + 90 * b + 12 * n, bold=rng.random() < 0.3, page=p) for p in range(4) for b in range(5) for n in range(6)]
    return cut_lineage(ly.line_style(spark.createDataFrame(spans, SPAN)))


def test_lines_move_to_their_page_once(lines):
    """the split into headings took three shuffles and a checkpoint."""
    split = ly.split_bold_lines(lines)
    assert plan(split).count("Exchange") == 1
    by_block = {}
    for r in sorted(lines.collect(), key=lambda r: (r.page, r.block, r.line)):
        by_block.setdefault((r.page, r.block), []).append(r)
    want = set()
    for at, mine in by_block.items():
        part, before, said = None, None, False
        for r in mine:
            body = not (r.bold and r.text != "")
            if not (body and before):
                part, said = r.line, False
            before, said = body, said or r.text != ""
            if said:
                want.add((*at, r.line, part, body))
    assert {(r.page, r.block, r.line, r.part, r.kind == "p") for r in split.collect()} == want


def test_paragraphs_are_numbered_over_pages(spark, lines):
    """positions run on from page to page, and rows of the result are moved once after they are made."""
    modes = spark.createDataFrame([(1, 10.0)], "doc_id long, body_size double")
    out = ly.paragraph_groups(ly.split_bold_lines(lines), ly.heading_thresholds(modes))
    got = sorted(out.collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(len(got))) and [r.page for r in got] == sorted(r.page for r in got)
    assert "Window" not in plan(out).split("BroadcastExchange")[0]


def test_claims_have_a_task_each_for_pages_of_few_bytes(spark):
    """candidates of all pages came to a few tasks, a call a page."""
    cand = spark.createDataFrame([(d, 0, i, f"c{(d + i + k) % 5}", 10.0 * k, 10.0 * k + 9, "t") for d in range(40) for i in range(3) for k in range(3)], "doc_id long, page int, image int, cand string, y0 double, y1 double, text string")
    claim = ly._claim(2)
    pdf = cand.orderBy("doc_id", "page", "image", "y0", "cand").toPandas()
    whole = list(map(tuple, next(claim(iter([pdf]))).values.tolist()))
    cut = [tuple(r) for part in claim(iter([pdf[a : a + 7] for a in range(0, len(pdf), 7)])) for r in part.values.tolist()]
    assert cut == whole and len({(r[0], r[1], r[3]) for r in whole}) == len(whole)
    got = ly._captions(cand, 2)[1].collect()
    assert sorted((r.doc_id, r.page, r.cand) for r in got) == sorted((r[0], r[1], r[3]) for r in whole)


def test_packing_hands_over_many_segments(spark):
    """a call of a segment each, and all segments of few bytes in one task."""
    rng = random.Random(5)
    docs = {d: rows(rng, rng.choice([3, 20, 90]), 20) for d in range(60)}
    data = [(d, i, "h2" if h else "p", "x" * (4 * t)) for d, (tokens, heading) in docs.items() for i, (t, h) in enumerate(zip(tokens, heading))]
    df = spark.createDataFrame(data, "doc_id long, pos int, kind string, text string")
    out = st.pack_chunks(df, 20, seg=8)
    assert "FlatMapGroupsInPandas" not in plan(out)
    calls = spark.sparkContext.accumulator(0)

    def many(pdf, cuts):
        calls.add(1)
        return {"doc_id": pdf["doc_id"].to_numpy()[cuts[:-1]], "n": np.diff(cuts)}

    sizes = grouped_batches(df.select("doc_id", "pos"), ["doc_id"], ["pos"], many, "doc_id long, n long")
    assert "REPARTITION_BY_NUM" in plan(sizes)
    assert {r.doc_id: r.n for r in sizes.collect()} == {d: len(t) for d, (t, _) in docs.items()} and calls.value <= 8
    got = {(r.doc_id, r.pos): r.chunk for r in out.collect()}
    for d, (tokens, heading) in docs.items():
        assert [got[d, i] for i in range(len(tokens))] == folded([max(1, t) for t in tokens], heading, 20)


def test_words_are_split_once_a_side(spark):
    """F16: every edit split both texts again."""
    df = spark.createDataFrame([("a b c d", "a x c d e"), ("", "y"), (None, "z"), ("same", "same")], "a string, b string")
    out = df.select("a", "b", cp.word_diff_segments(F.col("a"), F.col("b")).alias("s"))
    assert not re.search(r"slice\(regexp_extract_all", out._jdf.queryExecution().analyzed().toString())
    for r in out.where("a is not null").collect():
        assert "".join(x.a for x in r.s) == r.a and "".join(x.b for x in r.s) == r.b


def test_table_is_the_plain_one():
    """F16: rows of the table as bits give the places that the table of numbers gave."""
    rng = np.random.default_rng(6)
    for _ in range(400):
        n, m, k = rng.integers(1, 90), rng.integers(1, 90), rng.integers(1, 30)
        a, b = rng.integers(0, k, n), rng.integers(0, k, m)
        table = np.zeros((n + 1, m + 1), dtype=int)
        for i in range(n):
            for j in range(m):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        want, i, j = [], n, m
        while i and j and table[i, j]:
            if a[i - 1] == b[j - 1]:
                want.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif table[i - 1, j] >= table[i, j - 1]:
                i -= 1
            else:
                j -= 1
        assert al._table(a, b) == want
