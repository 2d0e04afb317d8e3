"""Quality classifier, language kernel, secret links and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import EXTRA, EXTRA_ROW, corpus, frame, near_classes, tokens

import corpus_pipeline
from quire.llm import language_kernel, quality_pu, secret_links, source_mix
from quire.llm.common import fold
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_quality_on_held_out_labels(spark):
    rows = QUERIES["op1_quality_pu"](spark, SF).join(table(spark, "labels"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(out) > 50
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert np.mean([r.predicted for r in out if r.quality == 1]) > 0.99


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality_pu.from_labels(docs, labels)
    assert 0.5 < model["prior"] <= 0.98
    rows = corpus(30)
    a = {str(r.doc_id) + str(r.score) for r in quality_pu.score(frame(spark, rows), model).collect()}
    b = {str(r.doc_id) + str(r.score) for r in quality_pu.score(frame(spark, [(r[0], r[1], "xx", "yy", 0) for r in rows], extra=False).repartition(3), model).collect()}
    assert a == b
    scores = quality_pu.score(frame(spark, rows), model).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    kept = quality_pu.good_rows(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == sum(r.score >= quality_pu.LEAST for r in scores)
    again = quality_pu.from_labels(docs.repartition(5), labels)
    assert np.array_equal(again["weights"], model["weights"])


def test_quality_without_samples(spark):
    docs = frame(spark, corpus(5))
    labels = table(spark, "labels").filter("false")
    assert quality_pu.from_labels(docs, labels) is None
    assert {r.score for r in quality_pu.score(docs, None).collect()} == {0.5}
    assert quality_pu.score(docs.filter("false"), None).count() == 0
    assert quality_pu.good_rows(docs.filter("false"), None).count() == 0


def test_nonnegative_risk_and_prior():
    rng = np.random.default_rng(0)
    one = lambda n, at: np.hstack([rng.normal(at, 1, (n, 2)), np.ones((n, 1))])
    p, u = one(3000, 2), np.vstack([one(3500, 2), one(1500, -2)])
    prior = quality_pu.estimate_prior(p, rng.permutation(u))
    assert prior == pytest.approx(0.7, abs=0.06)
    w = quality_pu.fit_nnpu(p, u, prior)
    assert ((one(500, 2) @ w) > 0).mean() > 0.97 and ((one(500, -2) @ w) > 0).mean() < 0.06


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op8_language_kernel"](spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = table(spark, "documents")
    model = language_kernel.fit(language_kernel.sample(docs, fold(3) != 1))
    rows = [(1, None), (2, ""), (3, " 12 !"), (4, "é"), (5, docs.first().text * 40), (5, "x"), (None, "the of and " * 9)]
    made = spark.createDataFrame([(*r, "zz", "s", 1, *EXTRA_ROW) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    got = language_kernel.identify(made, model).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3}
    assert language_kernel.identify(made.filter("false"), model).count() == 0
    nothing = language_kernel.fit(language_kernel.sample(made.filter("false"), fold(3) != 1))
    assert {r.lang_pred for r in language_kernel.identify(made, nothing).collect()} == {"und"}


def test_kernel_scores_equal_the_product_of_three_matrices():
    texts = ["abc abd", "xyz xyw", "abcx", ""]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    bits = language_kernel.presence(data, offsets)
    grams = [{t.encode()[i : i + k] for k in range(1, 6) for i in range(len(t) - k + 1)} for t in texts]
    assert [int(b) for b in bits.sum(axis=1)] == [len(g) for g in grams]
    kernel = language_kernel.normalised(bits) @ language_kernel.normalised(bits).T
    for i, a in enumerate(grams):
        for j, b in enumerate(grams):
            assert kernel[i, j] == pytest.approx(len(a & b) / max(1, len(a) * len(b)) ** 0.5, abs=1e-6)


KEY = "AKIA" + "ABCD1234" * 2
SECRETS = [
    ("plain words only", ""),
    (None, ""),
    ("", ""),
    ("password = hunter22 and Token:'abc'", "assign:0:19"),
    ("ſecret=abcdefgh PASSWD: \"abcdefgh\"", "assign:16:33"),
    (f"id {KEY} here", "access:3:23"),
    ("x" * 10 + " " + "0a" * 12 + " " + "0a" * 11, "hex:11:35"),
    ("login=alice http://db.example.org", ""),
    ("login=alice password=abcdef1 http://db.example.org", "name:0:11,assign:12:28,endpoint:29:50"),
    ("login=alice " + "x " * 200 + "password=abcdef1", "assign:412:428"),
    ("user=bob 10.0.0.1:80 Zx9Qw8Er7Ty6Ui5Op4As", "name:0:8,endpoint:9:20,entropy:21:41"),
    ("10.0.0.1 Zx9Qw8Er7Ty6Ui5Op4As", ""),
    ("user=bob 9fK2LmQ8ZpTr4XwB https://h.example/x?token=abcdef1", "name:0:8,entropy:9:25,endpoint:26:59,assign:46:59"),
    ("token=Zx9Qw8Er7Ty6Ui5Op4As user=bob", "assign:0:26,name:27:35"),
    ("é" * 50_000 + " secret=zzzzzzz", "assign:50001:50015"),
]


def weak_by_hand(text, strong):
    """Names, mixed strings of high entropy and endpoints, but for those wholly inside a strong span."""
    found = []
    for m in re.finditer(r"(?i:user|username|login|account|clientid|client_id|accesskeyid|accesskey_id|access_keyid|access_key_id)([\"']?) *[:=] *([\"']?)[A-Za-z0-9@._-]{3,}", text):
        if m.start() == 0 or not re.match("[A-Za-z0-9_]", text[m.start() - 1]):
            found.append(("name", m.start(), m.end()))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        s = m[0]
        p = [s.count(c) / len(s) for c in set(s)]
        if len(s) >= 16 and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and -sum(x * np.log2(x) for x in p) >= 3.2:
            found.append(("entropy", m.start(), m.end()))
    for m in re.finditer(r"(?<![a-z0-9+])[a-z][a-z0-9+]{1,9}://[^ \t\n\r\f\v\"'<>]+", text):
        found.append(("endpoint", m.start(), m.end()))
    for m in re.finditer(r"(?<![A-Za-z0-9_])[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{2,5})?(?![A-Za-z0-9_])", text):
        if not any(k == "endpoint" and a <= m.start() < b for k, a, b in found):
            found.append(("endpoint", m.start(), m.end()))
    return [(k, a, b) for k, a, b in found if not any(x <= a and b <= y for _, x, y in strong)]


def spans_by_hand(text):
    """Base spans from the patterns as written, then links between all parts, pair by pair."""
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in secret_links.ASSIGN.finditer(text) if len(m[2]) > 5]
    base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]
    base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
    parts = base + weak_by_hand(text, base)
    out = list(base)
    for k, a, b in parts:
        if k in secret_links.STRONG:
            continue
        met = [p for p in parts if secret_links.ROLES[p[0]] != secret_links.ROLES[k] and p[1] <= b + secret_links.SCOPE and p[2] >= a - secret_links.SCOPE]
        if any(p[0] in secret_links.STRONG for p in met) or len({secret_links.ROLES[p[0]] for p in met}) > 1:
            out.append((k, a, b))
    order = lambda s: (s[1], secret_links.KINDS.index(s[0]), s[2])
    return [",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=order)) for x in (base, out)]


def test_secrets(spark):
    rng = random.Random(2)
    bits = ["login=al ", "password=abcdef1 ", "Zx9Qw8Er7Ty6Ui5Op4As ", "http://h.org/ ", "pad " * 20, "pad " * 45, KEY + " ", "deadbeef" * 4 + " ", "\n", "é ", "1.2.3.4 "]
    rows = [(i, t) for i, (t, _) in enumerate(SECRETS)]
    rows += [(100 + i, "".join(rng.choices(bits, k=rng.randrange(1, 60)))) for i in range(60)] + [(7, SECRETS[8][0]), (None, SECRETS[8][0])]
    docs = frame(spark, [(*r, None, None, None) for r in rows])
    got = secret_links.find_secrets(docs)
    flat = got.select("doc_id", secret_links.joined("base").alias("b"), secret_links.joined("all").alias("a")).collect()
    assert sorted((str(r.doc_id), r.b, r.a) for r in flat) == sorted((str(i), *spans_by_hand(t)) for i, t in rows)
    by_id = {r.doc_id: r.a for r in flat if r.doc_id != 7}
    for i, (_, want) in enumerate(SECRETS):
        assert i == 7 or by_id[i] == want
    assert secret_links.find_secrets(docs.filter("false")).count() == 0


def test_secret_query(spark):
    text = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in QUERIES["op4_secret_links"](spark, SF).collect():
        base, every = spans_by_hand(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == every
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))


def test_pipeline_against_steps_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    score = {r.doc_id: r.score for r in quality_pu.score(docs, quality_pu.from_labels(docs, labels)).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] >= quality_pu.LEAST)
    seen, unique = set(), []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if n not in seen:
            unique.append((i, t))
        seen.add(n)
    near = [r for r, c in zip(unique, near_classes(unique)) if r[0] == c]
    items = [b" " + b" ".join(tokens(b.text)) + b" " for b in table(spark, "benchmark", sf).collect()]
    clean = {i for i, t in near if not any(x in b" " + b" ".join(tokens(t)) + b" " for x in items)}
    out = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id for r in out}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert got <= clean
    total = sum(size[i] for i in clean)
    assert abs(sum(r.taken_words for r in out) - total) <= 25
    assert all(r.taken_words <= size[r.doc_id] and r.epoch < 3 for r in out)
    docs_columns = docs.columns
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == docs_columns
    assert {r.doc_id for r in rows.select("doc_id").collect()} == clean


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty and blank texts, repeats, a text of 30,000 words and clashing columns, stage by stage."""
    sf = "/root/testdata/sf0.001"
    start = frame(spark, corpus(30))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in rows)

    model = quality_pu.from_labels(start, table(spark, "labels", sf))
    good = stages["quality classifier"](spark, start, sf)
    scores = {r.doc_id: r.score for r in quality_pu.score(start.filter("doc_id is not null"), model).collect()}
    assert key(good.collect()) == key(r for r in start.collect() if (r.doc_id is None and model is None) or scores.get(r.doc_id, 1) >= quality_pu.LEAST)

    unique = stages["exact dedup"](spark, start, sf)
    first = {}
    for r in start.collect():
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[norm] = min(first.get(norm, 1 << 60), 1 << 60 if r.doc_id is None else r.doc_id)
    left = unique.collect()
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left) == sorted(first)
    assert {r.doc_id for r in left} == set(first.values()) and unique.columns == start.columns

    near = stages["n-gram Jaccard join"](spark, unique, sf)
    rows = sorted((r.doc_id, r.text) for r in left)
    assert {r.doc_id for r in near.collect()} == {i for (i, _), c in zip(rows, near_classes(rows)) if c == i}

    clean = stages["benchmark decontamination"](spark, near, sf)
    assert key(clean.collect()) == key(near.collect()) and clean.columns == start.columns  # none of these words is in the benchmark

    mixed = stages["mixing sources"](spark, clean, sf)
    plan = {r.doc_id: r.taken for r in source_mix.mix(clean).collect()}
    took = {}
    for r in mixed.collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken_words
    assert took == {i: n for i, n in plan.items() if n} and sum(took.values()) > 0

    empty = start.filter("false")
    for stage in stages.values():
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
