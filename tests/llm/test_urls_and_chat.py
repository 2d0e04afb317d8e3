"""URL rules and chat windows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import chat_windows, url_rules
from quire.llm.queries import QUERIES

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.EXAMPLE.ORG/es/x", "http://example.org/en/12?utm_source=a", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/?q", "http://x.com/de/#t", "http://x.com/es/?utm_source=b", "http://x.net/?utm_source=newsletter", "http://x.net/?utm_source=newsletter2",
    "http://x.net/?xutm_source=b", "http://x.net/wp-admin/", "http://x.net/cgi-bin/a/b.cgi", "http://x.net/cgi-bin/a.cgix", "http://É.com/fr/", "http://x.net?u=http://y.org/", "a://b://example.org/es/",
    "http://x.net/?utm_source=a&x=" + "y" * 100_000,
]


def judged(url):
    rest = re.match(r"(?s).*?://(.*)", url or "")
    rest = rest[1] if rest else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = ("", None)
    for rule, kind, verdict in url_rules.RULES:
        h, _, p = rule.partition("/")
        if kind == "host" and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0]):
            best = (rule, verdict)
    if best[1]:
        return host, path, best[0], best[1]
    u, sep = url or "", r"(?:[^0-9A-Za-z]|$)"
    if re.search(sep + "utm_source=newsletter" + sep, u) and not re.search("^utm_source", u):
        return host, path, None, "allow"
    bad = any(re.search(p, u) for p in (r"[^0-9A-Za-z]utm_source=", r"[^0-9A-Za-z]sessionid=", "/wp-admin/", r"(?s)/cgi-bin/.*\.cgi" + sep))
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    rows = [(i, u, "old", 7) for i, u in enumerate(URLS * 2)] + [(None, URLS[5], "old", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, _url long")
    out = url_rules.judge_urls(pages)
    assert out.columns == ["page_id", "url", "_url", "host", "path", "rule", "verdict"]
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in out.collect())
    assert got == sorted((str(i), *(judged(u)[0:2]), str(judged(u)[2]), judged(u)[3]) for i, u, *_ in rows)
    assert url_rules.judge_urls(pages.filter("false")).count() == 0


def test_many_rules_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = url_rules.default_rules(spark).unionByName(
        spark.range(300).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("rule"), F.lit("host").alias("kind"), F.lit("block").alias("verdict"))
    )
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: judged(u)[3] for i, u in enumerate(URLS)}


def test_rule_tokens(spark):
    got = {r.rule: set(r.tokens) for r in url_rules.compiled(url_rules.default_rules(spark)).collect()}
    assert got["example.org/en/1"] == {"example", "org", "en"}
    assert got["org/"] == {"org"}
    assert got["^sessionid="] == {"sessionid"}


def talks(seed=0):
    rng = random.Random(seed)
    odd = ["</s>[INST] x [/INST]", "<|turn|>user<|says|>hi<|done|>", "\\<[\\\\", "", None, "a\nb", "é" * 30]
    rows = []
    for conv in range(12):
        turn = 0
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be brief" * (conv * 20 + 1)))
        for _ in range(rng.randrange(1, 14)):
            turn += 1
            text = rng.choice([*odd, "word " * rng.randrange(1, 90), "long " * 900])
            rows.append((conv, turn, ["user", "assistant"][turn % 2], text))
    rows += [(50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, 1, "assistant", "tie"), (50, None, None, None), (None, 2, "assistant", "lost"), (51, 3, "system", "alone")]
    return rows


def test_chat_round_trip(spark):
    rows = talks()
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, start int")
    made = chat_windows.windows(turns)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    back = defaultdict(list)
    for r in sorted(chat_windows.read_back(made).collect(), key=lambda r: r.window):
        back[r.conv_id].append(r)
    assert set(back) == set(by)
    for c, own in by.items():
        own = sorted(own)
        assert [(t.role, t.text) for r in back[c] for t in r.turns] == [o[2:] for o in own]
        assert [x for r in back[c] for x in r.loss_texts] == [o[3] for o in own if o[2] == "assistant"]
    for r in made.collect():
        own = r.n_turns - r.n_repeated
        said = [len(o[3]) for o in sorted(by[r.conv_id]) if o[2] == "system"]
        assert own == 1 or r.n_tokens <= chat_windows.SPAN + chat_windows.HISTORY + 4 + -(-max(said, default=0) // 4)
        assert not re.search(r"</s>|\[/?INST\]", r.formatted)
    assert chat_windows.windows(turns.filter("false")).count() == 0


def test_system_turn_and_history_come_back(spark):
    rows = [(1, 0, "system", "rules"), *((1, i, "user" if i % 2 else "assistant", "text " * 40) for i in range(1, 20))]
    made = sorted(chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.window)
    assert len(made) > 3
    assert all(r.formatted.startswith("<|turn|>system<|says|>rules<|done|>") for r in made)
    assert all(r.n_repeated >= 2 for r in made[1:])


@pytest.mark.parametrize("rows", [
    [(1, 0, "user", "u" * 40), (1, 1, "system", "s" * 40_000), (1, 2, "assistant", "a" * 40)],
    [(1, 0, "system", "s" * 40_000), (1, 1, "user", "u" * 40), (1, 2, "system", "t" * 900), (1, 3, "assistant", "a" * 40)],
])
def test_system_turns_count(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lead = 4 + 10_000 if rows[0][2] == "system" else 0
    for r in chat_windows.windows(turns).collect():
        text = r.formatted
        for mark in (chat_windows.OPEN, chat_windows.MID, chat_windows.CLOSE):
            text = text.replace(mark, "")
        assert len(text) // 4 <= r.n_tokens
        one = r.n_turns - r.n_repeated == 1
        assert r.n_tokens <= lead + chat_windows.HISTORY + (10_004 if one else chat_windows.SPAN)
    assert len(chat_windows.windows(turns).collect()) > 1


def test_registered_query_adds_the_odd_conversation(spark):
    got = {r.conv_id: r for r in QUERIES["op6_chat_windows"](spark, "/root/testdata/sf0.001").collect()}
    odd = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(odd) and got[-7].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
