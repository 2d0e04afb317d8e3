"""Encoding and decoding against the tokenizers library, and the automaton against the words it was built from."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import corpus, frame
from quire.llm import queries, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return word_bpe.Vocabulary(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


ODD = [
    "Hello  World's <|endoftext|> é 12 ΣΑΣ naïve !!! 日本\x1c\x85x", "é É à́", "<|startoftext|><|endoftext|><|endof", "İstanbul ǅ ß ﬁ ſ",
    "don't DON'T !'s 'S '' '", "a b c　d​e", "\x00\x01 \x00", "1²½Ⅷ٣", "x" * 5000, "!?" * 3000, "ab" * 700 + "é" * 900, "🙂🙂 👩‍👩‍👧", "مرحبا שלום नमस्ते", "",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, library, text):
    got = ids_of(next(word_bpe.Encoder(own, None)([text])))
    assert got == library.encode(text, add_special_tokens=False).ids


def test_every_usual_character(own, library):
    encode = word_bpe.Encoder(own, None)
    for c in [*range(0x250), *range(0x2010, 0x2028)]:
        for text in (f"a{chr(c)}b", f"{chr(c)}'s", f"A {chr(c)}{chr(c)}́"):
            assert ids_of(next(encode([text]))) == library.encode(text, add_special_tokens=False).ids, hex(c)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(own, library, text):
    assert ids_of(next(word_bpe.Encoder(own, None)([text]))) == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_as_short_ones_do(own):
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choice(b"aeinrst!") for _ in range(rng.randrange(2, 33)))
        assert own._merged_long([own.inside[b] for b in word[:-1]] + [own.last[word[-1]]]) == own.merged(word)


@pytest.mark.parametrize("together", [1, 7, 1 << 14])
def test_words_merged_together(own, together):
    rng = random.Random(8)
    words = [bytes(rng.choice("aeinrsté!ü".encode()) for _ in range(rng.randrange(1, 40))) for _ in range(600)] + [b"a", b"the", b"x" * 32, b"x" * 33]
    assert [m.tolist() for m in own.merged_all(words, together)] == [own.merged(w) for w in words]
    assert own.merged_all([]) == []


def test_automaton_holds_its_words_and_no_others(own, tmp_path):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcing") for _ in range(rng.randrange(1, 9))).encode() for _ in range(4000)} | {b"\x00", b"\xff\x00"}
    held = sorted(words)[::2]
    entries = [(w, tuple(own.merged(w))) for w in held]
    data = word_bpe.compiled(entries)
    (tmp_path / "a.bin").write_bytes(data)
    lexicon = word_bpe.Lexicon(str(tmp_path / "a.bin"))
    asked = sorted(words) + [b"zzz", b"a" * 80]
    found, ids, ends = lexicon.look_up(asked)
    assert [w for w, f in zip(asked, found) if f] == held
    for i, w in enumerate(asked):
        assert list(ids[ends[i] : ends[i + 1]]) == (own.merged(w) if found[i] else [])
    futures = {}
    edges = {}
    for key, target, start, n in zip(*(np.asarray(getattr(lexicon, f)).tolist() for f in word_bpe.FIELDS[:4])):
        edges.setdefault(key // word_bpe.SYMBOLS, []).append((key % word_bpe.SYMBOLS, target, tuple(lexicon.pool[start : start + n])))
    for state, out in edges.items():
        assert futures.setdefault(tuple(sorted(out)), state) == state, "two states with one future"
    assert lexicon.states < sum(len(w) for w in held) / 2


def test_empty_automaton(tmp_path):
    (tmp_path / "e.bin").write_bytes(word_bpe.compiled([]))
    found, ids, ends = word_bpe.Lexicon(str(tmp_path / "e.bin")).look_up([b"a", b"bb"])
    assert not found.any() and not len(ids) and ends.tolist() == [0, 0, 0]


def test_pieces_of_long_texts(own, library):
    rng = random.Random(6)
    text = " ".join(rng.choice(["ab", "é́x", "don't", "!!", "<|endoftext|>"]) for _ in range(3000))
    assert "".join(word_bpe.pieces(text, 50)) == text and max(map(len, word_bpe.pieces(text, 50))) < 80
    assert "".join(word_bpe.pieces("x" * 200, 50)) == "x" * 200
    split = word_bpe.Splitter(own)
    assert [w for p in word_bpe.pieces(text.replace("<|endoftext|>", "z"), 50) for w in split.split(p)] == split.split(text.replace("<|endoftext|>", "z"))


@pytest.mark.parametrize("most", [0, 40, 1 << 16])
def test_corpus_of_odd_rows(spark, library, most):
    rows = corpus(40) + [(900 + i, t, None, None, 0) for i, t in enumerate(ODD)]
    got = word_bpe.decode(word_bpe.encode(frame(spark, rows), PATH, most), PATH)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted(((r["doc_id"], ids_of(r["ids"]), r["decoded"], r["n_tokens"]) for r in got.collect()), key=key)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False), len(ids)))
    assert have == sorted(want, key=key)
    assert word_bpe.encode(frame(spark, rows).limit(0), PATH).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_word_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
