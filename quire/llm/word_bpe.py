"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus (at most ``LEXICON``; their counts cover all texts) are compiled into one automaton whose
edges carry token ids: ids move towards the start as far as words agree, and states with equal futures are one state, so
prefixes and suffixes are both shared. The automaton is a flat file in the shared folder that Spark hands to every
executor, where its tasks map it into memory and run all new words of a batch through it at once. A word that it does not
hold is merged exactly. The lexicon decides only how a word gets its ids, never which.

Texts are read as the vocabulary file says: its special tokens stand for themselves, the rest is brought to its normal
form and cut into words. Characters up to U+024F are normalised and cut here; texts with others go through the file's own
normaliser and splitter, so that the Unicode version is theirs.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty
from quire.llm.kernel import spread
from quire.session import fresh_folder, written

#: Most words in the lexicon, and the longest of them in bytes.
LEXICON, LONGEST = 1 << 16, 64
#: Words whose ids (or counts) a task keeps at hand, and characters of text worked on at once.
AT_HAND, PIECE = 1 << 18, 1 << 20

#: Fixed values of the vocabulary format: its word pattern and the mark of a word's last symbol.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Rank of a pair that is not joined.
NO_RANK = 1 << 40
#: Characters that need no composing and whose lower case and class no Unicode version changes.
UNUSUAL = re.compile("[^\x00-ɏ‐-‧]")


def byte_symbols() -> list[str]:
    """The character by which the vocabulary writes each byte: itself if printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a vocabulary file (its text)."""

    def __init__(self, text: str):
        file = json.loads(text)
        ids, merges = file["model"]["vocab"], file["model"]["merges"]
        self.text = text
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.symbols = byte_symbols()
        self.inside = [ids[s] for s in self.symbols]
        self.last = [ids[s + WORD_END] for s in self.symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        flat = np.array([(a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items()], dtype=np.int64).reshape(-1, 3)
        self.pairs, self.ranks, _ = flat[np.argsort(flat[:, 0])].T
        self.joined = np.zeros(len(merges) + 1, dtype=np.int32)
        self.joined[flat[:, 1]] = flat[:, 2]

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of the lowest rank is joined, the leftmost first, until none is left."""
        ids = [self.inside[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > 32:
            return self._merged_long(ids)
        while len(ids) > 1:
            ranks = [self.merges.get(p, (math.inf, 0))[0] for p in zip(ids, ids[1:])]
            least = min(ranks)
            if least == math.inf:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def merged_all(self, words: Sequence[bytes], together: int = 1 << 14) -> list[np.ndarray]:
        """``merged`` of many words at once: in each round every word joins its pair of the lowest rank."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        out: list = [None] * len(words)
        for i in np.flatnonzero(lens > 32).tolist():
            out[i] = np.array(self.merged(words[i]), dtype="<u4")
        short = np.flatnonzero(lens <= 32)
        short = short[np.argsort(lens[short], kind="stable")]
        inside, last = np.array(self.inside, dtype=np.int32), np.array(self.last, dtype=np.int32)
        for k in range(0, len(short), together):
            which = short[k : k + together]
            n, width = lens[which], int(lens[which[-1]])
            place = np.arange(width)
            ids = np.full((len(which), width), -1, dtype=np.int32)
            ids[place < n[:, None]] = inside[np.frombuffer(b"".join(words[i] for i in which.tolist()), dtype=np.uint8)]
            ids[np.arange(len(which)), n - 1] = last[[words[i][-1] for i in which.tolist()]]
            rank = self._ranks(ids[:, :-1], ids[:, 1:])
            while len(which):
                row = np.arange(len(which))
                at = rank.argmin(axis=1) if width > 1 else np.zeros(len(which), dtype=np.int64)
                least = rank[row, at] if width > 1 else np.full(len(which), NO_RANK)
                for j in np.flatnonzero(least == NO_RANK).tolist():
                    out[which[j]] = ids[j, : n[j]].astype("<u4")
                go = least < NO_RANK
                which, n, ids, rank, at, least = which[go], n[go] - 1, ids[go], rank[go], at[go], least[go]
                row = row[: len(which)]
                ids = np.take_along_axis(ids, np.minimum(place + (place > at[:, None]), width - 1), axis=1)
                ids[row, n] = -1
                ids[row, at] = self.joined[least]
                pair = place[:-1]
                rank = np.take_along_axis(rank, np.minimum(pair + (pair >= at[:, None]), max(width - 2, 0)), axis=1)
                rank[row, n - 1] = NO_RANK
                for left in (at - 1, at):
                    some = np.flatnonzero((left >= 0) & (left + 1 < n))
                    rank[some, left[some]] = self._ranks(ids[some, left[some]], ids[some, left[some] + 1])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(left.shape, NO_RANK)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0), self.ranks[at], NO_RANK)

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n = len(ids)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(a: int, b: int) -> None:
            found = self.merges.get((ids[a], ids[b]))
            if found:
                heapq.heappush(heap, (found[0], a, b, ids[a], ids[b], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, x, y, new = heapq.heappop(heap)
            if ids[a] != x or ids[b] != y or right[a] != b:
                continue
            ids[a], ids[b], right[a] = new, -1, right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [i for i in ids if i >= 0]


class Splitter:
    """Words and special tokens of texts, as the vocabulary file reads them."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.special = vocabulary.special
        # The longest of the special tokens that begin at a place counts.
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.words = regex.compile(WORDS).findall
        self.text, self.own = vocabulary.text, None
        self.bytes = {s: b for b, s in enumerate(vocabulary.symbols)}

    def __call__(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Runs of words, each with the special token behind it, if any."""
        parts = self.cut.split(text) if self.cut else [text]
        for i in range(0, len(parts), 2):
            for piece in pieces(parts[i]):
                yield self.split(piece), None
            if i + 1 < len(parts):
                yield [], self.special[parts[i + 1]]

    def split(self, piece: str) -> list[str]:
        if not UNUSUAL.search(piece):
            return self.words(piece.lower())
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_str(self.text)
        found = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(piece))
        return [bytes(map(self.bytes.__getitem__, word)).decode() for word, _ in found]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces that end before a space, over which nothing is composed and no word goes."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


# The automaton: edges sorted by (state, symbol), a symbol being a byte plus one or zero for the end of the word.

SYMBOLS = 257
FIELDS = ("keys", "targets", "starts", "lengths", "pool")


def compiled(entries: Sequence[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of ``entries`` (word, ids): minimal for outputs given as early as possible. State 0 accepts."""
    entries = sorted(entries)
    states: dict[tuple, int] = {(): 0}
    pool: dict[tuple[int, ...], int] = {}
    flat: list[int] = []

    def agreed(lo: int, hi: int, given: int) -> int:
        """How many ids from ``given`` on all entries of the range share."""
        first, n = entries[lo][1], len(entries[lo][1])
        for k in range(lo + 1, hi):
            ids, i = entries[k][1], given
            n = min(n, len(ids))
            while i < n and ids[i] == first[i]:
                i += 1
            n = i
            if n == given:
                break
        return n - given

    def state(lo: int, hi: int, depth: int, given: int) -> int:
        edges = []
        while lo < hi:
            word, ids = entries[lo]
            if len(word) == depth:
                edges.append((0, ids[given:], 0))
                lo += 1
                continue
            end = lo + 1
            while end < hi and entries[end][0][depth] == word[depth]:
                end += 1
            n = agreed(lo, end, given)
            edges.append((word[depth] + 1, ids[given : given + n], state(lo, end, depth + 1, given + n)))
            lo = end
        return states.setdefault(tuple(edges), len(states))

    root = state(0, len(entries), 0, 0) if entries else 0
    rows = []
    for edges, name in states.items():
        for symbol, ids, target in edges:
            if ids and ids not in pool:
                pool[ids] = len(flat)
                flat.extend(ids)
            rows.append((name * SYMBOLS + symbol, target, pool.get(ids, 0), len(ids)))
    rows.sort()
    columns = [np.array([r[k] for r in rows], dtype=np.int64) for k in range(4)] + [np.array(flat, dtype=np.int64)]
    head = np.array([root, len(states), *(len(c) for c in columns)], dtype=np.int64)
    return head.tobytes() + b"".join(c.tobytes() for c in columns)


class Lexicon:
    """A compiled automaton, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.int64, mode="r")
        self.root, self.states, *sizes = data[: 2 + len(FIELDS)].tolist()
        at = 2 + len(FIELDS)
        for name, size in zip(FIELDS, sizes):
            setattr(self, name, data[at : at + size])
            at += size

    def look_up(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is held, the ids of those held one after another, and the offsets of each word's ids."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        first = np.cumsum(lens) - lens
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        held, ids = np.zeros(len(words), dtype=bool), np.zeros(0, dtype=np.int64)
        active = np.flatnonzero(lens <= LONGEST) if len(self.keys) else np.zeros(0, dtype=np.int64)
        at, out, step = np.full(len(active), self.root, dtype=np.int64), [], 0
        while len(active):
            done = lens[active] == step
            symbol = np.zeros(len(active), dtype=np.int64)
            symbol[~done] = data[first[active[~done]] + step].astype(np.int64) + 1
            key = at * SYMBOLS + symbol
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            told = found & (self.lengths[edge] > 0)
            out.append(np.stack([active[told], np.full(told.sum(), step), self.starts[edge[told]], self.lengths[edge[told]]]))
            held[active[found & done]] = True
            go = found & ~done
            active, at, step = active[go], self.targets[edge[go]], step + 1
        n = np.zeros(len(words), dtype=np.int64)
        if out:
            word, place, start, length = np.concatenate(out, axis=1)
            mine = held[word]
            word, place, start, length = (x[mine] for x in (word, place, start, length))
            order = np.lexsort((place, word))
            _, _, index = spread(start[order], length[order])
            ids = np.asarray(self.pool[index])
            np.add.at(n, word, length)
        return held, ids, np.concatenate([[0], np.cumsum(n)])


class Encoder:
    """Ids of texts; words at hand first, then the automaton for all new words of a batch, then exact merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon, self.split = vocabulary, lexicon, Splitter(vocabulary)
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        if self.lexicon is None:
            held = [False] * len(new)
        else:
            held, ids, ends = self.lexicon.look_up(raw)
            ids = ids.astype("<u4")
        unseen = [i for i in range(len(new)) if not held[i]]
        for i, merged in zip(unseen, self.vocabulary.merged_all([raw[i] for i in unseen])):
            self.known[new[i]] = merged.tobytes()
        for i in np.flatnonzero(held).tolist():
            self.known[new[i]] = ids[ends[i] : ends[i + 1]].tobytes()

    def __call__(self, texts: Sequence[str]) -> Iterator[bytes]:
        if len(self.known) > AT_HAND:
            self.known.clear()
        runs = [list(self.split(t)) for t in texts]
        self.learn({w for run in runs for words, _ in run for w in words})
        for run in runs:
            yield b"".join(b"".join(map(self.known.__getitem__, words)) if special is None else np.array([special], dtype="<u4").tobytes() for words, special in run)


def _groups(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``limit`` characters with their texts; one long text is a range of its own."""
    lo, size, group = 0, 0, []
    for i, text in enumerate(texts):
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= limit:
            yield lo, i + 1, group
            lo, size, group = i + 1, 0, []
    if group:
        yield lo, lo + len(group), group


def _count(batches: Iterator[pa.RecordBatch], vocabulary, longest: int) -> Iterator[pa.RecordBatch]:
    split, counts = Splitter(Vocabulary(vocabulary.value)), Counter()

    def out():
        words = [w for w in counts if len(w.encode()) <= longest]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, texts in _groups(batch.column(0)):
            for text in texts:
                for words, _ in split(text):
                    counts.update(words)
                    if len(counts) > AT_HAND:
                        yield out()
                        counts.clear()
    yield out()


def _merge(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    merged = Vocabulary(vocabulary.value).merged_all
    for batch in batches:
        words = [w.encode() for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([m.tolist() for m in merged(words)], pa.list_(pa.int32()))], names=["word", "ids"])


def frequent_words(docs: DataFrame, vocabulary, most: int = LEXICON, longest: int = LONGEST) -> DataFrame:
    """word, n: the most frequent words of all texts, at most ``most``, none that occurs once.

    The least count is read off a table of counts by eighths of powers of two (a few hundred rows), so no task and not
    the driver sorts the words.
    """
    texts = docs.select(text_or_empty("text").alias("text"))
    counted = texts.mapInArrow(lambda b: _count(b, vocabulary, longest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.filter("n > 1").withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "words")
    levels, total, least = sorted(counted.groupBy("level").count().collect(), reverse=True), 0, math.inf
    for level, words in levels:
        total += words
        if total > most:
            break
        least = level
    return counted.filter(F.col("level") >= (least if least < math.inf else 1 << 30)).select("word", "n")


def build_lexicon(docs: DataFrame, vocabulary, most: int = LEXICON, longest: int = LONGEST) -> str:
    """Compiles the frequent words, writes the automaton to the shared folder, gives it to all executors; its name."""
    spark = docs.sparkSession
    rows = frequent_words(docs, vocabulary, most, longest).select("word").mapInArrow(lambda b: _merge(b, vocabulary), "word binary, ids array<int>").collect()
    return shared_file(spark, compiled([(bytes(r["word"]), tuple(r["ids"])) for r in rows]))


def shared_file(spark: SparkSession, data: bytes) -> str:
    sc = spark.sparkContext
    path = f"{fresh_folder(spark, 'lexicon')}.bin"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    sc.addFile(path)
    return path.rsplit("/", 1)[1]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary, name: str) -> Iterator[pa.RecordBatch]:
    encode = Encoder(Vocabulary(vocabulary.value), Lexicon(SparkFiles.get(name)))
    for batch in batches:
        for lo, hi, texts in _groups(batch.column(1)):
            ids = list(encode(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )


def _decode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known = Vocabulary(vocabulary.value).tokens
    tokens = np.array([known.get(i, "") for i in range(max(known) + 1)], dtype=object)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [" ".join(tokens[np.frombuffer(b.as_buffer(), dtype="<u4")].tolist()) if b.is_valid and len(b.as_buffer()) else "" for b in part.column(at)]
            yield part.append_column("decoded", pa.array(texts, pa.string()))


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (under 2 MB, whatever the corpus), read once and sent to every executor."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, most: int = LEXICON, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers): a row per row of ``docs``.

    ``path`` names a vocabulary file of the word-end kind on the driver. Null and empty texts have no ids, special
    tokens in a text stand for themselves, repeated rows give repeated rows, doc_id may be null, and an empty table
    gives an empty result. A long text is cut at spaces into pieces of about ``PIECE`` characters, and a word without
    any space is merged in time n log n, so only its ids are held whole. Columns but doc_id and text are not read.
    """
    vocabulary = shared_vocabulary(docs.sparkSession, path)
    name = build_lexicon(docs, vocabulary, most, longest)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(lambda b: _encode(b, vocabulary, name), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``: the tokens, special ones too, joined by one space. Null ids decode to ''."""
    vocabulary = shared_vocabulary(encoded.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda b: _decode(b, vocabulary), f"{schema}, decoded string")
