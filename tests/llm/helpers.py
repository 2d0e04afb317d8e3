"""Small corpora and step-by-step versions that the operators are held against."""

import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "rid long, id long, name string, level int, size long, digest string, key string, class string, epoch int, _id long, text_sha256 string"
EXTRA_ROW = (1, 2, "n", 3, 4, "d", "k", "c", 5, 6, "t")


def corpus(n=60, seed=0, words=None):
    """Rows of DOCS: random texts, some exact and near copies, shared passages, null, empty, blank and one long text."""
    rng = random.Random(seed)
    vocab = words or [f"w{i}" for i in range(400)]
    sentence = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = " ".join(sentence(60))
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            w = (rng.choice(texts) or "").split()
            if len(w) > 20:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(" ".join(sentence(15)) + "\n" + shared + "\t" + " ".join(sentence(20)))
        else:
            texts.append(" ".join(sentence(rng.randrange(1, 120))))
    texts += [None, "", " \n\t ", "one", "One", " ".join(sentence(30_000)), "loop " * 200, "loop " * 200, "é" * 9000]
    langs, sources = ["en", "fr", None], ["b", "a", None, "ä", "b", "b"]
    rows = [(i, t, langs[i % 3], sources[i % 6], len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[3], None, None, None), (5, texts[5], "en", "b", 1)]


def frame(spark, rows, extra=True):
    if extra:
        return spark.createDataFrame([r + EXTRA_ROW for r in rows], f"{DOCS}, {EXTRA}")
    return spark.createDataFrame(rows, DOCS)


def tokens(text):
    return re.findall(rb"[0-9a-zA-Z\x80-\xff]+", (text or "").lower().encode())


def shingle_set(text, k=5):
    w = tokens(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_classes(rows, similarity=0.8):
    """Smallest id of each row's class, links being all pairs at or above the similarity."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverse[x].append(k)
    for k, (_, s) in enumerate(sets):
        common = Counter(o for x in s for o in inverse[x] if o < k)
        for o, n in common.items():
            if n >= similarity * (len(s) + len(sets[o][1]) - n) - 1e-9:
                parent[root(k)] = root(o)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(rows))]
