"""The quality features and risk, and the language kernel's fit, against plain versions."""

import re

import numpy as np
import pytest

from quire.llm import language_kernel, quality_pu
from quire.llm.kernel import U64, mix64

TEXTS = ["", "Hello World, hello!", "aaa bbb aaa aaa  CCC 123\n", "é" * 20 + " naïve averyveryverylongword.", "x", "!! ?? ..", "a b a b a b", " \t\n"]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


def features_by_hand(text):
    raw = text.encode()
    n, words = max(len(raw), 1), re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw)
    many = max(len(words), 1)
    of = lambda test: sum(map(test, raw)) / n
    upper, lower = of(lambda b: 65 <= b <= 90), of(lambda b: 97 <= b <= 122)
    alnum = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122
    shape = [
        upper, lower, of(lambda b: 48 <= b <= 57), upper / max(upper + lower, 1e-9), of(lambda b: b >= 128), np.log1p(len(raw)) / 12,
        sum(map(len, words)) / many / 12, len(set(words)) / many, sum(a == b for a, b in zip(words, words[1:])) / many,
        sum(w[-1] < 128 and not alnum(w[-1]) for w in words) / many, sum(len(w) > 14 for w in words) / many, float(not words),
    ]
    shape += [raw.count(c.encode()) / n for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\n "]
    cells = np.zeros(quality_pu.TRIGRAMS)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = int(mix64(np.array([a * 65536 + b * 256 + c], dtype=np.uint64))[0] >> U64(56))
        cells[h % quality_pu.TRIGRAMS] += 1
    return np.concatenate([shape, np.sqrt(cells / n)])


def test_features_by_hand():
    got = quality_pu.features(*packed(TEXTS))
    assert got.shape == (len(TEXTS), quality_pu.SHAPES + quality_pu.TRIGRAMS)
    for text, row in zip(TEXTS, got):
        assert row == pytest.approx(features_by_hand(text), abs=1e-6), text


def risk_parts(p, u, w, prior):
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(p @ w).mean(), loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()


@pytest.mark.parametrize("prior", [0.2, 0.95])
def test_risk_gradient_by_differences(monkeypatch, prior):
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (40, 4)), rng.normal(0, 1, (60, 4))
    held = {}
    monkeypatch.setattr(quality_pu, "_descend", lambda gradient, width: held.setdefault("g", gradient) and np.zeros(width))
    quality_pu.fit_nnpu(p, u, prior)
    seen = set()
    for _ in range(60):
        w = rng.normal(0, 2, 4)
        positive, negative = risk_parts(p, u, w, prior)
        # While the last part is negative only it counts, and it is followed upwards.
        value = (lambda v: -risk_parts(p, u, v, prior)[1]) if negative < 0 else (lambda v: sum(risk_parts(p, u, v, prior)))
        seen.add(bool(negative < 0))
        step = 1e-5
        want = [(value(w + step * e) - value(w - step * e)) / (2 * step) for e in np.eye(4)]
        assert held["g"](w) == pytest.approx(want, abs=1e-6)
    assert False in seen and (prior < 0.5 or True in seen)


def test_language_fit_by_hand(spark):
    words = {"aa": ["the", "house", "and", "green"], "bb": ["der", "haus", "und", "grün"], "cc": ["la", "casa", "verde"]}
    rng = np.random.default_rng(1)
    rows = [(lang, " ".join(rng.choice(w, 12))) for lang, w in words.items() for _ in range(15 if lang != "cc" else 5)]
    langs, weights = language_kernel.fit(spark.createDataFrame(rows, "lang string, text string"), landmarks=9, ridge=0.05)
    assert langs == ["aa", "bb", "cc"]

    grams = lambda t: language_kernel.presence(*packed([t]))[0]
    ordered = sorted((lang, np.packbits(grams(t)).tobytes(), t) for lang, t in rows)
    bits = np.array([grams(t) for _, _, t in ordered], dtype=float)
    x = bits / np.sqrt(bits.sum(axis=1, keepdims=True))
    y = np.array([langs.index(lang) for lang, *_ in ordered])
    chosen = []
    for k in range(3):
        mine = [i for i in range(len(y)) if y[i] == k]
        chosen += mine[:: max(1, len(mine) // 3)][:3]
    z = x[chosen]
    # Nyström: the map K_xz K_zz^(-1/2) on the part of K_zz that is not null, then weighted ridge regression with a constant.
    s, v = np.linalg.eigh(z @ z.T)
    keep = s > 1e-6 * s.max()
    root = v[:, keep] / np.sqrt(s[keep])
    phi = np.hstack([x @ z.T @ root, np.ones((len(x), 1))])
    each = np.array([1 / (y == k).sum() for k in y])
    each /= each.mean()
    lines = []
    for k in range(3):
        target = np.where(y == k, 1.0, -1.0)
        a = np.sqrt(each)[:, None] * phi
        # The same ridge as rows of a least-squares problem.
        extra = np.sqrt(0.05 * len(phi) / 100) * np.eye(phi.shape[1])
        lines.append(np.linalg.lstsq(np.vstack([a, extra]), np.concatenate([np.sqrt(each) * target, np.zeros(len(extra))]), rcond=None)[0])
    want = phi @ np.array(lines).T
    got = x @ weights[:-1].astype(float) + weights[-1]
    assert got == pytest.approx(want, abs=2e-3)
    scored = {r.doc_id: (r.lang_pred, r.score) for r in language_kernel.identify(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(ordered)], "doc_id long, text string"), (langs, weights)).collect()}
    for i, margin in enumerate(want):
        assert scored[i][0] == langs[int(margin.argmax())] and scored[i][1] == pytest.approx(np.clip((margin.max() + 1) / 2, 0, 1), abs=2e-3)
