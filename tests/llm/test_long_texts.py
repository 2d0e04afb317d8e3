"""Language of texts far longer than the presence vector can tell apart as a whole."""

import numpy as np
from test_models_and_secrets import SF, table

from quire.llm import language_kernel
from quire.llm.common import fold


def test_pieces_cover_the_text_with_all_its_ngrams():
    offsets = np.cumsum([0, 3, 0, language_kernel.PIECE, 3 * language_kernel.PIECE + 5])
    start, end, of = language_kernel.piece_bounds(offsets)
    assert np.bincount(of).tolist() == [1, 1, 1, 4]
    assert (start[1:][of[1:] == of[:-1]] == end[:-1][of[1:] == of[:-1]] - language_kernel.LONGEST + 1).all()
    assert [start[of == k][0] for k in range(4)] == offsets[:-1].tolist() and [end[of == k][-1] for k in range(4)] == offsets[1:].tolist()


def test_language_of_texts_of_a_megabyte_and_more(spark):
    docs = table(spark, "documents")
    model = language_kernel.fit(language_kernel.sample(docs, fold(3) != 1))
    held = {}
    for r in docs.filter(fold(3) == 1).select("lang", "text").collect():
        if r.lang and r.text:
            held.setdefault(r.lang, []).append(r.text)
    assert len(held) > 1
    rows = []
    for lang, texts in held.items():
        whole = "\n".join(texts)
        for size in (50_000, 200_000, 1_400_000):
            rows.append((f"{lang} {size}", (whole * (size // len(whole) + 1))[:size]))
    got = language_kernel.identify(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    assert all(r.doc_id.split()[0] == r.lang_pred and r.score > 0.7 for r in got), got
