import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from tabulon.llm import language as m

MODEL = P.path("piece_bpe_32k.model")


def every_segmentation(word, prob, unknown):
    if not word:
        return 1.0
    out = sum(prob[word[:n]] * every_segmentation(word[n:], prob, unknown) for n in range(1, len(word) + 1) if word[:n] in prob)
    return out + (unknown * every_segmentation(word[1:], prob, unknown) if word[0] not in prob else 0)


def test_forward_sums_every_segmentation():
    pieces = ["a", "b", "ab", "ba", "aba", m.MARK, m.MARK + "a"]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 2, 2))
    p[-1] = 0
    s = m.Scorer(m.Model(pieces, ["x", "y"], p))
    words = ["a", "abab", "bc", "cab", "aababab", "é"]
    got = s.score_words(words)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            want = every_segmentation(m.MARK + w, {x: p[i, k] for i, x in enumerate(pieces)}, p[-2, k])
            assert math.isclose(math.exp(row[k]), want, rel_tol=1e-9)


def test_training_raises_the_likelihood():
    counts = {"x": Counter({"abab": 5, "aab": 2}), "y": Counter({"bb": 4, "ba": 1})}
    pieces = ["a", "b", "ab", "bb", m.MARK]
    seen = [sum(float(m.Scorer(m.train(counts, pieces, r)).score_words([w])[0][0]) * n for w, n in counts["x"].items()) for r in (0, 1, 3)]
    assert seen[0] < seen[1] <= seen[2] + 0.2


def test_rows(spark):
    rows = [(1, None, "en", 1.5), (2, "", "en", 1.5), (3, "12 34 !?", "en", 1.5), (4, "the and of", None, 0.0), (4, "the and of", None, 0.0), (5, "der und die", "de", 0.0), (6, "the " * 100_000 + "x" * 50_000, "en", 0.0), (7, "日本語", "en", 0.0), (8, "and of the in", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = m.fit(docs, MODEL)
    got = {(r.row.doc_id, r.row.score): (r.lang_pred, r.score) for r in m.predict(docs, model).collect()}
    assert m.predict(docs, model).count() == len(rows) and m.predict(docs.limit(0), model).count() == 0
    assert [got[k][0] for k in ((1, 1.5), (2, 1.5), (3, 1.5))] == ["und"] * 3 and got[(1, 1.5)][1] == 0.0
    assert got[(4, 0.0)][0] == "en" and got[(5, 0.0)][0] == "de" and got[(6, 0.0)][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = m.fit(docs.where("lang is null"), MODEL)
    assert {r.lang_pred for r in m.predict(docs, nothing).collect()} == {"und"}


def test_query_on_the_held_out_fold(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    lang = dict(duckdb.execute("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    got = QUERIES["op7_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    # Again without arrays: the sum over segmentations by recursion from the left, words one by one.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = m.fit(docs.select("doc_id", "text", "lang"), MODEL, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    at, longest = {x: i for i, x in enumerate(model.pieces)}, max(map(len, model.pieces))
    texts = dict(duckdb.execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())

    @functools.cache
    def plain(word, k):
        word = m.MARK + word
        sums = [1.0]
        for end in range(1, len(word) + 1):
            total = 0.0
            for n in range(1, min(end, longest) + 1):
                piece = word[end - n : end]
                if piece in at:
                    total += sums[end - n] * model.p[at[piece], k]
                elif n == 1:
                    total += sums[end - 1] * model.p[-2, k]
            sums.append(total)
        return math.log(sums[-1])

    for r in sorted(got, key=lambda r: r.doc_id)[::7]:
        found = [w for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()) if any(map(str.isalpha, w))]
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = [math.fsum(plain(w, k) for w in found) for k in range(len(model.languages))]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert r.lang_pred == model.languages[best]
        assert math.isclose(r.score, 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-6)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.95 * len(held) > 0


def test_a_label_with_long_texts_only(spark):
    rows = [(i, "the and of it is in that " * 4000, "en") for i in range(3)] + [(10 + i, "der und die das ist", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.fit(docs, MODEL)
    assert model.languages == ["de", "en"]
    assert {r.row.doc_id: r.lang_pred for r in m.predict(docs, model).collect()} == {i: x for i, _, x in rows}


def test_marks_and_words_of_any_length():
    assert m.words("हिन्दी The Ñu2x") == ["हिन्दी", "the", "ñu", "x"]
    pieces = ["a", "ab", "b" * 20, m.MARK]
    p = np.array([[0.3], [0.2], [0.1], [0.3], [0.1], [0.0]])
    s = m.Scorer(m.Model(pieces, ["x"], p))
    word = ("ab" * 30 + "b" * 20) * 3
    sums = [1.0]
    for end in range(1, len(word) + 2):
        w = m.MARK + word
        sums.append(sum(sums[end - n] * (p[pieces.index(w[end - n : end]), 0] if w[end - n : end] in pieces else 0.1 if n == 1 else 0) for n in range(1, min(end, 20) + 1) if w[end - n : end] in pieces or n == 1))
    assert math.isclose(s.score_words([word])[0, 0], math.log(sums[-1]), rel_tol=1e-9)
    assert np.isfinite(s.score_words(["ab" * 100_000])).all()
