import hashlib

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import pieces as p

MODEL = P.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = p.ChunkCodec(MODEL, entries=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁\n\t\r\x00aTheé日①<s>0 ́x"), max_size=40), max_size=3))
def test_encodes_as_the_library(texts):
    import numpy as np

    ids, back = CODEC.encode(texts)
    for t, i, b in zip(texts, ids, back, strict=True):
        want = SP.encode(t)
        assert np.frombuffer(i, "<i4").tolist() == want and b == SP.decode(want)


def test_rows_round_trip_and_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    rows = [(1, None, [1]), (1, None, [1]), (2, "", []), (3, "The  end.\n", None), (4, "word " * 100_000, []), (5, "x" * 20_000, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    out = p.encode(docs, MODEL)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4, 5]
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert r.ids == SP.encode(text) and r.decoded == SP.decode(r.ids)
    assert {r.doc_id: r.text for r in p.decode(out, MODEL).collect()} == {r.doc_id: r.decoded for r in got}
    assert p.encode(docs.limit(0), MODEL).count() == 0
    texts = dict(duckdb.execute("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    for r in QUERIES["op3_sentencepiece"](spark, "/root/testdata/sf0.001").collect():
        ids = SP.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
