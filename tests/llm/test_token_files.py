import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabulon.llm import token_files as t

PATH = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
CODEC = t.WordCodec(PATH, 40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAéÉ́̈ \n\t\r\x0b\x85\x1c日①'sİΣσ#0_", "<|endoftext|>", "'re", "  ", "word"]), max_size=30).map("".join), max_size=4))
def test_ids_are_the_librarys(texts):
    for text, ids in zip(texts, CODEC.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_block_round_trip_checkpoints_and_damage():
    rng = np.random.default_rng(3)
    for n_docs, most in ((0, 1), (1, 1), (3, 5), (40, 30_000)):
        docs = [(None if i == 2 else i - 1, np.minimum(rng.zipf(1.3, rng.integers(1, most + 1)), 49_000).astype("<u2").tobytes()) for i in range(n_docs)]
        raw = np.frombuffer(b"".join(x for _, x in docs), "<u2")
        coder = t.Coder(t.frequencies(np.bincount(raw, minlength=1 << 16)))
        block = coder.encode(docs)
        assert coder.decode(block) == [(i, np.frombuffer(x, "<u2").astype("<u4").tobytes()) for i, x in docs]
        b = coder.parse(block)
        if len(b["checks"]) > 1:  # any part alone
            k = len(b["checks"]) - 1
            assert coder.decode_from(b, k).tolist() == raw[k * t.CHECK_STEPS * t.LANES :].tolist()
    with pytest.raises(ValueError):
        coder.decode(block[:-40] + bytes(4) + block[-36:])
    with pytest.raises(ValueError):
        t.Coder(t.frequencies(np.array([1, 2, 3]))).decode(block)
    with pytest.raises(ValueError):
        t.Coder(t.frequencies(np.array([1, 2, 0]))).encode([(1, b"\2\0")])


def expect(rows):
    """(id, start, n, crc) by order of ids, for distinct ids."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*TOK.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i * 7 % 101 - 3, " ".join(rng.choices(["the", "Of", "x1", "é"], k=i))) for i in range(101)] + [(None, "null id"), (500, None), (501, ""), (502, "word " * 200_000)]
    docs = spark.createDataFrame([(*r, 1, b"z") for r in rows], "doc_id long, text string, start long, ids binary")
    t.write_documents(docs, f"{tmp_path}/a", PATH)
    got = t.read(spark, f"{tmp_path}/a").collect()
    assert sorted(((r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got), key=lambda r: r[1]) == expect(rows)
    t.write(t.tokenize(docs.union(docs).where("doc_id < 3"), PATH), f"{tmp_path}/b", n_files=3, block_ids=5)
    twice = sorted((r.start, r.id, r.n_tokens) for r in t.read(spark, f"{tmp_path}/b").collect())
    assert [x[1] for x in twice] == sorted(x[1] for x in twice) and len(twice) == 2 * sum(r[0] is not None and r[0] < 3 for r in rows)
    assert all(a[0] + a[2] == b[0] for a, b in zip(twice, twice[1:], strict=False))
    t.write_documents(docs.limit(0), f"{tmp_path}/c", PATH)
    assert t.read(spark, f"{tmp_path}/c").count() == 0


def test_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    rows = duckdb.execute("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = QUERIES["op6_token_files"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == expect(rows)
