import hashlib
import random

import pytest

from tabulon.llm import suffix as s


def brute(docs, length=100):
    """docs: bytes in order. Per document: (removed runs, kept)."""
    seen, out = set(), []
    for raw in docs:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def got(df, n=None):
    return {r.doc_id: (sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect()}


def texts(rng):
    words = ["the", "of", "and", "élan", "x", "thereafter", "日本"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(200)) for _ in range(n))
    shared = [say(rng.randint(5, 60)) for _ in range(8)]
    out = []
    for _ in range(90):
        out.append(" ".join(rng.choice([say(rng.randint(1, 30)), rng.choice(shared)]) for _ in range(rng.randint(1, 5))))
    out += ["ab" * 200, "be " * 120, "x" * 99, "x" * 100, "x" * 350, shared[0][:150] + "!", out[3], out[3], "", "é" * 120]
    line = say(10)[:90]
    out += [f"{say(20)}\n{line}\n{say(20)}" for _ in range(90)]  # more entries of one anchor than are compared in a run
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("batches,many", [(1, 3), (5, 64)])
def test_dedup_is_brute_force(spark, batches, many):
    docs = texts(random.Random(batches))
    df = spark.createDataFrame([(3 * i - 50, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, kept string, spans int")
    want = brute([t.encode() for t in docs])
    found = got(s.dedup(df, batches, many))
    assert found == {3 * i - 50: w for i, w in enumerate(want)}
    assert sum(w[0] for w in want) > 5000


def test_entries_hold_each_string_once():
    rng = random.Random(9)
    docs = [bytes(rng.choices(b"ab", k=n)) for n in (0, 99, 100, 101, 500, 5000)]
    of, a, n, off, h, c = s.entries(docs)
    strings = [(int(d), p) for d, x, m in zip(of, a, n, strict=True) for p in range(x, x + m)]
    assert sorted(strings) == [(d, p) for d, t in enumerate(docs) for p in range(len(t) - 99)]
    anchor = {docs[d][p : p + 100]: set() for d, p in strings}
    for d, x, m, o in zip(of, a, n, off, strict=True):
        for p in range(x, x + m):
            anchor[docs[d][p : p + 100]].add(int(x + o - p))
    assert all(len(v) == 1 for v in anchor.values())
    assert [b for _, b in s.parts(b"z" * 1000, 300)] == [b"z" * 399] * 3 + [b"z" * 100]
    assert s.parts(b"z" * 100, 300) == [(0, b"z" * 100)]


def test_nulls_repeats_long_and_empty(spark):
    rng = random.Random(3)
    a, b = "".join(rng.choices("abcdef", k=150)), "".join(rng.choices("abcdef", k=3000))
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, a), (5, b), (5, a + b[:400]), (None, b[:200]), (9, b * 400)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "doc_id long, text string, id string, sub int, h int, own int, runs int")
    out = sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.kept)) for r in s.dedup(df, 2).collect()), key=str)
    import zlib

    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want = {r: (len(r[1] or ""), w[0], len(w[2])) for r, w in zip(order, brute([(t or "").encode() for _, t in order]), strict=True)}
    assert out == sorted(((r[0], *want[r]) for r in rows), key=str)
    assert s.dedup(df.limit(0)).count() == 0


def test_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = duckdb.execute(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    want = {i: (len(t.encode()), n, m, hashlib.sha256(k).hexdigest()) for (i, t), (n, m, k) in zip(docs, brute([t.encode() for _, t in docs]), strict=True)}
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op1_suffix_dedup"](spark, sf).collect()} == want
