import random

import numpy as np
import pytest

from tabulon.llm import graph, near
from tabulon.llm.common import Scratch


def shingles(text, n=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n=4, percent=80):
    """docs: id to text. Id to (set size, component)."""
    sets, boss = {i: shingles(t, n) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for x in where.values() for a in x for b in x if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            boss[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_densified_signature_estimates_similarity():
    rng, sk = np.random.default_rng(1), near.Sketcher(100, 8)
    for size, share in ((8, 0.5), (40, 0.8), (2000, 0.6)):
        same = []
        for _ in range(60):
            u = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            cut = int(len(u) * (1 + share) / 2)
            a, b = np.sort(u[:cut]), np.sort(u[len(u) - cut :])
            same.append(np.mean(sk.signature(a) == sk.signature(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(same)) < 0.06
    assert (sk.signature(np.array([7], np.uint64)) == 7).all()


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(100)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]}[shape]
    boss = {}

    def find(i):
        boss.setdefault(i, i)
        while boss[i] != i:
            i = boss[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        boss[y] = x
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), shape).collect()))
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def family(rng, vocab, base, n, rate):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(len(w) * rate)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    texts = ["", " \n", "one", "One", "one two three", "one two THREE", "a b c d", "a b c d e", "a b c d e f"]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(5, 60))) for _ in range(60)]
    for rate in (0.0, 0.01, 0.03, 0.045, 0.06):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 250))]
        texts += family(rng, vocab, base, 25, rate)
    for n in range(30):  # a chain, each similar to the next
        texts.append(" ".join(f"c{k}" for k in range(n * 6, n * 6 + 90)))
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, True) for i, t in docs.items()], "doc_id long, text string, n long, kept boolean")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df, 4).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(docs).items()}


def test_nulls_repeats_long_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "same text here now"), (3, "same text here now"), (4, "SAME text\nhere now"), (None, "same text here now"), (None, None), (6, long), (5, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near.near_duplicates(df, 4).collect()), key=str)
    n = 60_000 - 3
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (None, 1, None, True), (None, 0, None, True), (6, n, 5, False), (5, n + 1, 5, True)]
    assert got == sorted(want, key=str)
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = dict(duckdb.execute(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_near_duplicates"](spark, sf).collect()}
    want = brute(docs)
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 20


def test_large_group_of_near_copies_in_tiles(spark, monkeypatch):
    """Two passes settle a group of any size, with tiles far smaller than it, and the number of jobs doesn't follow its size."""
    monkeypatch.setattr(near, "TILE", 6_000)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for size in (60, 700):
        texts = []
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 1)] = [rng.choice(vocab)] if kind < 2 else []
            texts.append(" ".join(w))
        docs = dict(enumerate(texts))
        spark.sparkContext.setJobGroup(f"near-{size}", "")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 4).collect()}
        jobs.append(len(tracker.getJobIdsForGroup(f"near-{size}")))
        assert got == brute(docs)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 30


def test_similar_is_brute_force():
    rng = np.random.default_rng(5)
    for n_q, n_m in ((1, 40), (30, 40), (3, 1), (300, 500)):
        base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)

        def one():
            some = base[rng.random(60) > rng.choice([0.02, 0.1, 0.5])]
            return np.unique(np.concatenate([some, rng.integers(0, 1 << 62, rng.integers(0, 12), dtype=np.uint64), base[:1]]))

        q, m = [one() for _ in range(n_q)], [one() for _ in range(n_m)]
        got = {(a, b) for x, y in near.similar(q, m, 80) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        want = {(a, b) for a, x in enumerate(q) for b, y in enumerate(m) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        assert got == want
