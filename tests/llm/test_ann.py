import math

import numpy as np

from tabulon.llm import ann


def brute(rows, queries, k=5):
    """rows, queries: (id, vector). Per query id: list of (score, id), nearest first."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in queries:
        if q is None or not v or not all(x is not None and math.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, np.float64)
        best = out.setdefault(q, {})
        for i, x in good:
            if i != q and len(x) == len(v):
                s = float(x @ v / (np.sqrt(x @ x) * np.sqrt(v @ v)))
                best[i] = max(s, best.get(i, -2.0))
    return {q: sorted(((-s, i) for i, s in b.items()))[:k] for q, b in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), "x", 1) for i in range(150)]
    rows += [(200 + i, rows[3][1], "x", 1) for i in range(40)]  # copies
    rows += [(300, None, "x", 1), (301, [0.0] * 8, "x", 1), (302, [1.0, None] * 4, "x", 1), (303, [float("nan")] * 8, "x", 1), (304, [float("inf")] + [1.0] * 7, "x", 1), (305, [], "x", 1), (None, [1.0] * 8, "x", 1)]
    rows += [(400 + i, rng.normal(size=3).tolist(), "x", 1) for i in range(4)]  # of another length
    rows += [(5, rows[5][1], "x", 1), (6, rows[7][1], "x", 1)]  # repeated ids
    rows += [(500, [1e200] * 8, "x", 1), (501, [1e-200, -1e-200] * 4, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    queries = df.where("vec_id % 5 = 0 OR vec_id IN (203, 401, 6)")
    pairs = [(i, v) for i, v, *_ in rows]
    want = brute([(i, [x / 1e200 for x in v] if i == 500 else [x * 1e200 for x in v] if i == 501 else v) for i, v in pairs], [(i, v if i != 500 else [1.0] * 8) for i, v in pairs if i is not None and (i % 5 == 0 or i in (203, 401, 6))])
    got = found(ann.nearest(df, queries, shards=3))
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in got[q]], [-s for s, _ in want[q]], rtol=1e-12, atol=1e-12)
    assert ann.nearest(df.limit(0), queries).count() == 0 and ann.nearest(df, queries.limit(0)).count() == 0
    one = df.where("vec_id = 9")
    assert ann.nearest(one, one).count() == 0


def test_recall_of_a_large_graph():
    rng = np.random.default_rng(2)
    x = ann.unit(rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)])
    g, hit = ann.Graph.build(x), 0
    for q in range(0, 3000, 50):
        s = x @ x[q]
        hit += len(set(g.search(x[q], ann.EF_SEARCH)[:6]) & set(np.argsort(-s)[:6].tolist()))
    assert hit >= 0.9 * 6 * 60
    assert (g.base < 3000).all() and all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in g.base)


def test_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = duckdb.execute(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got = found(QUERIES["op10_nearest"](spark, sf))
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    exact = {(q, i): -s for q, x in brute(rows, [r for r in rows if r[0] % 50 == 0], 10**6).items() for s, i in x}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12, abs_tol=1e-12) for q, x in got.items() for s, i in x)
