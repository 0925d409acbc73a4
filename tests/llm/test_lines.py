import hashlib
import random

from tabulon.llm import lines as m


def brute(docs):
    """docs: id to text, in order of ids."""
    seen, out = set(), {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(m.BLANKS)]
        gone = set()
        for a, b, c in zip(at, at[1:], at[2:], strict=False):
            key = tuple(lines[k].strip(m.BLANKS) for k in (a, b, c))
            if key in seen:
                gone.update(range(a, c + 1))
            seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_dedup_is_brute_force(spark):
    rng = random.Random(5)
    docs = {i: "\n".join(rng.choices(["a", "b ", " b", "c", "", "\t", "é"], k=rng.randint(0, 12))) for i in range(120)}
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in docs.items()], "doc_id long, text string, n_lines int, rest string")
    got = {r.id: (r.text, r.n_lines, r.n_removed) for r in m.dedup(df).collect()}
    assert got == brute(docs)
    assert m.dedup(df).select("rest.*").columns == ["n_lines", "rest"]


def test_nulls_repeats_long_and_empty(spark):
    long = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(1, None), (1, None), (2, ""), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "x\na\nb\nc"), (4, "other\ntext\nhere"), (None, "p\nq\nr"), (9, "p\nq\nr\ns"), (10, long), (11, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.text, r.n_lines, r.n_removed) for r in m.dedup(df).collect()), key=str)
    want = [(1, None, 0, 0), (1, None, 0, 0), (2, "", 1, 0), (3, "a\nb\nc", 3, 0), (3, "a\nb\nc", 3, 0), (4, "x", 4, 3), (4, "other\ntext\nhere", 3, 0), (None, "p\nq\nr", 3, 0), (9, "s", 4, 3), (10, long, 50_000, 0), (11, "", 50_000, 50_000)]
    assert got == sorted(want, key=str)
    assert m.dedup(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    import duckdb

    from tabulon.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op5_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op5_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())
    assert got == want
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    assert [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (t, n, k) in sorted(brute(texts).items())] == got
