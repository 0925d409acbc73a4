import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window=13):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        x = WORD.findall(lower(t))
        for i in range(max(1, len(x) - window + 1) if x else 0):
            p = x[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(str(item))
    return len(w), hit, sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "9", " ", "-", "\n", "aa"]), max_size=60), st.lists(st.lists(st.sampled_from(["a", "b ", " é", " 9 ", "aa "]), max_size=9), max_size=4))
def test_scan_is_brute_force(doc, items):
    text, items = "".join(doc), [(i, "".join(x)) for i, x in enumerate(items)]
    w = d.words(text)
    spans, found = d.Matcher([(str(i), t) for i, t in items], 3).scan(w)
    n, hit, ids = brute(text, items, 3)
    assert n == len(w) and sorted(found) == ids
    assert {i for a, b in spans for i in range(a, b)} == hit
    for s in d.offsets(text.encode(), spans):
        assert WORD.findall(lower(text[s["start"] : s["end"]])) == [x.decode() for x in w[s["first_word"] : s["first_word"] + s["n_words"]]]


def test_blocks_nulls_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"x {long} y", 5, "a"), (2, None, 5, "b"), (2, None, 5, "b"), (3, "", 1, "c"), (4, "Short item!", 1, "d"), (5, "w0 w1 " * 50_000, 1, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, items string")
    items = [(7, long), (7, long), (8, "short ITEM"), (9, None), (10, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block, at_once in ((d.BLOCK_BYTES, d.PASS_BYTES), (30, d.PASS_BYTES), (30, 60)):
        got = sorted(tuple(r) for r in d.scan_documents(docs, bench, block_bytes=block, pass_bytes=at_once).collect())
        assert [r[0] for r in got] == [1, 2, 2, 3, 4, 5]
        for r in got:
            n, hit, ids = brute(next(x[1] for x in rows if x[0] == r[0]) if r[0] != 5 else "", items)
            assert r[0] == 5 or (r[1], sum(s["n_words"] for s in r[2]), list(r[3])) == (n, len(hit), ids)
    assert d.scan_documents(docs.limit(0), bench).count() == 0
    assert d.scan_documents(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_items_without_ids_and_many_with_one_text(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two"), (4, "three")], "item_id long, text string")
    r = d.scan_documents(docs, bench).first()
    assert [(s["first_word"], s["n_words"]) for s in r.spans] == [(1, 2)] and list(r["items"]) == ["4"]
    assert d.Matcher([(str(i), "same words here") for i in range(20_000)]).scan(d.words("the same words here"))[0] == [(1, 4)]


def test_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    items = duckdb.execute(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    texts = dict(duckdb.execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = QUERIES["op2_decontaminate"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, ids = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
