import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers as P  # noqa: E402
import sentencepiece  # noqa: E402

from tests.llm import test_decontaminate, test_lines, test_near  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(docs, items):
    """docs: id to text, all of a clear language."""
    docs = {i: t for i, (t, _, gone) in test_lines.brute(docs).items() if not gone or t.strip()}
    docs = {i: docs[i] for i, (_, c) in test_near.brute(docs, 5).items() if i == c}
    out = {}
    for i, text in docs.items():
        n, hit, _ = test_decontaminate.brute(text, items)
        if hit and 20 * len(hit) >= n:
            continue
        at = [m.span() for m in test_decontaminate.WORD.finditer(test_decontaminate.lower(text))]
        runs = []
        for w in sorted(hit):
            runs = [*runs[:-1], (runs[-1][0], w)] if runs and runs[-1][1] == w - 1 else [*runs, (w, w)]
        for a, b in reversed(runs):
            text = text[: at[a][0]] + text[at[b][1] :]
        out[i] = text
    return out


def test_run_is_brute_force(spark):
    import duckdb

    items = duckdb.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    first = pipeline.identify_language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert first.columns == COLUMNS
    want = brute({r.doc_id: r.text for r in first.collect()}, items)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in pipeline.run(spark, SF).collect()}
    assert got == {i: (len(e := sp.encode(t)), e, sp.decode(e)) for i, t in want.items()}


def test_stages_on_odd_tables(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "the and of it\nand\nof", "en", "s", 21), (3, "the and of it\nand\nof", "en", "s", 21), (None, "the end of it", None, None, 13), (5, "der die und das " * 40_000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and out.count() >= 4, name
        assert name == "sentencepiece" or out.columns == COLUMNS


def test_columns_of_any_name_pass_through(spark):
    more = ["id", "h", "rest", "row", "spans", "left", "kept", "lang_pred", "a.b", "n`x", "digest", "cuts"]
    rows = [(i, f"the {w} and of it\nin the {w}\nand {w}", "en", "s", 1, *map(str, range(len(more)))) for i, w in enumerate(["cat", "dog", "dog", "sun"])]
    docs = spark.createDataFrame(rows, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").schema.names + more)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert {r.doc_id for r in kept} in ({0, 1, 2, 3}, {0, 1, 3}) and all(r["a.b"] == "8" and r["n`x"] == "9" for r in kept), name
