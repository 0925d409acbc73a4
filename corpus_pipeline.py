"""From documents to token ids: five stages, each written as Parquet and reread by the next.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, and more columns pass through, whatever their names. Texts are taken
whole, however long. An empty table gives an empty result in every stage.

What becomes of odd rows: a null or empty text has no letter, so language identification rejects
it; stages that get one nonetheless keep it as it is, and the last gives it no ids. Rows equal in
all columns go the same way, and stay as many as they were. A null id is a document of its own to
all stages but line dedup, where null ids come before all others.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, language, lines, near, pieces
from tabulon.llm.common import Scratch, table
from tabulon.llm.queries import tokenizer

#: SQL has no segmentation into pieces.
ORACLE_SQL = None
#: A document whose best language has less than this share of the probability is rejected.
LEAST_SCORE = 0.5


#: Documents that go to a Python worker at once, where the session has Spark's own 10,000: a batch is held
#: several times over, in the JVM and in the worker, and documents are long.
BATCH_DOCUMENTS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded(stage):
    """A stage whose session hands documents to Python in small batches; a session with a setting of its own keeps it."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH) == "10000":
            spark.conf.set(_BATCH, str(BATCH_DOCUMENTS))
        return stage(spark, docs, sf_dir)

    return run_stage


def quoted(name: str, struct: str | None = None) -> Column:
    """A column, or a struct's field, of any name."""
    name = "`" + name.replace("`", "``") + "`"
    return F.col(f"{struct}.{name}" if struct else name)


@_bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter go. Of languages of equal probability the first label counts, at half the score or less, so such documents stay if it is ``LEAST_SCORE``."""
    model = language.fit(docs, tokenizer("piece_bpe_32k.model"))
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@_bounded
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred in the same three-line window before; n_chars follows. A document that loses all it had goes. Of equal windows the one of smallest id, then of smallest line, stays."""
    cut = lines.dedup(docs).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars")
    own = {"doc_id": F.col("id").alias("doc_id"), "text": F.col("text"), "n_chars": n_chars}
    return cut.select(*[own.get(c, quoted(c, "rest").alias(c)) for c in docs.columns])


@_bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words at 0.8: the one of smallest id. Rows that repeat an id stay or go together; null and word-less texts and null ids stay."""
    gone = near.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])


@_bounded
def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that benchmark passages make up a twentieth of; shorter passages are cut out of the others, and n_chars follows."""
    found = decontaminate.scan_rows(docs, table(spark, sf_dir, "benchmark")).where(~decontaminate.contaminated())
    hit = F.size("spans") > 0
    text = F.when(hit, decontaminate.cut(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    out = found.select("row", "spans", text.alias("left"))
    own = {"text": F.col("left").alias("text"), "n_chars": F.when(hit, F.length("left").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return out.select(*[own.get(c, quoted(c, "row").alias(c)) for c in docs.columns])


@_bounded
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded: the text that the ids stand for."""
    out = pieces.encode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
