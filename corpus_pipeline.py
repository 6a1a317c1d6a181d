"""The corpus pipeline: quality, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet and read again before the next. Stages 1 to 4 return the columns of `documents`; models
are fitted on the labelled rows of the source tables. Null texts are rejected by the language
stage; repeated rows are copies, of which the near-duplicate stage keeps one. Tables that a stage
writes on its way lie under spark.checkpoint.dir: run() drops them when the stage is done, a stage
that is called by itself leaves its last ones, which its lazy result still reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import langid, neardup, packing, quality, secrets
from strandframe.llm.common import collecting, drop_tables, durable, held_out, keep_rows, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with `_sf_row`, a number that tells repeated rows apart, written so that it stays as it is."""
    return durable(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_sf_row")))


def quality_classifier(spark, docs, sf_dir):
    """Keep the documents that the classifier predicts to be of quality 1."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~held_out(F.col("doc_id")))
    return quality.keep(docs.select(*COLUMNS), "text", model)


def language_id(spark, docs, sf_dir):
    """Keep the documents whose language is told with enough confidence."""
    model = langid.fit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", ~held_out(F.col("doc_id")))
    return langid.keep(docs.select(*COLUMNS), "text", model)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each near-duplicate class: the one with the smallest doc_id."""
    rows = _numbered(docs)
    found = neardup.classes(rows.select(F.struct("doc_id", "_sf_row").alias("id"), "text"), "id", "text")
    first = found.filter(F.col("key") == F.col("class_id")).select(F.col("key._sf_row").alias("_sf_row"))
    return keep_rows(rows, "_sf_row", first).select(*COLUMNS)


def secret_scans(spark, docs, sf_dir):
    """Replace every secret in the texts by a mark; n_chars follows the new text."""
    found = secrets.scan(docs, "doc_id", "text", carry=COLUMNS[1:])
    text = secrets.redact(F.col("text"), F.col("spans"))
    out = found.select(F.col("key").alias("doc_id"), text.alias("text"), "lang", "source", F.col("n_chars"), F.size("spans").alias("n_"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark, docs, sf_dir):
    """Pieces of fixed-length token sequences."""
    return packing.digest(packing.pack(docs, "doc_id", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Trained models, signatures and tokenization are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input, and what it writes on its way, are dropped once its own result is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    with collecting(written):
        for _, stage in STAGES[:-1]:
            with scratch(spark):
                docs = durable(stage(spark, docs, sf_dir), lasting=True)
            drop_tables(spark, written[:-1])
            del written[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
