"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import ann, bpe, html, langid, neardup, packing, quality, secrets, shards, topk
from strandframe.llm.common import held_out, table
from strandframe.llm.oracles import ORACLES  # noqa: F401


def op1_subword_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id")))
    out = langid.predict(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_byte_cnn_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~held_out(F.col("doc_id")))
    out = quality.predict(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.LEVEL).cast("int").alias("predicted"))


def op4_linked_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op2_bpe_round_trip(spark, sf_dir):
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.sha_of_ids(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_scored_main_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"), "page_id", "html", carry=("url",))


def op6_norm_pruned_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op7_bagminhash_near_duplicates(spark, sf_dir):
    out = neardup.classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), "class_id")


def op8_learned_partitions(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op9_histogram_shards(spark, sf_dir):
    return shards.digest(shards.histogram_shards(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op10_concatenate_and_cut(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_subword_language, op2_bpe_round_trip, op3_byte_cnn_quality, op4_linked_secrets, op5_scored_main_text, op6_norm_pruned_top_k, op7_bagminhash_near_duplicates, op8_learned_partitions, op9_histogram_shards, op10_concatenate_and_cut)}
