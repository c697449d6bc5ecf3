"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from korvane.session import materialize, scratch_path

from . import (jaccard, licences, line_dedup, merkle, quality_mil, quality_rules, quotes, sentencepiece_sa, toxicity,
               training_order, warc, whitening, winnowing)
from .registry import ORACLE, QUERIES, query, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op1_attention_mil")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


@query("op2_segment_edit_join")
def op2(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op3_feistel_shards")
def op3(spark, sf_dir, rank_path=RANKS):
    """Every sequence with its slot, its documents and the digest of its record in the shards."""
    path = scratch_path(spark, "shards")
    order = training_order.materialise(table(spark, sf_dir, "documents"),
                                       training_order.Tokenizer(rank_path), path)
    if order.isEmpty():
        return order.withColumn("sha256", F.lit(None).cast("string"))
    stored = training_order.read_slots(spark, path) \
        .select("slot", F.sha2("data", 256).alias("sha256"))
    return order.join(stored, "slot").select("slot", "index", F.col("used").cast("long").alias("used"),
                                             "docs", "sha256")


@query("op4_compression_bands")
def op4(spark, sf_dir):
    return quality_rules.score_rules(table(spark, sf_dir, "documents"))


@query("op5_winnowing", winnowing.SQL)
def op5(spark, sf_dir):
    return winnowing.decontaminate(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "benchmark"))


@query("op6_levenshtein_lexicon")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op7_quotation_links")
def op7(spark, sf_dir):
    return quotes.conversations(quotes.as_mail(table(spark, sf_dir, "conversations")))


@query("op8_suffix_array_pieces")
def op8(spark, sf_dir, model_path=PIECES):
    """Ids of every text, and whether decoding them gives the text again."""
    model = sentencepiece_sa.Model.read(model_path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_sa.decode(sentencepiece_sa.encode(docs, model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op9_warc_transactions", warc.SQL)
def op9(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = materialize(warc.read_records(spark, path), "warc-records")
    again = F.col("record_type") == "revisit"
    # what the contract asks of a payload is taken from it where it was read, before any join
    records = records.withColumns({
        "payload_bytes": F.when(again, F.col("http_bytes"))
        .otherwise(F.octet_length("payload").cast("long")),
        "payload_digest": F.when(again, F.col("digest"))
        .otherwise(warc.base32_sha1(F.col("payload")))})
    return warc.assemble(records, ["payload_bytes", "payload_digest"]).select(
        warc.capture_of(F.col("capture_id")).cast("long").alias("page_id"), "payload_bytes",
        "payload_digest", "record_type",
        warc.capture_of(F.col("refers_to")).cast("long").alias("refers_to"))


@query("op10_jaccard_pigeonhole")
def op10(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op11_bidiagonal_whitening")
def op11(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


@query("op12_licence_automaton")
def op12(spark, sf_dir):
    return licences.report(table(spark, sf_dir, "documents"))


@query("op13_merkle_climb", merkle.SQL)
def op13(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"), claims=merkle.lowered())


def load():
    return QUERIES, ORACLE
