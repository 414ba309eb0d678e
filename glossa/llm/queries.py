"""The registered queries of the operators: each applies its operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import (bpe, chat, decontam, divergence, jaccard_join, langid, line_dedup, merkle, quality_model, quality_rules, sharding,
                        url_filter, warc)
from glossa.llm.common import is_held_out, landed, table
from glossa.llm.oracles import ORACLES

N_SHARDS = 24
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the byte-level vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows.unionByName(extra))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path, pattern)
    return bpe.decode(encoded, "ids", "decoded", path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "p_good")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_hits(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.report(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.with_slots(sharding.assign(rows, "doc_id", [1.0] * N_SHARDS), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.components(table(spark, sf_dir, "documents"), "doc_id", "text", size=3, percent=90)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), "page_id", "url", url_filter.rules_of(URL_RULES))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = langid.learn(docs, "doc_id", "text", "lang", ~is_held_out(F.col("doc_id")))
    out = langid.identify(docs, "doc_id", "text", learnt)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~is_held_out(F.col("doc_id")))
    weights = quality_model.fit(docs, "doc_id", "text", labels, "doc_id", "quality")
    out = quality_model.score(docs, "doc_id", "text", weights)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "lang", "source", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.leaf_of(fields)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = merkle.leaf_of([*fields[:-1], F.translate("text", upper, lower)])
    out = merkle.manifest(docs, "doc_id", "source", leaf, F.when(tampered, changed).otherwise(leaf))
    digest = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "proof", "folded_root")}
    return out.select("doc_id", digest["leaf"].alias("leaf"), digest["subroot"].alias("subroot"), digest["root"].alias("root"),
                      digest["proof"].alias("proof_sha256"), digest["folded_root"].alias("folded_root"),
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    out = warc.resolved(landed(warc.read_archives(spark, path), "warc-read"))
    return out.select(F.col("key").cast("long").alias("page_id"), F.col("n").alias("payload_bytes"),
                      F.col("digest").alias("payload_digest"), "record_type", F.col("refers_key").cast("long").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_byte_bpe, op3_quality_rules, op4_decontaminate, op5_line_dedup,
                            op6_rendezvous_shards, op7_jaccard_join, op8_url_filter, op9_language_id,
                            op10_quality_model, op11_source_divergence, op12_merkle_manifest,
                            op13_warc)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
