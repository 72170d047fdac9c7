"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, dac, decontaminate, line_dedup, merkle, near_dedup, packing, quality, secret_scan, syncmers, url_reputation, whitening
from .common import read, shared_folder

TOKENIZER = "word_bpe_49k.json"
#: Rules of the URL query (fixed values): verdict, host, start of the path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _crc(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = brown.fit(docs.where(_crc(10) != 0))
    out = brown.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (_crc(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(_crc(4) != 2))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (_crc(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page shows the document whose number ends its path; bad where that is labelled toxic or of low quality."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labels = read(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    shown = F.regexp_extract("url", "/([0-9]{1,18})(?:[/.?#][^0-9]*|[?#].*)?$", 1)
    outcomes = pages.withColumn("number", shown).select("url", F.expr("try_cast(number AS bigint)").alias("doc_id"))
    out = url_reputation.judge(pages, outcomes.join(labels, "doc_id").select("url", "bad"), RULES)
    return out.withColumnRenamed("id", "page_id")


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.repair(read(spark, sf_dir, "conversations"))
    return out.withColumnRenamed("conv", "conv_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_items(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items.item_id").alias("item_ids"), F.col("items.edits").alias("edits"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end=0, capacity=2048)
    return out.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.compare_with_edited(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    return out.select(F.col("id").alias("doc_id"), "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    dac.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end=1)
    out = dac.read_documents(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of a match is that of the whole match; those that the lexer adds are of kind literal or constant."""
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    digest = F.sha2(joined(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256")
    added = F.size(of(secret_scan.LITERAL, secret_scan.CONSTANT)).cast("long").alias("n_added")
    return found.select(F.col("id").alias("doc_id"), *counts, digest, joined(F.col("spans")).alias("spans"), added)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64, shift=1_000_000, components=32)
    return out.withColumnRenamed("id", "vec_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered: where 7 divides the CRC of the id, one more in n_chars."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    n_chars = F.col("n_chars") + F.when(_crc(7) == 0, 1).otherwise(0)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = docs.select(
        "doc_id", "lang", merkle.digest(*map(F.col, fields)).alias("leaf"),
        F.when(_crc(7) == 0, merkle.digest(*(n_chars if f == "n_chars" else F.col(f) for f in fields))).alias("claimed"),
    )
    manifest = merkle.build(leaves, id_col="doc_id", tree_col="lang", leaf_col="leaf", claimed_col="claimed", path=f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}")
    out = merkle.verify(manifest)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_minhash_near_dedup, op2_brown_lm, op3_line_dedup, op4_quality, op5_url_reputation, op6_chat_repair, op7_decontaminate,
        op8_best_fit_packing, op9_syncmers, op10_dac_tokens, op11_secret_scan, op12_whitening, op13_merkle_manifest,
    )
    return {f.__name__: f for f in named}


def oracles() -> dict[str, str]:
    from . import oracle

    return dict(oracle.SQL)
