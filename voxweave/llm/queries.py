"""One query per operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.runtime import cut

from . import decontaminate, html_main, importance, language_id, license_scan, near_dedup, pieces, pii, quality_hosts, secret_scan, substring_dedup, token_counts, vector_codes
from .sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query
def op7_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_quality_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return quality_hosts.judge(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("sound").alias("kept"))


@query
def op4_html_main(spark: SparkSession, sf: str) -> DataFrame:
    return html_main.extract(_table(spark, sf, "pages"))


def _listed(spans: str) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    found = pii.find(docs.select("doc_id", "text"), pii.train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    order = lambda x: F.struct(F.array_position(F.array(*map(F.lit, pii.KINDS)), x["kind"]).alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    every = found.withColumn("every", F.array_sort(F.transform(F.concat("base", "added"), order)))
    return every.select("doc_id", *map(count, pii.KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("every").alias("spans"))


@query
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf, "documents"))
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["unit"], x["first"], x["words"])), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_found"), F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))).alias("licenses"),
                        listed.alias("spans"))


@query
def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    # Two arrivals: the ledger of one part is read when all versions are scanned, so that no content is searched twice.
    _, ledger = secret_scan.scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    found, _ = secret_scan.scan(docs, cut(ledger))
    base = found.withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*secret_scan.BASE)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return base.select("doc_id", *map(count, secret_scan.BASE), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


@query
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf, "documents"))
    return pieces.decode(coded).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.codes_and_errors(_table(spark, sf, "embeddings"))


@query
def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf, "documents"))


@query
def op13_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resample(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
