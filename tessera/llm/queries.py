"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, html, langid, manifest, media, name_join, ngram_join, packing, pieces, quality, quality_rules, secrets, toxicity
from .common import CRC_SQL, id_crc, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; another path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held(divisor: int, rest: int) -> Column:
    """True for rows kept out of learning; false where the id is null."""
    return F.coalesce(F.pmod(id_crc("doc_id"), F.lit(divisor)) == rest, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.document_statistics(table(spark, sf_dir, "documents")), "stats")
    labels = table(spark, sf_dir, "labels").filter(~held(5, 0))
    model = quality.learn(stats, labels, calibration=held(5, 4))
    return quality.score(stats, model).select("doc_id", held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~held(4, 2)))
    return langid.identify(docs, model).select("doc_id", held(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held(4, 2)))
    return toxicity.score(docs, model).select("doc_id", held(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_report(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents"))


def op11_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_join.join_vendors(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.converted(table(spark, sf_dir, "pages")).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_ngram_join": op2_ngram_join,
        "op3_language": op3_language,
        "op4_html": op4_html,
        "op5_toxicity": op5_toxicity,
        "op6_pack": op6_pack,
        "op7_quality_rules": op7_quality_rules,
        "op8_pieces": op8_pieces,
        "op9_media": op9_media,
        "op10_secrets": op10_secrets,
        "op11_name_join": op11_name_join,
        "op12_manifest": op12_manifest,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.ORACLE_SQL,
        "op7_quality_rules": quality_rules.ORACLE_SQL,
        "op11_name_join": name_join.ORACLE_SQL,
        "op12_manifest": manifest.oracle_sql(CRC_SQL),
        "op13_warc": archives.ORACLE_SQL,
    }
