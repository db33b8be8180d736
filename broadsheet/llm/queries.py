"""Queries of the llm operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import encoding, names, neardup, packing, quality, scans, spam, tokens


def p1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "articles"), table(spark, sf_dir, "common_words"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_quality(spark, sf_dir).filter("verdict = 'not prose'").select("id").distinct()


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can work out as well."""
    s = quality.statistics(table(spark, sf_dir, "articles"), table(spark, sf_dir, "common_words"))
    return s.select("id", F.col("word_count").cast("long").alias("word_count"), *(F.round(x, 6).alias(x) for x in ("mean_word_length", "common_ratio"))).distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "articles"), size=3, threshold=0.5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(p2_groups(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variants(*(table(spark, sf_dir, t) for t in ("entity_recognition", "biblio_enriched", "given_names")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs_of(p3_classes(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find(table(spark, sf_dir, "articles"), ["content", "title"])


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find(table(spark, sf_dir, "articles"), ["content", "title"], restore=True)


def _scans(spark: SparkSession, sf_dir: str, restore: bool) -> DataFrame:
    return scans.find(table(spark, sf_dir, "articles"), table(spark, sf_dir, "common_words"), ["content", "original_content"], restore=restore)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir, False)


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir, True)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return tokens.decode(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a container of each kind."""
    return p7_containers(spark, sf_dir).select("container_kind", "container_id", F.inline("items"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind: documents placed, documents cut though they fit, and containers that hold more than they may or say."""
    packed = materialize(p7_containers(spark, sf_dir), "containers")
    placed = packed.select("container_kind", "capacity", F.inline("items")).groupBy("container_kind", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    docs = placed.groupBy("container_kind").agg(F.count("*").alias("docs"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut_in_vain"))
    held = F.aggregate("items", F.lit(0), lambda s, i: s + i["tokens"])
    over = packed.groupBy("container_kind").agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("used") != held)).alias("overfull"))
    return docs.join(over, "container_kind")


def p8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pages(spark, sf_dir).filter("is_spam").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_quality, p1_statistics, p2_found, p2_groups, p3_found, p3_classes, p4_found, p4_restored, p5_found, p5_repaired, p6_ids, p6_round_trip, p7_containers, p7_placements, p7_coverage, p8_found, p8_pages)}
