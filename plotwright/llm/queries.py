"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.llm.addresses import same_building_classes, same_building_pairs
from plotwright.llm.canonical import map_to_canonical
from plotwright.llm.components import ad_groups
from plotwright.llm.leakage import WINDOW, find_edited, find_leaks
from plotwright.llm.linkage import link_deeds
from plotwright.llm.near_dup import near_duplicate_classes, near_duplicate_pairs
from plotwright.llm.packing import CAPACITY, pack_documents
from plotwright.llm.pairs import class_rows
from plotwright.llm.pii import find_mentions, redact_documents
from plotwright.llm.sql import ORACLE  # noqa: F401 - read by the driver contract
from plotwright.llm.survivor import judge_values, survivors
from plotwright.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads of listing with the group that confirmed matches put them in."""
    listing = table(spark, sf_dir, "listing").select("seq", "source", "source_id", "url")
    return ad_groups(listing, table(spark, sf_dir, "match_pair"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listing rows with close area and price that share the picture or most title words."""
    return near_duplicate_pairs(table(spark, sf_dir, "listing").select("seq", "type", "area", "price", "title", "image"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links without expansion: rows with a partner, their class of equal rows and its number of links."""
    return class_rows(*near_duplicate_classes(table(spark, sf_dir, "listing").select("seq", "type", "area", "price", "title", "image")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freely typed towns with the entry of locality_ref they stand for, or 0."""
    listing = table(spark, sf_dir, "listing").select("seq", "locality", "district")
    return map_to_canonical(listing, "locality", table(spark, sf_dir, "locality_ref"), beside="district").select("seq", "loc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listing rows that state the same building."""
    listing = table(spark, sf_dir, "listing").select("seq", "street", "locality", "district")
    return same_building_pairs(listing, table(spark, sf_dir, "locality_ref"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links without expansion: rows with a partner, their class of equal readings and its number of links."""
    listing = table(spark, sf_dir, "listing").select("seq", "street", "locality", "district")
    return class_rows(*same_building_classes(listing, table(spark, sf_dir, "locality_ref")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_deeds(table(spark, sf_dir, "archive_row"), table(spark, sf_dir, "deed"), table(spark, sf_dir, "locality_ref"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived properties with the deeds that can be their sale."""
    return _links(spark, sf_dir).filter("matched").select("archive_id", "deed_id")


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs with the label model's confidence."""
    return _links(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row, price, source and created of each duplicate group."""
    return survivors(table(spark, sf_dir, "dup_group"), table(spark, sf_dir, "listing"), table(spark, sf_dir, "source_trust"))


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claimed value of the groups' fields with the probability that it is true."""
    return judge_values(table(spark, sf_dir, "dup_group"), table(spark, sf_dir, "listing"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed whole into containers of 4,096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers and the share of their capacity that is used."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 4))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items of which they contain at least 12 consecutive words."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return leaks.filter(F.col("run") >= WINDOW).select("doc_id", "item_id")


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain an edited copy of a tenth of a test item or more, with alignment score and longest run."""
    leaks = find_edited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return leaks.filter(F.col("score") >= F.greatest(F.lit(2 * WINDOW), F.ceil(F.col("item_words") * 0.2)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of people and how to reach them, by kind and position."""
    return find_mentions(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with typed placeholders in place of the mentions."""
    return redact_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_classes, p4_found, p5_found, p5_classes, p6_found, p6_confidence, p7_found, p7_values, p8_pack, p8_fill, p9_found, p9_edited, p10_found, p10_redacted)}
