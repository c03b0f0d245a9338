"""Builders of small tables with the schemas of the engine."""

from __future__ import annotations

LISTING = (
    "seq bigint, source string, source_id string, url string, title string, type string, price bigint, area double, price_per_m2 double, rooms int, plot_area double, floor string, "
    "locality string, district string, street string, is_private boolean, market string, agency string, image string, created string, archived boolean, phashes array<array<bigint>>, photo_urls array<string>"
)
MATCH_PAIR = "pair_id bigint, left_source string, left_source_id string, left_url string, right_source string, right_source_id string, right_url string, method string, score double, is_match boolean, matched_at timestamp"


def rows(spark, schema: str, *records: dict):
    """A DataFrame of ``schema``; missing fields are null."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def listing(spark, *records: dict):
    return rows(spark, LISTING, *({"seq": i + 1, **r} for i, r in enumerate(records)))


def as_set(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}
