"""Thresholds of the operators; every one is a parameter of the function that uses it."""

from __future__ import annotations

from dataclasses import dataclass

# Preference of sources when one row is to stand for several; unknown sources come after all.
SOURCE_RANK = {"otodom": 0, "nieruchomosci-online": 1, "gratka": 2, "olx": 3}
UNRANKED = 9


@dataclass(frozen=True)
class Limits:
    """Numbers that steer clustering, history and linkage."""

    price_spread: float = 1.15
    photo_bits: int = 40
    area_tolerance: float = 0.6
    sold_before_days: int = 60
    sold_after_days: int = 400
    grace_days: int = 7
    snapshot_days: int = 7
    cache_days: int = 21
    stored_hashes: int = 10
    stored_urls: int = 8
    gallery_images: int = 5
    timeline_head: int = 2
    timeline_tail: int = 22
    developer_ads: int = 3
    checks_per_run: int = 300
    page: int = 60


LIMITS = Limits()
