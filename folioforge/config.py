"""Thresholds and caps with their defaults; pass another instance to change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    provider_min_confidence: float = 0.80
    strong_isbn: float = 0.85
    weak_isbn: float = 0.5
    catalog_strong: float = 0.9
    catalog_medium: float = 0.5
    cover_similarity: float = 0.8
    cover_confidence: float = 0.7
    cover_gap: float = 0.15
    cluster_gap: float = 0.1
    cluster_max: int = 3
    no_match_similarity: float = 0.45
    tiny_crop: float = 0.05
    large_crop: float = 0.30
    compare_cap: int = 3
    compare_cap_most: int = 30
    title_mismatch: float = 0.3
    title_strong: float = 0.85
    vision_match: float = 0.85
    vision_likely: float = 0.6
    alternatives_per_book: int = 2
    resale_per_ad: int = 30
    verify_per_ad: int = 10
    mismatch_per_book: int = 2
    mismatch_per_ad: int = 4
    crop_retries: int = 6
    recovery_per_ad: int = 8
    fallback_min_detected: int = 5
    fallback_max_eligible: int = 1
    candidates_kept: int = 10
    payload_attempts: int = 3
    price_attempts: int = 2
    payload_lock_minutes: int = 90
    price_lock_minutes: int = 15


DEFAULT = Config()
