"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["decontaminate", "chat", "near_dedup", "quality_model", "secrets", "byte_bpe", "language_mix", "substring_dedup", "quality_rules", "sharding", "spelling", "personal", "centroids"]


def collect(attribute: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), attribute).items()}


def queries() -> dict:
    return collect("QUERIES")


def oracles() -> dict:
    return collect("ORACLES")
