"""Configuration: defaults, then a section, then overrides."""

from __future__ import annotations

from typing import Any

#: The embedding model's size is not to be overridden (fixed value).
DIMENSIONS = 1024


def deep_merge(base: dict[str, Any], other: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``other``; dictionaries are merged, anything else is replaced."""
    merged = dict(base)
    for key, value in other.items():
        old = merged.get(key)
        merged[key] = deep_merge(old, value) if isinstance(old, dict) and isinstance(value, dict) else value
    return merged


def effective(defaults: dict[str, Any], section: str, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, the section laid over them, then the overrides; the vector size stays."""
    merged = deep_merge(deep_merge({k: v for k, v in defaults.items() if k != section}, defaults.get(section, {})), overrides or {})
    embedding = merged.get("embedding")
    return merged | {"embedding": {**embedding, "dimensions": DIMENSIONS}} if isinstance(embedding, dict) else merged
