"""The registered queries: the library's operators over the given tables."""

from __future__ import annotations

from docquill import registry


def _load() -> None:
    from docquill.plans import access, aggregates, order, prompts, scalars, text, vectors  # noqa: F401


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
