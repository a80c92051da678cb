"""Queries over the driver's tables, by name."""

from __future__ import annotations


def all_queries() -> dict:
    from foldwise.plans import inference_queries, kernel_queries, metric_queries, registry, surface_queries  # noqa: F401

    return dict(registry.QUERIES)


def all_oracles() -> dict:
    from foldwise.plans import inference_queries, kernel_queries, metric_queries, registry, surface_queries  # noqa: F401

    return dict(registry.ORACLES)
