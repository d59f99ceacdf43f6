"""All queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "risk", "learning", "more", "audits")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"ledgerweave.queries.{m}"), name)
        assert not out.keys() & part.keys()
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def sql() -> dict:
    return _merged("SQL")


def flagship(spark, sf_dir):
    """Events to dense daily counts, burstiness, Hawkes intensity and time since the last flagged event."""
    from ledgerweave.plans.shipping import ship

    ship(spark)
    return queries()["r058_temporal_series"](spark, sf_dir)
