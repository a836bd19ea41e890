"""Registered queries and their SQL twins."""

from palisade.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import every plan module, which fills the catalog."""
    from palisade.plans import changes, detectors, entities, estate, findings, relational, streams, surface, validation  # noqa: F401
