"""All registered queries."""

from mailfleet.catalog import (  # noqa: F401
    abuse, directory, health, messages, posture, replicas, streams,
)
from mailfleet.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
