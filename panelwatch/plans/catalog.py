"""All registered queries; importing the modules fills the registry."""

from panelwatch.plans import queries_panel, queries_refresh, queries_serving, queries_sources  # noqa: F401
from panelwatch.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
