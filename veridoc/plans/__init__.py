"""Query catalogue over the driver tables."""

from veridoc.plans import audit, eligible, evaluation, grounding, index, preparation, retrieval  # noqa: F401
from veridoc.plans.registry import CATALOGUE, runner

__all__ = ["CATALOGUE", "runner"]
