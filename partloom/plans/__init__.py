"""Registered queries over the driver tables, each with the SQL it must agree with where SQL can say it."""

from partloom.plans import curation, evaluation, labels, model_io, packaging, pseudo, scalars, sources  # noqa: F401
from partloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
