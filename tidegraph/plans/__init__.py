"""Named queries over the driver's tables, one module for each part of the blueprint."""

from tidegraph.registry import Registry

REGISTRY = Registry()

from tidegraph.plans import evaluation, extra, history, passages, scores  # noqa: E402, F401
