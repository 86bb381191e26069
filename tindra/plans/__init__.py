"""Registered queries. Importing the package fills the registry."""

from . import base, columns, derived, entities, graph, ledger, quality, registry, text  # noqa: F401
