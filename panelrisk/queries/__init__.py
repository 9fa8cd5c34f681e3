"""Registered queries of the panel engine, each with equivalent SQL where SQL can express it."""

from panelrisk.queries import evaluation, features, metrics, models, quality, storage, tables  # noqa: F401  (they register)
from panelrisk.queries.base import ORACLES, QUERIES  # noqa: F401
