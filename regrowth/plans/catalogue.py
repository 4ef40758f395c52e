"""Imports every plan module so that its queries are registered."""

from regrowth.plans import aggregates, effects, intervals, joins_and_windows, recovery, sources_and_panel  # noqa: F401
from regrowth.plans.registry import ORACLES, QUERIES  # noqa: F401
