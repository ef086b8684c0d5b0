"""Queries of the library over the driver's tables."""

from touchline.catalog import feature_tables, file_sources, outcomes, pools, raw_data, team_state, training  # noqa: F401
from touchline.catalog.registry import REGISTRY  # noqa: F401
