"""Importing this module registers every check query."""

from suite import demand_checks  # noqa: F401
from suite import decision_checks  # noqa: F401
from suite import ingest_checks  # noqa: F401
from suite import store_checks  # noqa: F401
from suite import cache_checks  # noqa: F401
