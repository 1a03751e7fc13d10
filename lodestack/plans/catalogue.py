"""All queries of the engine by name, with their DuckDB counterparts."""

from lodestack.plans import assets, chunks, hosts, manifests, scenes, storage, versions  # noqa: F401
from lodestack.plans.registry import ORACLES, QUERIES  # noqa: F401
