"""Every operator run on the given tables, with an oracle where SQL can say it."""

from importlib import import_module

from spanledger.queries.registry import ORACLES, QUERIES

for _name in ("reviews", "scalars", "reconcile", "texts", "places", "streams", "schedules", "reports", "findings", "drawing_review"):
    import_module(f"spanledger.queries.{_name}")

__all__ = ["QUERIES", "ORACLES"]
