"""matchbook.plans: the registered queries, by what they read."""

from matchbook.plans import analytics, events, files, imagery, places, reviews, sets, tables
from matchbook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "events", "files", "imagery", "places", "reviews", "sets", "tables"]
