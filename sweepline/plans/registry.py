"""All registered queries and their oracle SQL, by name."""

from __future__ import annotations

from sweepline.plans import building as building
from sweepline.plans import floors as floors
from sweepline.plans import gnss as gnss
from sweepline.plans import maps as maps
from sweepline.plans import places as places
from sweepline.plans import poses as poses
from sweepline.plans import scanner as scanner
from sweepline.plans import surfaces as surfaces
from sweepline.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
