"""All registered queries: name -> Entry(build, sql)."""

from __future__ import annotations

from .registry import ENTRIES, Entry
from . import shop_campaign, shop_candidates, shop_catalog, shop_changes, shop_costing, shop_drawing, shop_formulas, shop_limits, shop_nc, shop_planning, shop_plans, shop_quality, shop_records, shop_sources  # noqa: F401  (they register their queries)

__all__ = ["ENTRIES", "Entry"]
