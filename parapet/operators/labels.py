"""Rules of height labels: reject reasons, quality tiers, dates that conflict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import reasons

#: Points that a label, tier B, tier A and full coverage need.
LEAST_POINTS, POINTS_B, POINTS_A, FULL_COVERAGE = 10, 40, 100, 50.0


def quality(roof: Column, ground: Column, height: Column, conflict: Column) -> dict[str, Column]:
    """reasons, tier, both usable flags and the coverage shares of a label; ``conflict`` is a reason or null."""
    thin = (roof < LEAST_POINTS, "fewer_than_10_roof_points"), (ground < LEAST_POINTS, "fewer_than_10_ground_points")
    why = F.array_join(F.array_compact(F.array(F.when(reasons(*thin) != "", reasons(*thin)), F.when(height.isNull(), "missing_height").when(height <= 0, "implausible_height"), F.when(conflict != "", conflict))), ";")
    both = lambda n: (roof >= n) & (ground >= n)
    tier = F.when(why != "", "Reject").when(both(POINTS_A), "A").when(both(POINTS_B), "B").otherwise("C")
    share = lambda n: F.least(F.lit(1.0), n / FULL_COVERAGE)
    return {"reasons": why, "tier": tier, "usable_for_training": tier.isin("A", "B"), "usable_for_validation": tier.isin("A", "B", "C"), "roof_coverage": share(roof), "ground_coverage": share(ground)}


def temporal_mismatch(city: Column, status: Column, built: Column, drawn: Column, merged: Column) -> Column:
    """Why a footprint's date conflicts with its survey's, or an empty text; merged footprints have no date of their own."""
    gone = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("demolished", "removed")
    new_york, los_angeles = city == "new_york_city", city == "los_angeles"
    return (
        F.when(merged, "").when(new_york & (built > 2014), "constructed_after_lidar").when(los_angeles & gone, "footprint_status_demolished_or_removed")
        .when(los_angeles & (drawn > 2024), "footprint_date_after_lidar").otherwise("")
    )
