"""Catalog: frame features and scores."""

from __future__ import annotations

from gustframe.plans import common as X
from gustframe.plans.registry import register


@register("FTR8_comfort_frames", X.FRAME_SCHEMA, "SELECT * FROM $frame_table",
          ids=("FTR8", "WIN2", "PRJ3", "AGG1", "AGG2", "AGG4", "SCR1", "FLT5"))
def ftr8_comfort_frames(spark, sf):
    return X.frame_table(spark, sf)
