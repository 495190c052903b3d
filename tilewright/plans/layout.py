"""Detections to canvas layout: filter, number, fit, order (one wide shuffle on the image)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tilewright import constants as K
from tilewright.operators import boxes as B
from tilewright.operators.ranking import HOT_ROWS


def canvas_layout(
    detections: DataFrame, min_side: float = 0.0, match_side: float = K.LARGE_SIDE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Numbered boxes with canvas corners and paste order."""
    boxes = B.large_boxes(detections, min_side)
    numbered = B.crop_numbers(boxes, match_side=match_side, hot_rows=hot_rows)
    # The counts per image are the ones that look for hot images, so Spark shares that exchange.
    return B.paste_order(B.letterbox_boxes(numbered), counts=B.crop_counts(boxes))
