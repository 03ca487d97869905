"""Classification of document pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A page with so many characters is text; one covered by images to this share is scanned.
TEXT_CHARS = 20
SCANNED_SHARE = 0.5


def image_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """Share of the page that images (x0, y0, x1, y1) cover, at most 1; 0 for a page without area."""
    area = F.aggregate(F.coalesce(boxes, F.array()), F.lit(0.0), lambda s, b: s + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    return F.least(F.coalesce(F.try_divide(area, width * height), F.lit(0.0)), F.lit(1.0))


def page_status(char_count: Column, coverage: Column) -> Column:
    """text, scanned or near_empty."""
    return F.when(char_count >= TEXT_CHARS, "text").when(coverage >= SCANNED_SHARE, "scanned").otherwise("near_empty")


def status_after_ocr(status: Column, char_count: Column) -> Column:
    """A scanned page becomes text, or ocr_failed if recognition has found too little."""
    return F.when(status != "scanned", status).when(char_count < TEXT_CHARS, "ocr_failed").otherwise("text")


def is_scanned(status: Column) -> Column:
    return status.isin("scanned", "ocr_failed")
