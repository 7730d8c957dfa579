"""Column builders for detection boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a box's width and height added on each side of a face crop and of an ear crop.
FACE_PAD, EAR_PAD = 0.05, 0.10


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(x, hi))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """0 for a box whose corners are the wrong way round."""
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of corner boxes (x1, y1, x2, y2); 0 for an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = area(*a) + area(*b) - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.try_divide(both, union))


def center_to_top_left(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Center box to [x_min, y_min, w, h]."""
    return F.array(x - w / 2, y - h / 2, w, h)


def top_left_to_center(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x + w / 2, y + h / 2, w, h)


def face_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = FACE_PAD) -> list[Column]:
    """Corners of a padded center box within the image; box and padding are truncated to pixels one after the other."""
    dx, dy = (w * pad).cast("int"), (h * pad).cast("int")
    zero = F.lit(0)
    return [
        clamp((x - w / 2).cast("int") - dx, zero, width),
        clamp((y - h / 2).cast("int") - dy, zero, height),
        clamp((x + w / 2).cast("int") + dx, zero, width),
        clamp((y + h / 2).cast("int") + dy, zero, height),
    ]


def ear_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = EAR_PAD) -> list[Column]:
    """Corners of a padded corner box within the image, truncated once."""
    w, h, zero = x2 - x1, y2 - y1, F.lit(0)
    return [clamp((x1 - pad * w).cast("int"), zero, width), clamp((y1 - pad * h).cast("int"), zero, height), clamp((x2 + pad * w).cast("int"), zero, width), clamp((y2 + pad * h).cast("int"), zero, height)]


def triage(boxes: Column) -> Column:
    """Label of an image from its boxes, array<struct<confidence, area>>."""

    def above(level: float) -> Column:
        return F.filter(boxes, lambda b: b.confidence > level)

    def ratio(some: Column) -> Column:
        sizes = F.sort_array(F.transform(some, lambda b: b.area), asc=False)
        return F.try_divide(F.get(sizes, F.lit(0)), F.get(sizes, F.lit(1)))

    high, middle = above(0.8), above(0.7)
    rh, rm = ratio(high), ratio(middle)
    return (
        F.when((F.size(high) > 1) & (rh >= 4), "Probable")
        .when((F.size(high) > 1) & (rh >= 3), "Uncertain")
        .when((F.size(high) > 1) & (rh >= 2), "Likely Bad")
        .when(F.size(high) > 1, "Rejected")
        .when((F.size(high) == 1) & (F.size(above(0.9)) == 1), "Certain")
        .when(F.size(high) == 1, "Probable")
        .when((F.size(middle) > 1) & (rm >= 4), "Uncertain")
        .when((F.size(middle) > 1) & (rm >= 2), "Likely Bad")
        .when(F.size(middle) > 1, "Rejected")
        .when(F.size(middle) == 1, "Probable")
        .when(F.size(above(0.6)) == 0, "Rejected")
        .otherwise("Uncertain")
    )


def box_label(confidence: Column, size: Column) -> Column:
    """Text drawn beside a box: whole percent and area in thousands."""
    return F.format_string("%d%% %.1fk", F.bround(confidence * 100, 0).cast("int"), F.bround(size / 1000, 1))


def palette(i: Column, n: Column) -> Column:
    """RGB (0-255) of colour i of n: hues evenly around the circle in whole degrees, full saturation and value."""
    hue = F.floor(i * 360 / n)
    c = F.lit(255)
    x = (255 * (1 - F.abs(F.pmod(hue / 60, F.lit(2.0)) - 1))).cast("int")
    zero = F.lit(0)
    sextant = F.floor(hue / 60)
    return (
        F.when(sextant == 0, F.array(c, x, zero)).when(sextant == 1, F.array(x, c, zero)).when(sextant == 2, F.array(zero, c, x))
        .when(sextant == 3, F.array(zero, x, c)).when(sextant == 4, F.array(x, zero, c)).otherwise(F.array(c, zero, x))
    )
