"""Box geometry as column expressions. A box is a struct or four columns l, t, r, b with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns l, t, r, b with a prefix, such as ``c.``."""
    return tuple(F.col(f"{prefix}{k}") for k in "ltrb")


def area(b: Box) -> Column:
    """Area; zero for a degenerate box."""
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def signed_area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Box:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def overlaps(a: Box, b: Box) -> Column:
    """Boxes share an inner point; touching edges do not count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; zero where the union is empty."""
    both = area(intersection(a, b))
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def generalised_iou(a: Box, b: Box) -> Column:
    """IoU less the share of the hull that neither box covers."""
    both = area(intersection(a, b))
    whole = area(a) + area(b) - both
    hull = area(union(a, b))
    return both / whole - (hull - whole) / hull


def over_second(a: Box, b: Box) -> Column:
    """Share of the second box that the first covers."""
    return area(intersection(a, b)) / area(b)


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """Corners of a centre box, in the type of its columns."""
    half = F.lit(0.5).cast("float")
    return cx - half * w, cy - half * h, cx + half * w, cy + half * h


def to_centre(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def merge_span(first: Box, last: Box) -> Box:
    """One centre box for a horizontal span from its first and last boxes: centre, width, height.

    The width runs between the outer edges; the height from the first one's top to the last one's bottom.
    """
    left, right = first[0] - first[2] / 2, last[0] + last[2] / 2
    top = F.least(first[1] - first[3] / 2, last[1] - last[3] / 2)
    width = right - left
    height = last[1] + last[3] / 2 - (first[1] - first[3] / 2)
    return left + width / 2, top + height / 2, width, height


def to_page(b: Box, region: Box) -> Box:
    """A box in shares of a region, in page units."""
    w, h = region[2] - region[0], region[3] - region[1]
    return region[0] + w * b[0], region[1] + h * b[1], region[0] + w * b[2], region[1] + h * b[3]


def scaled(b: Box, factor: Column) -> Box:
    return tuple(x * factor for x in b)


def page_scale(height: Column, to: float = 1024.0) -> Column:
    """Factor that brings a page to a height."""
    return F.lit(to) / height


def round_clamped(b: Box, width: Column, height: Column) -> Box:
    """Corners rounded half to even, kept on the page, right and bottom not before left and top."""
    inside = lambda x, most: F.greatest(F.lit(0), F.least(F.rint(x).cast("int"), most.cast("int")))
    left, top = inside(b[0], width), inside(b[1], height)
    return left, top, F.greatest(left, inside(b[2], width)), F.greatest(top, inside(b[3], height))


def unpad(b: Box, share_x: Column, share_y: Column) -> Box:
    """Boxes of an image padded around its centre, in shares of the image without padding, within 0 and 1."""
    x = lambda v: F.least(F.greatest((v - 0.5) * share_x + 0.5, F.lit(0.0)), F.lit(1.0))
    y = lambda v: F.least(F.greatest((v - 0.5) * share_y + 0.5, F.lit(0.0)), F.lit(1.0))
    return x(b[0]), y(b[1]), x(b[2]), y(b[3])


def to_table_image(b: Box, region: Box, page_height: Column) -> Box:
    """Page coordinates from the bottom left to those of the table's image from the top left."""
    return b[0] - region[0], page_height - b[3] - region[1], b[2] - region[0], page_height - b[1] - region[1]


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def aligned_left(alignment: Column, x: Column, width: Column) -> Column:
    """Left edge of a box of ``width`` whose left, middle or right stands at ``x``."""
    return F.when(alignment == "left", x).when(alignment == "middle", x - width / 2).otherwise(x - width)


def band_depth(centre_a: Column, centre_b: Column) -> Column:
    """Distance of two centres, rounded half to even."""
    return F.rint(F.abs(centre_a - centre_b))


def unscaled(b: Box, factor: Column) -> Box:
    return tuple(x / factor for x in b)


def scaled_width(width: Column, height: Column, to: float = 1024.0) -> Column:
    """Width of a page brought to a height, cut to whole pixels."""
    return (width * page_scale(height, to)).cast("long")


def resized(centre: Box, x: Column, y: Column) -> Box:
    """A centre box of an image whose width and height are scaled by x and y."""
    return centre[0] * x, centre[1] * y, centre[2] * x, centre[3] * y
