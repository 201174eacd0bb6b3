"""Boxes, colours and placement as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w, h = overlap(a["x0"], a["x1"], b["x0"], b["x1"]), overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def area(b: dict[str, Column]) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x0", "y0", "x1", "y1")}


def unrotated(b: dict[str, Column], deg: Column, w: Column, h: Column) -> Column:
    """Box of a rotated copy in the space of the original."""
    turned = {
        90: (b["y0"], h - b["x1"], b["y1"], h - b["x0"]),
        180: (w - b["x1"], h - b["y1"], w - b["x0"], h - b["y0"]),
        270: (w - b["y1"], b["x0"], w - b["y0"], b["x1"]),
    }
    out = F.struct(*[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")])
    for d, c in turned.items():
        out = F.when(deg == d, F.struct(*[v.alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), c, strict=True)])).otherwise(out)
    return out


def hex_to_rgb(c: Column) -> Column:
    """(r, g, b) in 0..1 from ``#rrggbb`` or ``rgb()``/``rgba()``, else null."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("double") / 255
    css = lambda i: F.regexp_extract(c, r"rgba?\((\d+),\s*(\d+),\s*(\d+)", i).cast("double") / 255
    return F.when(c.rlike("(?i)^#[0-9a-f]{6}$"), F.array(part(2), part(4), part(6))).when(c.rlike(r"rgba?\(\d+,\s*\d+,\s*\d+"), F.array(css(1), css(2), css(3)))


def unit_colour(c: Column) -> Column:
    """Components in 0..1 whichever scale they came in."""
    return F.when(F.array_max(c) > 1.0001, F.transform(c, lambda x: x / 255)).otherwise(c)


def normal_colour(c: Column) -> Column:
    """Gray, RGB or CMYK components to RGB."""
    cmyk = F.transform(F.slice(c, 1, 3), lambda x: (1 - x) * (1 - c[3]))
    return F.when(F.coalesce(F.size(c), F.lit(0)) < 1, F.array(*[F.lit(0.0)] * 3)).when(F.size(c) == 1, F.array_repeat(c[0], 3)).when(F.size(c) == 4, cmyk).otherwise(F.slice(c, 1, 3))


def contrast_text(r: Column, g: Column, b: Column) -> Column:
    return F.when(0.299 * r + 0.587 * g + 0.114 * b < 140, "#ffffff").otherwise("#000000")


def rotated_image_size(w: Column, h: Column, deg: Column) -> tuple[Column, Column]:
    t = F.radians(deg)
    return F.abs(w * F.cos(t)) + F.abs(h * F.sin(t)), F.abs(w * F.sin(t)) + F.abs(h * F.cos(t))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)
