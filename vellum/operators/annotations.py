"""Annotations burnt into pages: each kind becomes drawing primitives in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G

#: Colours that stand in for one that can't be read.
YELLOW, BLACK, BLUE = (1.0, 0.84, 0.0), (0.0, 0.0, 0.0), (0.18, 0.23, 0.36)
FADED = 0.4
_PRIMITIVE = "struct<op:string,x0:double,y0:double,x1:double,y1:double,colour:array<double>,width:double,opacity:double>"


def _number(c: Column, default: float = 0.0) -> Column:
    """Null, 0 and not-a-number count as not given."""
    return F.when(F.coalesce(c, F.lit(0.0)).isin(0.0, float("nan")), F.lit(default)).otherwise(c.cast("double"))


def _colour(c: Column, default: tuple[float, ...]) -> Column:
    return F.coalesce(G.hex_to_rgb(c), F.array(*map(F.lit, default)))


def _one(op: str, x0: Column, y0: Column, x1: Column, y1: Column, colour: Column, width: Column, opacity: Column) -> Column:
    values = zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)
    return F.struct(F.lit(op).alias("op"), *(v.cast("double").alias(k) for k, v in values), colour.alias("colour"), width.cast("double").alias("width"), opacity.cast("double").alias("opacity"))


def burnt_in(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """``annotations`` as (doc_id, page_index, ann_seq, at, op, x0, y0, x1, y1, colour, width, opacity).

    ``annotations(doc_id, page_index, ann_seq, kind, x, y, width, height, rx, ry,
    x1, y1, x2, y2, points, rows, cols, stroke, fill, stroke_width, opacity,
    marker)`` count from the bottom left, ``pages(doc_id, page_index, page_w,
    page_h, rotation)`` give each page's space, in which primitives count from the
    top left of the page as it is shown: a page turned by a quarter swaps sides.
    Kinds: highlight (a filled box), rect, ellipse (by its box), line, path (a
    line for each two points; as a marker it is faded), table (rows and columns
    ruled from edge to edge).  Unknown kinds, paths of fewer than two points and
    pages that don't exist draw nothing.
    """
    kept = [c for c in ("doc_id", "page_index", "ann_seq")]
    both = annotations.alias("a").join(pages.select("doc_id", "page_index", "page_w", "page_h", "rotation"), ["doc_id", "page_index"])
    c = F.col
    ph = c("page_h")
    x, y, w, h = (_number(c(k)) for k in ("x", "y", "width", "height"))
    box = (x, ph - y - h, x + w, ph - y)
    thick = lambda default=1.0: F.greatest(F.lit(0.5), _number(c("stroke_width"), default))
    solid, faded = F.lit(1.0), F.coalesce(c("opacity").cast("double"), F.lit(FADED))
    rx, ry, cy = _number(c("rx")), _number(c("ry")), ph - y
    line = (_number(c("x1")), ph - _number(c("y1")), _number(c("x2")), ph - _number(c("y2")))
    points = F.filter(F.coalesce(c("points"), F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    steps = F.when(F.size(points) >= 2, F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda k: F.struct(F.get(points, k).alias("p"), F.get(points, k + 1).alias("q"))))
    path = F.transform(steps, lambda s: _one("line", s["p"][0], ph - s["p"][1], s["q"][0], ph - s["q"][1], _colour(c("stroke"), YELLOW), thick(2.0), F.when(c("marker"), faded).otherwise(solid)))
    count = lambda k: F.greatest(F.lit(1), F.when(F.coalesce(c(k), F.lit(0)) == 0, 3).otherwise(c(k)))
    rule = lambda x0, y0, x1, y1: _one("line", x0, y0, x1, y1, _colour(c("stroke"), BLUE), _number(c("stroke_width"), 1.0), solid)
    across = F.transform(F.sequence(F.lit(0), count("rows")), lambda r: rule(x, box[1] + h * r / count("rows"), x + w, box[1] + h * r / count("rows")))
    down = F.transform(F.sequence(F.lit(0), count("cols")), lambda k: rule(x + w * k / count("cols"), box[1], x + w * k / count("cols"), box[3]))
    kinds = {
        "highlight": F.array(_one("fill", *box, _colour(c("fill"), YELLOW), F.lit(0.0), faded)),
        "rect": F.array(_one("rect", *box, _colour(c("stroke"), BLACK), thick(), solid)),
        "ellipse": F.array(_one("ellipse", x - rx, cy - ry, x + rx, cy + ry, _colour(c("stroke"), BLACK), thick(), solid)),
        "line": F.array(_one("line", *line, _colour(c("stroke"), BLACK), thick(), solid)),
        "path": path,
        "table": F.concat(across, down),
    }
    drawn = F.lit(None).cast(f"array<{_PRIMITIVE}>")
    for kind, rows in kinds.items():
        drawn = F.when(c("kind") == kind, rows.cast(f"array<{_PRIMITIVE}>")).otherwise(drawn)
    rows = both.select(*kept, "page_w", "page_h", "rotation", F.posexplode(drawn).alias("at", "p"))
    p = {k: F.col(f"p.{k}") for k in ("x0", "y0", "x1", "y1")}
    turn = F.pmod(F.coalesce(c("rotation"), F.lit(0)), F.lit(360))
    px = lambda a, b: F.when(turn == 90, ph - b).when(turn == 180, c("page_w") - a).when(turn == 270, b).otherwise(a)
    py = lambda a, b: F.when(turn == 90, a).when(turn == 180, ph - b).when(turn == 270, c("page_w") - a).otherwise(b)
    shown = [px(p["x0"], p["y0"]).alias("x0"), py(p["x0"], p["y0"]).alias("y0"), px(p["x1"], p["y1"]).alias("x1"), py(p["x1"], p["y1"]).alias("y1")]
    return rows.select(*kept, "at", F.col("p.op").alias("op"), *shown, F.col("p.colour").alias("colour"), F.col("p.width").alias("width"), F.col("p.opacity").alias("opacity"))
