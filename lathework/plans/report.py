"""Reports of detections as SVG and HTML text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..functions.values import finite, fixed2, half_up
from ..sources.files import write_files

STYLE = "body{font:15px/1.4 sans-serif;margin:2em auto;max-width:70em}section{padding:1em 0}section+section{border-top:2px solid silver}h2{font-size:1em}svg{display:block;max-width:100%;height:auto}"


def pixels(b: Column, width: Column, height: Column) -> Column:
    """x, y, w, h of a box within its frame: clamped, its edges put in order; null where a coordinate is not finite."""
    c = F.transform(b, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    good = (F.size(b) == 4) & F.forall(b, lambda x: F.coalesce(finite(x), F.lit(False)))
    x0, x1 = F.least(c[0], c[2]), F.greatest(c[0], c[2])
    y0, y1 = F.least(c[1], c[3]), F.greatest(c[1], c[3])
    return F.when(good, F.struct((x0 * width).alias("x"), (y0 * height).alias("y"), ((x1 - x0) * width).alias("w"), ((y1 - y0) * height).alias("h")))


def frame_side(x: Column) -> Column:
    return F.when(finite(x) & (x > 0), x).otherwise(0.0)


def raster_uri(uri: Column) -> Column:
    """An address of base64 JPEG or PNG data; null for any other."""
    return F.when(uri.startswith("data:image/jpeg;base64,") | uri.startswith("data:image/png;base64,"), uri)


def _s(x: Column) -> Column:
    return half_up(x).cast("string")


def detection_svg(p: Column, title: Column, label: Column) -> Column:
    lit = F.lit
    return F.concat(
        lit('<g><rect x="'), _s(p["x"]), lit('" y="'), _s(p["y"]), lit('" width="'), _s(p["w"]), lit('" height="'), _s(p["h"]),
        lit('" fill="none" stroke="blue" stroke-width="2"><title>'), xml_escape(title), lit('</title></rect><text x="'), _s(p["x"] + 2),
        lit('" y="'), _s(p["y"] + 14), lit('" fill="blue" font-size="14" font-family="sans-serif">'), xml_escape(label), lit("</text></g>"),
    )


def svg(width: Column, height: Column, detections: Column, uri: Column | None = None) -> Column:
    """A page of boxes; ``detections`` are (bbox, title, label); boxes that are not finite are left out."""
    lit, w, h = F.lit, _s(frame_side(width)), _s(frame_side(height))
    head = F.concat(lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, lit('" height="'), h, lit('" viewBox="0 0 '), w, lit(" "), h, lit('">'))
    image = lit("")
    if uri is not None:
        u = xml_escape(F.when(uri.startswith("data:image/"), uri))
        image = F.when(
            F.coalesce(uri.startswith("data:image/"), lit(False)),
            F.concat(lit('<image x="0" y="0" width="'), w, lit('" height="'), h, lit('" href="'), u, lit('" xlink:href="'), u, lit('"/>')),
        ).otherwise("")
    boxes = F.transform(detections, lambda d: detection_svg(pixels(d["bbox"], frame_side(width), frame_side(height)), d["title"], d["label"]))
    return F.concat(head, image, F.array_join(F.filter(boxes, lambda x: x.isNotNull()), ""), lit("</svg>"))


def detection_label(rendered: Column, common: Column, scientific: Column, rank_name: Column) -> Column:
    """What is written at a box: the rendered keyword, else the first name that is there, else ``bird``."""
    return F.coalesce(F.when(rendered != "", rendered), common, scientific, rank_name, F.lit("bird"))


def detection_title(common: Column, scientific: Column, confidence: Column, rank: Column, rank_name: Column) -> Column:
    """What is shown over a box: names, confidence with two digits, and rank; a ``?`` for what is missing or not a number."""
    shown = F.coalesce(fixed2(F.when(~F.isnan(confidence), confidence)), F.lit("?"))
    return F.concat(
        F.coalesce(common, scientific, F.lit("bird")), F.lit(" ("), F.coalesce(scientific, F.lit("?")), F.lit(")  conf="), shown,
        F.lit("  rank="), F.coalesce(rank, rank_name, F.lit("?")),
    )


def report_name(index: Column) -> Column:
    """``report-00007.svg``: at least five digits."""
    n = index.cast("long").cast("string")
    return F.concat(F.lit("report-"), F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n), F.lit(".svg"))


def write_reports(pages: DataFrame, path: str) -> None:
    """A file for each row (index, svg)."""
    write_files(pages.select(report_name(F.col("index")).alias("name"), F.encode("svg", "UTF-8").alias("content")), path)


def section(label: Column, labels: Column, body: Column) -> Column:
    """A photo's part of the gallery: its caption, the labels of its detections, and its SVG."""
    caption = F.concat(xml_escape(label), F.array_join(F.transform(labels, lambda x: F.concat(F.lit(" &middot; "), xml_escape(x))), ""))
    return F.concat(F.lit("<section><h2>"), caption, F.lit("</h2>"), body, F.lit("</section>"))


def gallery(sections: Column, title: str = "detections") -> Column:
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body>'
    return F.concat(F.lit(head), F.array_join(sections, ""), F.lit("</body></html>"))
