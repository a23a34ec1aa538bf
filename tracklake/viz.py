"""An HTML page with a track drawn on a map, without further packages."""

from __future__ import annotations

import html
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.simplify import simplify

#: Points drawn at most; longer tracks are thinned evenly, keeping first and last.
MOST_POINTS = 50_000
#: Rows of a range in which ranks are counted.
ROWS_PER_RANGE = 1_000_000
ZOOM, WEIGHT, OPACITY = 8, 3, 0.9

_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;background:#eef3f7}}svg{{width:100vw;height:100vh}}</style></head>
<body><svg id="map" data-zoom="{zoom}" data-center="{center}" viewBox="{box}" preserveAspectRatio="xMidYMid meet">
<polyline fill="none" stroke="#1f6fb2" stroke-width="{weight}" stroke-opacity="{opacity}" vector-effect="non-scaling-stroke" points="{points}"/></svg>
<script type="application/json" id="track">{track}</script></body></html>
"""


def _thinned(points: DataFrame, order: list[str], n: int) -> DataFrame:
    """LAT, LON of ``MOST_POINTS`` points, evenly by rank, with the first and the last, in order.

    Ranks are counted within ranges of the order, to which the ranges' sizes add.
    """
    by, key = "__order", F.col(order[0]) if order else F.monotonically_increasing_id()
    if order and dict(points.dtypes)[order[0]] in ("timestamp", "timestamp_ntz", "date"):
        key = F.unix_micros(key.cast("timestamp"))
    rows = points.select("LAT", "LON", key.alias(by))
    dealt = rows.select(by).repartitionByRange(max(32, n // ROWS_PER_RANGE), by)
    borders = sorted(r.least for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(by).alias("least")).collect() if r.least is not None)
    at = F.array(*map(F.lit, borders)) if borders else F.array(F.lit(None).cast(dict(rows.dtypes)[by]))
    rows = rows.withColumn("__range", F.coalesce(F.size(F.filter(at, lambda b: b <= F.col(by))), F.lit(0)))
    before, starts = 0, []
    for r in sorted(rows.groupBy("__range").count().collect(), key=lambda r: r["__range"]):
        starts += [F.lit(r["__range"]), F.lit(before)]
        before += r["count"]
    own = F.row_number().over(Window.partitionBy("__range").orderBy(by))
    ranked = rows.withColumn("__rank", own - 1 + F.element_at(F.create_map(*starts), F.col("__range")))
    scaled = lambda x: F.floor(x * (MOST_POINTS - 1) / F.lit(n - 1))
    kept = (F.col("__rank") == 0) | (scaled(F.col("__rank")) > scaled(F.col("__rank") - 1))
    return ranked.where(kept).orderBy("__rank").select("LAT", "LON")


def plot_track_html(
    df: DataFrame, out_html: str | os.PathLike, title: str = "Track", every_point: bool = False, error_km: float | None = None
) -> Path:
    """Write the track of ``df``, in time order, centred on its mean position.

    A page of more than MOST_POINTS is drawn only if ``every_point`` asks for
    it; the driver then holds all points of the track. With ``error_km`` and a
    time the line is simplified first: no point is farther from it than that.
    """
    if not {"LAT", "LON"} <= set(df.columns):
        raise ValueError("LAT and LON are required")
    points = df.where(F.col("LAT").isNotNull() & F.col("LON").isNotNull())
    order = [c for c in ("ts", "BaseDateTime") if c in df.columns][:1]
    n, lat, lon = points.agg(F.count(F.lit(1)), *(F.avg(F.col(c).cast("double")) for c in ("LAT", "LON"))).first()
    if not n:
        raise ValueError("There are no points to draw")
    if error_km is not None and order:
        points = simplify(points, error_km, key=None)
        order, n = ["ts"], points.count()
    unsorted, points = points, points.orderBy(*order) if order else points
    rows = points.select("LAT", "LON")
    if n > MOST_POINTS and not every_point:
        drawn = _thinned(unsorted, order, n).collect()
    else:
        drawn = rows.collect()
    track = [(float(r.LAT), float(r.LON)) for r in drawn]
    margin = 0.02 + max(max(p[i] for p in track) - min(p[i] for p in track) for i in (0, 1)) * 0.05
    box = [min(p[1] for p in track) - margin, -max(p[0] for p in track) - margin]
    box += [max(p[1] for p in track) + margin - box[0], -min(p[0] for p in track) + margin - box[1]]
    page = _PAGE.format(
        title=html.escape(title), zoom=ZOOM, center=f"{lat:.6f},{lon:.6f}", box=" ".join(f"{v:.6f}" for v in box),
        weight=WEIGHT, opacity=OPACITY, points=" ".join(f"{b:.6f},{-a:.6f}" for a, b in track), track=json.dumps(track),
    )
    out = Path(out_html)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(page, encoding="utf-8")
    return out
