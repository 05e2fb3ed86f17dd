"""Queries of the pixel statistics."""

from ..operators import pixels
from ..sources import testviews as T
from .core import query, view


@query("e1_edge_density", "SELECT image_id, edge_density FROM edges")
def _(spark, folder):
    return pixels.edge_density(T.pixels(spark, folder))


view("framed", """
SELECT p.*, w, h, cr, cg, cb FROM (SELECT image_id, y, x, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM pixels) p
JOIN (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, max(CAST(r AS BIGINT)) FILTER (x = 0 AND y = 0) AS cr, max(CAST(g AS BIGINT)) FILTER (x = 0 AND y = 0) AS cg,
  max(CAST(b AS BIGINT)) FILTER (x = 0 AND y = 0) AS cb FROM pixels GROUP BY image_id) s USING (image_id)""")


@query("e2_z_direction", """
SELECT image_id, CASE WHEN nb >= 1 AND nc >= 1 THEN CASE WHEN my < mc THEN 'up' WHEN my > mc THEN 'down' END END AS z_dir FROM (
SELECT image_id, count(*) FILTER (blue) AS nb, count(*) FILTER (cyan) AS nc, avg(y) FILTER (blue) AS my, avg(y) FILTER (cyan) AS mc FROM (
SELECT image_id, y, y >= floor(h * 0.55e0) AND x >= floor(w * 0.55e0) AND b > 110 AND r < 60 AND g < 60 AS blue,
  y >= floor(h * 0.55e0) AND x >= floor(w * 0.55e0) AND r < 90 AND g > 150 AND b > 150 AS cyan FROM framed) a GROUP BY image_id) b""")
def _(spark, folder):
    return pixels.z_direction(T.pixels(spark, folder), blue_min=1, cyan_min=1, dead_band=0.0)


@query("e3_red_count", """
SELECT image_id, count(*) FILTER (r > 200 AND g < 50 AND b < 50 AND NOT (y < floor(h * 0.62e0) AND x < floor(w * 0.27e0))
  AND NOT (y >= floor(h * 0.55e0) AND x >= floor(w * 0.80e0))) AS red_px FROM framed GROUP BY image_id""")
def _(spark, folder):
    return pixels.red_count(T.pixels(spark, folder))


@query("e4_content_bbox", """
SELECT image_id, CASE WHEN applied THEN l ELSE 0 END AS box_l, CASE WHEN applied THEN t ELSE 0 END AS box_t, CASE WHEN applied THEN r ELSE w END AS box_r, CASE WHEN applied THEN b ELSE h END AS box_b, applied
FROM (SELECT *, coalesce((r - l) * (b - t) < 0.97e0 * w * h, false) AS applied FROM (
SELECT image_id, w, h, greatest(0, x0 - pad) AS l, greatest(0, y0 - pad) AS t, least(w, x1 + 1 + pad) AS r, least(h, y1 + 1 + pad) AS b FROM (
SELECT image_id, any_value(w) AS w, any_value(h) AS h, greatest(0, CAST(floor(0.012e0 * greatest(any_value(w), any_value(h))) AS BIGINT)) AS pad,
  min(x) FILTER (d > 14) AS x0, min(y) FILTER (d > 14) AS y0, max(x) FILTER (d > 14) AS x1, max(y) FILTER (d > 14) AS y1
FROM (SELECT *, floor((abs(r - cr) * 19595 + abs(g - cg) * 38470 + abs(b - cb) * 7471 + 32768) / 65536) AS d FROM framed) a GROUP BY image_id) b) c) d""")
def _(spark, folder):
    # 8 x 8 pictures: no minimum border, or nothing would ever be cut
    return pixels.content_bbox(T.pixels(spark, folder), min_pad=0)


@query("e5_analysis_scale", """
SELECT job_id, id, least(1.0e0, 3000.0e0 / greatest(width, height)) AS k_analysis, least(1.0e0, 2600.0e0 / greatest(width, height)) AS k_place FROM pictures""")
def _(spark, folder):
    return pixels.analysis_scale(T.pictures(spark, folder))
