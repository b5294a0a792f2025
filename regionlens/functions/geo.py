"""Geometry, projection and raster column expressions.

Geometries are plain nested columns, so every measure below is a native
Spark expression (higher-order functions over arrays) and runs in the JVM:

* point:    two double columns ``x``, ``y``
* line:     ``array<struct<x:double,y:double>>`` (one part)
* polygon:  ``array<array<struct<x:double,y:double>>>`` -- ring 1 is the
            shell, further rings are holes; rings are closed (last = first).

Multi-part geometries are one row per part (``posexplode``, P14).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double>"
LINE_TYPE = f"array<{POINT_TYPE}>"
POLYGON_TYPE = f"array<array<{POINT_TYPE}>>"
EDGE_TYPE = "struct<ax:double,ay:double,bx:double,by:double>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _s(v) -> str:
    """SQL text of an argument: a column name / SQL expression, or a number.

    Lambda-heavy expressions are written as Spark SQL text: one call builds
    the whole tree in the JVM, instead of one Python->JVM call per node."""
    if isinstance(v, bool):
        raise TypeError("expected a column name, SQL expression or number")
    if isinstance(v, (int, float)):
        return f"({float(v)!r}D)"
    if isinstance(v, str):
        return f"({v})"
    raise TypeError("geometry functions take column names, SQL expressions or numbers, "
                    f"not {type(v).__name__}; add the Column to the DataFrame first")


# ---------------------------------------------------------------- builders

def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _ring_edges_sql(r: str) -> str:
    return (f"zip_with(slice({r}, 1, size({r}) - 1), slice({r}, 2, size({r}) - 1), "
            "(pa_, pb_) -> named_struct('ax', pa_.x, 'ay', pa_.y, 'bx', pb_.x, 'by', pb_.y))")


def ring_edges(ring) -> Column:
    """Consecutive vertex pairs of one closed ring or an open line (X14
    array functions: slice / zip_with, flatten in ``polygon_edges``)."""
    return F.expr(_ring_edges_sql(_s(ring)))


def _polygon_edges_sql(rings: str) -> str:
    return f"flatten(transform({rings}, re_ -> {_ring_edges_sql('re_')}))"


def polygon_edges(rings) -> Column:
    """All edges of all rings of a polygon, as ``array<EDGE_TYPE>``."""
    return F.expr(_polygon_edges_sql(_s(rings)))


# ---------------------------------------------------------------- predicates

def _pip_sql(edges: str, x: str, y: str, acc: str = "pacc_", e: str = "pe_") -> str:
    return (f"(aggregate({edges}, 0, ({acc}, {e}) -> {acc} + CASE WHEN (({e}.ay > {y}) <> ({e}.by > {y})) "
            f"AND ({x} < {e}.ax + try_divide(({y} - {e}.ay) * ({e}.bx - {e}.ax), {e}.by - {e}.ay)) "
            "THEN 1 ELSE 0 END) % 2 = 1)")


def point_in_edges(edges, x, y) -> Column:
    """G5 point-in-polygon, even-odd crossing rule over precomputed edges.

    Half-open on both axes: a point on a shared edge belongs to exactly one of
    the two adjoining polygons (the one to its right / above), so tilings
    count every point once.  The crossing abscissa is computed as
    ``ax + (y-ay)*(bx-ax)/(by-ay)``, which is exact on integer vertices.
    """
    return F.expr(_pip_sql(_s(edges), _s(x), _s(y)))


def cell_parity_sql(corner: str, edges: str, x: str, y: str, x1: str, y0: str) -> str:
    """G5 by a cell's own edges: whether (x, y) is inside, from whether the cell's corner (x1, y0) is.

    One goes from the point along its height to the line x = x1 and down that line to the
    corner; each edge met on the way changes sides.  The comparisons are those of
    ``point_in_edges``, so both agree on borders, and edges beyond the way cancel out.
    """
    xc = "(cp_.ax + try_divide((%s - cp_.ay) * (cp_.bx - cp_.ax), cp_.by - cp_.ay))" % y
    yc = "(cp_.ay + try_divide((%s - cp_.ax) * (cp_.by - cp_.ay), cp_.bx - cp_.ax))" % x1
    level = f"((cp_.ay > {y}) <> (cp_.by > {y})) AND (({x} < {xc}) <> ({x1} < {xc}))"
    rises = "(cp_.bx - cp_.ax) * (cp_.by - cp_.ay) > 0"
    upright = (f"((cp_.ax > {x1}) <> (cp_.bx > {x1})) AND CASE WHEN {rises} THEN ({yc} < {y}) <> ({yc} < {y0}) "
               f"ELSE ({yc} <= {y}) <> ({yc} <= {y0}) END")
    return (f"({corner} <> (aggregate({edges}, 0, (cn_, cp_) -> cn_ + CASE WHEN {level} THEN 1 ELSE 0 END "
            f"+ CASE WHEN {upright} THEN 1 ELSE 0 END) % 2 = 1))")


def is_empty(rings) -> Column:
    """F12 empty-geometry test (after a clip)."""
    return F.coalesce(F.size(_c(rings)), F.lit(0)) <= 0


# ---------------------------------------------------------------- measures

def _signed_area_sql(r: str) -> str:
    return f"(aggregate({_ring_edges_sql(r)}, 0.0D, (sa_, ea_) -> sa_ + (ea_.ax * ea_.by - ea_.bx * ea_.ay)) / 2)"


def _moment_sql(r: str, axis: str) -> str:
    return (f"(aggregate({_ring_edges_sql(r)}, 0.0D, (sm_, em_) -> sm_ + (em_.a{axis} + em_.b{axis}) "
            "* (em_.ax * em_.by - em_.bx * em_.ay)) / 6)")


_SIGN = "(CASE WHEN ri_ = 0 THEN 1.0D ELSE -1.0D END)"


def polygon_area(rings) -> Column:
    """G3 polygon area: |shell| minus |holes| (orientation-free)."""
    r = _s(rings)
    return F.expr(f"aggregate(transform({r}, (rr_, ri_) -> {_SIGN} * abs({_signed_area_sql('rr_')})), "
                  "0.0D, (st_, v_) -> st_ + v_)")


def polygon_centroid(rings) -> Column:
    """G2 area-weighted centroid with holes removed; ``struct<x,y>``."""
    r = _s(rings)
    part = (f"transform(array({_signed_area_sql('rr_')}), a_ -> named_struct("
            f"'a', {_SIGN} * abs(a_), 'mx', {_SIGN} * signum(a_) * {_moment_sql('rr_', 'x')}, "
            f"'my', {_SIGN} * signum(a_) * {_moment_sql('rr_', 'y')}))[0]")
    tot = (f"aggregate(transform({r}, (rr_, ri_) -> {part}), named_struct('a', 0.0D, 'mx', 0.0D, 'my', 0.0D), "
           "(sc_, pc_) -> named_struct('a', sc_.a + pc_.a, 'mx', sc_.mx + pc_.mx, 'my', sc_.my + pc_.my))")
    return F.expr(f"transform(array({tot}), t_ -> named_struct('x', try_divide(t_.mx, t_.a), "
                  "'y', try_divide(t_.my, t_.a)))[0]")


def _line_length_sql(line: str) -> str:
    return f"aggregate({_ring_edges_sql(line)}, 0.0D, (sl_, el_) -> sl_ + hypot(el_.bx - el_.ax, el_.by - el_.ay))"


def line_length(line) -> Column:
    """G4 length of a line (sum of segment lengths)."""
    return F.expr(_line_length_sql(_s(line)))


def polygon_perimeter(rings) -> Column:
    """G4 perimeter of all rings (shell and holes), as a polygon's length."""
    return F.expr(f"aggregate(transform({_s(rings)}, rp_ -> {_line_length_sql('rp_')}), 0.0D, "
                  "(sp_, vp_) -> sp_ + vp_)")


def bbox(rings) -> Column:
    """Bounding box of a polygon (or of one line wrapped in an array)."""
    return F.expr(f"transform(array(flatten({_s(rings)})), pts_ -> named_struct("
                  "'minx', array_min(transform(pts_, p_ -> p_.x)), 'miny', array_min(transform(pts_, p_ -> p_.y)), "
                  "'maxx', array_max(transform(pts_, p_ -> p_.x)), 'maxy', array_max(transform(pts_, p_ -> p_.y))))[0]")


def repair_rings(rings) -> Column:
    """G9 light repair: drop repeated consecutive vertices, close open rings,
    drop rings with fewer than 4 vertices or zero area.

    This is not a full polygon-overlay repair (no self-intersection split);
    see the README's list of re-aimed items.
    """
    dedup = "filter(rr_, (p_, i_) -> i_ = 0 OR p_ <> rr_[i_ - 1])"
    closed = (f"transform(array({dedup}), k_ -> CASE WHEN element_at(k_, 1) <> element_at(k_, -1) "
              "THEN concat(k_, array(element_at(k_, 1))) ELSE k_ END)[0]")
    return F.expr(f"filter(transform({_s(rings)}, rr_ -> {closed}), "
                  f"rk_ -> size(rk_) >= 4 AND {_signed_area_sql('rk_')} <> 0)")


def is_valid(rings) -> Column:
    """G9 ring shape: every ring closed, >= 4 vertices, non-zero area.  Crossings and
    holes outside their shell are found by ``operators.validity``."""
    return F.expr(f"size({_s(rings)}) > 0 AND forall({_s(rings)}, rv_ -> size(rv_) >= 4 AND element_at(rv_, 1) = element_at(rv_, -1) "
                  f"AND {_signed_area_sql('rv_')} <> 0)")


# ---------------------------------------------------------------- line clip

def _cut_params_sql(ax, ay, bx, by, edges) -> str:
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    den = f"({dx} * (ec_.by - ec_.ay) - {dy} * (ec_.bx - ec_.ax))"
    t = f"try_divide((ec_.ax - {ax}) * (ec_.by - ec_.ay) - (ec_.ay - {ay}) * (ec_.bx - ec_.ax), {den})"
    s_ = f"try_divide((ec_.ax - {ax}) * {dy} - (ec_.ay - {ay}) * {dx}, {den})"
    return (f"transform(filter(transform({edges}, ec_ -> named_struct('t', {t}, 's', {s_})), "
            "c_ -> c_.s >= 0 AND c_.s <= 1 AND c_.t > 0 AND c_.t < 1), c_ -> c_.t)")


def _segment_cuts_sql(ax, ay, bx, by, edges, t0="0.0D", t1="1.0D") -> str:
    return (f"array_sort(concat(array({t0}), filter({_cut_params_sql(ax, ay, bx, by, edges)}, "
            f"tc_ -> tc_ > {t0} AND tc_ < {t1}), array({t1})))")


def segment_cuts(ax, ay, bx, by, edges, t0="0.0D", t1="1.0D") -> Column:
    """Sorted cut parameters of segment A->B between t0 and t1 (SQL text), with these at the ends."""
    return F.expr(_segment_cuts_sql(_s(ax), _s(ay), _s(bx), _s(by), _s(edges), t0, t1))


def _inside_intervals_sql(ax, ay, bx, by, cuts, inside) -> str:
    mx = f"({ax} + (pi_.t0 + pi_.t1) / 2 * ({bx} - {ax}))"
    my = f"({ay} + (pi_.t0 + pi_.t1) / 2 * ({by} - {ay}))"
    return (f"transform(array({cuts}), ts_ -> filter(zip_with(slice(ts_, 1, size(ts_) - 1), slice(ts_, 2, size(ts_) - 1), "
            f"(u0_, u1_) -> named_struct('t0', u0_, 't1', u1_)), pi_ -> pi_.t1 > pi_.t0 AND {inside(mx, my)}))[0]")


def inside_intervals(ax, ay, bx, by, cuts, inside) -> Column:
    """G6 / G8 the intervals [t0, t1] of segment A->B between consecutive ``cuts`` whose midpoint
    is inside, as ``array<struct<t0,t1>>``.  ``inside(x, y)`` gives the test as SQL text; with a
    half-open one, a piece on a shared border is owned by exactly one polygon."""
    return F.expr(_inside_intervals_sql(_s(ax), _s(ay), _s(bx), _s(by), _s(cuts), inside))


def clipped_segment_length(ax, ay, bx, by, edges) -> Column:
    """G6 length of the part of segment A->B inside a polygon given by all its edges."""
    ax, ay, bx, by, edges = (_s(v) for v in (ax, ay, bx, by, edges))
    spans = _inside_intervals_sql(ax, ay, bx, by, _segment_cuts_sql(ax, ay, bx, by, edges), lambda x, y: _pip_sql(edges, x, y))
    return F.expr(f"aggregate({spans}, 0.0D, (sl_, sp_) -> sl_ + sp_.t1 - sp_.t0) * hypot({bx} - {ax}, {by} - {ay})")


# ---------------------------------------------------------------- G1 UTM

# WGS84 ellipsoid and UTM scale / offsets.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0


_N = WGS84_F / (2.0 - WGS84_F)
_RADIUS = WGS84_A / (1.0 + _N) * (1.0 + _N * _N / 4.0 + _N ** 4 / 64.0)


def _zone_terms(zone, north) -> tuple[Column, Column]:
    """Central meridian in radians and false northing, of numbers or columns."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    n = north if isinstance(north, Column) else F.lit(north)
    return F.radians(z * 6.0 - 183.0), F.when(n, 0.0).otherwise(UTM_FALSE_NORTHING_SOUTH)


def to_utm(lon, lat, zone, north=True) -> Column:
    """G1 WGS84 lon/lat (degrees) -> UTM easting/northing (metres).

    Krueger series to third order in n (sub-millimetre inside a zone), as
    plain column arithmetic; ``zone`` and ``north`` may be columns.  Returns
    ``struct<x,y>``.
    """
    n = _N
    alpha = [n / 2.0 - 2.0 * n * n / 3.0 + 5.0 * n ** 3 / 16.0,
             13.0 * n * n / 48.0 - 3.0 * n ** 3 / 5.0,
             61.0 * n ** 3 / 240.0]
    c = 2.0 * math.sqrt(n) / (1.0 + n)
    lam0, false_north = _zone_terms(zone, north)
    phi = F.radians(_c(lat))
    dlam = F.radians(_c(lon)) - lam0
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(1.0 + t * t))
    east = eta
    north_ = xi
    for j, a_j in enumerate(alpha, start=1):
        east = east + a_j * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north_ = north_ + a_j * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    x = UTM_FALSE_EASTING + UTM_K0 * _RADIUS * east
    y = UTM_K0 * _RADIUS * north_ + false_north
    return F.struct(x.alias("x"), y.alias("y"))


def from_utm(x, y, zone, north=True) -> Column:
    """G1 UTM easting/northing (metres) -> WGS84 lon/lat (degrees), ``struct<x,y>``: the inverse
    series to third order in n."""
    n = _N
    beta = [n / 2.0 - 2.0 * n * n / 3.0 + 37.0 * n ** 3 / 96.0, n * n / 48.0 + n ** 3 / 15.0, 17.0 * n ** 3 / 480.0]
    delta = [2.0 * n - 2.0 * n * n / 3.0 - 2.0 * n ** 3, 7.0 * n * n / 3.0 - 8.0 * n ** 3 / 5.0, 56.0 * n ** 3 / 15.0]
    lam0, false_north = _zone_terms(zone, north)
    xi = (_c(y) - false_north) / (UTM_K0 * _RADIUS)
    eta = (_c(x) - UTM_FALSE_EASTING) / (UTM_K0 * _RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, start=1):
        xi1 = xi1 - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        eta1 = eta1 - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + d * F.sin(2.0 * j * chi)
    lon = F.degrees(lam0 + F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.struct(lon.alias("x"), F.degrees(phi).alias("y"))


def utm_code(lon, lat) -> Column:
    """EPSG code of the UTM zone of a WGS84 point: 32601 to 32660 north, 32701 to 32760 south."""
    zone = F.floor((_c(lon) + 180.0) / 6.0) % 60 + 1
    return (F.when(_c(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_crs(x, y, source, target: int) -> Column:
    """G1 a point in the system of ``source`` (EPSG code, a column) in that of ``target``.

    Known systems are WGS84 lon/lat (4326) and its UTM zones (326zz, 327zz).  A missing
    code is taken to be ``target`` already, equal codes change nothing, and an unknown code
    gives NULL.  Returns ``struct<x,y>``.
    """
    def utm(code):
        return code % 100, F.floor(code / 100) == 326 if isinstance(code, Column) else code // 100 == 326

    if target != 4326 and not (target // 100 in (326, 327) and 1 <= target % 100 <= 60):
        raise ValueError(f"unknown system {target}")
    s = _c(source)
    here = F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))
    in_utm = F.floor(s / 100).isin(326, 327) & (s % 100).between(1, 60)
    degrees = F.when(s == 4326, here).when(in_utm, from_utm(x, y, *utm(s)))
    # a one-element array binds the degrees, which the projection uses many times
    moved = degrees if target == 4326 else F.transform(F.array(degrees), lambda q: to_utm(q.x, q.y, *utm(target)))[0]
    return F.when(s.isNull() | (s == target), here).when((s == 4326) | in_utm, moved)


def rings_to_crs(rings, source, target: int) -> Column:
    """G1 on every vertex of a polygon."""
    return F.transform(_c(rings), lambda r: F.transform(r, lambda p: to_crs(p.x, p.y, source, target)))


# ---------------------------------------------------------------- raster

def pixel_centre(row, col, x0: float, dx: float, y0: float, dy: float) -> Column:
    """G11 affine transform of a pixel centre -> map coordinates."""
    return F.struct((F.lit(x0) + (_c(col) + 0.5) * dx).alias("x"),
                    (F.lit(y0) + (_c(row) + 0.5) * dy).alias("y"))


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b); zero denominator -> NULL (skipped by aggregates)."""
    return F.try_divide(_c(a) - _c(b), _c(a) + _c(b))


def ndvi(nir, red) -> Column:
    """G14 NDVI = (NIR - Red) / (NIR + Red)."""
    return normalized_difference(nir, red)


def ndbi(swir, nir) -> Column:
    """G15 NDBI = (SWIR - NIR) / (SWIR + NIR)."""
    return normalized_difference(swir, nir)


def ndwi(nir, swir) -> Column:
    """G16 NDWI from the kept bands = (NIR - SWIR) / (NIR + SWIR)."""
    return normalized_difference(nir, swir)


def nodata_to_null(c, nodata=None) -> Column:
    """S7 masking: NaN (and an optional nodata value) become NULL."""
    v = _c(c)
    cond = ~F.isnan(v)
    if nodata is not None:
        cond = cond & (v != F.lit(nodata))
    return F.when(cond, v)
