"""Raster pixel tables: zonal statistics, composites, clip, warp
(F8-F11, F13, G11-G13, G17, P13, A8-A11, A20-A22).

A raster is a pixel table (``row, col`` or map ``x, y`` plus band columns,
nodata as NULL).  Zonal statistics assign each pixel once to the zone that
contains its centre (``spatial.assign_points_to_zones``) and aggregate per
zone with partial aggregation before the shuffle; zones without pixels are
kept with NULL statistics by a left join from the zone table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import spatial

# Sentinel-2 QA60 cloud and cirrus bits.
QA_CLOUD_BIT = 10
QA_CIRRUS_BIT = 11


# ---------------------------------------------------------------- filters

def date_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """F8 half-open date range ``start <= ts < end`` (X13 date literals
    compared natively, pushed to the scan)."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
                    & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def cloud_filter(df: DataFrame, max_pct: float = 20, col: str = "cloud_pct") -> DataFrame:
    """F9 scene metadata filter ``cloud_pct < max_pct``."""
    return df.where(F.col(col) < max_pct)


def qa_clear(qa: str = "qa60"):
    """F11 clear-sky mask: neither the cloud nor the cirrus bit is set
    (X12 bitwise AND with shifted bits)."""
    q = F.col(qa)
    return ((q.bitwiseAND(F.shiftleft(F.lit(1), QA_CLOUD_BIT)) == 0)
            & (q.bitwiseAND(F.shiftleft(F.lit(1), QA_CIRRUS_BIT)) == 0))


def bbox_overlap(minx, miny, maxx, maxy, region: tuple[float, float, float, float]):
    """F10 footprint-intersects-region prefilter on bounding boxes."""
    rx0, ry0, rx1, ry1 = region
    return ((F.col(minx) <= rx1) & (F.col(maxx) >= rx0) & (F.col(miny) <= ry1) & (F.col(maxy) >= ry0))


# ---------------------------------------------------------------- composites

def mean_composite(scenes: DataFrame, keys: Sequence[str] = ("pixel",), value: str = "value") -> DataFrame:
    """A20 temporal mean per pixel."""
    return scenes.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_obs"))


def masked_median_composite(scenes: DataFrame, start: str, end: str, max_cloud: float = 20,
                            keys: Sequence[str] = ("pixel",), value: str = "value") -> DataFrame:
    """F8 + F9 + F11 + A21: per-pixel median over clear observations.

    The exact median comes from ``quantile.exact_median``: a pixel's stack
    goes to one bounded ``percentile`` buffer, and a pixel holding more than
    the bound is refined by histogram passes instead of gathered in one
    task.  The observation count is a plain aggregate joined on the pixel.
    """
    from regionlens.operators.quantile import exact_median

    s = cloud_filter(date_range(scenes, start, end), max_cloud).where(qa_clear())
    med = exact_median(s, value, list(keys)).withColumnRenamed(value, "median_value")
    cnt = s.groupBy(*keys).agg(F.count(value).alias("n_obs"))
    return med.join(cnt, list(keys))


# ---------------------------------------------------------------- bands

def split_bands(pixels: DataFrame, keys: Sequence[str], bands: Sequence[int],
                names: Sequence[str], band: str = "band", value: str = "value") -> DataFrame:
    """P13 band-indexed pixels -> one column per band (explicit pivot list)."""
    wide = pixels.groupBy(*keys).pivot(band, list(bands)).agg(F.first(value))
    return wide.select(*keys, *[F.col(str(b)).alias(n) for b, n in zip(bands, names)])


def complete_case(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """F13 keep pixels valid in all bands at once."""
    cond = F.lit(True)
    for b in bands:
        cond = cond & F.col(b).isNotNull() & ~F.isnan(F.col(b))
    return pixels.where(cond)


# ---------------------------------------------------------------- zonal

def zonal_stats(pixels: DataFrame, zones: DataFrame, key: str, value: str, cell_size: float,
                prefix: str = "viirs") -> DataFrame:
    """J8 + A8 (+ A11): mean, population std, max, sum and count of a
    band per zone.  Every zone is kept (left join);
    a zone without valid pixels gets NULL statistics (count 0)."""
    inz = spatial.assign_points_to_zones(pixels.select("x", "y", value), zones, [key], cell_size)
    v = F.col(value)
    aggs = [F.avg(v).alias(f"{prefix}_mean"), F.stddev_pop(v).alias(f"{prefix}_std"),
            F.max(v).alias(f"{prefix}_max"), F.sum(v).alias(f"{prefix}_sum"),
            F.count(v).alias(f"{prefix}_count")]
    st = inz.groupBy(key).agg(*aggs)
    return (zones.select(key).join(st, key, "left")
            .withColumn(f"{prefix}_count", F.coalesce(F.col(f"{prefix}_count"), F.lit(0))))


def zonal_median(pixels: DataFrame, zones: DataFrame, key: str, value: str, cell_size: float,
                 prefix: str = "viirs") -> DataFrame:
    """A10 exact zonal median by histogram refinement per zone
    (``quantile.exact_quantiles``): a hot zone never gathers its values in
    one task."""
    from regionlens.operators.quantile import exact_median

    inz = spatial.assign_points_to_zones(pixels.select("x", "y", value).where(F.col(value).isNotNull()),
                                         zones, [key], cell_size)
    st = exact_median(inz, value, [key], materialize_input=True).withColumnRenamed(value, f"{prefix}_median")
    return zones.select(key).join(st, key, "left")


def zonal_indices(pixels: DataFrame, zones: DataFrame, key: str, cell_size: float,
                  nir: str = "nir", red: str = "red", swir: str = "swir") -> DataFrame:
    """F13 + G14-G16 + A9: per zone band means, NDVI mean / population std,
    NDBI mean and NDWI mean over complete-case pixels."""
    px = complete_case(pixels.select("x", "y", nir, red, swir), [nir, red, swir])
    inz = spatial.assign_points_to_zones(px, zones, [key], cell_size)
    nd_v, nd_b, nd_w = geo.ndvi(nir, red), geo.ndbi(swir, nir), geo.ndwi(nir, swir)
    st = inz.groupBy(key).agg(
        F.avg(red).alias("s2_red_mean"), F.avg(nir).alias("s2_nir_mean"), F.avg(swir).alias("s2_swir_mean"),
        F.avg(nd_v).alias("s2_ndvi_mean"), F.stddev_pop(nd_v).alias("s2_ndvi_std"),
        F.avg(nd_b).alias("s2_ndbi_mean"), F.avg(nd_w).alias("s2_ndwi_mean"),
        F.count(F.lit(1)).alias("s2_count"))
    return (zones.select(key).join(st, key, "left")
            .withColumn("s2_count", F.coalesce("s2_count", F.lit(0))))


def zonal_features(pixels: DataFrame, zones: DataFrame, key: str, cell_size: float, light: str = "light",
                   nir: str = "nir", red: str = "red", swir: str = "swir") -> DataFrame:
    """A8 + A9 in one pass: each pixel is assigned to its zone once and one
    grouped aggregate computes the light statistics (over valid light
    values; NULL and NaN are none) and the spectral statistics (over complete-case pixels only, as
    conditional aggregates)."""
    px = pixels.select("x", "y", light, nir, red, swir)
    inz = spatial.assign_points_to_zones(px, zones, [key], cell_size)
    valid = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    ok = valid(nir) & valid(red) & valid(swir)

    def cc(c):
        return F.when(ok, c)

    v = F.when(valid(light), F.col(light))
    st = inz.groupBy(key).agg(
        F.avg(v).alias("viirs_mean"), F.stddev_pop(v).alias("viirs_std"), F.max(v).alias("viirs_max"),
        F.sum(v).alias("viirs_sum"),
        F.avg(cc(F.col(red))).alias("s2_red_mean"), F.avg(cc(F.col(nir))).alias("s2_nir_mean"),
        F.avg(cc(F.col(swir))).alias("s2_swir_mean"),
        F.avg(cc(geo.ndvi(nir, red))).alias("s2_ndvi_mean"),
        F.stddev_pop(cc(geo.ndvi(nir, red))).alias("s2_ndvi_std"),
        F.avg(cc(geo.ndbi(swir, nir))).alias("s2_ndbi_mean"),
        F.avg(cc(geo.ndwi(nir, swir))).alias("s2_ndwi_mean"))
    return zones.select(key).join(st, key, "left")


# ---------------------------------------------------------------- grid ops

def with_centres(grid: DataFrame, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """G11 add pixel-centre map coordinates."""
    c = geo.pixel_centre("row", "col", x0, dx, y0, dy)
    return grid.withColumn("x", c.x).withColumn("y", c.y)


def clip_raster(grid: DataFrame, zones: DataFrame, x0: float, dx: float, y0: float, dy: float,
                cell_size: float, value: str = "value") -> DataFrame:
    """G13 clip to a boundary by the pixel-centre rule and crop to the
    extent of the kept pixels (G17): row/col become relative to the crop."""
    px = with_centres(grid, x0, dx, y0, dy)
    kept = spatial.clip_points(px, zones, cell_size)
    ext = kept.agg(F.min("row").alias("r0"), F.min("col").alias("c0")).first()
    r0 = ext["r0"] if ext["r0"] is not None else 0
    c0 = ext["c0"] if ext["c0"] is not None else 0
    return kept.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"),
                       F.col("row").alias("src_row"), F.col("col").alias("src_col"), value)


def zone_extent(pixels: DataFrame, zones: DataFrame, key: str, cell_size: float) -> DataFrame:
    """G17 per-zone bounding box of the pixels it contains."""
    inz = spatial.assign_points_to_zones(pixels.select("x", "y"), zones, [key], cell_size)
    return inz.groupBy(key).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"),
                                F.min("y").alias("min_y"), F.max("y").alias("max_y"),
                                F.count(F.lit(1)).alias("n_pixels"))


def raster_shape(grid: DataFrame, value: str = "value") -> DataFrame:
    """A22 raster height, width and global maximum."""
    return grid.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"),
                    F.max(value).alias("max_value"))


def bilinear_warp(grid: DataFrame, factor_x: float, factor_y: float, value: str = "value") -> DataFrame:
    """G12 bilinear resampling onto a target grid whose pixels are
    ``factor_x`` x ``factor_y`` source pixels.

    Target pixel centres map back to fractional source coordinates; each
    target pixel is equi-joined to its (up to) four surrounding source
    pixels; the value is the weight-normalised sum over the neighbours that
    exist and are valid (NULL when none is).  The target grid is generated
    from the source extent, so its size follows the data; a last row or
    column that the source fills only in part is kept.  An empty raster
    gives an empty one.
    """
    ext = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"),
                   F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    spark = grid.sparkSession
    if ext["r0"] is None or ext["c0"] is None:
        return spark.createDataFrame([], f"row bigint, col int, {value} double")
    h = math.ceil((ext["r1"] - ext["r0"] + 1) / factor_y)
    w = math.ceil((ext["c1"] - ext["c0"] + 1) / factor_x)
    # a row of Spark's range per pixel: spread over the tasks, and of a size that Spark knows
    tgt = spark.range(h * w).select(F.expr(f"id div {w}").alias("trow"), (F.col("id") % w).cast("int").alias("tcol"))
    # centre of target pixel in source pixel units, then to source-centre grid
    sr = F.lit(float(ext["r0"])) + (F.col("trow") + 0.5) * factor_y - 0.5
    sc = F.lit(float(ext["c0"])) + (F.col("tcol") + 0.5) * factor_x - 0.5
    return _bilinear(tgt.select("trow", "tcol", sr.alias("_sr"), sc.alias("_sc")), grid, value)


def _bilinear(tgt: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """row, col and value of target pixels (trow, tcol) whose centres lie at the fractional source
    place (_sr, _sc): the normalised sum over the neighbours that exist and are valid (NULL when
    none is)."""
    t = tgt
    t = t.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                                          for a in (0, 1) for b in (0, 1)])).alias("_n"))
    t = t.select("trow", "tcol", F.col("_n.a").alias("_a"), F.col("_n.b").alias("_b"),
                 (F.floor("_sr") + F.col("_n.a")).cast("long").alias("row"),
                 (F.floor("_sc") + F.col("_n.b")).cast("long").alias("col"),
                 (1 - F.abs(F.col("_sr") - (F.floor("_sr") + F.col("_n.a")))).alias("_wr"),
                 (1 - F.abs(F.col("_sc") - (F.floor("_sc") + F.col("_n.b")))).alias("_wc"))
    src = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                      F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    j = t.join(src, ["row", "col"])
    wgt = F.col("_wr") * F.col("_wc")
    # each neighbour lands in its own slot (max of one value: order-free), so
    # the weighted sum below always adds in the same order and is
    # reproducible to the last bit
    slots = [(a, b) for a in (0, 1) for b in (0, 1)]
    aggs = []
    for a, b in slots:
        hit = (F.col("_a") == a) & (F.col("_b") == b)
        aggs += [F.max(F.when(hit, wgt * F.col("_v"))).alias(f"_p{a}{b}"), F.max(F.when(hit, wgt)).alias(f"_w{a}{b}")]
    agg = j.groupBy("trow", "tcol").agg(*aggs)
    num = None
    den = None
    for a, b in slots:
        pn = F.coalesce(F.col(f"_p{a}{b}"), F.lit(0.0))
        wn = F.coalesce(F.col(f"_w{a}{b}"), F.lit(0.0))
        num = pn if num is None else num + pn
        den = wn if den is None else den + wn
    return (tgt.select("trow", "tcol").join(agg.select("trow", "tcol", num.alias("_num"), den.alias("_den")), ["trow", "tcol"], "left")
            .select(F.col("trow").alias("row"), F.col("tcol").alias("col"),
                    F.try_divide("_num", "_den").alias(value)))


def _quads(grid: DataFrame, value: str) -> DataFrame:
    """_nr, _nc and _v00 to _v11: the valid values at the corners of each square between the centres
    of four neighbouring pixels, from (row, col) = (_nr, _nc) on; squares without any are left out."""
    slots = [(a, b) for a in (0, 1) for b in (0, 1)]
    src = grid.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).alias("_v"))
    put = src.where("_r IS NOT NULL AND _c IS NOT NULL AND _v IS NOT NULL").select("_r", "_c", "_v", F.explode(F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in slots])).alias("_n"))
    own = lambda a, b: F.when((F.col("_n.a") == a) & (F.col("_n.b") == b), F.col("_v"))
    return put.groupBy((F.col("_r") - F.col("_n.a")).alias("_nr"), (F.col("_c") - F.col("_n.b")).alias("_nc")).agg(
        *[F.max(own(a, b)).alias(f"_v{a}{b}") for a, b in slots])


def reproject(grid: DataFrame, zone: int, res: float, lon0: float, dlon: float, lat0: float, dlat: float,
              north: bool = True, edge_points: int = 21, value: str = "value", covered: bool = False) -> DataFrame:
    """G12 a lon/lat raster onto a UTM grid of square pixels of ``res`` metres, bilinear.

    The source pixel (row, col) covers lon0 + col dlon .. and lat0 + row dlat ...  The target's
    bounds are those of the source's edges, of which ``edge_points`` places a side are
    projected (edges are curved in the target), widened to whole pixels.  Each square between
    four neighbouring source pixels is projected to find the target pixels near it; their
    centres are traced back, and those inside weigh the four values.  So the work grows with
    the source and not with the target's bounds, which a long curved raster fills in small
    part.  Output: row and col (from the lower left), the value, NULL where no valid
    neighbour is, and weight, the share of the neighbours that was valid; with ``covered``
    without the pixels that have no valid neighbour.  An empty raster gives an empty one.
    """
    spark = grid.sparkSession
    e = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if e["r0"] is None or e["c0"] is None:
        return spark.createDataFrame([], f"row bigint, col bigint, {value} double, weight double")
    x0, x1 = lon0 + e["c0"] * dlon, lon0 + (e["c1"] + 1) * dlon
    y0, y1 = lat0 + e["r0"] * dlat, lat0 + (e["r1"] + 1) * dlat
    share = [i / (edge_points - 1) for i in range(edge_points)]
    edge = [(x0 + (x1 - x0) * s, y) for s in share for y in (y0, y1)] + [(x, y0 + (y1 - y0) * s) for s in share for x in (x0, x1)]
    b = (spark.createDataFrame(edge, "lon double, lat double").select(geo.to_utm("lon", "lat", zone, north).alias("p"))
         .agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1")).first())
    left, low = math.floor(b["x0"] / res), math.floor(b["y0"] / res)
    w, h = math.ceil(b["x1"] / res) - left, math.ceil(b["y1"] / res) - low
    values = [f"_v{a}{b}" for a in (0, 1) for b in (0, 1)]
    # the box of the square's corners and the middles of its sides; a side that bends like a
    # parabola leaves the box of its three places by an eighth of it at most
    places = F.array(*[F.struct((lon0 + (F.col("_nc") + j) * dlon).alias("lon"), (lat0 + (F.col("_nr") + i) * dlat).alias("lat"))
                       for i in (0.5, 1.0, 1.5) for j in (0.5, 1.0, 1.5) if (i, j) != (1.0, 1.0)])
    placed = (_quads(grid, value).withColumn("_q", F.explode(places))
              .select("_nr", "_nc", *values, geo.to_utm("_q.lon", "_q.lat", zone, north).alias("_p"))
              .groupBy("_nr", "_nc").agg(*[F.max(v).alias(v) for v in values],
                                         *[f(f"_p.{c}").alias(f"_{c}{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]))

    def near(axis: str, start: int, size: int) -> Column:
        """The target's rows or columns whose centres may be inside; a millimetre for the series' error."""
        lo, hi = F.col(f"_{axis}lo"), F.col(f"_{axis}hi")
        slack = (hi - lo) / 8 + (0.001 + 0.001 * res)
        first = F.greatest(F.lit(0).cast("long"), F.ceil((lo - slack) / res - (start + 0.5)))
        last = F.least(F.lit(size - 1).cast("long"), F.floor((hi + slack) / res - (start + 0.5)))
        return F.when(first <= last, F.sequence(first, last))

    spans = placed.select("_nr", "_nc", *values, near("y", low, h).alias("_rows"), near("x", left, w).alias("_cols"))
    tried = spans.withColumn("trow", F.explode("_rows")).withColumn("tcol", F.explode("_cols")).drop("_rows", "_cols")
    at = tried.withColumn("_g", geo.from_utm(F.lit(left * res) + (F.col("tcol") + 0.5) * res,
                                             F.lit(low * res) + (F.col("trow") + 0.5) * res, zone, north))
    at = at.select("trow", "tcol", "_nr", "_nc", *values, ((F.col("_g.y") - lat0) / dlat - 0.5).alias("_sr"),
                   ((F.col("_g.x") - lon0) / dlon - 0.5).alias("_sc"))
    at = at.where((F.floor("_sr") == F.col("_nr")) & (F.floor("_sc") == F.col("_nc")))
    num = den = None
    for a in (0, 1):
        for b in (0, 1):
            v = F.col(f"_v{a}{b}")
            wgt = (1 - F.abs(F.col("_sr") - (F.col("_nr") + a))) * (1 - F.abs(F.col("_sc") - (F.col("_nc") + b)))
            p, s = F.when(v.isNotNull(), wgt * v).otherwise(0.0), F.when(v.isNotNull(), wgt).otherwise(0.0)
            num, den = (p, s) if num is None else (num + p, den + s)
    out = at.select(F.col("trow").alias("row"), F.col("tcol").alias("col"), num.alias("_num"), den.alias("weight")).select(
        "row", "col", F.try_divide("_num", "weight").alias(value), "weight")
    if covered:
        return out
    # whole pixels, spread over the session's tasks
    tgt = spark.range(w * h).select((F.expr(f"id div {w}")).alias("row"), (F.col("id") % w).alias("col"))
    return tgt.join(out.hint("merge"), ["row", "col"], "left")
