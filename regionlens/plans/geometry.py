"""Queries on projections, clipped geometry, validity, scans and the end-to-end model, with their
oracle SQL; they join the catalogue when this module is imported."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import clean, evaluate, moments, profile, raster, spatial, split, validity
from regionlens.plans import features as fm
from regionlens.plans.catalog import R, _metric_sql, query
from regionlens.session import materialize, scratch_path
from regionlens.sources import fixtures as fx
from regionlens.sources import io


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


# ================================================================ G1 projections

def _inverse_sql(x: str, y: str, zone: str, north: str = "TRUE") -> tuple[str, str]:
    """lon and lat of UTM coordinates as DuckDB text, by the inverse series to third order."""
    n = geo.WGS84_F / (2.0 - geo.WGS84_F)
    a = geo.UTM_K0 * geo.WGS84_A / (1.0 + n) * (1.0 + n * n / 4.0 + n ** 4 / 64.0)
    beta = [n / 2.0 - 2.0 * n * n / 3.0 + 37.0 * n ** 3 / 96.0, n * n / 48.0 + n ** 3 / 15.0, 17.0 * n ** 3 / 480.0]
    delta = [2.0 * n - 2.0 * n * n / 3.0 - 2.0 * n ** 3, 7.0 * n * n / 3.0 - 8.0 * n ** 3 / 5.0, 56.0 * n ** 3 / 15.0]
    xi = f"(({y} - CASE WHEN {north} THEN 0.0 ELSE 10000000.0 END) / {_d(a)})"
    eta = f"(({x} - 500000.0) / {_d(a)})"
    xi1 = f"({xi}" + "".join(f" - {_d(b)} * sin({2 * j}.0 * {xi}) * cosh({2 * j}.0 * {eta})" for j, b in enumerate(beta, 1)) + ")"
    eta1 = f"({eta}" + "".join(f" - {_d(b)} * cos({2 * j}.0 * {xi}) * sinh({2 * j}.0 * {eta})" for j, b in enumerate(beta, 1)) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = f"degrees({chi}" + "".join(f" + {_d(e)} * sin({2 * j}.0 * {chi})" for j, e in enumerate(delta, 1)) + ")"
    return f"degrees(radians({zone} * 6.0 - 183.0) + atan2(sinh({eta1}), cos({xi1})))", lat


def _forward_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    n = geo.WGS84_F / (2.0 - geo.WGS84_F)
    a = geo.UTM_K0 * geo.WGS84_A / (1.0 + n) * (1.0 + n * n / 4.0 + n ** 4 / 64.0)
    alpha = [n / 2.0 - 2.0 * n * n / 3.0 + 5.0 * n ** 3 / 16.0, 13.0 * n * n / 48.0 - 3.0 * n ** 3 / 5.0, 61.0 * n ** 3 / 240.0]
    c = 2.0 * math.sqrt(n) / (1.0 + n)
    t = f"sinh(atanh(sin(radians({lat}))) - {_d(c)} * atanh({_d(c)} * sin(radians({lat}))))"
    lam = f"(radians({lon}) - {_d(math.radians(zone * 6.0 - 183.0))})"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1.0 + {t} * {t}))"
    east = eta + "".join(f" + {_d(e)} * cos({2 * j}.0 * {xi}) * sinh({2 * j}.0 * {eta})" for j, e in enumerate(alpha, 1))
    north = xi + "".join(f" + {_d(e)} * sin({2 * j}.0 * {xi}) * cosh({2 * j}.0 * {eta})" for j, e in enumerate(alpha, 1))
    return f"500000.0 + {_d(a)} * ({east})", f"{_d(a)} * ({north})"


_LON, _LAT = _inverse_sql("e", "n", "18")


@query("utm_inverse", uses=("centroids",), ctes="""
u AS (SELECT geoid, 450000.0 + x AS e, 4200000.0 + y AS n FROM centroids)""", sql=f"""
SELECT geoid, round({_LON}, 8) AS lon, round({_LAT}, 8) AS lat, TRUE AS returns FROM u""")
def utm_inverse(spark: SparkSession, d: str) -> DataFrame:
    """G1 inverse: UTM zone 18N -> lon/lat, and whether the way back ends
    within a millimetre of the start."""
    c = fx.centroids(spark, d).select("geoid", (F.col("x") + 450000.0).alias("e"), (F.col("y") + 4200000.0).alias("n"))
    c = c.withColumn("g", geo.from_utm("e", "n", 18))
    c = c.withColumn("b", geo.to_utm("g.x", "g.y", 18))
    return c.select("geoid", R(F.col("g.x"), 8).alias("lon"), R(F.col("g.y"), 8).alias("lat"),
                    (F.hypot(F.col("b.x") - F.col("e"), F.col("b.y") - F.col("n")) < 0.001).alias("returns"))


_LON17, _LAT17 = _inverse_sql("500000.0 + x", "4100000.0 + y", "17")
_TO18 = _forward_sql("lon", "lat", 18)


@query("crs_align", uses=("zones",), ctes=f"""
v AS (SELECT geoid, zi, zj, zone_id % 3 AS kind, zone_id % 4 AS k,
             20000.0 * zi + 2000.0 * zj + 1000.0 * (zone_id % 4) AS x, 20000.0 * zj AS y FROM zones),
g AS (SELECT *, CASE kind WHEN 1 THEN -78.0 + x / 100000.0 ELSE {_LON17} END AS lon,
             CASE kind WHEN 1 THEN 37.0 + y / 100000.0 ELSE {_LAT17} END AS lat FROM v)""", sql=f"""
SELECT geoid, round(CASE WHEN kind = 0 THEN 300000.0 + x ELSE {_TO18[0]} END, 3) AS x,
       round(CASE WHEN kind = 0 THEN 4100000.0 + y ELSE {_TO18[1]} END, 3) AS y FROM g""")
def crs_align(spark: SparkSession, d: str) -> DataFrame:
    """G1 CRS rule: zones without a code are taken as they are, lon/lat and UTM
    17N ones are reprojected to UTM 18N (first vertex shown)."""
    kind, k = F.col("zone_id") % 3, F.col("zone_id") % 4
    z = fx.zones(spark, d).withColumn("code", F.when(kind == 1, 4326).when(kind == 2, 32617))
    # the fixture's plane, moved to where each code's coordinates lie
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(
        F.when(kind == 1, -78.0 + (p.x + 1000.0 * k) / 100000.0)
        .otherwise(p.x + 1000.0 * k + F.when(kind == 2, 500000.0).otherwise(300000.0)).alias("x"),
        F.when(kind == 1, 37.0 + p.y / 100000.0).otherwise(p.y + 4100000.0).alias("y"))))
    out = z.select("geoid", geo.rings_to_crs(moved, F.col("code"), 32618).alias("r"))
    first = F.col("r")[0][0]
    return out.select("geoid", R(first["x"], 3).alias("x"), R(first["y"], 3).alias("y"))


# ================================================================ G12 reprojection

_TLON, _TLAT = _inverse_sql("tx", "ty", "18")
_EDGE = 21


def _edge_points_sql() -> str:
    s = f"range / {_EDGE - 1}.0"
    return " UNION ALL ".join(f"SELECT {lon} AS lon, {lat} AS lat FROM sp, range({_EDGE})" for lon, lat in (
        (f"lo0 + (lo1 - lo0) * {s}", "la0"), (f"lo0 + (lo1 - lo0) * {s}", "la1"),
        ("lo0", f"la0 + (la1 - la0) * {s}"), ("lo1", f"la0 + (la1 - la0) * {s}")))


@query("raster_reproject", uses=("grid",), ctes=f"""
px AS (SELECT 0.3::DOUBLE / (max(col) + 1) AS dl, 25000.0::DOUBLE / (max(col) + 1) AS res FROM grid),
sp AS (SELECT -75.15 + dl * min(col) AS lo0, -75.15 + dl * (max(col) + 1) AS lo1,
              37.0 + dl * min("row") AS la0, 37.0 + dl * (max("row") + 1) AS la1 FROM grid, px GROUP BY dl),
ed AS ({_edge_points_sql()}),
eu AS (SELECT {_forward_sql("lon", "lat", 18)[0]} AS x, {_forward_sql("lon", "lat", 18)[1]} AS y FROM ed),
bo AS (SELECT res, dl, floor(min(x) / res) AS x0, floor(min(y) / res) AS y0,
              CAST(ceil(max(x) / res) - floor(min(x) / res) AS BIGINT) AS w,
              CAST(ceil(max(y) / res) - floor(min(y) / res) AS BIGINT) AS h FROM eu, px GROUP BY res, dl),
tp AS (SELECT dl, a.range AS trow, b.range AS tcol, x0 * res + (b.range + 0.5) * res AS tx, y0 * res + (a.range + 0.5) * res AS ty
       FROM bo, range((SELECT h FROM bo)) a, range((SELECT w FROM bo)) b),
sc AS (SELECT trow, tcol, ({_TLAT} - 37.0) / dl - 0.5 AS sr, ({_TLON} + 75.15) / dl - 0.5 AS sc FROM tp),
nb AS (SELECT trow, tcol, floor(sr) + i.range AS nr, floor(sc) + j.range AS nc,
              (1 - abs(sr - floor(sr) - i.range)) * (1 - abs(sc - floor(sc) - j.range)) AS wt
       FROM sc, range(2) i, range(2) j)""", sql="""
SELECT trow AS "row", tcol AS col, round(sum(wt * value) / sum(wt), 4) AS value
FROM nb JOIN grid g ON g."row" = nr AND g.col = nc WHERE value IS NOT NULL GROUP BY trow, tcol HAVING sum(wt) > 1e-3""")
def raster_reproject(spark: SparkSession, d: str) -> DataFrame:
    """G12 a lon/lat raster onto a UTM 18N grid of about its own resolution:
    bounds from densified edges, target pixels traced back, four neighbours
    weighted; pixels without any are no rows.  The raster spans 0.3 degrees, however many columns it has."""
    g = fx.grid(spark, d)
    width = g.agg(F.max("col")).first()[0] + 1
    out = raster.reproject(g, 18, 25000.0 / width, -75.15, 0.3 / width, 37.0, 0.3 / width, edge_points=_EDGE,
                           covered=True)
    return out.where("weight > 1e-3").select("row", "col", R("value"))


# ================================================================ G8 / J9 clipped lines

@query("clip_lines", uses=("zones", "segs"), ctes="""
pairs AS (SELECT s.road_id, s.ax, s.ay, s.bx, s."by", 10 * z.zi * 20000.0 AS lo, 10 * (z.zi + 1) * 20000.0 AS hi,
                 20000.0 * z.zj AS y0, 20000.0 * (z.zj + 1) AS y1, 10 * ax - ay AS ua, 10 * bx - "by" AS ub
          FROM segs s, zones z WHERE (z.zi + z.zj) % 2 = 0),
ends AS (SELECT *, greatest(0.0, CASE WHEN ua = ub THEN CASE WHEN ua >= lo AND ua < hi THEN 0.0 ELSE 2.0 END
                                 ELSE least((lo - ua) / (ub - ua), (hi - ua) / (ub - ua)) END,
                        CASE WHEN ay = "by" THEN CASE WHEN ay >= y0 AND ay < y1 THEN 0.0 ELSE 2.0 END
                             ELSE least((y0 - ay) / ("by" - ay), (y1 - ay) / ("by" - ay)) END) AS t0,
                least(1.0, CASE WHEN ua = ub THEN 1.0 ELSE greatest((lo - ua) / (ub - ua), (hi - ua) / (ub - ua)) END,
                      CASE WHEN ay = "by" THEN 1.0 ELSE greatest((y0 - ay) / ("by" - ay), (y1 - ay) / ("by" - ay)) END) AS t1 FROM pairs),
pc AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY t0) - 1 AS piece FROM ends WHERE t1 > t0 + 1e-12)""", sql="""
SELECT road_id, piece, round(ax + t0 * (bx - ax), 4) + 0.0::DOUBLE AS x0, round(ay + t0 * ("by" - ay), 4) + 0.0::DOUBLE AS y0,
       round(ax + t1 * (bx - ax), 4) + 0.0::DOUBLE AS x1, round(ay + t1 * ("by" - ay), 4) + 0.0::DOUBLE AS y1,
       round((t1 - t0) * sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)), 4) AS length, 2 AS vertices FROM pc""")
def clip_lines(spark: SparkSession, d: str) -> DataFrame:
    """J9 / G8 clipped line geometry: the ordered pieces of each road inside a
    chequered boundary, one zone of it given twice (which must not double a length)."""
    z = fx.zones(spark, d).where("(zone_id % 5 + zone_id div 5) % 2 = 0")
    twice = z.unionByName(z.where("zone_id = 12"))
    c = spatial.clip_lines(fx.roads(spark, d), twice, "road_id", fx.ROAD_CELL)
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    return c.where("length > 1e-8").select("road_id", "piece", 
                                           *[(F.round(v, 4) + 0.0).alias(n) for n, v in (
                                               ("x0", a["x"]), ("y0", a["y"]), ("x1", b["x"]), ("y1", b["y"]))], R("length"), F.size("line").alias("vertices"))


# ================================================================ G9 / F12 validity

_QUAD = [(7, 13), (11, 5), (17, 29), (23, 3)]     # corner i of customer c: (c * a % 40, c * b % 40)


def _quads(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    corner = [geo.point((c * a) % 40, (c * b) % 40) for a, b in _QUAD]
    return fx.table(spark, d, "customer").select(c.alias("custkey"), F.array(F.array(*corner, corner[0])).alias("rings"))


def _quad_sql() -> str:
    pts = " UNION ALL ".join(f"SELECT c_custkey AS k, {i} AS i, c_custkey * {a} % 40 AS x, c_custkey * {b} % 40 AS y FROM customer"
                             for i, (a, b) in enumerate(_QUAD))
    side = lambda o, p: f"sign(({o}.bx - {o}.ax) * ({p[1]} - {o}.ay) - ({o}.\"by\" - {o}.ay) * ({p[0]} - {o}.ax))"
    box = lambda o, p: (f"({p[0]} BETWEEN least({o}.ax, {o}.bx) AND greatest({o}.ax, {o}.bx) AND "  # noqa: E731
                        f"{p[1]} BETWEEN least({o}.ay, {o}.\"by\") AND greatest({o}.ay, {o}.\"by\"))")
    ends = {"f": [("f.ax", "f.ay"), ("f.bx", "f.\"by\"")], "e": [("e.ax", "e.ay"), ("e.bx", "e.\"by\"")]}
    touch = " OR ".join(f"({side(o, p)} = 0 AND {box(o, p)})" for o, q in (("e", "f"), ("f", "e")) for p in ends[q])
    proper = (f"({side('e', ends['f'][0])} * {side('e', ends['f'][1])} < 0 AND {side('f', ends['e'][0])} * {side('f', ends['e'][1])} < 0)")
    spread = " OR ".join(f"least(greatest(e.a{v}, e.b{v}), greatest(f.a{v}, f.b{v})) > greatest(least(e.a{v}, e.b{v}), least(f.a{v}, f.b{v}))"
                         for v in "xy").replace("e.by", "e.\"by\"").replace("f.by", "f.\"by\"")
    along = f"({side('e', ends['f'][0])} = 0 AND {side('e', ends['f'][1])} = 0 AND ({spread}))"
    return f"""
pt AS ({pts}),
ed AS (SELECT a.k, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM pt a JOIN pt b ON a.k = b.k AND b.i = (a.i + 1) % 4
       WHERE a.x <> b.x OR a.y <> b.y),
ar AS (SELECT a.k, sum(a.x * b.y - b.x * a.y) AS area FROM pt a JOIN pt b ON a.k = b.k AND b.i = (a.i + 1) % 4 GROUP BY a.k),
cr AS (SELECT DISTINCT e.k FROM ed e JOIN ed f ON e.k = f.k AND e.i < f.i
       WHERE CASE WHEN f.i - e.i IN (1, 3) THEN {along} ELSE {proper} OR {touch} END)"""


@query("polygon_validity", ctes=_quad_sql(), sql="""
SELECT ar.k AS custkey, ar.area = 0 AS shape, cr.k IS NOT NULL AS crossing, FALSE AS outside FROM ar LEFT JOIN cr ON cr.k = ar.k""")
def polygon_validity(spark: SparkSession, d: str) -> DataFrame:
    """G9 validity of one quadrilateral per customer: many cross themselves,
    some have no area."""
    return validity.invalid_parts(_quads(spark, d), "custkey")


@query("empty_geometry", sql=f"""
SELECT c_custkey AS custkey FROM customer
WHERE {" + ".join(f"(c_custkey * {a} % 40) * (c_custkey * {e} % 40) - (c_custkey * {c} % 40) * (c_custkey * {b} % 40)"
                  for (a, b), (c, e) in zip(_QUAD, _QUAD[1:] + _QUAD[:1]))} = 0""")
def empty_geometry(spark: SparkSession, d: str) -> DataFrame:
    """F12 rows whose geometry is empty once it is repaired (no area left)."""
    repaired = _quads(spark, d).withColumn("rings", geo.repair_rings("rings"))
    return repaired.where(geo.is_empty("rings")).select("custkey")


# ================================================================ scans and filters

@query("population_scan", uses=("poptab",), sql="""
SELECT ISO3_code, Location, CAST(population AS BIGINT) AS population, wealth FROM poptab""")
def population_scan(spark: SparkSession, d: str) -> DataFrame:
    """S2 population table exported from a workbook: read as text, then typed."""
    path = scratch_path(spark, f"population-{uuid.uuid4().hex}.csv")
    io.write_csv(fx.population_table(spark, d), path)
    p = io.read_population(spark, path)
    return p.select("ISO3_code", "Location", F.col("population").cast("long").alias("population"),
                    F.col("wealth").cast("double").alias("wealth"))


@query("boundary_scan", uses=("zones",), sql="""
SELECT geoid AS GEOID, county AS COUNTYFP, CAST(400000000.0 AS DOUBLE) AS area, 0 AS part FROM zones WHERE county IN ('003', '011', '017')""")
def boundary_scan(spark: SparkSession, d: str) -> DataFrame:
    """S5 census boundaries from GeoJSON with the state and multi-county filters."""
    path = scratch_path(spark, f"boundaries-{uuid.uuid4().hex}.geojson")
    z = fx.zones(spark, d).select(F.col("geoid").alias("GEOID"), F.lit("51").alias("STATEFP"), F.col("county").alias("COUNTYFP"),
                                  F.lit("020200").alias("TRACTCE"), "rings")
    io.write_geojson(z, path, "rings", ["GEOID", "STATEFP", "COUNTYFP", "TRACTCE"])
    b = io.read_boundaries(spark, path, "51", ["003", "011", "017"], collection=False)
    return b.select("GEOID", "COUNTYFP", R(geo.polygon_area("rings")).alias("area"), "part")


@query("year_filter", uses=("panel_long",), sql="""
SELECT gid, year, round(gdp, 2) AS gdp FROM panel_long WHERE year IN (1996, 1999)""")
def year_filter(spark: SparkSession, d: str) -> DataFrame:
    """F4 membership filter on years."""
    return clean.filter_years(fx.panel_long(spark, d), [1996, 1999]).select("gid", "year", R("gdp", 2))


@query("boxplot_outliers", uses=("panel_long",), ctes="""
q AS (SELECT year, quantile_cont(gdp, 0.25) AS q1, quantile_cont(gdp, 0.75) AS q3 FROM panel_long WHERE gdp IS NOT NULL GROUP BY year)""",
       sql="""
SELECT p.gid, p.year, round(p.gdp, 2) AS gdp FROM panel_long p JOIN q ON p.year = q.year
WHERE p.gdp < q1 - 1.5 * (q3 - q1) OR p.gdp > q3 + 1.5 * (q3 - q1)""")
def boxplot_outliers(spark: SparkSession, d: str) -> DataFrame:
    """A25 the rows beyond the whiskers of their year's box."""
    return profile.boxplot_outliers(fx.panel_long(spark, d), "year", "gdp").select("gid", "year", R("gdp", 2))


# ================================================================ models

_ONE = """
cc AS (SELECT * FROM features WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
fit AS (SELECT regr_slope(target, x1) AS b, regr_intercept(target, x1) AS a FROM cc)"""


@query("model_roundtrip", uses=("features",), ctes=_ONE, sql="""
SELECT geoid, round(a + b * x1, 4) AS prediction FROM cc, fit""")
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """S14 a fitted pipeline is saved, loaded and applied."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from regionlens.operators import model as M
    f = clean.drop_incomplete(fx.features(spark, d), ["x1", "x2", "target"])
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    M.save_model(Pipeline(stages=[VectorAssembler(inputCols=["x1"], outputCol=M.VEC), M.ols("target")]).fit(f), path)
    return M.load_model(path).transform(f).select("geoid", R("prediction"))


def _matrix_cv_sql() -> str:
    """Fold sums and normal equations of two features of the flagship matrix."""
    inner = fm._fm_sql()
    names = ["viirs_mean", "road_density_km_per_sqkm", "y"]
    a, b, y = names
    s = lambda e, alias: f"sum({e}) AS {alias}"
    cols = ", ".join([s(a, "sa"), s(b, "sb"), s(y, "sy"), s(f"{a} * {a}", "saa"), s(f"{a} * {b}", "sab"), s(f"{b} * {b}", "sbb"),
                      s(f"{a} * {y}", "say"), s(f"{b} * {y}", "sby")])
    parts = ["n", "sa", "sb", "sy", "saa", "sab", "sbb", "say", "sby"]
    return f"""
WITH matrix AS ({inner}),
truth AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS county, round(avg(c_acctbal) FILTER (c_acctbal >= 0), 4) AS income
          FROM customer GROUP BY 1),
j AS (SELECT m.geoid, m.viirs_mean, m.road_density_km_per_sqkm, t.income AS y
      FROM (SELECT * REPLACE (geoid AS geoid) FROM matrix) m JOIN truth t ON t.county = substr(m.geoid, 3, 3)),
fo AS (SELECT *, (row_number() OVER (ORDER BY substr(geoid, 3, 3)) - 1) % 5 AS fold FROM j),
pf AS (SELECT fold, count(*) AS n, {cols} FROM fo GROUP BY fold),
tr AS (SELECT pf.fold, {", ".join(f"t.{p} - pf.{p} AS {p}" for p in parts)}
       FROM pf, (SELECT {", ".join(f"sum({p}) AS {p}" for p in parts)} FROM pf) t),
mm AS (SELECT *, saa - sa * sa / n AS caa, sab - sa * sb / n AS cab, sbb - sb * sb / n AS cbb, say - sa * sy / n AS cay,
              sby - sb * sy / n AS cby FROM tr),
co AS (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS wa, (caa * cby - cab * cay) / (caa * cbb - cab * cab) AS wb FROM mm),
predictions AS (SELECT fo.fold, fo.y AS actual, sy / n + wa * ({a} - sa / n) + wb * ({b} - sb / n) AS predicted
                FROM fo JOIN co ON co.fold = fo.fold)
SELECT fold, round(MAE, 3) AS MAE, round(RMSE, 3) AS RMSE, round(R2, 4) AS R2, round(MAPE, 3) AS MAPE, n FROM ({_metric_sql(group='fold')})"""


@query("matrix_cv")
def matrix_cv(spark: SparkSession, d: str) -> DataFrame:
    """Entry points A to B end to end: the feature matrix joined to the truth
    (mean income of each county), grouped 5-fold CV of a linear model, metrics
    per fold."""
    from regionlens.plans.catalog import REGISTRY
    matrix = REGISTRY["feature_matrix"][0](spark, d)
    truth = (clean.acs_ground_truth(fx.acs(spark, d)).groupBy(F.substring("geoid", 3, 3).alias("county"))
             .agg(F.round(F.avg("median_income"), 4).alias("income")))
    j = matrix.withColumn("county", F.substring("geoid", 3, 3)).join(truth, "county")
    names = ["viirs_mean", "road_density_km_per_sqkm"]
    folded = materialize(split.group_folds(j.select("county", "income", *names), "county", 5), "matrix-folds")
    models, _ = moments.cross_validate(folded, names, "income")
    rows = moments.predict_folds(folded, names, models).select("fold", F.col("income").alias("actual"), "predicted")
    m = evaluate.regression_metrics(rows, ["fold"])
    return m.select("fold", R("MAE", 3), R("RMSE", 3), R("R2", 4), R("MAPE", 3), "n")


from regionlens.plans import catalog as _catalog  # noqa: E402

_catalog.REGISTRY["matrix_cv"] = (_catalog.REGISTRY["matrix_cv"][0], _matrix_cv_sql())
