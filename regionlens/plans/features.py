"""Entry point A: one feature row per zone (block group).

zones -> G2 centroids -> J7 nearest facility per type -> J5/A12 facility
counts -> J6/G6/A13 road length + G3 area + X10 densities -> J8 + A8/A9
night-light and spectral statistics in one pixel pass -> J1 left joins on
the zone key -> A14 median imputation.

Every feature family is an independent aggregate keyed by the zone id; the
zone table (small, one row per zone) is the left side of every join, so
Spark can broadcast it (behind the measured-size check) or shuffle the big
sides once on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import clean, raster, spatial
from regionlens.plans.catalog import R, query
from regionlens.plans.oracle import with_fixtures
from regionlens.session import materialize
from regionlens.sources import fixtures as fx


def build_feature_matrix(zones: DataFrame, facilities: DataFrame, segments: DataFrame, pixels: DataFrame,
                         zone_population: DataFrame | None, key: str, cell_size: float,
                         types: Sequence[str], radii: Sequence[float] = (1000, 2000, 5000),
                         type_col: str = "amenity", impute: bool = True,
                         road_cell_size: float | None = None) -> DataFrame:
    """Assemble the feature matrix (see module docstring)."""
    c = geo.polygon_centroid("rings")
    base = zones.select(key, c.x.alias("x"), c.y.alias("y"), geo.polygon_area("rings").alias("area_sqm"))
    near = spatial.nearest_facility(base, facilities, key, types, type_col=type_col)
    near = near.select(key, *[f"nearest_{t.lower()}_dist" for t in types])
    counts = spatial.count_within(base, facilities, key, radii, types, type_col)
    roads = spatial.road_length_per_zone(segments, zones, key, road_cell_size or cell_size)
    zonal = raster.zonal_features(pixels, zones, key, cell_size)
    fm = (base.join(near, key, "left").join(counts, key, "left").join(roads, key, "left")
          .join(zonal, key, "left"))
    fm = fm.withColumn("road_density_km_per_sqkm",
                       F.try_divide(F.col("total_road_length_m") / 1000, F.col("area_sqm") / 1000000))
    if zone_population is not None:
        fm = fm.join(zone_population, key, "left").withColumn(
            "population_density_per_sqkm", F.try_divide(F.col("population"), F.col("area_sqm") / 1000000))
    else:
        fm = fm.withColumn("population_density_per_sqkm", F.lit(None).cast("double"))
    if impute:
        # the medians need the assembled matrix; write it once to the shared
        # checkpoint folder so imputation does not recompute every branch
        fm = materialize(fm, "feature-matrix")
        num = clean.numeric_columns(fm, exclude=(key,))
        fm = clean.median_impute(fm, num)
    return fm


def _fm_sql() -> str:
    near = ", ".join(
        f"min(sqrt((b.x - f.x) * (b.x - f.x) + (b.y - f.y) * (b.y - f.y))) FILTER (WHERE f.amenity = '{t}') "
        f"AS nearest_{t.lower()}_dist" for t in fx.FACILITY_TYPES)
    cnt = ", ".join(
        f"count(f.facility_id) FILTER (WHERE f.amenity = '{t}' AND (b.x - f.x) * (b.x - f.x) + (b.y - f.y) * (b.y - f.y) "
        f"<= {r * r}.0) AS {t.lower()}_count_{r // 1000}km"
        for t in fx.FACILITY_TYPES for r in (1000, 2000, 5000))
    from regionlens.plans.catalog import _ROAD_CTES, _nd
    ctes = f"""
base AS (SELECT geoid, county, 20000.0::DOUBLE * (zi + 0.5::DOUBLE) + 2000.0::DOUBLE * (zj + 0.5::DOUBLE) AS x,
                20000.0::DOUBLE * (zj + 0.5::DOUBLE) AS y, 400000000.0::DOUBLE AS area_sqm FROM zones),
nr AS (SELECT b.geoid, {near} FROM base b CROSS JOIN facilities f GROUP BY b.geoid),
ct AS (SELECT b.geoid, {cnt} FROM base b LEFT JOIN facilities f
       ON (b.x - f.x) * (b.x - f.x) + (b.y - f.y) * (b.y - f.y) <= 25000000.0 GROUP BY b.geoid),
{_ROAD_CTES.strip()},
vl AS (SELECT geoid, avg(light) AS viirs_mean, stddev_pop(light) AS viirs_std, max(light) AS viirs_max,
              sum(light) AS viirs_sum FROM pz GROUP BY geoid),
s2 AS (SELECT geoid, avg(red) AS s2_red_mean, avg(nir) AS s2_nir_mean, avg(swir) AS s2_swir_mean,
              avg({_nd('nir', 'red')}) AS s2_ndvi_mean, stddev_pop({_nd('nir', 'red')}) AS s2_ndvi_std,
              avg({_nd('swir', 'nir')}) AS s2_ndbi_mean, avg({_nd('nir', 'swir')}) AS s2_ndwi_mean
       FROM pz WHERE nir IS NOT NULL AND red IS NOT NULL AND swir IS NOT NULL GROUP BY geoid),
pop AS (SELECT county, sum(population) AS population FROM gt GROUP BY county)"""
    counts = ", ".join(f"ct.{t.lower()}_count_{r // 1000}km" for t in fx.FACILITY_TYPES for r in (1000, 2000, 5000))
    nears = ", ".join(f"round(nr.nearest_{t.lower()}_dist, 4) AS nearest_{t.lower()}_dist" for t in fx.FACILITY_TYPES)
    sql = f"""
SELECT b.geoid, round(b.x, 4) AS x, round(b.y, 4) AS y, round(b.area_sqm, 4) AS area_sqm, {nears}, {counts},
       round(COALESCE(tot.l, 0.0), 3) AS total_road_length_m,
       round((COALESCE(tot.l, 0.0) / 1000) / (b.area_sqm / 1000000), 6) AS road_density_km_per_sqkm,
       round(vl.viirs_mean, 4) AS viirs_mean, round(vl.viirs_std, 4) AS viirs_std,
       round(vl.viirs_max, 4) AS viirs_max, round(vl.viirs_sum, 4) AS viirs_sum,
       round(s2.s2_red_mean, 4) AS s2_red_mean, round(s2.s2_nir_mean, 4) AS s2_nir_mean,
       round(s2.s2_swir_mean, 4) AS s2_swir_mean, round(s2.s2_ndvi_mean, 6) AS s2_ndvi_mean,
       round(s2.s2_ndvi_std, 6) AS s2_ndvi_std, round(s2.s2_ndbi_mean, 6) AS s2_ndbi_mean,
       round(s2.s2_ndwi_mean, 6) AS s2_ndwi_mean,
       round(pop.population, 4) AS population,
       round(pop.population / (b.area_sqm / 1000000), 6) AS population_density_per_sqkm
FROM base b JOIN nr ON b.geoid = nr.geoid JOIN ct ON b.geoid = ct.geoid
LEFT JOIN tot ON b.geoid = tot.geoid LEFT JOIN vl ON b.geoid = vl.geoid LEFT JOIN s2 ON b.geoid = s2.geoid
LEFT JOIN pop ON b.county = pop.county"""
    return with_fixtures(sql, ("zones", "facilities", "segs", "pz", "gt"), ctes)


def _rounded(fm: DataFrame) -> DataFrame:
    six = {"road_density_km_per_sqkm", "s2_ndvi_mean", "s2_ndvi_std", "s2_ndbi_mean", "s2_ndwi_mean",
           "population_density_per_sqkm"}
    out = []
    for f in fm.schema.fields:
        if f.name == "total_road_length_m":
            out.append(R(f.name, 3))
        elif f.dataType.simpleString() == "double":
            out.append(R(f.name, 6 if f.name in six else 4))
        else:
            out.append(F.col(f.name))
    return fm.select(*out)


@query("feature_matrix", sql=None)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the full per-zone feature matrix."""
    z = fx.zones(spark, d)
    segs = spatial.explode_line_segments(fx.roads(spark, d), "line")
    pop = (clean.acs_ground_truth(fx.acs(spark, d))
           .groupBy(F.substring("geoid", 3, 3).alias("county")).agg(F.sum("population").alias("population"))
           .join(z.select("county", "geoid"), "county").select("geoid", "population"))
    fm = build_feature_matrix(z, fx.facilities(spark, d), segs, fx.pixels(spark, d), pop, "geoid",
                              fx.ZONE_CELL, fx.FACILITY_TYPES, road_cell_size=fx.ROAD_CELL)
    return _rounded(fm)


# register the oracle text (built after the catalogue module is importable)
from regionlens.plans import catalog as _catalog  # noqa: E402

_catalog.REGISTRY["feature_matrix"] = (_catalog.REGISTRY["feature_matrix"][0], _fm_sql())
