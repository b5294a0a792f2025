"""Scans and sinks.

Vector data arrives as GeoJSON (a FeatureCollection file, or one Feature
per line) or as Parquet with the nested geometry columns of
``functions.geo``; rasters arrive as Parquet pixel tables.  Per-file codecs
(GeoTIFF, Shapefile, GeoPackage, xlsx) are not built -- see the README.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions import geo

# ---------------------------------------------------------------- S1, S2, S6, S11

# The ACS variables and geography parts of a census table.
ACS_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()), T.StructField("county", T.StringType()),
    T.StructField("tract", T.StringType()), T.StructField("block_group", T.StringType()),
    T.StructField("B19013_001E", T.DoubleType()), T.StructField("B01003_001E", T.DoubleType()),
    T.StructField("B17021_001E", T.DoubleType()), T.StructField("B17021_002E", T.DoubleType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               header: bool = True) -> DataFrame:
    """S1 CSV scan with an explicit schema (id columns stay strings; no
    inference pass).  Without a schema every column is read as a string."""
    r = spark.read.option("header", header).option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """S2 population table exported from the workbook (CSV or Parquet)."""
    if path.endswith(".parquet") or path.endswith("/"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_acs(spark: SparkSession, path: str) -> DataFrame:
    """S6 census table with the four ACS variables."""
    return read_table(spark, path, ACS_SCHEMA)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S11 CSV sink with a header (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


# ---------------------------------------------------------------- S3, S5, S12

_POS = "array<double>"
_GEOM_SCHEMAS = {
    "Point": _POS,
    "LineString": f"array<{_POS}>",
    "MultiLineString": f"array<array<{_POS}>>",
    "Polygon": f"array<array<{_POS}>>",
    "MultiPolygon": f"array<array<array<{_POS}>>>",
}
_FEATURE = T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("properties", T.StringType()),
                         T.StructField("geometry", T.StringType())])


def _xy(p: Column) -> Column:
    return F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))


def _coords(geom: Column, gtype: str) -> Column:
    """X15 JSON: ``from_json`` of one geometry type's coordinates."""
    return F.from_json(geom, f"struct<coordinates:{_GEOM_SCHEMAS[gtype]}>").coordinates


def parse_geometry(geom: Column) -> Column:
    """GeoJSON geometry text -> ``array<polygon rings>`` of parts:
    a polygon is one part, a multipolygon several; lines become one ring per
    part, points a one-vertex ring.  Callers ``posexplode`` the parts (P14)."""
    t = F.get_json_object(geom, "$.type")
    ring = lambda r: F.transform(r, _xy)
    return (F.when(t == "Polygon", F.array(F.transform(_coords(geom, "Polygon"), ring)))
            .when(t == "MultiPolygon", F.transform(_coords(geom, "MultiPolygon"),
                                                   lambda poly: F.transform(poly, ring)))
            .when(t == "LineString", F.array(F.array(ring(_coords(geom, "LineString")))))
            .when(t == "MultiLineString", F.transform(_coords(geom, "MultiLineString"),
                                                      lambda ln: F.array(ring(ln))))
            .when(t == "Point", F.array(F.array(F.array(_xy(_coords(geom, "Point")))))))


def read_geojson(spark: SparkSession, path: str, properties: T.StructType | str | None = None,
                 collection: bool = True) -> DataFrame:
    """S3 GeoJSON scan -> one row per feature part: properties, ``gtype``,
    ``part`` and ``rings`` (polygon rings; a line is one ring, a point a
    one-vertex ring).

    ``collection=True`` reads FeatureCollection files (multi-line JSON, one
    collection per file); ``False`` reads one Feature per line.  Geometry is
    read as text and parsed per type with an explicit schema, so integer
    coordinates never infer as long.  Properties default to map<string,string>.
    """
    if collection:
        raw = (spark.read.option("multiLine", True)
               .schema(T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])).json(path)
               .select(F.explode("features").alias("f")).select("f.*"))
    else:
        raw = spark.read.schema(_FEATURE).json(path)
    props = F.from_json("properties", properties if properties is not None else "map<string,string>")
    df = raw.select(props.alias("_p"), F.get_json_object("geometry", "$.type").alias("gtype"),
                    parse_geometry(F.col("geometry")).alias("_parts"))
    df = df.select("*", F.posexplode("_parts").alias("part", "rings")).drop("_parts")
    if properties is not None:
        return df.select("_p.*", "gtype", "part", "rings")
    return df.withColumnRenamed("_p", "properties")


def read_boundaries(spark: SparkSession, path: str, state: str | None = None,
                    counties: Sequence[str] | None = None, collection: bool = True) -> DataFrame:
    """S5 census boundary scan: block groups / counties with F1-F3 filters."""
    schema = "GEOID string, STATEFP string, COUNTYFP string, TRACTCE string"
    df = read_geojson(spark, path, schema, collection)
    if state is not None:
        df = df.where(F.col("STATEFP") == state)
    if counties:
        df = df.where(F.col("COUNTYFP").isin(list(counties)))
    return df


def _geometry_json(rings: Column, gtype: str) -> Column:
    pos = lambda p: F.array(p.x, p.y)
    if gtype == "Polygon":
        coords = F.transform(rings, lambda r: F.transform(r, pos))
    elif gtype == "LineString":
        coords = F.transform(rings, pos)
    else:
        raise ValueError(gtype)
    return F.struct(F.lit(gtype).alias("type"), coords.alias("coordinates"))


def geojson_features(df: DataFrame, geom: str = "rings", props: Sequence[str] = (),
                     gtype: str = "Polygon") -> DataFrame:
    """S12 one GeoJSON Feature text per row (GeoJSON-seq)."""
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(*[F.col(p) for p in props]).alias("properties"),
                    _geometry_json(F.col(geom), gtype).alias("geometry"))
    return df.select(F.to_json(feat).alias("value"))


def write_geojson(df: DataFrame, path: str, geom: str = "rings", props: Sequence[str] = (),
                  gtype: str = "Polygon", mode: str = "overwrite") -> None:
    """S12 GeoJSON sink, one Feature per line (read back with
    ``read_geojson(..., collection=False)``)."""
    geojson_features(df, geom, props, gtype).write.mode(mode).text(path)


# ---------------------------------------------------------------- S4

def read_layer(spark: SparkSession, path: str, layer: str | None = None,
               layer_col: str = "layer") -> DataFrame:
    """S4 vector layer by name from a Parquet dataset partitioned by
    ``layer``; without a name the first layer (by name) is used.  The layer
    filter is a partition filter, so other layers are never read."""
    df = spark.read.parquet(path)
    if layer is None:
        first = df.select(layer_col).distinct().orderBy(layer_col).limit(1).collect()
        if not first:
            return df
        layer = first[0][0]
    return df.where(F.col(layer_col) == layer)


# ---------------------------------------------------------------- S7, S8, S13

def read_raster(spark: SparkSession, path: str, bands: Sequence[str] = ("value",),
                nodata: float | None = None) -> DataFrame:
    """S7 pixel-table scan; NaN and the nodata value become NULL."""
    df = spark.read.parquet(path)
    return df.select(*[geo.nodata_to_null(F.col(b), nodata).alias(b) if b in bands else F.col(b)
                       for b in df.columns])


def read_scenes(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                ts: str = "ts") -> DataFrame:
    """S8 image-collection scan (Parquet partitioned by acquisition month),
    optionally from ``start`` to before ``end`` (dates or timestamps as text).
    The range also selects the months, so the other partitions are not read."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("month") >= start[:7]) & (F.col(ts) >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.where((F.col("month") <= end[:7]) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    return df


def write_raster(df: DataFrame, path: str, partition_by: Sequence[str] = ("raster_id",),
                 mode: str = "overwrite") -> None:
    """S13 raster sink: Parquet partitioned by raster / tile."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_scenes(df: DataFrame, path: str, ts: str = "ts", mode: str = "overwrite") -> None:
    """S8 companion sink: scenes partitioned by acquisition month."""
    df.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode(mode).partitionBy("month").parquet(path)


# ---------------------------------------------------------------- S9, S10

def osm_features(features: DataFrame, region: DataFrame, tags: dict, cell_size: float,
                 tags_col: str = "tags") -> DataFrame:
    """S9 OSM features matching a tag spec (F6) inside a region."""
    from regionlens.operators import clean, spatial
    return spatial.clip_points(clean.tag_filter(features, tags, tags_col), region, cell_size)


def osm_roads(edges: DataFrame, region: DataFrame, key: str, cell_size: float,
              network_type: str | None = "drive", line_col: str = "line",
              edge_id: str = "edge_id") -> DataFrame:
    """S10 road edges of a network type clipped to a region: segment pieces
    inside the region with their lengths (J9 via G6)."""
    from regionlens.operators import spatial
    e = edges.where(F.col("network_type") == network_type) if network_type else edges
    segs = spatial.explode_line_segments(e.select(edge_id, line_col), line_col)
    return spatial.clip_segments_to_zones(segs, region, [key], cell_size, [edge_id, "seg"])


# ---------------------------------------------------------------- S15

_OUTPUT = "struct<output_type:string,name:string,data:map<string,string>>"
_CELL = f"struct<cell_type:string,source:array<string>,outputs:array<{_OUTPUT}>>"
NOTEBOOK_SCHEMA = (f"cells array<{_CELL}>, metadata map<string,string>, nbformat long, "
                   "nbformat_minor long")


def read_notebooks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S15 notebook corpus -> one row per cell: notebook, idx, cell_type,
    source, outputs.  ``lines=False`` reads .ipynb files (one document per
    file, the notebook id is the file path); ``lines=True`` reads one
    document per line as written by ``write_notebooks`` (the id is
    ``metadata.id``).  Output ``data`` values stay JSON text."""
    nb = spark.read.option("multiLine", not lines).schema(NOTEBOOK_SCHEMA).json(path)
    nid = F.col("metadata")["id"] if lines else F.input_file_name()
    return nb.select(nid.alias("notebook"), F.posexplode("cells").alias("idx", "c")) \
        .select("notebook", "idx", "c.cell_type", "c.source", "c.outputs")


def notebooks_json(cells: DataFrame) -> DataFrame:
    """S15 sink side: cells back to one notebook JSON document per notebook,
    in cell order (a notebook's cells form one bounded group)."""
    c = F.struct("idx", F.struct("cell_type", "source", "outputs").alias("cell"))
    by_idx = lambda a, b: F.when(a.idx < b.idx, -1).when(a.idx > b.idx, 1).otherwise(0)
    g = cells.groupBy("notebook").agg(F.array_sort(F.collect_list(c), by_idx).alias("_c"))
    doc = F.struct(F.transform("_c", lambda e: e.cell).alias("cells"),
                   F.create_map(F.lit("id"), F.col("notebook").cast("string")).alias("metadata"),
                   F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"))
    return g.select("notebook", F.to_json(doc).alias("value"))


def write_notebooks(cells: DataFrame, path: str, mode: str = "overwrite") -> None:
    notebooks_json(cells).select("value").write.mode(mode).text(path)
