"""Domain-shaped tables derived from the driver's TPC-H-ish Parquet.

Every definition is integer arithmetic (or plain aggregation) over the
driver's tables, so DuckDB evaluates the very same expressions in the
oracle SQL (``regionlens.plans.oracle``).  The plane is in metres,
0 <= x, y < 100003.  All fixtures are lazy DataFrames whose size grows with
the scale factor of the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions import geo

# Fixed values of the fixture definitions (see FIXTURES.md section 3).
PLANE = 100003
ZONE_SIDE = 20000          # zone height and base width, metres
ZONE_SHEAR = 2000          # x shift per zone row (0.1 * ZONE_SIDE)
ZONE_CELL = 2000.0         # grid cell for point-in-zone joins (a tenth of a zone)
ROAD_CELL = 10000.0        # grid cell for road clipping (half a zone)
FACILITY_TYPES = ["School", "hospital", "grocery"]   # by s_suppkey % 3
PANEL_YEARS = list(range(1995, 2002))
GRID_DX = 500.0            # grid raster: col -> x
GRID_DY = 12500.0          # grid raster: row -> y
SCENE_CLOUD_MAX = 20
SCENE_START = "2024-01-05"
SCENE_END = "2024-01-20"   # exclusive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lpad_min(c: Column, n: int) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def customer_geoid(custkey: Column, nationkey: Column) -> Column:
    """'51' + county (3) + tract (6) + block group (1)."""
    return F.concat(F.lit("51"), F.lpad(nationkey.cast("string"), 3, "0"),
                    _lpad_min(F.floor(custkey / 4), 6), (custkey % 4).cast("string"))


# ---------------------------------------------------------------- vectors

def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 parallelogram zones from ``nation``: cell (i, j) = (n % 5, n div 5),
    corners x = 20000*u + 2000*v, y = 20000*v for u in {i, i+1}, v in {j, j+1}."""
    n = F.col("n_nationkey")
    i, j = n % 5, F.floor(n / 5)

    def corner(du, dv):
        u, v = i + du, j + dv
        return geo.point(u * ZONE_SIDE + v * ZONE_SHEAR, v * ZONE_SIDE)

    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return table(spark, sf_dir, "nation").select(
        n.alias("zone_id"),
        F.concat(F.lit("51"), F.lpad(n.cast("string"), 3, "0"), F.lit("0202001")).alias("geoid"),
        F.lpad(n.cast("string"), 3, "0").alias("county"),
        F.array(ring).alias("rings"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("custkey"), customer_geoid(c, F.col("c_nationkey")).alias("geoid"),
        ((c * 7919) % PLANE).cast("double").alias("x"),
        ((c * 104729) % PLANE).cast("double").alias("y"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    amen = (F.when(s % 3 == 0, F.lit(FACILITY_TYPES[0]))
            .when(s % 3 == 1, F.lit(FACILITY_TYPES[1])).otherwise(F.lit(FACILITY_TYPES[2])))
    return table(spark, sf_dir, "supplier").select(
        s.alias("facility_id"),
        ((s * 15485863) % PLANE).cast("double").alias("x"),
        ((s * 32452843) % PLANE).cast("double").alias("y"),
        amen.alias("amenity"),
        F.create_map(F.lit("amenity"), amen).alias("tags"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-vertex line per part; also carries the segment columns."""
    p = F.col("p_partkey")
    ax, ay = (p * 7919) % PLANE, (p * 104729) % PLANE
    bx, by = ax + (p * 31) % 4001 - 2000, ay + (p * 37) % 4001 - 2000
    return table(spark, sf_dir, "part").select(
        p.alias("road_id"),
        F.array(geo.point(ax, ay), geo.point(bx, by)).alias("line"))


# ---------------------------------------------------------------- rasters

def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table with nodata: all bands NULL when l_linenumber = 7."""
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    valid = ln != 7
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        ok.alias("orderkey"), ln.alias("linenumber"),
        ((ok * 7919 + ln * 104729) % PLANE).cast("double").alias("x"),
        ((F.col("l_partkey") * 15485863 + ln * 31) % PLANE).cast("double").alias("y"),
        F.when(valid, price).alias("nir"),
        F.when(valid, price * (1 - F.col("l_discount"))).alias("red"),
        F.when(valid, price * (1 + F.col("l_tax"))).alias("swir"),
        F.when(valid, F.col("l_quantity")).alias("light"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular raster: row = l_linenumber, col = l_orderkey div 8, so it
    widens with the orders."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_linenumber").alias("row"), F.expr("l_orderkey div 8").alias("col"))
            .agg(F.avg("l_quantity").alias("value")))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("scene_id"), F.col("user_id").alias("pixel"), F.col("ts"),
        (e % 100).alias("cloud_pct"), ((e % 4) * 1024).cast("int").alias("qa60"),
        F.col("value"))


# ---------------------------------------------------------------- tables

def acs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census-style table: income = c_acctbal (negative = missing),
    population and poverty universe = order count, poverty count = 'F'
    orders.  Orders are aggregated before the join (partial aggregation)."""
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("n_orders"),
              F.count_if(F.col("o_orderstatus") == "F").alias("n_f")))
    c = table(spark, sf_dir, "customer")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    ck = F.col("c_custkey")
    return j.select(
        F.lit("51").alias("state"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("county"),
        _lpad_min(F.floor(ck / 4), 6).alias("tract"),
        (ck % 4).cast("string").alias("block_group"),
        F.col("c_acctbal").alias("B19013_001E"),
        F.coalesce("n_orders", F.lit(0)).alias("B01003_001E"),
        F.coalesce("n_orders", F.lit(0)).alias("B17021_001E"),
        F.coalesce("n_f", F.lit(0)).alias("B17021_002E"))


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid = nation, year) -> rounded sum of order prices; NULL where
    (nation + year) % 11 = 0.  Orders are summed per (customer, year)
    before the join, so even a customer holding a third of all orders
    reaches the join shuffle as one row per year."""
    o = (table(spark, sf_dir, "orders")
         .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
         .agg(F.sum("o_totalprice").alias("_s")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    agg = (o.join(c, o.o_custkey == c.c_custkey)
           .groupBy(F.col("c_nationkey").alias("gid"), "year")
           .agg(F.round(F.sum("_s"), 2).alias("gdp")))
    return agg.withColumn("gdp", F.when((F.col("gid") + F.col("year")) % 11 != 0, F.col("gdp")))


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 long -> wide with an explicit year list: gid, iso3, country,
    '1995' ... '2001'."""
    long = panel_long(spark, sf_dir)
    wide = long.groupBy("gid").pivot("year", PANEL_YEARS).agg(F.first("gdp"))
    nat = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("gid"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"),
        F.col("n_name").alias("country"))
    return nat.join(wide, "gid", "left").select(
        "gid", "iso3", "country", *[F.col(f"`{y}`").alias(str(y)) for y in PANEL_YEARS])


def population_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country population table keyed by ``ISO3_code`` (nations with
    n % 7 = 3 are absent, so a left join leaves NULLs)."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("population"), F.round(F.sum("c_acctbal"), 2).alias("wealth"))
    return (c.where(F.col("c_nationkey") % 7 != 3).select(
        F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("ISO3_code"),
        F.concat(F.lit("LOC"), F.col("c_nationkey").cast("string")).alias("Location"),
        "population", "wealth"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix, one row per customer: x1 order count, x2 average order
    price (NULL without orders), x3 centroid y, target = c_acctbal."""
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("x1"), F.avg("o_totalprice").alias("x2")))
    c = table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    geoid = customer_geoid(ck, F.col("c_nationkey"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        geoid.alias("geoid"), F.substring(geoid, 6, 6).alias("tract"),
        F.coalesce("x1", F.lit(0)).cast("double").alias("x1"), F.col("x2"),
        ((ck * 104729) % PLANE).cast("double").alias("x3"),
        F.col("c_acctbal").alias("target"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        customer_geoid(ck, F.col("c_nationkey")).alias("geoid"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("county"),
        F.col("c_acctbal").alias("actual"),
        (F.col("c_acctbal") * 0.9 + (ck % 17) * 10).alias("predicted"),
        (ck % 5).cast("int").alias("fold"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook corpus: one row per cell; outputs by (conv_id + turn) % 5 =
    0 error, 1 stderr stream, 2 image display, 3 stdout stream, 4 none."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    out_t = "struct<output_type:string,name:string,data:map<string,string>>"

    def output(otype, name, data):
        return F.struct(F.lit(otype).alias("output_type"), F.lit(name).cast("string").alias("name"),
                        data.alias("data"))

    empty_map = F.create_map().cast("map<string,string>")
    outputs = (F.when(k == 0, F.array(output("error", None, empty_map)))
               .when(k == 1, F.array(output("stream", "stderr", empty_map)))
               .when(k == 2, F.array(output("display_data", None,
                                            F.create_map(F.lit("image/png"), F.lit("iVBOR")))))
               .when(k == 3, F.array(output("stream", "stdout", empty_map)))
               .otherwise(F.array().cast(f"array<{out_t}>")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("notebook"), F.col("turn").alias("idx"),
        F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"),
        F.split(F.col("text"), "\n").alias("source"),
        outputs.cast(f"array<{out_t}>").alias("outputs"))
