"""Spatial joins as grid-cell equi-joins.

Catalyst has no spatial index: a distance or point-in-polygon predicate on
its own plans as a nested-loop join.  Every join here therefore first maps
both sides to integer grid cells, equi-joins on the cell key (hash or
sort-merge, chosen by Spark / AQE), and evaluates the exact predicate as the
join's residual condition.  No pair list is ever built outside the cell
neighbourhood, and no side is broadcast unless its measured size is under the
session's broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions import geo
from regionlens.operators import quadtree
from regionlens.session import materialize

_DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024
_ARRAY_ELEMENT_BYTES = 40


# ---------------------------------------------------------------- sizing

def broadcast_limit(spark: SparkSession) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", str(_DEFAULT_BROADCAST_BYTES))
    try:
        v = int(str(raw).lower().rstrip("b"))
    except ValueError:
        v = _DEFAULT_BROADCAST_BYTES
    return v if v > 0 else 0


def _type_bytes(dt: T.DataType) -> int:
    if isinstance(dt, T.StructType):
        return sum(_type_bytes(f.dataType) for f in dt.fields)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return 16
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return 24
    if isinstance(dt, (T.ByteType, T.BooleanType)):
        return 1
    if isinstance(dt, T.ShortType):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    return 8


def _flat_row_bytes(schema: T.StructType) -> int:
    return _type_bytes(schema) + 8


def measured_bytes(df: DataFrame, array_cols: Sequence[str] = ()) -> int:
    """Measure (not estimate) a side's size: one aggregate over it.

    Strings count with their real bytes and other columns without a fixed
    width with the bytes of their JSON text; arrays in ``array_cols`` hold
    fixed-width numbers and count by element.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.coalesce(F.sum(F.size(F.flatten(F.col(c))) if _is_nested_array(df, c)
                              else F.size(F.col(c))), F.lit(0)).alias(f"e{i}")
             for i, c in enumerate(array_cols)]
    own = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            own.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) and f.name not in array_cols:
            own.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), F.lit(0)))
    widths = sum((w.cast("bigint") for w in own), F.lit(0).cast("bigint"))
    row = df.agg(*aggs, F.coalesce(F.sum(widths), F.lit(0)).alias("w")).first()
    elems = sum(row[f"e{i}"] for i in range(len(array_cols)))
    return row["n"] * _flat_row_bytes(df.schema) + row["w"] + elems * _ARRAY_ELEMENT_BYTES


def _is_nested_array(df: DataFrame, c: str) -> bool:
    dt = df.schema[c].dataType
    return isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.ArrayType)


def broadcast_if_small(df: DataFrame, array_cols: Sequence[str] = (),
                       limit_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its measured size is under the limit.

    Beyond the limit the plain DataFrame is returned and the join shuffles
    both sides on the cell key (AQE may still split skewed partitions).
    """
    limit = broadcast_limit(df.sparkSession) if limit_bytes is None else limit_bytes
    if limit <= 0:
        return df
    return F.broadcast(df) if measured_bytes(df, array_cols) <= limit else df


# ---------------------------------------------------------------- skew-safe join

_SKEW_ROWS_CONF = "spark.regionlens.skewRows"
_DEFAULT_SKEW_ROWS = 200_000
#: At most this many of a side's keys are split, the hottest; any other holds less than 1 / _HOT_KEYS of its rows.
_HOT_KEYS = 100_000


def skew_rows(spark: SparkSession) -> int:
    """Rows of one key on one side above which the key is split (at least)."""
    return int(spark.conf.get(_SKEW_ROWS_CONF, str(_DEFAULT_SKEW_ROWS)))


def cell_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              cond=None, array_cols: Sequence[str] = (), right_bytes: int | None = None) -> DataFrame:
    """Equi-join on grid-cell ``keys`` that survives hot cells.

    ``cond(l, r)`` optionally adds a residual predicate over the two joined
    frames.  ``right_bytes`` passes a size the caller already measured.  The output has ``left``'s columns (one copy of the keys) plus,
    for inner joins, ``right``'s other columns.

    * ``right`` measured under the broadcast limit: broadcast hash join, no
      shuffle, and a hot cell is spread over the tasks of ``left``'s input.
    * otherwise both sides shuffle on the keys (a merge join by hint: Spark's own
      estimate does not see rows that an explode adds, and would broadcast them
      through the driver).  Keys holding more than
      ``spark.regionlens.skewRows`` rows on a side are found with one aggregate
      per side, the 100,000 hottest of each at most; so at most 200,000 hot
      keys are collected and broadcast, however large the sides are.  A hot key is split into a x b salt cells:
      a left row takes salt i = hash(row) mod a and is copied to every j < b,
      a right row takes j = hash(row) mod b and is copied to every i < a, so
      each (i, j) task sees 1/(a*b) of the key's pairs and every pair still
      meets exactly once.  Salts are hashes of the row, so a recomputed task
      makes the same choice.  For ``left_semi`` only ``left`` is spread
      (b = 1, and a grows with the key's rows on both sides), so no left row
      is duplicated.  For ``left`` joins a hot left
      row may come out once per right salt with NULLs on the right, so the
      caller must aggregate per left key (every spatial operator here does).
    """
    spark = left.sparkSession
    keys = list(keys)
    rk = {k: f"_rk_{k}" for k in keys}
    right = right.select(*[F.col(f"`{c}`").alias(rk.get(c, c)) for c in right.columns])

    def on(l, r, salted=False):
        c = None
        for k in keys:
            e = l[k] == r[rk[k]]
            c = e if c is None else c & e
        if salted:
            c = c & (l["_si"] == r["_ri"]) & (l["_sj"] == r["_rj"])
        return c & cond(l, r) if cond is not None else c

    def finish(out):
        return out if how == "left_semi" else out.drop(*rk.values())

    limit = broadcast_limit(spark)
    size = right_bytes if right_bytes is not None else (measured_bytes(right, array_cols) if limit > 0 else 0)
    if limit > 0 and size <= limit:
        rb = F.broadcast(right)
        return finish(left.join(rb, on(left, rb), how))

    def hot_keys(df, names):
        """How many times over the threshold each of a side's hottest keys is."""
        thr = skew_rows(spark)
        return {tuple(r[n] for n in names): -(-r["_n"] // thr) for r in
                df.where(has_key(names)).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > thr).orderBy(F.desc("_n"), *names).limit(_HOT_KEYS).collect()}

    def has_key(names):
        c = F.lit(True)              # NULL keys meet nothing and need no salt
        for n in names:
            c = c & F.col(n).isNotNull()
        return c

    hot_l, hot_r = hot_keys(left, keys), hot_keys(right, [rk[k] for k in keys])
    hot = set(hot_l) | set(hot_r)
    if not hot:
        merged = right.hint("merge")
        return finish(left.join(merged, on(left, merged), how))
    if how == "left_semi":
        rows = [(*k, hot_l.get(k, 1) * hot_r.get(k, 1), 1) for k in hot]
    else:
        rows = [(*k, hot_l.get(k, 1), hot_r.get(k, 1)) for k in hot]
    kt = {f.name: f.dataType.simpleString() for f in left.schema.fields if f.name in keys}
    salts = F.broadcast(spark.createDataFrame(
        rows, ", ".join([f"{k} {kt[k]}" for k in keys] + ["_sa int", "_sb int"])))
    lh, rh = row_hash(left), row_hash(right)
    ls = (left.join(salts, keys, "left")
          .withColumn("_sa", F.coalesce("_sa", F.lit(1))).withColumn("_sb", F.coalesce("_sb", F.lit(1)))
          .withColumn("_si", F.pmod(lh, F.col("_sa").cast("long")))
          .withColumn("_sj", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_sb") - 1).cast("long"))))
          .drop("_sa", "_sb"))
    rsalt = salts.select(*[F.col(k).alias(rk[k]) for k in keys], "_sa", "_sb")
    rs = (right.join(rsalt, [rk[k] for k in keys], "left")
          .withColumn("_sa", F.coalesce("_sa", F.lit(1))).withColumn("_sb", F.coalesce("_sb", F.lit(1)))
          .withColumn("_rj", F.pmod(rh, F.col("_sb").cast("long")))
          .withColumn("_ri", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_sa") - 1).cast("long"))))
          .drop("_sa", "_sb"))
    rs = rs.hint("merge")
    out = ls.join(rs, on(ls, rs, salted=True), how)
    out = out.drop("_si", "_sj") if how == "left_semi" else out.drop("_si", "_sj", "_ri", "_rj")
    return finish(out)


# ---------------------------------------------------------------- cells

def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row's columns; maps, which have no hash, are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def _cell(v, size) -> Column:
    return F.floor(v / F.lit(float(size)))


def _offsets9() -> Column:
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in (-1, 0, 1) for dy in (-1, 0, 1)])


#: Cells reach this share of their width further when edges are placed, as points are assigned by a rounded division.
_REACH = 1e-9


def zone_cells(zones: DataFrame, cell_size: float, rings: str = "rings") -> DataFrame:
    """One row per (zone, grid cell) that the zone meets, written once.

    A cell carries the edges that touch it (``_edges``) and whether its lower
    right corner is inside (``_corner``): a point of the cell is then tested
    against these edges alone (`geo.cell_parity_sql`).  A cell without edges is
    wholly inside or, not being listed, wholly outside.

    Edges are placed one by one: each goes to the cells that it passes, strip
    by strip, and to the lower border of each strip that it crosses.  The
    sorted crossings of a border tell which corners on it are inside.  So work
    and table grow with the edges and the inner cells, not with edges times
    cells.
    """
    c = float(cell_size)
    cols = [x for x in zones.columns if x != rings]
    named = materialize(zones.withColumn("_z", F.monotonically_increasing_id()), "zones")
    edges = named.select("_z", F.inline(geo.polygon_edges(rings)))
    low, high, reach = F.least("ay", "by"), F.greatest("ay", "by"), _REACH * c
    strip = edges.withColumn("_cy", F.explode(F.sequence(_cell(low - reach, c), _cell(high + reach, c))))
    # the edge's stretch in the strip, by height
    slope = F.try_divide(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    at = lambda y: F.least(F.greatest(F.col("ax") + (y - F.col("ay")) * slope, F.least("ax", "bx")), F.greatest("ax", "bx"))
    ends = [at(F.greatest(low, F.col("_cy") * c - reach)), at(F.least(high, (F.col("_cy") + 1) * c + reach))]
    left, right = (F.when(low == high, f("ax", "bx")).otherwise(f(*ends)) for f in (F.least, F.greatest))
    passed = strip.withColumn("_cx", F.explode(F.sequence(_cell(left - reach, c), _cell(right + reach, c))))
    border = passed.groupBy("_z", "_cx", "_cy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_edges"))
    y0 = F.col("_cy") * c
    crossed = (strip.where((F.col("ay") > y0) != (F.col("by") > y0))
               .groupBy("_z", "_cy").agg(F.array_sort(F.collect_list(
                   F.col("ax") + F.try_divide((y0 - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("by") - F.col("ay")))).alias("_xs")))
    # the corners from each odd crossing to the next
    spans = crossed.select("_z", "_cy", "_xs", F.explode(F.sequence(F.lit(1), F.size("_xs"), F.lit(2))).alias("_i"))
    corners = (spans.withColumn("_cx", F.explode(F.sequence(_cell(F.element_at("_xs", F.col("_i")), c) - 1,
                                                            _cell(F.try_element_at("_xs", F.col("_i") + 1), c))))
               .where(F.size(F.filter("_xs", lambda v: (F.col("_cx") + 1) * c < v)) % 2 == 1)
               .select("_z", "_cx", "_cy").distinct().withColumn("_corner", F.lit(True)))
    cells = (border.join(corners, ["_z", "_cx", "_cy"], "full")
             .select("_z", "_cx", "_cy", F.coalesce("_corner", F.lit(False)).alias("_corner"),
                     F.coalesce("_edges", F.array().cast(f"array<{geo.EDGE_TYPE}>")).alias("_edges")))
    return materialize(cells.join(named.select("_z", *cols), "_z").drop("_z"), "zone-cells")


def _corner_sql(cell_size: float) -> tuple[str, str]:
    """x of a cell's right border and y of its lower one."""
    c = f"{float(cell_size)!r}D"
    return f"((_cx + 1) * {c})", f"(_cy * {c})"


def _inside_sql(x: str, y: str, cell_size: float) -> str:
    return geo.cell_parity_sql("_corner", "_edges", x, y, *_corner_sql(cell_size))


def _in_zone(x: str, y: str, cell_size: float) -> Column:
    return F.expr(f"CASE WHEN size(_edges) = 0 THEN _corner ELSE {_inside_sql(x, y, cell_size)} END")


# ---------------------------------------------------------------- J8 / J9

def assign_points_to_zones(points: DataFrame, zones: DataFrame, zone_cols: Sequence[str],
                           cell_size: float, x: str = "x", y: str = "y",
                           rings: str = "rings") -> DataFrame:
    """Inner join of points (pixels, facilities) with the zones whose
    polygon contains them (pixel-centre rule, half-open borders).

    Output = point columns + ``zone_cols``.  Each point is tested only against
    zones whose bounding box shares its grid cell.
    """
    zc = zone_cells(zones.select(*zone_cols, rings), cell_size, rings)
    p = (points.withColumn("_cx", _cell(F.col(x), cell_size))
         .withColumn("_cy", _cell(F.col(y), cell_size)))
    j = cell_join(p, zc, ["_cx", "_cy"], "inner", lambda l, r: _in_zone(f"`{x}`", f"`{y}`", cell_size), ["_edges"])
    return j.drop("_cx", "_cy", "_edges", "_corner")


def clip_points(points: DataFrame, zones: DataFrame, cell_size: float, x: str = "x",
                y: str = "y", rings: str = "rings") -> DataFrame:
    """Keep points inside the union of the zones (a semi-join, so a
    point inside several overlapping parts is kept once; no dissolve)."""
    zc = zone_cells(zones.select(rings), cell_size, rings).select("_cx", "_cy", "_edges", "_corner")
    p = (points.withColumn("_cx", _cell(F.col(x), cell_size))
         .withColumn("_cy", _cell(F.col(y), cell_size)))
    j = cell_join(p, zc, ["_cx", "_cy"], "left_semi", lambda l, r: _in_zone(f"`{x}`", f"`{y}`", cell_size), ["_edges"])
    return j.drop("_cx", "_cy")


# ---------------------------------------------------------------- J5 / A12

def _radius_names(radii: Sequence[float]) -> list[str]:
    names = [f"{int(r // 1000)}km" for r in radii]
    if len(set(names)) != len(names) or any(r < 1000 for r in radii):
        raise ValueError(f"radii {list(radii)} give colliding km names {names}")
    return names


def count_within(points: DataFrame, facilities: DataFrame, key: str,
                 radii: Sequence[float] = (1000, 2000, 5000),
                 types: Sequence[str] = (), type_col: str = "amenity",
                 px: str = "x", py: str = "y", fx: str = "x", fy: str = "y") -> DataFrame:
    """A12 facility counts per point, radius and type, zero-filled.

    The facilities' quadtree has top cells as wide as the largest radius; cells
    wholly inside a disc are taken by their stored count and only those on a
    rim are opened, for all radii together.  Facilities at the same spot and
    of the same type are one weighted row, and points at the same place are
    counted once, so copies do not multiply the join.  Columns: ``{type}_count_{km}km``.  Points and facilities without finite
    coordinates count nothing.  Facilities are used through their point (centroid), as the nearest-
    distance feature does.
    """
    names = _radius_names(radii)
    spots = (facilities.where(F.col(type_col).isin(list(types)) & _finite(fx) & _finite(fy))
             .groupBy(F.col(type_col).alias("t"), F.col(fx).cast("double").alias("fx"), F.col(fy).cast("double").alias("fy"))
             .agg(F.count(F.lit(1)).alias("w"), F.lit(None).cast("bigint").alias("fid")))
    tree = quadtree.build(materialize(spots, "spots"), float(max(radii)), leaf=quadtree.BLOCK)
    pts = points.select(F.col(key).alias("_key"), F.col(px).cast("double").alias("px"), F.col(py).cast("double").alias("py"))
    finite = pts.where(_finite("px") & _finite("py"))
    hits = quadtree.count_in_discs(finite.select("px", "py").distinct(), tree, [float(r) for r in radii])
    cols = {f"{t.lower()}_count_{nm}": (t, f"c{i}") for t in types for i, nm in enumerate(names)}
    near = materialize(hits.groupBy("px", "py").agg(*[F.sum(F.when(F.col("t") == t, F.col(c))).alias(n) for n, (t, c) in cols.items()]), "disc-counts")
    every = pts.select("_key", *[F.lit(0).cast("long").alias(n) for n in cols])
    return (cell_join(finite, near, ["px", "py"], "left").select("_key", *cols).unionByName(every)
            .groupBy(F.col("_key").alias(key)).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in cols]))


# ---------------------------------------------------------------- J7

def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))   # NaN is above all numbers


def nearest_facility(points: DataFrame, facilities: DataFrame, key: str,
                     types: Sequence[str], type_col: str = "amenity", fac_id: str = "facility_id",
                     px: str = "x", py: str = "y", fx: str = "x", fy: str = "y") -> DataFrame:
    """J7 / W8 nearest facility of each type per point, exact.

    A quadtree of the facilities (one spot per type and place, with its
    smallest id) is searched from the top: at each level the cells that begin
    beyond the nearest cell's farthest place are dropped, so a point meets the
    spots of a few leaves.  Output: ``key`` + ``nearest_{type}_dist`` (NULL
    when a type has no facility) + ``nearest_{type}_id``.  Points and
    facilities without finite coordinates take no part: such a point has
    NULLs.
    """
    spots = materialize(facilities.where(F.col(type_col).isin(list(types)) & _finite(fx) & _finite(fy))
                        .groupBy(F.col(type_col).alias("t"), F.col(fx).cast("double").alias("fx"), F.col(fy).cast("double").alias("fy"))
                        .agg(F.min(fac_id).alias("fid"), F.lit(1).cast("long").alias("w")), "nearest-spots")
    st = spots.agg(F.min("fx").alias("x0"), F.max("fx").alias("x1"), F.min("fy").alias("y0"), F.max("fy").alias("y1")).first()
    named = [f"nearest_{t.lower()}_{c}" for t in types for c in ("dist", "id")]
    if st["x0"] is None:
        return points.select(key, *[F.lit(None).cast("double" if c.endswith("dist") else "long").alias(c) for c in named])
    # a little wider than the extent, so that the far border is inside the top cell
    size = max(st["x1"] - st["x0"], st["y1"] - st["y0"], 1.0) * (1 + 1e-6)
    tree = quadtree.build(spots, size, st["x0"], st["y0"], leaf=8)
    pts = points.select(F.col(key).alias("_key"), F.col(px).cast("double").alias("px"), F.col(py).cast("double").alias("py"))
    best = quadtree.nearest_spots(pts.where(_finite("px") & _finite("py")), tree, "_key", list(types))
    aggs = []
    for t in types:
        own = F.min(F.when(F.col("t") == t, F.struct("d2", "fid")))
        aggs += [F.sqrt(own["d2"]).alias(f"nearest_{t.lower()}_dist"), own["fid"].alias(f"nearest_{t.lower()}_id")]
    return points.select(key).join(best.groupBy(F.col("_key").alias(key)).agg(*aggs), key, "left").select(key, *named)


# ---------------------------------------------------------------- J6 / G6

def explode_line_segments(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """P14 + segments: one row per part (if multi) and per vertex pair."""
    df = lines
    dt = df.schema[line_col].dataType
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.ArrayType):
        df = df.select("*", F.posexplode(line_col).alias("part", "_part")).drop(line_col) \
            .withColumnRenamed("_part", line_col)
    seg = df.select("*", F.posexplode(geo.ring_edges(line_col)).alias("seg", "_e")).drop(line_col)
    return seg.select(*[c for c in seg.columns if c != "_e"],
                      F.col("_e.ax").alias("ax"), F.col("_e.ay").alias("ay"),
                      F.col("_e.bx").alias("bx"), F.col("_e.by").alias("by"))


def clip_segments_to_zones(segments: DataFrame, zones: DataFrame, zone_cols: Sequence[str],
                           cell_size: float, seg_cols: Sequence[str], rings: str = "rings") -> DataFrame:
    """J6 + G6: pieces of line segments inside each zone, with their length.

    Segments and zones meet on grid cells.  In each cell the segment's stretch
    there is cut at the cell's own edges, and the pieces whose midpoints are
    inside are kept.  Output: seg_cols + zone_cols + ``length``, a row per cell
    that they share (0 where the segment misses the zone).
    """
    j = _cell_spans(segments, zones, zone_cols, cell_size, rings)
    length = F.aggregate("_spans", F.lit(0.0), lambda a, s: a + (s["t1"] - s["t0"])) * F.hypot(
        F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    # no row filter on length here: Catalyst would push it into the join
    # condition and evaluate the clip twice; rows with length 0 vanish in the sums
    return j.select(*seg_cols, *zone_cols, length.alias("length"))


def _cell_spans(segments: DataFrame, zones: DataFrame, zone_cols: Sequence[str], cell_size: float, rings: str) -> DataFrame:
    """Segment, zone and shared cell, with the intervals of the segment inside both (``_spans``)."""
    zc = zone_cells(zones.select(*zone_cols, rings), cell_size, rings)
    s = (segments
         .withColumn("_cx", F.explode(F.sequence(_cell(F.least("ax", "bx"), cell_size), _cell(F.greatest("ax", "bx"), cell_size))))
         .withColumn("_cy", F.explode(F.sequence(_cell(F.least("ay", "by"), cell_size), _cell(F.greatest("ay", "by"), cell_size)))))
    # the stretch in the cell; one along a border belongs to the cell that begins there
    c = float(cell_size)
    lo, hi = [], []
    for axis, cell in (("x", "_cx"), ("y", "_cy")):
        a, d = f"a{axis}", f"(b{axis} - a{axis})"
        low, high = f"({cell} * {c!r}D)", f"(({cell} + 1) * {c!r}D)"
        lo.append(f"CASE WHEN {d} = 0 THEN CASE WHEN {a} >= {low} AND {a} < {high} THEN 0.0D ELSE 2.0D END "
                  f"WHEN {d} > 0 THEN try_divide({low} - {a}, {d}) ELSE try_divide({high} - {a}, {d}) END")
        hi.append(f"CASE WHEN {d} = 0 THEN 1.0D WHEN {d} > 0 THEN try_divide({high} - {a}, {d}) ELSE try_divide({low} - {a}, {d}) END")
    s = s.withColumn("_t0", F.expr(f"greatest(0.0D, {', '.join(lo)})")).withColumn("_t1", F.expr(f"least(1.0D, {', '.join(hi)})"))
    j = cell_join(s.where("_t0 < _t1"), zc, ["_cx", "_cy"], "inner", None, ["_edges"])
    # cuts in their own projection: the clip references them several times
    j = j.withColumn("_cuts", geo.segment_cuts("ax", "ay", "bx", "by", "_edges", "_t0", "_t1"))
    return j.withColumn("_spans", geo.inside_intervals("ax", "ay", "bx", "by", "_cuts", lambda x, y: _inside_sql(x, y, cell_size)))


def clip_lines(lines: DataFrame, boundary: DataFrame, line_id: str, cell_size: float, line_col: str = "line",
               rings: str = "rings") -> DataFrame:
    """J9 / G8 the part of each line inside the union of ``boundary``'s polygons, as ordered pieces:
    ``line_id``, piece (from 0), line and length.

    Along each segment the intervals inside any polygon are merged, so
    overlapping polygons do not count a stretch twice; intervals that meet at a
    vertex are stitched together.  A line that misses the boundary has no
    row, a multi-part line (``array<array<point>>``) is never stitched across its
    parts.  Rows that share an id count as one line's parts only if their
    column is nested; ids of plain lines must differ.
    """
    multi = isinstance(lines.schema[line_col].dataType.elementType, T.ArrayType)
    segs = explode_line_segments(lines.select(line_id, line_col), line_col)
    if not multi:
        segs = segs.withColumn("part", F.lit(0))
    own = [line_id, "part", "seg", "ax", "ay", "bx", "by"]
    spans = _cell_spans(segs, boundary.select(rings), [], cell_size, rings).select(*own, F.inline("_spans"))
    # merge along each segment, over cells and polygons
    before = Window.partitionBy(line_id, "part", "seg").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(line_id, "part", "seg").orderBy("t0", "t1")
    spans = (spans.withColumn("_new", (F.col("t0") > F.coalesce(F.max("t1").over(before), F.lit(-1.0))).cast("int"))
             .withColumn("_run", F.sum("_new").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .groupBy(*own, "_run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")))
    # stitch runs that end at a vertex to those that begin there
    along = Window.partitionBy(line_id).orderBy("part", "seg", "t0")
    last = lambda c: F.lag(c).over(along)
    joined = ((F.col("t0") == 0.0) & (last("t1") == 1.0) & (last("part") == F.col("part")) & (last("seg") == F.col("seg") - 1))
    runs = (spans.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int"))
            .withColumn("piece", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1))
    at = lambda t: geo.point(F.col("ax") + F.col(t) * (F.col("bx") - F.col("ax")),
                             F.col("ay") + F.col(t) * (F.col("by") - F.col("ay")))
    step = F.struct("seg", "t0", at("t0").alias("a"), F.when(F.col("t1") == 1.0, geo.point(F.col("bx"), F.col("by")))
                    .otherwise(at("t1")).alias("b"),
                    ((F.col("t1") - F.col("t0")) * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("l"))
    out = runs.groupBy(line_id, "piece").agg(F.array_sort(F.collect_list(step)).alias("_s"))
    return out.select(line_id, F.col("piece").cast("int").alias("piece"),
                      F.concat(F.array(F.col("_s")[0]["a"]), F.transform("_s", lambda s: s["b"])).alias("line"),
                      F.aggregate("_s", F.lit(0.0), lambda x, s: x + s["l"]).alias("length"))


def road_length_per_zone(segments: DataFrame, zones: DataFrame, key: str, cell_size: float,
                         seg_id: str = "road_id", rings: str = "rings") -> DataFrame:
    """A13 total clipped road length per zone, zero-filled for zones
    without roads."""
    pieces = clip_segments_to_zones(segments, zones, [key], cell_size, [seg_id], rings)
    tot = pieces.groupBy(key).agg(F.sum("length").alias("total_road_length_m"))
    return (zones.select(key).join(tot, key, "left")
            .withColumn("total_road_length_m", F.coalesce("total_road_length_m", F.lit(0.0))))
