"""Grid joins equal brute force; split and fold invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from regionlens.operators import quantile as Q
from regionlens.operators import spatial, split


def _points(spark, n, seed, lo=0, hi=50000, prefix="p"):
    rnd = random.Random(seed)
    return spark.createDataFrame([(f"{prefix}{i}", float(rnd.randint(lo, hi)), float(rnd.randint(lo, hi)),
                                   rnd.choice(["a", "b"])) for i in range(n)],
                                 "id string, x double, y double, amenity string")


@pytest.mark.parametrize("seed", [1, 2])
def test_count_within_equals_brute_force(spark, seed):
    pts = _points(spark, 300, seed)
    fac = _points(spark, 120, seed + 100, prefix="f").withColumnRenamed("id", "facility_id")
    got = {r.id: r for r in spatial.count_within(pts, fac, "id", (1000, 3000), ["a", "b"]).collect()}
    P, Fc = pts.collect(), fac.collect()
    for p in P:
        for t in ("a", "b"):
            for r, nm in ((1000, "1km"), (3000, "3km")):
                want = sum(1 for f in Fc if f.amenity == t and (p.x - f.x) ** 2 + (p.y - f.y) ** 2 <= r * r)
                assert getattr(got[p.id], f"{t}_count_{nm}") == want


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_equals_brute_force(spark, seed):
    pts = _points(spark, 200, seed)
    # clustered facilities: most points are far from any of them
    fac = _points(spark, 30, seed + 7, lo=0, hi=5000, prefix="f").withColumn(
        "facility_id", F.monotonically_increasing_id())
    got = {r.id: r for r in spatial.nearest_facility(pts, fac, "id", ["a", "b", "c"]).collect()}
    Fc = fac.collect()
    for p in pts.collect():
        for t in ("a", "b"):
            d = [math.hypot(p.x - f.x, p.y - f.y) for f in Fc if f.amenity == t]
            want = min(d) if d else None
            g = getattr(got[p.id], f"nearest_{t}_dist")
            assert (g is None and want is None) or g == pytest.approx(want)
        assert got[p.id].nearest_c_dist is None


@pytest.mark.parametrize("cell", [1500.0, 4000.0, 20000.0])
def test_zone_assignment_independent_of_cell_size(spark, cell):
    from conftest import SF_SMALL
    from regionlens.sources import fixtures as fx
    z = fx.zones(spark, SF_SMALL)
    px = fx.pixels(spark, SF_SMALL)
    a = spatial.assign_points_to_zones(px, z, ["zone_id"], cell).groupBy("zone_id").count()
    b = px.withColumn("zi", F.floor((10 * F.col("x") - F.col("y")) / 200000.0)) \
        .withColumn("zj", F.floor(F.col("y") / 20000.0)) \
        .where("zi between 0 and 4 and zj between 0 and 4") \
        .groupBy((F.col("zi") + 5 * F.col("zj")).cast("int").alias("zone_id")).count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_exact_split_size_and_multilevel(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    monkeypatch.setattr(split, "_FETCH_BELOW", 3)  # force refinement levels
    s = split.exact_split(df, "k", 0.2, 42)
    assert s.where("is_test").count() == math.ceil(5000 * 0.2)
    want = sorted(df.select("k", split.hash_score("k", 42).alias("h")).collect(), key=lambda r: (r.h, r.k))
    want_set = {r.k for r in want[:1000]}
    assert {r.k for r in s.where("is_test").collect()} == want_set


def test_group_folds_keep_groups_together_and_balance(spark):
    rnd = random.Random(5)
    rows = [(f"r{i}", f"g{rnd.randint(0, 40)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, g string")
    f = split.group_folds(df, "g", 5)
    per_group = f.groupBy("g").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in per_group)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    biggest = max(r["count"] for r in df.groupBy("g").count().collect())
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= biggest


def test_contiguous_folds_match_ntile(spark):
    df = spark.range(103).select(F.format_string("%05d", "id").alias("k"))
    f = {r.k: r.fold for r in split.contiguous_folds(df, "k", 5).collect()}
    sizes = [sum(1 for v in f.values() if v == i) for i in range(5)]
    assert sizes == [21, 21, 21, 20, 20]
    ks = sorted(f)
    assert all(f[a] <= f[b] for a, b in zip(ks, ks[1:]))


def test_mask_cells_exact_count(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    m = split.mask_cells(df, "k", ["v"], 0.3)
    assert m.where(F.col("v").isNull()).count() == 300


@pytest.mark.parametrize("limit,buckets", [(10**6, 4096), (40, 8), (3, 4)])
def test_exact_quantiles_equal_numpy(spark, limit, buckets):
    import numpy as np
    rnd = random.Random(11)
    rows = []
    for g, n in (("s", 5), ("m", 50), ("l", 700)):
        for _ in range(n):
            v = float(rnd.randint(0, 20)) if rnd.random() < 0.4 else rnd.uniform(-1e3, 1e3)
            rows.append((g, v))
    rows.append(("l", None))
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.05, 0.25, 0.5, 0.75, 1.0]
    got = {(r.g, r.q): r.v for r in Q.exact_quantiles(df, "v", qs, ["g"], limit=limit, buckets=buckets).collect()}
    glob = {r.q: r.v for r in Q.exact_quantiles(df, "v", qs, limit=limit, buckets=buckets).collect()}
    for g in ("s", "m", "l"):
        vals = np.array([v for gg, v in rows if gg == g and v is not None])
        for q in qs:
            assert got[(g, q)] == pytest.approx(np.quantile(vals, q), rel=1e-12, abs=1e-9)
    allv = np.array([v for _, v in rows if v is not None])
    for q in qs:
        assert glob[q] == pytest.approx(np.quantile(allv, q), rel=1e-12, abs=1e-9)


@pytest.fixture
def forced_salting(spark):
    """No broadcast, and any cell with more than 3 rows on a side is hot."""
    old_b = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.regionlens.skewRows", "3")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_b)
    spark.conf.unset("spark.regionlens.skewRows")


def test_salted_count_within_equals_brute_force(spark, forced_salting):
    # a third of the facilities sit in one cell: the hot key
    rnd = random.Random(9)
    pts = _points(spark, 150, 21, 0, 20000)
    fac_rows = [(f"f{i}", float(rnd.randint(5000, 5900)), float(rnd.randint(5000, 5900)), "a") for i in range(40)]
    fac_rows += [(f"g{i}", float(rnd.randint(0, 20000)), float(rnd.randint(0, 20000)), rnd.choice("ab"))
                 for i in range(80)]
    fac = spark.createDataFrame(fac_rows, "facility_id string, x double, y double, amenity string")
    got = {r.id: r for r in spatial.count_within(pts, fac, "id", (1000, 3000), ["a", "b"]).collect()}
    for p in pts.collect():
        for t in ("a", "b"):
            for r, nm in ((1000, "1km"), (3000, "3km")):
                want = sum(1 for f in fac_rows if f[3] == t and (p.x - f[1]) ** 2 + (p.y - f[2]) ** 2 <= r * r)
                assert getattr(got[p.id], f"{t}_count_{nm}") == want


def test_salted_nearest_equals_brute_force(spark, forced_salting):
    pts = _points(spark, 120, 31)
    fac = _points(spark, 40, 37, lo=0, hi=8000, prefix="f").withColumn("facility_id", F.monotonically_increasing_id())
    got = {r.id: r for r in spatial.nearest_facility(pts, fac, "id", ["a", "b"]).collect()}
    Fc = fac.collect()
    for p in pts.collect():
        for t in ("a", "b"):
            want = min(math.hypot(p.x - f.x, p.y - f.y) for f in Fc if f.amenity == t)
            assert getattr(got[p.id], f"nearest_{t}_dist") == pytest.approx(want)


def test_salted_zone_joins_match_unsalted(spark):
    from conftest import SF_SMALL
    from regionlens.sources import fixtures as fx
    z, px = fx.zones(spark, SF_SMALL), fx.pixels(spark, SF_SMALL)
    roads = spatial.explode_line_segments(fx.roads(spark, SF_SMALL), "line")

    def run():
        a = sorted(map(tuple, spatial.assign_points_to_zones(px, z, ["zone_id"], 4000.0)
                       .groupBy("zone_id").count().collect()))
        b = sorted(r.facility_id for r in spatial.clip_points(fx.facilities(spark, SF_SMALL), z, 4000.0).collect())
        c = sorted((r.geoid, round(r.total_road_length_m, 6))
                   for r in spatial.road_length_per_zone(roads, z, "geoid", 10000.0).collect())
        return a, b, c

    plain = run()
    old_b = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.regionlens.skewRows", "3")
    try:
        salted = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_b)
        spark.conf.unset("spark.regionlens.skewRows")
    assert salted == plain


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_contiguous_folds_do_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(2003).select(F.format_string("%06d", F.col("id") * 7919 % 2003).alias("k"), "id")
        got = sorted((r.k, r.fold) for r in split.contiguous_folds(df.repartition(parts + 1), "k", 5).collect())
        assert [f for _, f in got] == [f for f, n in enumerate([401, 401, 401, 400, 400]) for _ in range(n)]
        few = split.contiguous_folds(df.limit(3), "k", 5)
        assert sorted(r.fold for r in few.collect()) == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_splits_with_ties_and_null_keys(spark):
    rows = [("a", 1), ("a", 2), ("a", 3), (None, 4), (None, 5), ("b", 6), ("c", 7), ("d", 8)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert split.exact_split(df, "k", 0.5).where("is_test").count() == 4
    assert split.exact_split(df, "k", 0.5).count() == 8
    assert split.mask_cells(df, "k", ["v"], 0.5).where("v IS NULL").count() == 4
    folds = split.contiguous_folds(df, "k", 4)
    assert sorted(r.fold for r in folds.collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert {r.fold for r in folds.where("k IS NULL").collect()} == {0}


def test_splits_tell_copies_apart(spark, monkeypatch):
    rows = [(i if i % 3 else 50, 1 if i % 3 == 0 else i, 2) for i in range(120)] + [(None, 3, 2)] * 30
    df = spark.createDataFrame(rows, "k int, v int, w int").repartition(7)
    for limit in (10_000, 5):
        monkeypatch.setattr(split, "_FETCH_BELOW", limit)
        for frac in (0.1, 0.5):
            got = split.exact_split(df, "k", frac)
            assert got.columns == [*df.columns, "is_test"]
            assert (got.count(), got.where("is_test").count()) == (150, round(150 * frac))
            got = split.mask_cells(df, "k", ["v", "w"], frac)
            assert (got.where("v IS NULL").count(), got.where("w IS NULL").count()) == (150 * frac, 150 * frac)
    for k in (4, 10):
        got = [r.n for r in split.contiguous_folds(df, "k", k).groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()]
        assert got == [150 // k + (f < 150 % k) for f in range(k)]


def test_row_hash_leaves_maps_out(spark):
    df = spark.sql("SELECT 1 AS a, map('x', 1) AS tags")
    assert df.select(spatial.row_hash(df).alias("h")).first().h == df.select(F.xxhash64("a").alias("h")).first().h


def test_group_folds_equal_greedy_pass(spark):
    import heapq

    rnd = random.Random(9)
    sizes = [rnd.choice([1, 1, 1, 2, 2, 3, 5, 8, 90, 400]) for _ in range(300)] + [1500]
    rows = [(f"g{i:03d}" if i else None,) for i, n in enumerate(sizes) for _ in range(n)]
    got = {r.g: r.fold for r in split.group_folds(spark.createDataFrame(rows, "g string"), "g", 5).distinct().collect()}
    heap, want = [(0, f) for f in range(5)], {}
    groups = sorted(((-n, f"g{i:03d}" if i else "") for i, n in enumerate(sizes)))  # NULL before all text
    for n, g in groups:
        load, f = heapq.heappop(heap)
        want[g or None] = f
        heapq.heappush(heap, (load - n, f))
    assert got == want
    assert split.group_folds(spark.createDataFrame([], "g string"), "g", 5).collect() == []


def test_quantiles_agree_to_the_last_bit_at_every_limit(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i % 3, rnd.gauss(0, 1e3)) for i in range(900)], "g int, v double")
    qs = [0.1, 0.25, 1 / 3, 0.5, 0.9]
    one, two = ({(r.g, r.q): r.v for r in Q.exact_quantiles(df, "v", qs, ["g"], limit=n, buckets=7).collect()}
                for n in (10**6, 4))
    assert len(one) == 15 and one == two


def test_nearest_leaves_missing_coordinates_aside(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, 1.0), ("c", float("nan"), 1.0), ("d", 9e6, 0.0)],
                                "k string, x double, y double")
    fac = spark.createDataFrame([(1, "School", 3.0, 4.0), (2, "School", None, 0.0), (3, "School", 0.0, float("nan"))],
                                "facility_id long, amenity string, x double, y double")
    got = {r.k: r.nearest_school_dist for r in spatial.nearest_facility(pts, fac, "k", ["School"]).collect()}
    assert got["a"] == 5.0 and got["b"] is None and got["c"] is None and got["d"] == pytest.approx(math.hypot(9e6 - 3, 4))


def test_warp_keeps_partial_and_narrow_edges(spark):
    from regionlens.operators import raster

    row = spark.createDataFrame([(0, c, float(c)) for c in range(7)], "row int, col int, value double")
    got = {r.col: r.value for r in raster.bilinear_warp(row, 1.5, 1.0).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[4] == 6.0       # the last one is filled to two thirds
    one = raster.bilinear_warp(row.where("col = 0"), 5.0, 5.0).collect()
    assert [(r.row, r.col) for r in one] == [(0, 0)]
    assert raster.bilinear_warp(row.where("col > 9"), 2.0, 2.0).collect() == []


def test_measured_bytes_counts_long_texts(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 10_000).alias("s"), F.array(F.repeat(F.lit("y"), 500)).alias("a"))
    assert spatial.measured_bytes(df) > 1000 * 10_500


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_cell_join_splits_hot_keys_of_both_sides(spark, how):
    left = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("a"))
    right = spark.range(90).select((F.col("id") % 2).cast("int").alias("k"), F.col("id").alias("b"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.regionlens.skewRows")
    old = spark.conf.get(names[0])
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "20")
    try:
        got = spatial.cell_join(left, right, ["k"], how, lambda l, r: (l["a"] + r["b"]) % 7 == 0).collect()
    finally:
        spark.conf.set(names[0], old)
        spark.conf.unset(names[1])
    pairs = [(a, b) for a in range(400) for b in range(90) if int(a % 3 == 0) == b % 2 and (a + b) % 7 == 0]
    if how == "inner":
        assert sorted((r.a, r.b) for r in got) == pairs
    else:
        assert sorted(r.a for r in got) == sorted({a for a, _ in pairs})


def test_quantiles_of_infinite_and_extreme_values(spark):
    from regionlens.operators import quantile as Q
    inf = float("inf")
    for vals in ([*map(float, range(60)), inf], [-inf] * 20 + [inf] * 21 + [1.0, 2.0],
                 [1.7e308 * (-1) ** i * (1 - i / 200) for i in range(40)], [0.0] * 10 + [5e-324] * 11):
        df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "g int, v double").repartition(3)
        small = sorted(map(str, Q.exact_quantiles(df, "v", [0, 0.25, 0.5, 1.0], ["g"]).collect()))
        big = sorted(map(str, Q.exact_quantiles(df, "v", [0, 0.25, 0.5, 1.0], ["g"], limit=3, buckets=64).collect()))
        assert small == big
