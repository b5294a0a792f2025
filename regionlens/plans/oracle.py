"""DuckDB text of the fixture tables, for the oracle SQL of each query.

Each entry is one CTE body; ``with_fixtures`` prepends the CTEs a query
names (and the ones those depend on) in a fixed order.  The expressions are
the same integer arithmetic as ``regionlens.sources.fixtures``.
"""

from __future__ import annotations

_GEOID = ("'51' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || "
          "(CASE WHEN length(CAST(c_custkey // 4 AS VARCHAR)) >= 6 THEN CAST(c_custkey // 4 AS VARCHAR) "
          "ELSE lpad(CAST(c_custkey // 4 AS VARCHAR), 6, '0') END) || CAST(c_custkey % 4 AS VARCHAR)")

_TRACT = ("(CASE WHEN length(CAST(c_custkey // 4 AS VARCHAR)) >= 6 THEN CAST(c_custkey // 4 AS VARCHAR) "
          "ELSE lpad(CAST(c_custkey // 4 AS VARCHAR), 6, '0') END)")

# (name, dependencies, body) in dependency order
FIXTURES: list[tuple[str, tuple[str, ...], str]] = [
    ("zones", (), """
        SELECT CAST(n_nationkey AS BIGINT) AS zone_id,
               '51' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '0202001' AS geoid,
               lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county,
               CAST(n_nationkey % 5 AS BIGINT) AS zi, CAST(n_nationkey // 5 AS BIGINT) AS zj
        FROM nation"""),
    ("centroids", (), f"""
        SELECT c_custkey AS custkey, {_GEOID} AS geoid,
               CAST(c_custkey * 7919 % 100003 AS DOUBLE) AS x,
               CAST(c_custkey * 104729 % 100003 AS DOUBLE) AS y
        FROM customer"""),
    ("facilities", (), """
        SELECT s_suppkey AS facility_id,
               CAST(s_suppkey * 15485863 % 100003 AS DOUBLE) AS x,
               CAST(s_suppkey * 32452843 % 100003 AS DOUBLE) AS y,
               CASE s_suppkey % 3 WHEN 0 THEN 'School' WHEN 1 THEN 'hospital' ELSE 'grocery' END AS amenity
        FROM supplier"""),
    ("segs", (), """
        SELECT p_partkey AS road_id,
               CAST(p_partkey * 7919 % 100003 AS DOUBLE) AS ax,
               CAST(p_partkey * 104729 % 100003 AS DOUBLE) AS ay,
               CAST(p_partkey * 7919 % 100003 + p_partkey * 31 % 4001 - 2000 AS DOUBLE) AS bx,
               CAST(p_partkey * 104729 % 100003 + p_partkey * 37 % 4001 - 2000 AS DOUBLE) AS "by"
        FROM part"""),
    ("pixels", (), """
        SELECT l_orderkey AS orderkey, l_linenumber AS linenumber,
               CAST((l_orderkey * 7919 + l_linenumber * 104729) % 100003 AS DOUBLE) AS x,
               CAST((l_partkey * 15485863 + l_linenumber * 31) % 100003 AS DOUBLE) AS y,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS nir,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1 - l_discount) END AS red,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1 + l_tax) END AS swir,
               CASE WHEN l_linenumber <> 7 THEN l_quantity END AS light
        FROM lineitem"""),
    ("pz", ("pixels", "zones"), """
        SELECT p.*, z.geoid, z.zone_id FROM
          (SELECT *, CAST(floor((10 * x - y) / 200000.0) AS BIGINT) AS zi,
                     CAST(floor(y / 20000.0) AS BIGINT) AS zj FROM pixels) p
        JOIN zones z ON p.zi = z.zi AND p.zj = z.zj"""),
    ("grid", (), """
        SELECT CAST(l_linenumber AS BIGINT) AS "row", CAST(l_orderkey // 8 AS BIGINT) AS col,
               avg(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2"""),
    ("scenes", (), """
        SELECT event_id AS scene_id, user_id AS pixel, ts, event_id % 100 AS cloud_pct,
               CAST((event_id % 4) * 1024 AS INTEGER) AS qa60, value
        FROM events"""),
    ("acs", (), f"""
        SELECT '51' AS state, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS county,
               {_TRACT} AS tract, CAST(c_custkey % 4 AS VARCHAR) AS block_group,
               c_acctbal AS B19013_001E, COALESCE(o.n, 0) AS B01003_001E,
               COALESCE(o.n, 0) AS B17021_001E, COALESCE(o.nf, 0) AS B17021_002E
        FROM customer LEFT JOIN (
          SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS nf
          FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey"""),
    ("gt", ("acs",), """
        SELECT lpad(state, 2, '0') || lpad(county, 3, '0') || lpad(tract, 6, '0') || lpad(block_group, 1, '0') AS geoid,
               county,
               CASE WHEN B19013_001E >= 0 THEN B19013_001E END AS median_income,
               CAST(CASE WHEN B01003_001E >= 0 THEN B01003_001E END AS DOUBLE) AS population,
               CASE WHEN B17021_001E >= 0 AND B17021_001E <> 0 AND B17021_002E >= 0
                    THEN CAST(B17021_002E AS DOUBLE) / CAST(B17021_001E AS DOUBLE) END AS poverty_rate
        FROM acs"""),
    ("panel_long", (), """
        SELECT gid, year, CASE WHEN (gid + year) % 11 <> 0 THEN s END AS gdp FROM (
          SELECT CAST(c_nationkey AS BIGINT) AS gid, CAST(year(o_orderdate) AS BIGINT) AS year,
                 round(sum(o_totalprice), 2) AS s
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""),
    ("panel_full", ("panel_long",), """
        SELECT CAST(n.n_nationkey AS BIGINT) AS gid, 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS iso3,
               n.n_name AS country, y.year, p.gdp
        FROM nation n CROSS JOIN (SELECT CAST(range AS BIGINT) AS year FROM range(1995, 2002)) y
        LEFT JOIN panel_long p ON p.gid = n.n_nationkey AND p.year = y.year"""),
    ("panel_wide", ("panel_full",), """
        SELECT gid, iso3, country,
               max(gdp) FILTER (WHERE year = 1995) AS "1995", max(gdp) FILTER (WHERE year = 1996) AS "1996",
               max(gdp) FILTER (WHERE year = 1997) AS "1997", max(gdp) FILTER (WHERE year = 1998) AS "1998",
               max(gdp) FILTER (WHERE year = 1999) AS "1999", max(gdp) FILTER (WHERE year = 2000) AS "2000",
               max(gdp) FILTER (WHERE year = 2001) AS "2001"
        FROM panel_full GROUP BY gid, iso3, country"""),
    ("poptab", (), """
        SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ISO3_code,
               'LOC' || CAST(c_nationkey AS VARCHAR) AS Location,
               count(*) AS population, round(sum(c_acctbal), 2) AS wealth
        FROM customer WHERE c_nationkey % 7 <> 3 GROUP BY c_nationkey"""),
    ("features", (), f"""
        SELECT {_GEOID} AS geoid, substr({_GEOID}, 6, 6) AS tract,
               CAST(COALESCE(o.x1, 0) AS DOUBLE) AS x1, o.x2,
               CAST(c_custkey * 104729 % 100003 AS DOUBLE) AS x3, c_acctbal AS target
        FROM customer LEFT JOIN (
          SELECT o_custkey, count(*) AS x1, avg(o_totalprice) AS x2 FROM orders GROUP BY o_custkey) o
        ON c_custkey = o.o_custkey"""),
    ("predictions", (), f"""
        SELECT {_GEOID} AS geoid, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS county,
               c_acctbal AS actual, c_acctbal * CAST(0.9 AS DOUBLE) + (c_custkey % 17) * 10 AS predicted,
               CAST(c_custkey % 5 AS BIGINT) AS fold
        FROM customer"""),
    ("cells", (), """
        SELECT conv_id AS notebook, turn AS idx,
               CASE WHEN role = 'assistant' THEN 'code' ELSE 'markdown' END AS cell_type,
               lower(replace(text, chr(10), ' ')) AS txt, (conv_id + turn) % 5 AS k
        FROM conversations"""),
]

_BY_NAME = {n: (deps, body) for n, deps, body in FIXTURES}
_ORDER = [n for n, _, _ in FIXTURES]


def with_fixtures(sql: str, uses: tuple[str, ...] | list[str], extra_ctes: str = "",
                  recursive: bool = False) -> str:
    """Prefix ``sql`` with the CTEs it uses (dependencies first).

    ``extra_ctes`` are further query-specific CTEs (``name AS (...)`` items,
    comma-separated) placed after the fixtures."""
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        for d in _BY_NAME[n][0]:
            add(d)
        need.add(n)

    for u in uses:
        add(u)
    parts = [f"{n} AS ({_BY_NAME[n][1]}\n)" for n in _ORDER if n in need]
    if extra_ctes.strip():
        parts.append(extra_ctes.strip())
    if not parts:
        return sql.strip()
    rec = "RECURSIVE " if recursive else ""
    return "WITH " + rec + ",\n".join(parts) + "\n" + sql.strip()
