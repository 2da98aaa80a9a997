"""DuckDB SQL equal to the registered queries: named parts, put together with WITH."""

from __future__ import annotations

# Named parts; each may use those before it.
PARTS = {
    "ev": """SELECT CAST(l_shipdate AS DATE) AS event_date,
        CASE WHEN month(l_shipdate) BETWEEN 4 AND 7 THEN concat('1ra ', CAST(year(l_shipdate) AS VARCHAR)) WHEN month(l_shipdate) >= 11 THEN concat('2da ', CAST(year(l_shipdate) AS VARCHAR)) END AS season,
        n_name AS company, s_name AS vessel, l_quantity AS catch_tm,
        CAST(-160 + (l_suppkey * 37 + l_orderkey * 11) % 110 AS DOUBLE) / 10 AS lat, CAST(-820 + (l_partkey * 13 + l_suppkey * 7) % 80 AS DOUBLE) / 10 AS lon
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # Events of a fleet with renamed and sold vessels, and pings, as the views make them.
    "fleet": """SELECT event_date, season, CASE WHEN v % 7 = 3 AND year(event_date) > 1997 THEN b.n_name ELSE company END AS company, CASE WHEN v % 2 = 0 THEN concat('TASA ', v) ELSE vessel END AS vessel, catch_tm, lat, lon
        FROM (SELECT *, CAST(regexp_extract(vessel, '(\\d+)$', 1) AS INTEGER) AS v FROM ev) e JOIN nation a ON a.n_name = e.company JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25""",
    "ping": """SELECT CASE WHEN l_suppkey % 9 = 4 THEN concat('X', l_suppkey) WHEN l_suppkey % 2 = 0 THEN concat('TASA ', l_suppkey) ELSE concat('SUPPLIER#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) END AS vessel,
        CAST(l_shipdate AS DATE) + CAST(l_orderkey % 5 AS INTEGER) AS day, year(l_shipdate) AS file_year, CASE WHEN month(l_shipdate) BETWEEN 4 AND 7 THEN '1ra' ELSE '2da' END AS file_season
        FROM lineitem WHERE month(l_shipdate) BETWEEN 4 AND 7 OR month(l_shipdate) >= 11""",
    # METH 6.1: only pings in the season window of the file's year; seasons with 30 covered days.
    "pday": """SELECT vessel, day, file_season || ' ' || file_year AS season, count(*) AS pings FROM ping
        WHERE year(day) = file_year AND CASE file_season WHEN '1ra' THEN dayofyear(day) BETWEEN 91 AND 212 ELSE dayofyear(day) BETWEEN 305 AND 365 END GROUP BY 1, 2, 3""",
    "pclean": """SELECT * FROM pday WHERE season IN (SELECT season FROM pday GROUP BY 1 HAVING count(DISTINCT day) >= 30)""",
    # METH 6.2: companies of vessels from the events, as of the day.
    "own": """SELECT upper(vessel) AS vessel, company, min(event_date) AS since, max(event_date) AS until, count(*) AS n FROM fleet GROUP BY 1, 2""",
    "pown": """SELECT * FROM (SELECT p.*, company, row_number() OVER (PARTITION BY vessel, day, season ORDER BY CASE WHEN day < since THEN since - day WHEN day > until THEN day - until ELSE 0 END, n DESC, company) AS r FROM pclean p JOIN own USING (vessel)) WHERE r = 1""",
    "hours": """SELECT 'day' AS level, company, CAST(day AS VARCHAR) AS period, CAST(sum(pings) AS DOUBLE) * 0.15 AS hours, count(DISTINCT day) AS days FROM pown GROUP BY 2, 3
        UNION ALL SELECT 'week', company, isoyear(day) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0'), CAST(sum(pings) AS DOUBLE) * 0.15, count(DISTINCT day) FROM pown GROUP BY 2, 3
        UNION ALL SELECT 'month', company, strftime(day, '%Y-%m'), CAST(sum(pings) AS DOUBLE) * 0.15, count(DISTINCT day) FROM pown GROUP BY 2, 3
        UNION ALL SELECT 'season', company, season, CAST(sum(pings) AS DOUBLE) * 0.15, count(DISTINCT day) FROM pown GROUP BY 2, 3""",
    "gr": """SELECT CAST(l_shipdate AS DATE) AS time, CAST(-155 + 10 * (l_suppkey % 11) AS DOUBLE) / 10 AS lat, CAST(-815 + 10 * (l_partkey % 8) AS DOUBLE) / 10 AS lon, avg(14 + 100 * l_discount) AS value FROM lineitem GROUP BY 1, 2, 3""",
    "fi": """SELECT CAST(o_orderdate AS DATE) AS time, CAST(-1575 + 50 * (o_custkey % 21) AS DOUBLE) / 100 AS lat, CAST(-8175 + 50 * (o_orderkey % 15) AS DOUBLE) / 100 AS lon, avg(14 + o_totalprice / 50000) AS value FROM orders GROUP BY 1, 2, 3""",
    "allreg": """SELECT * FROM (VALUES ('Todo el mar', NULL, NULL), ('Norte', -7.1, NULL), ('Centro Norte', -11.0, -7.1), ('Centro Sur', -15.8, -11.0), ('Centro', -15.8, -7.1)) t(region, lat_min, lat_max)""",
    "reg": """SELECT * FROM allreg WHERE region IN ('Norte', 'Centro Norte', 'Centro Sur')""",
    "clim": """SELECT dayofyear(time) AS doy, lat, lon, avg(value) AS clim FROM gr WHERE year(time) BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3""",
    "anom": """SELECT time, gr.lat, gr.lon, value - clim AS anom FROM gr JOIN clim ON dayofyear(time) = doy AND gr.lat = clim.lat AND gr.lon = clim.lon""",
    "er": """SELECT ev.*, region FROM ev JOIN reg ON (lat_min IS NULL OR lat > lat_min) AND (lat_max IS NULL OR lat <= lat_max)""",
    "era": """SELECT ev.*, region FROM ev JOIN allreg ON (lat_min IS NULL OR lat > lat_min) AND (lat_max IS NULL OR lat <= lat_max)""",
    "ext": """SELECT region, min(lat) AS south, max(lat) AS north FROM er GROUP BY 1""",
    "bands": """SELECT region, CAST(floor(lat) AS INTEGER) AS band, quantile_cont(lon, 0.05) AS west, quantile_cont(lon, 0.95) AS east FROM er GROUP BY 1, 2 HAVING count(*) >= 20""",
    "ring": """SELECT region, 0 AS side, b AS o, x, y FROM (
            SELECT region, band + 0.5 AS b, west AS x, band + 0.5 AS y FROM bands
            UNION ALL SELECT e.region, -1e9, arg_min(west, band), any_value(south) FROM ext e JOIN bands b ON e.region = b.region GROUP BY 1
            UNION ALL SELECT e.region, 1e9, arg_max(west, band), any_value(north) FROM ext e JOIN bands b ON e.region = b.region GROUP BY 1)
        UNION ALL SELECT region, 1, -b, x, y FROM (
            SELECT region, band + 0.5 AS b, east AS x, band + 0.5 AS y FROM bands
            UNION ALL SELECT e.region, -1e9, arg_min(east, band), any_value(south) FROM ext e JOIN bands b ON e.region = b.region GROUP BY 1
            UNION ALL SELECT e.region, 1e9, arg_max(east, band), any_value(north) FROM ext e JOIN bands b ON e.region = b.region GROUP BY 1)""",
    "edges": """SELECT region, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ring WINDOW w AS (PARTITION BY region ORDER BY side, o)""",
    "cells": """SELECT c.region, c.lat, c.lon FROM (
            SELECT e.region, a.lat, a.lon FROM (SELECT DISTINCT lat, lon FROM anom WHERE lon BETWEEN -82 AND -74) a JOIN edges e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
            GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) c JOIN ext USING (region) WHERE c.lat > south - 0.1 AND c.lat <= north + 0.1""",
    "daily": """SELECT region, time, avg(anom) AS idx FROM anom JOIN cells USING (lat, lon) GROUP BY 1, 2 HAVING avg(anom) IS NOT NULL""",
    "seas": """SELECT region, year(time) AS year, CASE WHEN dayofyear(time) BETWEEN 91 AND 212 THEN 'T1' WHEN dayofyear(time) BETWEEN 305 AND 365 THEN 'T2' END AS tipo, avg(idx) AS idx FROM daily WHERE dayofyear(time) BETWEEN 91 AND 212 OR dayofyear(time) BETWEEN 305 AND 365 GROUP BY 1, 2, 3""",
    "monthly": """SELECT region, date_trunc('month', time)::DATE AS time, avg(idx) AS idx FROM daily GROUP BY 1, 2""",
    "cseas": """SELECT region, year(time) AS year, CASE WHEN month(time) IN (4, 5, 6, 7) THEN 'T1' ELSE 'T2' END AS tipo, avg(idx) AS idx FROM monthly WHERE month(time) IN (4, 5, 6, 7, 11, 12) GROUP BY 1, 2, 3 HAVING count(idx) = CASE WHEN tipo = 'T1' THEN 4 ELSE 2 END""",
    "bothseas": """SELECT a.region, a.year, a.idx AS t1, b.idx AS t2 FROM seas a JOIN seas b ON a.region = b.region AND a.year = b.year WHERE a.tipo = 'T1' AND b.tipo = 'T2'""",
    "pct": """SELECT region, quantile_cont(idx, 0.8) AS p80, quantile_cont(idx, 0.9) AS p90, quantile_cont(idx, 0.95) AS p95, quantile_cont(idx, 0.99) AS p99 FROM daily GROUP BY 1""",
    "rs": """SELECT region, season, sum(catch_tm) AS catch_tm, CAST(regexp_extract(season, '(\\d{4})', 1) AS INTEGER) AS year, CASE WHEN season LIKE '1ra%' THEN 'T1' ELSE 'T2' END AS tipo FROM er WHERE season IS NOT NULL GROUP BY 1, 2""",
    "base": """SELECT region, coalesce(avg(catch_tm) FILTER (tipo = 'T1'), 0) AS base_t1, coalesce(avg(catch_tm) FILTER (tipo = 'T2'), 0) AS base_t2, coalesce(max(catch_tm) FILTER (tipo = 'T1'), 0) AS max_t1, coalesce(max(catch_tm) FILTER (tipo = 'T2'), 0) AS max_t2 FROM rs GROUP BY 1""",
    "scen": """SELECT region, 'p90' AS scenario, p90 AS entry, p99 AS exit_ FROM pct UNION ALL SELECT region, 'p80', p80, p99 FROM pct""",
    "hist": """SELECT scenario, b.region, year, least((base_t1 + base_t2) * (greatest(0, least(1, (t1 - entry) / (exit_ - entry))) + greatest(0, least(1, (t2 - entry) / (exit_ - entry)))), base_t1 + base_t2) AS payout, base_t1 + base_t2 AS cap FROM bothseas b JOIN base USING (region) JOIN scen USING (region)""",
    "fit": """SELECT region, tipo, count(idx) AS n, avg(idx) AS mu, stddev_samp(idx) AS sd FROM seas GROUP BY 1, 2""",
    "dr": """SELECT sim_id, tipo, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS z FROM (
            SELECT sim_id, tipo, max(u) FILTER (k % 2 = 1) AS u1, max(u) FILTER (k % 2 = 0) AS u2 FROM (
                SELECT sim_id, k, CASE WHEN k <= 2 THEN 'T1' ELSE 'T2' END AS tipo, (h3 + 1.0) / 2147483648.0::DOUBLE AS u FROM (
                    SELECT sim_id, k, (((h2 * h2 + k * 40692 + 2 * 12345 + 1) % 2147483647) * 48271) % 2147483647 AS h3 FROM (
                        SELECT sim_id, k, (((h1 * h1 + k * 40692 + 12345 + 1) % 2147483647) * 48271) % 2147483647 AS h2 FROM (
                            SELECT sim_id, k, (((h0 * h0 + k * 40692 + 1) % 2147483647) * 48271) % 2147483647 AS h1 FROM (
                                SELECT range AS sim_id, k, (range * 48271 + k * 69621 + 42 * 16807) % 2147483647 AS h0 FROM range(4000), (VALUES (1::BIGINT), (2), (3), (4)) t(k)))))) GROUP BY 1, 2)""",
    "syn": """SELECT region, sim_id, max(mu + z * sd) FILTER (tipo = 'T1') AS t1, max(mu + z * sd) FILTER (tipo = 'T2') AS t2 FROM dr JOIN fit USING (tipo) GROUP BY 1, 2""",
    "spay": """SELECT scenario, s.region, sim_id, least((base_t1 + base_t2) * (greatest(0, least(1, (t1 - entry) / (exit_ - entry))) + greatest(0, least(1, (t2 - entry) / (exit_ - entry)))), base_t1 + base_t2) AS payout, base_t1 + base_t2 AS cap FROM syn s JOIN base USING (region) JOIN scen USING (region)""",
    "port": """SELECT scenario, sim_id, least(sum(payout), sum(cap)) AS payout FROM spay GROUP BY 1, 2""",
    "fit6": """SELECT * FROM fit""",
    # Points to the nearest value of an axis: the smallest wins ties.
    "axt": """SELECT p.year, p.event_date, arg_min(g.time, abs(date_diff('day', g.time, p.event_date)) * 100000 + dayofyear(g.time)) AS t FROM (SELECT DISTINCT year(event_date) AS year, event_date FROM ev) p JOIN (SELECT DISTINCT time FROM anom) g ON year(g.time) = p.year GROUP BY 1, 2""",
    "axla": """SELECT year, plat, lat AS la FROM (SELECT p.year, p.lat AS plat, g.lat, row_number() OVER (PARTITION BY p.year, p.lat ORDER BY abs(g.lat - p.lat), g.lat) AS r FROM (SELECT DISTINCT year(event_date) AS year, lat FROM ev) p JOIN (SELECT DISTINCT year(time) AS year, lat FROM anom) g USING (year)) WHERE r = 1""",
    "axlo": """SELECT year, plon, lon AS lo FROM (SELECT p.year, p.lon AS plon, g.lon, row_number() OVER (PARTITION BY p.year, p.lon ORDER BY abs(g.lon - p.lon), g.lon) AS r FROM (SELECT DISTINCT year(event_date) AS year, lon FROM ev) p JOIN (SELECT DISTINCT year(time) AS year, lon FROM anom) g USING (year)) WHERE r = 1""",
    "en": """SELECT ev.*, anom.anom AS sst_anom FROM ev LEFT JOIN axt ON axt.event_date = ev.event_date LEFT JOIN axla ON axla.year = year(ev.event_date) AND plat = ev.lat LEFT JOIN axlo ON axlo.year = year(ev.event_date) AND plon = ev.lon LEFT JOIN anom ON anom.time = t AND anom.lat = la AND anom.lon = lo""",
    "fen": """SELECT e.*, CAST(anom.anom AS DOUBLE) AS sst_anom FROM fleet e LEFT JOIN axt ON axt.event_date = e.event_date LEFT JOIN axla ON axla.year = year(e.event_date) AND plat = e.lat LEFT JOIN axlo ON axlo.year = year(e.event_date) AND plon = e.lon LEFT JOIN anom ON anom.time = t AND anom.lat = la AND anom.lon = lo""",
    "fcat": """SELECT level, company, period, sum(catch_tm) AS catch_tm, avg(sst_anom) AS sst_anom, avg(lat) AS lat FROM (
            SELECT *, unnest(['day', 'week', 'month', 'season']) AS level, unnest([CAST(event_date AS VARCHAR), isoyear(event_date) || '-W' || lpad(CAST(weekofyear(event_date) AS VARCHAR), 2, '0'), strftime(event_date, '%Y-%m'), season]) AS period FROM fen WHERE season IS NOT NULL) GROUP BY 1, 2, 3""",
    "cpue": """SELECT c.*, hours, days, catch_tm / hours AS cpue FROM fcat c JOIN hours USING (level, company, period)""",
    "us": """SELECT *, ln(catch_tm) AS log_catch FROM en WHERE catch_tm > 0 AND sst_anom IS NOT NULL AND season IS NOT NULL""",
    "usr": """SELECT us.*, region FROM us JOIN allreg ON (lat_min IS NULL OR lat > lat_min) AND (lat_max IS NULL OR lat <= lat_max)""",
    "cs": """SELECT region, company, season, ln(sum(catch_tm)) AS y, avg(sst_anom) AS x FROM usr GROUP BY 1, 2, 3""",
    "bandm": """SELECT month, CAST(floor(lat) AS INTEGER) AS band, avg(v) AS v FROM (SELECT month, lat, avg(v) AS v FROM (SELECT strftime(time, '%Y-%m') AS month, lat, lon, avg(value) AS v FROM gr GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1, 2""",
    "bandr": """SELECT a.band AS band_a, b.band AS band_b, corr(a.v, b.v) AS r FROM bandm a JOIN bandm b ON a.month = b.month AND a.band < b.band WHERE a.month IN (SELECT month FROM bandm GROUP BY 1 HAVING count(v) = (SELECT count(DISTINCT band) FROM bandm)) GROUP BY 1, 2""",
    # Each cell of the fine grid to the nearest cell of the coarse one, on days that both have.
    "pair": """SELECT f.time, la AS lat, lo AS lon, a.value AS coarse, f.value AS fine FROM fi f
        JOIN (SELECT flat, lat AS la FROM (SELECT f.lat AS flat, c.lat, row_number() OVER (PARTITION BY f.lat ORDER BY abs(c.lat - f.lat), c.lat) AS r FROM (SELECT DISTINCT lat FROM fi) f, (SELECT DISTINCT lat FROM gr) c) WHERE r = 1) x ON x.flat = f.lat
        JOIN (SELECT flon, lon AS lo FROM (SELECT f.lon AS flon, c.lon, row_number() OVER (PARTITION BY f.lon ORDER BY abs(c.lon - f.lon), c.lon) AS r FROM (SELECT DISTINCT lon FROM fi) f, (SELECT DISTINCT lon FROM gr) c) WHERE r = 1) y ON y.flon = f.lon
        JOIN gr a ON a.time = f.time AND a.lat = la AND a.lon = lo WHERE f.value IS NOT NULL AND a.value IS NOT NULL""",
    "cellq": """SELECT lat, lon, count(*) AS n, corr(coarse, fine) AS r, avg(coarse - fine) AS bias FROM pair GROUP BY 1, 2 HAVING count(*) >= 3""",
    "banda": """SELECT month, CAST(floor(lat) AS INTEGER) AS band, avg(v) AS v FROM (SELECT month, lat, avg(v) AS v FROM (SELECT strftime(time, '%Y-%m') AS month, lat, lon, avg(anom) AS v FROM anom GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1, 2""",
    "csr": """SELECT company, region, season, sum(catch_tm) AS catch_tm, CASE WHEN season LIKE '1ra%' THEN 'T1' ELSE 'T2' END AS tipo FROM er WHERE season IS NOT NULL GROUP BY 1, 2, 3""",
}

# Corridors whose caps lie at the region's bounds (r) or at the edges of its outer bands (b).
PARTS["extr"] = """SELECT region, coalesce(lat_min, south) AS south, coalesce(lat_max, north) AS north FROM ext JOIN reg USING (region)"""
PARTS["extb"] = """SELECT region, CAST(min(band) AS DOUBLE) AS south, CAST(max(band) + 1 AS DOUBLE) AS north FROM bands GROUP BY 1"""
for _kind in "rb":
    PARTS[f"ring{_kind}"] = PARTS["ring"].replace("FROM ext e", f"FROM ext{_kind} e")
    PARTS[f"edges{_kind}"] = PARTS["edges"].replace("FROM ring", f"FROM ring{_kind}")


def sql(body: str) -> str:
    """body with the parts that it needs, directly or through others."""
    import re

    needed: set[str] = set()

    def add(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", text)):
            if name in PARTS and name not in needed:
                used = re.search(rf"(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+{name}\b|,\s*{name}\b(?=\s|$|\))", text)
                if used:
                    needed.add(name)
                    add(PARTS[name])

    add(body)
    parts = [f"{n} AS ({p})" for n, p in PARTS.items() if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


P_EVEN = "sin(th) * (1 + coalesce(list_sum(list_transform(range(1, CAST((nu - 2) // 2 AS BIGINT) + 1), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(th), 2 * j))), 0))"
P_ODD = "2 / pi() * (th + sin(th) * cos(th) * (1 + coalesce(list_sum(list_transform(range(1, CAST((nu - 3) // 2 AS BIGINT) + 1), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(th), 2 * j))), 0)))"
P_BIG = "2 * (exp(-t * t / 2) / sqrt(2 * pi())) * (1 / (1 + 0.2316419 * t)) * (0.319381530 + (1 / (1 + 0.2316419 * t)) * (-0.356563782 + (1 / (1 + 0.2316419 * t)) * (1.781477937 + (1 / (1 + 0.2316419 * t)) * (-1.821255978 + (1 / (1 + 0.2316419 * t)) * 1.330274429))))"


def with_p(source: str) -> str:
    """source has t and nu; adds p."""
    return f"SELECT *, CASE WHEN nu > 20000 THEN {P_BIG} WHEN nu = 1 THEN 1 - 2 * th / pi() WHEN nu % 2 = 0 THEN greatest(0, 1 - {P_EVEN}) ELSE greatest(0, 1 - {P_ODD}) END AS p FROM (SELECT * EXCLUDE (t), abs(t) AS t, atan(abs(t) / sqrt(nu)) AS th FROM ({source}))"


def ols_sql(source: str, keys: str, y: str, x: str) -> str:
    """keys, n, beta, intercept, r2, se, p of groups with 10 pairs at least."""
    inner = f"SELECT *, beta / se AS t, n - 2 AS nu FROM (SELECT *, sqrt(greatest(0, syy - beta * sxy) / (n - 2) / sxx) AS se FROM (SELECT {keys}, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS beta, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM {source} GROUP BY {keys})) WHERE n >= 10"
    return with_p(inner)


Z = 1.959963984540054
G = [(Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384, (79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160]
TQ = f"({Z} + {G[0]} / nu + {G[1]} / pow(nu, 2) + {G[2]} / pow(nu, 3) + {G[3]} / pow(nu, 4))"
