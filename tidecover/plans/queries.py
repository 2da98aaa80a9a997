"""Registered queries: each operator applied to the driver's tables, beside equal SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payouts as P
from ..functions import seasons as S
from ..functions import text as X
from ..functions.stats import exact_percentiles, percentiles
from ..operators import catch as C
from ..operators import climate as Y
from ..operators import corridor as K
from ..operators import effort as H
from ..operators import grid as G
from ..operators import match as M
from ..operators import premium as Q
from ..operators import regress as R
from ..operators import report as T
from ..operators import scenario as N
from ..sources import files as E
from ..sources import views as V
from ..sources.documents import climate_index, quote_tables
from .sql import TQ, ols_sql, sql, with_p

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CORRIDORS = ["Norte", "Centro Norte", "Centro Sur"]
BASE_YEARS = (1995, 2000)


_held: ContextVar[dict[str, DataFrame]] = ContextVar("held")  # tables that the query being built has written, as it uses them more than once


def hold(s: SparkSession, d: str, name: str, build: Query) -> DataFrame:
    """build(s, d), written once for the query that is being built."""
    held = _held.get({})
    if name not in held:
        held[name] = E.written(build(s, d), name)
    return held[name]


def query(oracle: str | None):
    def add(f: Query) -> Query:
        @wraps(f)
        def run(s: SparkSession, d: str) -> DataFrame:
            token = _held.set({})
            try:
                return f(s, d)
            finally:
                _held.reset(token)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def r6(c: str, name: str | None = None) -> Column:
    return F.round(F.col(c), 6).alias(name or c)


def t_anomaly(s: SparkSession, d: str) -> DataFrame:
    return G.doy_anomalies(V.grid(s, d), BASE_YEARS)


def t_regions(s: SparkSession) -> DataFrame:
    return V.regions(s, CORRIDORS)


def t_daily(s: SparkSession, d: str) -> DataFrame:
    held = _held.get({})
    if "daily" in held:
        return held["daily"]
    return K.corridor_daily(V.catch_events(s, d), t_anomaly(s, d), t_regions(s), places=V.grid_places(s, d))


def t_seasons(s: SparkSession, d: str) -> DataFrame:
    return K.season_means(t_daily(s, d), S.season_by_doy(F.col("time")), ["region"])


def t_complete(s: SparkSession, d: str) -> DataFrame:
    return K.complete_season_means(t_daily(s, d), S.season_by_month(F.col("time")), ["region"])


def t_triggers(s: SparkSession, d: str) -> DataFrame:
    p = t_daily(s, d).groupBy("region").agg(percentiles("idx", [0.8, 0.9, 0.95, 0.99]).alias("p"))
    return p.select("region", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p80", "p90", "p95", "p99"))])


def t_baselines(s: SparkSession, d: str) -> DataFrame:
    return C.baselines(C.region_seasons(V.catch_events(s, d), t_regions(s)), ["region"])


def t_scenarios(s: SparkSession, d: str) -> DataFrame:
    entries = F.explode(F.array(F.struct(F.lit("p90").alias("scenario"), F.col("p90").alias("entry")), F.struct(F.lit("p80").alias("scenario"), F.col("p80").alias("entry"))))
    return t_triggers(s, d).select("region", entries.alias("e"), F.col("p99").alias("exit")).select("region", "e.scenario", "e.entry", "exit")


def with_payouts(years: DataFrame, s: SparkSession, d: str) -> DataFrame:
    df = years.join(F.broadcast(t_baselines(s, d)), "region").join(F.broadcast(t_scenarios(s, d)), "region")
    fraction = lambda c: P.ramp(F.col(c), F.col("entry"), F.col("exit"))
    return df.withColumns({"payout": P.annual(fraction("t1"), fraction("t2"), F.col("base_t1"), F.col("base_t2")), "cap": F.col("base_t1") + F.col("base_t2")})


def t_history(s: SparkSession, d: str) -> DataFrame:
    hold(s, d, "daily", t_daily)
    return with_payouts(K.both_seasons(t_seasons(s, d), ["region"]), s, d)


def t_synthetic(s: SparkSession, d: str) -> DataFrame:
    hold(s, d, "daily", t_daily)
    fit = R.normal_fit(t_seasons(s, d), ["region", "tipo"])
    return with_payouts(N.scenarios(N.draws(s), fit), s, d)


def t_enriched(s: SparkSession, d: str) -> DataFrame:
    points = V.catch_events(s, d).withColumn("year", F.year("event_date"))
    return M.nearest_grid(points, t_anomaly(s, d).withColumnRenamed("anom", "value"), "sst_anom")


def t_usable(s: SparkSession, d: str) -> DataFrame:
    df = C.usable(t_enriched(s, d), "sst_anom", "season").withColumn("log_catch", F.log("catch_tm"))
    return K.assign_regions(df, V.regions(s))


def t_company_seasons(s: SparkSession, d: str) -> DataFrame:
    return t_usable(s, d).groupBy("region", "company", "season").agg(F.log(F.sum("catch_tm")).alias("y"), F.avg("sst_anom").alias("x"))


# ---- sources, filters, projections -----------------------------------------------------------------------------------


@query("SELECT scenario, region, round(avg(payout), 4) AS aal, round(max(payout), 4) AS largest, count(*) FILTER (payout > 0) AS years_paid, count(*) FILTER (payout <= 0) AS years_unpaid FROM hist GROUP BY 1, 2")
def entry_historical_aal(s, d):
    out = Q.average_loss(t_history(s, d), ["scenario", "region"])
    return out.select("scenario", "region", F.round("aal", 4).alias("aal"), F.round("largest", 4).alias("largest"), "years_paid", "years_unpaid")


@query("SELECT CAST(l_shipdate AS DATE) AS event_date, n_name AS company, NULL::DOUBLE AS juvenile, l_quantity AS catch_tm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT CAST(l_shipdate AS DATE), NULL, 100 * l_discount, l_quantity FROM lineitem")
def src4_union_of_columns(s, d):
    a = V.catch_events(s, d).select("event_date", "company", "catch_tm")
    b = V.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("event_date"), (100 * F.col("l_discount")).alias("juvenile"), F.col("l_quantity").alias("catch_tm"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS DATE) END AS event_date, CASE WHEN l_linenumber > 1 THEN l_quantity END AS catch_tm, count(*) AS n FROM lineitem GROUP BY 1, 2")
def src5_lenient_types(s, d):
    li = V.table(s, d, "lineitem")
    raw = li.select(F.when(F.col("l_linenumber") < 7, F.date_format("l_shipdate", "d/M/yyyy")).otherwise("n/a").alias("fecha_cala"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("string")).otherwise("-").alias("declarado_tm"))
    return E.typed_events(raw).groupBy(F.col("fecha_cala").alias("event_date"), F.col("declarado_tm").alias("catch_tm")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT season, count(*) AS n, round(sum(catch_tm), 3) AS catch_tm, round(min(lat), 4) AS south, count(DISTINCT vessel) AS vessels FROM ev WHERE season IS NOT NULL GROUP BY 1")
def src1_src2_src3_event_files(s, d):
    """The tables' events as files by year and season, as fleets send them, found and read back by name."""
    ev = V.catch_events(s, d).filter("season is not null")
    root = E.scratch_path(s, "calas")
    named = ev.select(F.year("event_date").alias("folder"), F.when(F.col("season").startswith("1ra"), "Primera").otherwise("segunda").alias("part"), F.concat_ws(",", F.date_format("event_date", "d/M/yyyy"), "vessel", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("catch_tm").cast("string")).alias("value"))
    E.write_event_files(named, root, "fecha_cala, nave ,latitud,longitud,declarado_tm")
    return E.read_events(s, root).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("declarado_tm"), 3).alias("catch_tm"), F.round(F.min("latitud"), 4).alias("south"), F.count_distinct("nave").alias("vessels"))


@query("SELECT year(time) AS year, lat, count(*) AS n, round(sum(value), 4) AS total FROM fi WHERE year(time) BETWEEN 1996 AND 1998 GROUP BY 1, 2")
def src7_snk2_yearly_grids(s, d):
    """Both sensors written by variable and year; one variable's three years read back, and no other folder."""
    root = E.scratch_path(s, "grids")
    E.write_grids({"sst": V.grid(s, d), "chl": V.fine_grid(s, d)}, root)
    return E.scan_grid(s, root, "chl", (1996, 1998)).groupBy(F.year("time").alias("year"), "lat").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS time, count(*) AS n FROM orders GROUP BY 1")
def src7_dates_of_names(s, d):
    o = V.table(s, d, "orders")
    name = F.concat(F.lit("/in/20150101/MODIS."), F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("latest"), F.lit(".L3m.DAY.SST.nc"))
    return o.groupBy(E.date_of_name(name).alias("time")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time, value FROM gr UNION ALL SELECT time, value FROM fi) WHERE time IN (SELECT time FROM gr WHERE value IS NOT NULL) AND time IN (SELECT time FROM fi WHERE value IS NOT NULL) GROUP BY 1")
def src8_required_variables(s, d):
    both = V.grid(s, d).withColumn("var", F.lit("sst")).unionByName(V.fine_grid(s, d).withColumn("var", F.lit("chl")))
    return E.with_variables(both, ["time"], "var", ["sst", "chl"]).groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lat, lon, count(*) AS n FROM ev GROUP BY 1, 2")
def src15_snk1_csv_columns(s, d):
    """Events as CSV with six decimals, of which two columns are read back."""
    path = E.scratch_path(s, "csv")
    E.write_csv(V.catch_events(s, d), path)
    df = E.read_csv(s, path, "event_date date, season string, company string, vessel string, catch_tm double, lat double, lon double", ["lat", "lon"])
    return df.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT region, temporada_key, anio, temporada, format('{:.6f}', captura_tm) AS captura_tm FROM (SELECT region, season AS temporada_key, year AS anio, tipo AS temporada, catch_tm AS captura_tm FROM rs)")
def snk1_summary_csv(s, d):
    """The catch summary as it lies in its file."""
    path = E.scratch_path(s, "csv")
    rs = C.region_seasons(V.catch_events(s, d), t_regions(s))
    E.write_csv(rs.select("region", F.col("season").alias("temporada_key"), F.col("year").alias("anio"), F.col("tipo").alias("temporada"), F.col("catch_tm").alias("captura_tm")), path)
    return E.read_csv(s, path, "region string, temporada_key string, anio int, temporada string, captura_tm string", ["region", "temporada_key", "anio", "temporada", "captura_tm"])


@query("SELECT year(l_shipdate) AS year, CASE WHEN month(l_shipdate) BETWEEN 4 AND 7 THEN concat('1ra ', CAST(year(l_shipdate) AS VARCHAR)) ELSE concat('2da ', CAST(year(l_shipdate) AS VARCHAR)) END AS season, count(*) AS n FROM lineitem WHERE month(l_shipdate) IN (4, 5, 6, 7, 11, 12) GROUP BY 1, 2")
def src6_path_columns(s, d):
    from ..sources.files import path_columns

    li = V.table(s, d, "lineitem").filter(F.month("l_shipdate").isin(4, 5, 6, 7, 11, 12))
    path = F.concat(F.lit("/calas/"), F.year("l_shipdate").cast("string"), F.lit("/calas anchoveta "), F.when(F.month("l_shipdate") < 11, "Primera").otherwise("segunda"), F.lit(" temporada.csv"))
    return path_columns(li.select(path.alias("path")), F.col("path")).groupBy("year", "season").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time, lat, lon, round(value, 6) AS value FROM gr WHERE lat BETWEEN -12 AND -8 AND lon BETWEEN -80 AND -76 AND year(time) = 1996 AND value IS NOT NULL")
def src7_src9_grid_crop(s, d):
    g = G.crop(V.grid(s, d), -12, -8, -80, -76).filter((F.year("time") == 1996) & F.col("value").isNotNull())
    return g.select("time", "lat", "lon", r6("value"))


@query("SELECT CASE WHEN o_custkey % 360 > 180 THEN o_custkey % 360 - 360 ELSE o_custkey % 360 END AS lon, round(avg(CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END) + 1e-6, 2) AS value FROM orders GROUP BY 1")
def src10_src11_wrap_and_mask(s, d):
    o = V.table(s, d, "orders").select((F.col("o_custkey") % 360).alias("lon"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")).otherwise(1e20).alias("v"))
    return o.groupBy(G.wrap_longitude(F.col("lon")).alias("lon")).agg(F.round(F.avg(G.mask_sentinel(F.col("v"), 1e12)) + 1e-6, 2).alias("value"))


@query("SELECT l_orderkey AS cell, arg_min(l_quantity, l_linenumber * 1000 + l_quantity) AS value FROM lineitem GROUP BY 1")
def src12_surface(s, d):
    li = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("depth"), F.col("l_quantity").alias("value"))
    return G.surface(li, ["cell"])


@query("SELECT o_orderpriority[1:1] AS season, year(o_orderdate) AS year, round(o_totalprice / 1000 + 1e-6, 2) AS oni FROM orders WHERE o_orderkey % 5 > 0")
def src13_climate_text(s, d):
    o = V.table(s, d, "orders")
    line = F.concat_ws("   ", F.left("o_orderpriority", F.lit(1)), F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate").cast("string")).otherwise("YR"), F.lit("27.1"), F.round(F.col("o_totalprice") / 1000 + 1e-6, 2).cast("string"))
    return climate_index(o.select(F.concat(F.lit("  "), line).alias("value")))


QUOTE_SQL = "SELECT n_name AS company, year(l_shipdate) AS year, CASE WHEN month(l_shipdate) <= 6 THEN 'T1' ELSE 'T2' END AS tipo, sum(l_quantity) AS actual FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3"


def t_actuals(s: SparkSession, d: str) -> DataFrame:
    df = V.catch_events(s, d)
    return df.groupBy("company", F.year("event_date").alias("year"), F.when(F.month("event_date") <= 6, "T1").otherwise("T2").alias("tipo")).agg(F.sum("catch_tm").alias("actual"))


def t_company_documents(s: SparkSession, d: str) -> DataFrame:
    own = t_actuals(s, d).groupBy("company").agg(F.avg(F.when(F.col("tipo") == "T1", F.col("actual"))).alias("baseline_t1"), F.avg(F.when(F.col("tipo") == "T2", F.col("actual"))).alias("baseline_t2"), F.collect_list(F.struct("year", "tipo", F.col("actual").alias("actual_ton"))).alias("actuals"))
    return own.select(F.to_json(F.struct(F.create_map("company", F.struct("baseline_t1", "baseline_t2", "actuals")).alias("companies"))).alias("value"))


def t_index_document(s: SparkSession, d: str) -> DataFrame:
    """The quoting page's region has one index, a row per season."""
    index = t_seasons(s, d).filter("region = 'Centro Norte'")
    return index.agg(F.collect_list(F.struct("year", "tipo", F.col("idx").alias("sst"))).alias("sst")).select(F.to_json(F.struct("sst")).alias("value"))


@query(f"SELECT company, year, tipo, actual, round(avg(actual) OVER (PARTITION BY company, tipo), 6) AS baseline FROM ({QUOTE_SQL})")
def src14_prm5_quote_document(s, d):
    """Documents like the quoting page's, made from the tables and read back into tables."""
    companies, actuals, _ = quote_tables(t_company_documents(s, d))
    both = actuals.join(companies, "company")
    return both.select("company", "year", "tipo", "actual", F.round(F.when(F.col("tipo") == "T1", F.col("baseline_t1")).otherwise(F.col("baseline_t2")), 6).alias("baseline"))


@query("SELECT year, tipo, round(idx, 6) AS sst FROM seas WHERE region = 'Centro Norte'")
def src14_quote_index(s, d):
    """The document's seasonal index, read back."""
    return quote_tables(t_index_document(s, d))[2].select("year", "tipo", r6("sst"))


@query("SELECT dayofyear(time) AS doy, lat, lon, round(avg(value) + 1e-8, 6) AS clim FROM gr WHERE year(time) BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3")
def snk3_refreshed_climatology(s, d):
    """The baseline of a store that began without the last years and with other values in one, brought up to the whole grid."""
    g, path = hold(s, d, "grid", V.grid), E.scratch_path(s, "climatology")
    year = F.year("time")
    Y.refresh(g.filter(year < 1998).withColumn("value", F.when(year == 1996, F.col("value") + 1).otherwise(F.col("value"))), path)
    Y.refresh(g, path)
    return Y.climatology(s, path, BASE_YEARS).select("doy", "lat", "lon", F.round(F.col("clim") + 1e-8, 6).alias("clim"))


@query("SELECT DISTINCT year(time) AS year FROM gr WHERE year(time) NOT IN (SELECT DISTINCT year(time) FROM fi WHERE year(time) <= 1998)")
def snk3_missing_years(s, d):
    from ..sources.files import missing

    return missing(V.grid(s, d).select(F.year("time").alias("year")), V.fine_grid(s, d).filter(F.year("time") <= 1998).select(F.year("time").alias("year")), ["year"])


@query("SELECT region, count(*) AS n, round(sum(catch_tm), 4) AS catch_tm, min(lat) AS south, max(lat) AS north FROM era GROUP BY 1")
def flt1_jon6_regions(s, d):
    df = K.assign_regions(V.catch_events(s, d), V.regions(s))
    return df.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("catch_tm"), 4).alias("catch_tm"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@query("SELECT company, count(*) AS n FROM ev WHERE lat BETWEEN -12 AND -7 GROUP BY 1")
def flt2_zone(s, d):
    return V.catch_events(s, d).filter(F.col("lat").between(-12, -7)).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT year(event_date) AS year, CASE WHEN dayofyear(event_date) BETWEEN 91 AND 212 THEN 'T1' WHEN dayofyear(event_date) BETWEEN 305 AND 365 THEN 'T2' END AS by_doy, CASE WHEN month(event_date) IN (4, 5, 6, 7) THEN 'T1' WHEN month(event_date) IN (11, 12) THEN 'T2' END AS by_month, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def flt3_flt4_seasons(s, d):
    e = F.col("event_date")
    return V.catch_events(s, d).groupBy(F.year(e).alias("year"), S.season_by_doy(e).alias("by_doy"), S.season_by_month(e).alias("by_month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN label LIKE '1ra%' OR label LIKE '%CN-I' THEN 'T1' WHEN label LIKE '2da%' OR label LIKE '%CN-II' THEN 'T2' END AS tipo, count(*) AS n FROM (SELECT CASE WHEN length(company) % 2 = 0 AND season LIKE '1ra%' THEN 'Pesca CN-I' WHEN length(company) % 2 = 0 AND season LIKE '2da%' THEN 'Pesca CN-II' ELSE season END AS label FROM ev) GROUP BY 1")
def flt5_season_labels(s, d):
    even = F.length("company") % 2 == 0
    label = F.when(even & F.col("season").startswith("1ra"), "Pesca CN-I").when(even & F.col("season").startswith("2da"), "Pesca CN-II").otherwise(F.col("season"))
    return V.catch_events(s, d).groupBy(S.season_type(label).alias("tipo")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT company, season, count(*) AS n, round(sum(catch_tm), 4) AS catch_tm FROM us GROUP BY 1, 2 HAVING count(*) >= 10")
def flt6_flt7_guards(s, d):
    df = C.usable(t_enriched(s, d), "sst_anom", "season")
    return df.groupBy("company", "season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("catch_tm"), 4).alias("catch_tm")).filter("n >= 10")


@query("SELECT region, year(time) AS year, count(*) AS days, round(avg(idx), 6) AS idx FROM daily WHERE year(time) BETWEEN 1996 AND 2000 GROUP BY 1, 2 HAVING count(*) >= 200")
def flt8_flt10_complete_years(s, d):
    df = S.complete_years(t_daily(s, d), ["region"], "time").filter(F.year("time").between(1996, 2000))
    return df.groupBy("region", F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("idx"), 6).alias("idx"))


@query("SELECT company, count(*) AS n, round(sum(catch_tm), 4) AS catch_tm FROM ev JOIN (SELECT company, quantile_cont(catch_tm, 0.25) AS q1, quantile_cont(catch_tm, 0.75) AS q3 FROM ev GROUP BY 1) USING (company) WHERE catch_tm BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) GROUP BY 1")
def flt11_outliers(s, d):
    df = C.without_outliers(V.catch_events(s, d), ["company"], "catch_tm", 0.5)
    return df.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("catch_tm"), 4).alias("catch_tm"))


@query("SELECT event_date, year(event_date) AS year, isoyear(event_date) AS iso_year, weekofyear(event_date) AS iso_week, concat(CAST(isoyear(event_date) AS VARCHAR), '-W', lpad(CAST(weekofyear(event_date) AS VARCHAR), 2, '0')) AS week_key, strftime(event_date, '%Y-%m') AS month_key, dayofyear(event_date) AS doy, count(*) AS n, round(sum(ln(catch_tm)), 6) AS log_catch FROM ev GROUP BY ALL")
def prj1_prj2_prj3_calendar(s, d):
    df = V.catch_events(s, d).withColumnsRenamed({"catch_tm": "tons", "not_there": "x"})
    keyed = S.calendar_keys(df, "event_date")
    return keyed.groupBy("event_date", "year", "iso_year", "iso_week", "week_key", "month_key", "doy").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.log("tons")), 6).alias("log_catch"))


@query("SELECT CASE upper(trim(n_name)) WHEN 'NATION_1' THEN 'FIRST' WHEN 'NATION_2' THEN 'SECOND' ELSE upper(trim(n_name)) END AS company, n_nationkey FROM nation")
def str1_company_names(s, d):
    aliases = s.createDataFrame([("nation_1 ", "FIRST"), ("Nation_2", "SECOND")], "alias string, name string")
    df = V.table(s, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("company"), "n_nationkey")
    return X.normal_companies(df, "company", aliases).select("company", "n_nationkey")


@query("SELECT p_name, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN string_split(p_name, ' ')[2] ELSE p_name END AS token, contains(lower(p_name), lower(p_brand)) AS named, trim(replace(replace(replace(replace(lower(p_name || n.v), '.', ''), ' ', '_'), 's_a_a', 'saa'), 's_a_c', 'sac'), '_') AS slug FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN ' S.A.A.' WHEN 1 THEN ' S A C' WHEN 2 THEN ' ' ELSE '' END AS v FROM part) n")
def str2_str4_tokens(s, d):
    p = V.table(s, d, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, " S.A.A.").when(F.col("p_partkey") % 4 == 1, " S A C").when(F.col("p_partkey") % 4 == 2, " ").otherwise("")
    return p.select("p_name", X.company_token(F.col("p_name")).alias("token"), X.mentions(F.col("p_name"), F.col("p_brand")).alias("named"), X.slug(F.concat("p_name", kind)).alias("slug"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('TASA ', CAST(s_suppkey AS VARCHAR)) ELSE upper(s_name) END AS vessel FROM supplier")
def str3_vessel_codes(s, d):
    su = V.table(s, d, "supplier")
    code = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name"))
    return su.select("s_suppkey", X.vessel_code(code).alias("vessel"))


# ---- grids and joins -------------------------------------------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS time, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def agg1_daily_means(s, d):
    return G.daily_means(V.table(s, d, "events"), "ts", "value", ["event_type"]).select("time", "event_type", r6("value"))


@query("SELECT time, lat, lon, round(anom, 6) AS anom FROM anom")
def agg2_jon3_anomalies(s, d):
    return t_anomaly(s, d).select("time", "lat", "lon", r6("anom"))


@query("SELECT g.time, g.lat, g.lon, round(value - clim, 6) AS anom FROM gr g JOIN (SELECT month(time) AS m, lat, lon, avg(value) AS clim FROM gr WHERE year(time) BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3) c ON month(g.time) = m AND g.lat = c.lat AND g.lon = c.lon")
def agg3_jon4_monthly_anomalies(s, d):
    g = V.grid(s, d)
    month = F.month("time")
    return G.anomalies(g, G.climatology(g, month, "month", (1996, 1999)), month, "month").select("time", "lat", "lon", r6("anom"))


@query("SELECT event_date, season, company, vessel, round(sum(catch_tm), 4) AS catch_tm, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM ev WHERE season IS NOT NULL GROUP BY 1, 2, 3, 4")
def agg4_vessel_days(s, d):
    return C.vessel_days(V.catch_events(s, d)).select("event_date", "season", "company", "vessel", F.round("catch_tm", 4).alias("catch_tm"), r6("lat"), r6("lon"))


@query("SELECT company, event_date, count(*) AS n, count(sst_anom) AS matched, round(sum(sst_anom), 6) AS total FROM en GROUP BY 1, 2")
def jon1_nearest_grid(s, d):
    return t_enriched(s, d).groupBy("company", "event_date").agg(F.count(F.lit(1)).alias("n"), F.count("sst_anom").alias("matched"), F.round(F.sum("sst_anom"), 6).alias("total"))


@query("SELECT company, count(*) AS n, count(anom) AS matched, round(sum(anom), 6) AS total FROM ev LEFT JOIN axt ON axt.event_date = ev.event_date LEFT JOIN (SELECT year, plat, lat AS la FROM (SELECT p.year, p.lat AS plat, g.lat, row_number() OVER (PARTITION BY p.year, p.lat ORDER BY abs(g.lat - p.lat), g.lat DESC) AS r FROM (SELECT DISTINCT year(event_date) AS year, lat FROM ev) p JOIN (SELECT DISTINCT year(time) AS year, lat FROM anom) g USING (year)) WHERE r = 1) la ON la.year = year(ev.event_date) AND plat = ev.lat LEFT JOIN axlo ON axlo.year = year(ev.event_date) AND plon = ev.lon LEFT JOIN anom ON anom.time = t AND anom.lat = la AND anom.lon = lo GROUP BY 1")
def jon1_falling_latitude(s, d):
    """The same with a latitude axis stored from north to south: of two cells as near, the northern one."""
    points = V.catch_events(s, d).withColumn("year", F.year("event_date"))
    df = M.nearest_grid(points, t_anomaly(s, d).withColumnRenamed("anom", "value"), "v", falling=("lat",))
    return df.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("matched"), F.round(F.sum("v"), 6).alias("total"))


JON2 = """SELECT e.company, year(e.event_date) AS year, count(*) AS n, count(temp) AS with_temp, count(chl) AS with_chl, round(sum(temp), 4) AS temp, round(sum(temp - 35.1), 4) AS temp_ref FROM (
    SELECT ev.*, g.value AS temp, f.value AS chl FROM ev
    LEFT JOIN (SELECT event_date, arg_min(time, abs(date_diff('day', time, event_date)) * 100000 + dayofyear(time)) AS tg FROM (SELECT DISTINCT event_date FROM ev) JOIN (SELECT DISTINCT time FROM gr) ON year(time) = year(event_date) GROUP BY 1) a ON a.event_date = ev.event_date
    LEFT JOIN (SELECT event_date, arg_min(time, abs(date_diff('day', time, event_date)) * 100000 + dayofyear(time)) AS tf FROM (SELECT DISTINCT event_date FROM ev) JOIN (SELECT DISTINCT time FROM fi) ON year(time) = year(event_date) GROUP BY 1) b ON b.event_date = ev.event_date
    LEFT JOIN (SELECT y, p, v FROM (SELECT y, p, v, row_number() OVER (PARTITION BY y, p ORDER BY abs(v - p), v) AS r FROM (SELECT DISTINCT year(event_date) AS y, lat AS p FROM ev) JOIN (SELECT DISTINCT year(time) AS y, lat AS v FROM gr) USING (y)) WHERE r = 1) c ON c.y = year(ev.event_date) AND c.p = ev.lat
    LEFT JOIN (SELECT y, p, v FROM (SELECT y, p, v, row_number() OVER (PARTITION BY y, p ORDER BY abs(v - p), v) AS r FROM (SELECT DISTINCT year(event_date) AS y, lon AS p FROM ev) JOIN (SELECT DISTINCT year(time) AS y, lon AS v FROM gr) USING (y)) WHERE r = 1) d ON d.y = year(ev.event_date) AND d.p = ev.lon
    LEFT JOIN (SELECT y, p, v FROM (SELECT y, p, v, row_number() OVER (PARTITION BY y, p ORDER BY abs(v - p), v) AS r FROM (SELECT DISTINCT year(event_date) AS y, lat AS p FROM ev) JOIN (SELECT DISTINCT year(time) AS y, lat AS v FROM fi) USING (y)) WHERE r = 1) h ON h.y = year(ev.event_date) AND h.p = ev.lat
    LEFT JOIN (SELECT y, p, v FROM (SELECT y, p, v, row_number() OVER (PARTITION BY y, p ORDER BY abs(v - p), v) AS r FROM (SELECT DISTINCT year(event_date) AS y, lon AS p FROM ev) JOIN (SELECT DISTINCT year(time) AS y, lon AS v FROM fi) USING (y)) WHERE r = 1) k ON k.y = year(ev.event_date) AND k.p = ev.lon
    LEFT JOIN gr g ON g.time = tg AND g.lat = c.v AND g.lon = d.v LEFT JOIN fi f ON f.time = tf AND f.lat = h.v AND f.lon = k.v) e WHERE year(e.event_date) IN (SELECT DISTINCT year(time) FROM fi) AND year(e.event_date) IN (SELECT DISTINCT year(time) FROM gr) GROUP BY 1, 2"""


@query(JON2)
def jon2_prj4_enrichment(s, d):
    grids = {("temp",): V.grid(s, d).withColumnRenamed("value", "temp"), ("chl",): V.fine_grid(s, d).withColumnRenamed("value", "chl")}
    df = M.enrich(V.catch_events(s, d), grids, ["temp", "chl"], ("temp", 35.1, "temp_ref"))
    return df.groupBy("company", "year").agg(F.count(F.lit(1)).alias("n"), F.count("temp").alias("with_temp"), F.count("chl").alias("with_chl"), F.round(F.sum("temp"), 4).alias("temp"), F.round(F.sum("temp_ref"), 4).alias("temp_ref"))


SEVEN = ("temp", "sal", "temp_anom", "chl", "chl_anom", "modis", "modis_anom")
JON2_SEVEN = JON2.replace("g.value AS temp, f.value AS chl FROM", "g.value AS temp, 33 + g.value / 10 AS sal, CASE WHEN year(ev.event_date) >= 1995 THEN g.value - 20 END AS temp_anom, f.value AS chl, CASE WHEN year(ev.event_date) <= 1997 THEN f.value * 2 END AS chl_anom, f.value + 1 AS modis, NULL::DOUBLE AS modis_anom FROM")
JON2_SEVEN = "SELECT company, year(event_date) AS year, count(*) AS n, " + ", ".join(f"count({c}) AS n_{c}, round(sum({c}), 4) AS {c}" for c in SEVEN) + ", round(sum(sal - 35.1), 4) AS sal_ref FROM (" + JON2_SEVEN.split(" FROM (", 1)[1].replace("year(e.event_date) IN (SELECT DISTINCT year(time) FROM fi) AND ", "")


@query(JON2_SEVEN)
def jon2_seven_variables(s, d):
    """Two variables that a year must have, and five that it may lack: in some years, or altogether (the last one)."""
    g, f, year = V.grid(s, d), V.fine_grid(s, d), F.year("time")
    v = F.col("value")
    coarse = g.select("time", "lat", "lon", v.alias("temp"), (33 + v / 10).alias("sal"), F.when(year >= 1995, v - 20).alias("temp_anom"))
    fine = f.select("time", "lat", "lon", v.alias("chl"), F.when(year <= 1997, v * 2).alias("chl_anom"), (v + 1).alias("modis"))
    df = M.enrich(V.catch_events(s, d), {SEVEN[:3]: coarse, SEVEN[3:]: fine}, ["temp", "sal"], ("sal", 35.1, "sal_ref"))
    sums = [x for c in SEVEN for x in (F.count(c).alias(f"n_{c}"), F.round(F.sum(c), 4).alias(c))]
    return df.groupBy("company", "year").agg(F.count(F.lit(1)).alias("n"), *sums, F.round(F.sum("sal_ref"), 4).alias("sal_ref"))


@query("SELECT region, lat, lon FROM cells")
def jon5_idx1_members(s, d):
    ev = V.catch_events(s, d)
    ext = K.extents(ev, t_regions(s))
    return K.members(t_anomaly(s, d), K.edges(K.bands(ev, t_regions(s)), ext), ext)


@query("SELECT region, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM edges")
def idx1_win2_edges(s, d):
    ev = V.catch_events(s, d)
    return K.edges(K.bands(ev, t_regions(s)), K.extents(ev, t_regions(s))).select("region", *[r6(c) for c in ("x1", "y1", "x2", "y2")])


@query("SELECT kind, region, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM (SELECT 'bounds' AS kind, * FROM edgesr UNION ALL SELECT 'bands', * FROM edgesb)")
def idx1_fixed_caps(s, d):
    """Corridors that end at the region's bounds, or at the edges of its outer bands."""
    ev, regions = V.catch_events(s, d), t_regions(s)
    bands = hold(s, d, "bands", lambda s, d: K.bands(ev, regions))
    kinds = {"bounds": K.caps_at_bounds(regions, K.extents(ev, regions)), "bands": K.caps_at_bands(bands)}
    parts = [K.edges(bands, caps).select(F.lit(kind).alias("kind"), "region", *[r6(c) for c in ("x1", "y1", "x2", "y2")]) for kind, caps in kinds.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT region, band, round(west, 6) AS west, round(east, 6) AS east FROM bands")
def agg18_bands(s, d):
    return K.bands(V.catch_events(s, d), t_regions(s)).select("region", "band", r6("west"), r6("east"))


@query("SELECT region, year, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM bothseas")
def jon7_both_seasons(s, d):
    return K.both_seasons(t_seasons(s, d), ["region"]).select("region", "year", r6("t1"), r6("t2"))


@query("SELECT time, lat, lon, round(coarse, 6) AS coarse, round(fine, 6) AS fine FROM pair")
def jon8_colocation(s, d):
    return M.colocate(V.grid(s, d), V.fine_grid(s, d)).select("time", "lat", "lon", r6("coarse"), r6("fine"))


@query("SELECT count(*) AS n, round(corr(coarse, fine), 6) AS r, round(sqrt(avg(pow(coarse - fine, 2))), 6) AS rmse, round(avg(coarse - fine), 6) AS bias FROM pair")
def agg25_sensor_quality(s, d):
    p = M.colocate(V.grid(s, d), V.fine_grid(s, d)).withColumn("e", F.col("coarse") - F.col("fine"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("coarse", "fine"), 6).alias("r"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.avg("e"), 6).alias("bias"))


@query("SELECT lat, lon, n, round(r, 6) AS r, round(bias, 6) AS bias FROM cellq")
def agg25_cell_quality(s, d):
    return M.cell_quality(M.colocate(V.grid(s, d), V.fine_grid(s, d))).select("lat", "lon", "n", r6("r"), r6("bias"))


@query("SELECT round(quantile_cont(abs(bias), 0.95), 6) AS p95, count(*) AS cells FROM cellq")
def agg26_cell_bias(s, d):
    cells = M.cell_quality(M.colocate(V.grid(s, d), V.fine_grid(s, d)))
    return cells.agg(F.round(F.percentile(F.abs("bias"), 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("cells"))


@query("SELECT round(max(p97), 6) AS largest FROM (SELECT band, quantile_cont(abs(v), 0.97) AS p97 FROM banda GROUP BY 1)")
def agg26_band_range(s, d):
    bands = G.band_series(t_anomaly(s, d).withColumnRenamed("anom", "value"))
    return bands.groupBy("band").agg(F.percentile(F.abs("v"), 0.97).alias("p97")).agg(F.round(F.max("p97"), 6).alias("largest"))


def t_owned(s: SparkSession, d: str) -> DataFrame:
    return H.with_company(H.clean_pings(V.pings(s, d)), H.owners(V.fleet_events(s, d)))


def t_cpue(s: SparkSession, d: str) -> DataFrame:
    points = V.fleet_events(s, d).withColumn("year", F.year("event_date"))
    events = M.nearest_grid(points, t_anomaly(s, d).withColumnRenamed("anom", "value"), "sst_anom")
    return H.catch_per_effort(H.catch_periods(events, ["sst_anom", "lat"], []), H.effort_periods(t_owned(s, d)))


@query("SELECT company, period AS season, round(hours, 6) AS hours, days, round(cpue, 6) AS cpue FROM cpue WHERE level = 'season'")
def agg32_jon12_effort(s, d):
    """Catch per hour at sea of each company and season: pings in the season, vessels by their company of the day."""
    df = H.catch_per_effort(H.catch_periods(V.fleet_events(s, d), [], []).filter("level = 'season'"), H.effort_periods(t_owned(s, d)))
    return df.select("company", F.col("period").alias("season"), r6("hours"), "days", r6("cpue"))


@query("SELECT company, period AS week, round(hours, 6) AS hours, days, round(cpue, 6) AS cpue FROM cpue WHERE level = 'week'")
def agg32_jon12_weekly(s, d):
    df = H.catch_per_effort(H.catch_periods(V.fleet_events(s, d), [], []).filter("level = 'week'"), H.effort_periods(t_owned(s, d)))
    return df.select("company", F.col("period").alias("week"), r6("hours"), "days", r6("cpue"))


@query("SELECT count(*) AS vessels, count(*) FILTER (vessel NOT IN (SELECT vessel FROM pclean)) AS unmatched, round(count(*) FILTER (vessel IN (SELECT vessel FROM pclean)) / count(*), 6) AS rate FROM (SELECT DISTINCT upper(vessel) AS vessel FROM fleet)")
def jon12_match_rate(s, d):
    return H.match_rate(V.fleet_events(s, d), H.clean_pings(V.pings(s, d))).select("vessels", "unmatched", r6("rate"))


@query("SELECT vessel, day, company, pings FROM pown")
def jon12_vessel_company(s, d):
    return t_owned(s, d).select("vessel", "day", "company", "pings")


# ---- indices and aggregates ------------------------------------------------------------------------------------------


@query("SELECT region, time, round(idx, 6) AS idx FROM daily")
def agg8_corridor_daily(s, d):
    return t_daily(s, d).select("region", "time", r6("idx"))


@query("SELECT region, time, round(avg(anom), 6) AS idx FROM anom JOIN reg ON (lat_min IS NULL OR lat >= lat_min) AND (lat_max IS NULL OR lat <= lat_max) WHERE lon BETWEEN -82 AND -74 GROUP BY 1, 2")
def agg9_box_mean(s, d):
    r = F.broadcast(t_regions(s))
    inside = (F.col("lat_min").isNull() | (F.col("lat") >= F.col("lat_min"))) & (F.col("lat_max").isNull() | (F.col("lat") <= F.col("lat_max")))
    df = t_anomaly(s, d).filter(F.col("lon").between(-82, -74)).join(r, inside)
    return df.groupBy("region", "time").agg(F.round(F.avg("anom"), 6).alias("idx"))


@query("SELECT region, year, tipo, round(idx, 6) AS idx FROM seas")
def agg10_idx2_seasons(s, d):
    return t_seasons(s, d).select("region", "year", "tipo", r6("idx"))


@query("SELECT region, time, round(idx, 6) AS idx FROM monthly")
def agg11_monthly(s, d):
    return t_daily(s, d).groupBy("region", F.trunc("time", "MM").alias("time")).agg(F.round(F.avg("idx"), 6).alias("idx"))


@query("SELECT region, year, tipo, round(idx, 6) AS idx FROM cseas")
def agg12_flt9_complete_seasons(s, d):
    return t_complete(s, d).select("region", "year", "tipo", r6("idx"))


@query("SELECT year, tipo, lat, lon, round(avg(anom), 6) AS value FROM (SELECT *, year(time) AS year, CASE WHEN dayofyear(time) BETWEEN 91 AND 212 THEN 'T1' WHEN dayofyear(time) BETWEEN 305 AND 365 THEN 'T2' END AS tipo FROM anom) WHERE tipo IS NOT NULL AND (year, tipo) IN (SELECT (year(time), CASE WHEN dayofyear(time) BETWEEN 91 AND 212 THEN 'T1' WHEN dayofyear(time) BETWEEN 305 AND 365 THEN 'T2' END) FROM anom GROUP BY 1 HAVING count(DISTINCT time) >= 5) GROUP BY 1, 2, 3, 4")
def agg13_season_maps(s, d):
    m = G.season_map(t_anomaly(s, d).withColumnRenamed("anom", "value"), S.season_by_doy(F.col("time")), 5)
    return m.select("year", "tipo", "lat", "lon", r6("value"))


@query("SELECT month, band, round(v + 1e-8, 6) AS v FROM bandm")
def agg14_band_series(s, d):
    return G.band_series(V.grid(s, d)).select("month", "band", F.round(F.col("v") + 1e-8, 6).alias("v"))


@query("SELECT band_a, band_b, round(r, 6) AS r FROM bandr")
def jon13_band_correlations(s, d):
    return G.band_correlations(G.band_series(V.grid(s, d))).select("band_a", "band_b", r6("r"))


@query("SELECT round(quantile_cont(r, 0.5), 6) AS median, round(min(r), 6) AS least, round(max(r), 6) AS most, round(avg(CASE WHEN r > 0.1 THEN 1 ELSE 0 END), 6) AS above FROM bandr")
def agg24_correlation_summary(s, d):
    r = G.band_correlations(G.band_series(V.grid(s, d)))
    return r.agg(F.round(F.percentile("r", 0.5), 6).alias("median"), F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"), F.round(F.avg((F.col("r") > 0.1).cast("int")), 6).alias("above"))


@query("SELECT region, round(quantile_cont(idx, 0.01), 6) AS p1, round(quantile_cont(idx, 0.5), 6) AS p50, round(quantile_cont(idx, 0.8), 6) AS p80, round(quantile_cont(idx, 0.9), 6) AS p90, round(quantile_cont(idx, 0.99), 6) AS p99 FROM daily GROUP BY 1")
def agg15_percentiles(s, d):
    names = {"p1": 0.01, "p50": 0.5, "p80": 0.8, "p90": 0.9, "p99": 0.99}
    p = t_daily(s, d).groupBy("region").agg(percentiles("idx", list(names.values())).alias("p"))
    return p.select("region", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


LEVELS = "SELECT region, 'daily' AS level, idx FROM daily UNION ALL SELECT region, 'monthly', idx FROM monthly UNION ALL SELECT region, tipo, idx FROM seas"
SHARE_COLUMNS = ", ".join(f"round(quantile_cont(idx, {p}), 6) AS {n}" for n, p in T.SHARES.items())


@query(f"SELECT region, level, count(idx) AS n, {SHARE_COLUMNS} FROM ({LEVELS}) GROUP BY 1, 2")
def agg15_snk4_percentile_table(s, d):
    return T.percentile_table(hold(s, d, "daily", t_daily), ["region"]).select("region", "level", "n", *[r6(n) for n in T.SHARES])


@query("SELECT round(quantile_cont(idx, 0.9), 6) AS p90, round(quantile_cont(idx, 0.95), 6) AS p95, round(quantile_cont(idx, 0.99), 6) AS p99 FROM seas")
def agg16_pooled_percentiles(s, d):
    p = t_seasons(s, d).agg(percentiles("idx", [0.9, 0.95, 0.99]).alias("p"))
    return p.select(*[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p90", "p95", "p99"))])


@query("SELECT region, tipo, round(quantile_cont(idx, 0.9), 6) AS entry, round(max(idx), 6) AS exit FROM seas GROUP BY 1, 2")
def agg17_season_triggers(s, d):
    p = t_seasons(s, d).groupBy("region", "tipo").agg(percentiles("idx", [0.9, 1.0]).alias("p"))
    return p.select("region", "tipo", F.round(F.get("p", F.lit(0)), 6).alias("entry"), F.round(F.get("p", F.lit(1)), 6).alias("exit"))


@query("SELECT region, season, year, tipo, round(catch_tm, 4) AS catch_tm FROM rs")
def agg5_region_seasons(s, d):
    return C.region_seasons(V.catch_events(s, d), t_regions(s)).select("region", "season", "year", "tipo", F.round("catch_tm", 4).alias("catch_tm"))


@query("SELECT t.*, CAST(trunc(a.mean) AS BIGINT) AS mean_year, CAST(trunc(a.lo) AS BIGINT) AS min_year_tm, a.lo_year AS min_year, CAST(trunc(a.hi) AS BIGINT) AS max_year_tm, a.hi_year AS max_year FROM (SELECT region, CAST(trunc(avg(catch_tm) FILTER (tipo = 'T1')) AS BIGINT) AS mean_t1, CAST(trunc(avg(catch_tm) FILTER (tipo = 'T2')) AS BIGINT) AS mean_t2 FROM rs GROUP BY 1) t JOIN (SELECT region, avg(total) AS mean, min(total) AS lo, max(total) AS hi, arg_min(year, total) AS lo_year, arg_max(year, total) AS hi_year FROM (SELECT region, year, sum(catch_tm) AS total FROM rs GROUP BY 1, 2) GROUP BY 1) a USING (region)")
def agg6_srt3_region_summary(s, d):
    return C.region_summary(C.region_seasons(V.catch_events(s, d), t_regions(s)))


@query("SELECT company, concat(CAST(isoyear(event_date) AS VARCHAR), '-W', lpad(CAST(weekofyear(event_date) AS VARCHAR), 2, '0')) AS period, round(sum(catch_tm), 4) AS catch_tm, round(avg(sst_anom), 6) AS sst_anom FROM us GROUP BY 1, 2")
def agg7_company_weeks(s, d):
    df = C.usable(t_enriched(s, d), "sst_anom", "season")
    return df.groupBy("company", S.iso_week(F.col("event_date")).alias("period")).agg(F.round(F.sum("catch_tm"), 4).alias("catch_tm"), F.round(F.avg("sst_anom"), 6).alias("sst_anom"))


@query("SELECT region, round(base_t1, 4) AS base_t1, round(base_t2, 4) AS base_t2, round(max_t1, 4) AS max_t1, round(max_t2, 4) AS max_t2 FROM base")
def agg19_baselines(s, d):
    return t_baselines(s, d).select("region", *[F.round(c, 4).alias(c) for c in ("base_t1", "base_t2", "max_t1", "max_t2")])


@query("SELECT company, region, tipo, round(avg(catch_tm), 4) AS baseline FROM csr GROUP BY 1, 2, 3")
def agg20_company_baselines(s, d):
    df = C.company_seasons(V.catch_events(s, d), t_regions(s))
    return df.groupBy("company", "region", "tipo").agg(F.round(F.avg("catch_tm"), 4).alias("baseline"))


@query("SELECT company, arg_max(year, tm) AS best_year, round(max(tm), 4) AS best_tm FROM (SELECT company, year(event_date) AS year, sum(catch_tm) AS tm FROM ev WHERE year(event_date) < 2001 GROUP BY 1, 2) GROUP BY 1")
def agg21_flt12_best_years(s, d):
    return C.best_year(V.catch_events(s, d), "company", 2001).select("company", "best_year", F.round("best_tm", 4).alias("best_tm"))


@query("SELECT round(avg(tm), 4) AS mean, round(max(tm), 4) AS largest, arg_max(year, tm) AS year FROM (SELECT year(event_date) AS year, sum(catch_tm) AS tm FROM ev GROUP BY 1)")
def agg22_national(s, d):
    per = V.catch_events(s, d).groupBy(F.year("event_date").alias("year")).agg(F.sum("catch_tm").alias("tm"))
    return per.agg(F.round(F.avg("tm"), 4).alias("mean"), F.round(F.max("tm"), 4).alias("largest"), F.max_by("year", "tm").alias("year"))


@query("SELECT coalesce(region, 'Total') AS region, round(sum(base_t1) / 4, 4) AS m1, round(sum(base_t2) / 2, 4) AS m2, round(100 * (sum(base_t1) / 4 + sum(base_t2) / 2) / (SELECT sum(base_t1) / 4 + sum(base_t2) / 2 FROM base), 4) AS share FROM base GROUP BY ROLLUP (region)")
def agg23_win3_monthly_baseline(s, d):
    return C.monthly_baseline(t_baselines(s, d)).select("region", *[F.round(c, 4).alias(c) for c in ("m1", "m2", "share")])


@query("SELECT season, CAST(least(floor((lon + 82) * 80 / 8), 79) AS INTEGER) AS ix, CAST(least(floor((lat + 16) * 110 / 11), 109) AS INTEGER) AS iy, count(*) AS n FROM ev WHERE lon BETWEEN -82 AND -74 AND lat BETWEEN -16 AND -5 GROUP BY 1, 2, 3")
def agg27_density(s, d):
    return C.density(V.catch_events(s, d), ["season"])


@query("SELECT company, CASE WHEN season LIKE '1ra%' THEN 'T1' WHEN season LIKE '2da%' THEN 'T2' END AS tipo, count(*) AS n FROM ev GROUP BY 1, 2")
def agg28_counts(s, d):
    return V.catch_events(s, d).groupBy("company", S.season_type(F.col("season")).alias("tipo")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT region, tipo, n, round(mu, 6) AS mu, round(sd, 6) AS sd, round(mu + 1.2815515655446004 * sd, 6) AS p90, round(mu + 1.6448536269514722 * sd, 6) AS p95, round(mu + 2.3263478740408408 * sd, 6) AS p99 FROM fit")
def agg29_reg12_normal_fit(s, d):
    return R.normal_fit(t_seasons(s, d), ["region", "tipo"]).select("region", "tipo", "n", *[r6(c) for c in ("mu", "sd", "p90", "p95", "p99")])


PHASES = "(SELECT year, CASE WHEN q = 2 THEN 'T1' ELSE 'T2' END AS tipo, CASE WHEN oni >= 0.5 THEN 'Warm' WHEN oni <= -0.5 THEN 'Cold' ELSE 'Neutral' END AS phase FROM (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS q, (avg(o_totalprice) - 250000) / 2000 AS oni FROM orders WHERE quarter(o_orderdate) IN (2, 4) GROUP BY 1, 2))"


def t_phases(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders")
    per = o.filter(F.quarter("o_orderdate").isin(2, 4)).groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("q")).agg(((F.avg("o_totalprice") - 250000) / 2000).alias("oni"))
    phase = F.when(F.col("oni") >= 0.5, "Warm").when(F.col("oni") <= -0.5, "Cold").otherwise("Neutral")
    return per.select("year", F.when(F.col("q") == 2, "T1").otherwise("T2").alias("tipo"), phase.alias("phase"))


@query(f"SELECT s.region, s.year, s.tipo, coalesce(phase, 'Neutral') AS phase FROM seas s LEFT JOIN {PHASES} p ON s.year = p.year AND s.tipo = p.tipo")
def ens1_jon10_phases(s, d):
    return t_seasons(s, d).join(t_phases(s, d), ["year", "tipo"], "left").select("region", "year", "tipo", F.coalesce("phase", F.lit("Neutral")).alias("phase"))


@query(f"SELECT region, phase, count(idx) AS n, round(avg(idx), 6) AS mu, round(stddev_samp(idx), 6) AS sd FROM (SELECT s.*, coalesce(phase, 'Neutral') AS phase FROM seas s LEFT JOIN {PHASES} p ON s.year = p.year AND s.tipo = p.tipo) GROUP BY 1, 2 HAVING count(idx) >= 4")
def agg30_phase_fit(s, d):
    df = t_seasons(s, d).join(t_phases(s, d), ["year", "tipo"], "left").withColumn("phase", F.coalesce("phase", F.lit("Neutral")))
    return R.normal_fit(df, ["region", "phase"], 4).select("region", "phase", "n", r6("mu"), r6("sd"))


@query("SELECT region, trigger, count(*) AS seasons, count(*) FILTER (idx >= level) AS hits, round(count(*) FILTER (idx >= level) / count(*), 6) AS share FROM seas JOIN (SELECT region, 'p80' AS trigger, quantile_cont(idx, 0.8) AS level FROM seas GROUP BY 1 UNION ALL SELECT region, 'p90', quantile_cont(idx, 0.9) FROM seas GROUP BY 1) USING (region) GROUP BY 1, 2")
def agg31_activations(s, d):
    seasons = t_seasons(s, d)
    p = seasons.groupBy("region").agg(percentiles("idx", [0.8, 0.9]).alias("p"))
    levels = p.select("region", F.explode(F.array(F.struct(F.lit("p80").alias("trigger"), F.get("p", F.lit(0)).alias("level")), F.struct(F.lit("p90").alias("trigger"), F.get("p", F.lit(1)).alias("level")))).alias("t")).select("region", "t.trigger", "t.level")
    return Q.activations(seasons, levels, ["region"]).withColumn("share", F.round("share", 6))


@query("SELECT region, trigger, count(*) AS seasons, count(*) FILTER (idx <= level) AS hits, round(count(*) FILTER (idx <= level) / count(*), 6) AS share FROM seas JOIN (SELECT region, 'p20' AS trigger, quantile_cont(idx, 0.2) AS level FROM seas GROUP BY 1 UNION ALL SELECT region, 'p10', quantile_cont(idx, 0.1) FROM seas GROUP BY 1) USING (region) GROUP BY 1, 2")
def agg31_activations_below(s, d):
    """For an index that pays when it is low, such as salinity."""
    hold(s, d, "daily", t_daily)
    seasons = t_seasons(s, d)
    p = exact_percentiles(seasons, ["region"], "idx", {"p20": 0.2, "p10": 0.1})
    levels = p.select("region", F.explode(F.array(*[F.struct(F.lit(c).alias("trigger"), F.col(c).alias("level")) for c in ("p20", "p10")])).alias("t")).select("region", "t.*")
    return Q.activations(seasons, levels, ["region"], below=True).withColumn("share", F.round("share", 6))


@query("SELECT region, year, tipo, round(greatest(0, least(1, (p20 - idx) / (p20 - p01))), 6) AS ramp, CASE WHEN idx <= p20 THEN 1.0::DOUBLE ELSE 0 END AS step, round(CASE WHEN idx < 0 THEN 1 - exp(0.5 * idx) ELSE 0 END * CASE WHEN tipo = 'T1' THEN base_t1 ELSE base_t2 END, 4) AS loss_tm FROM seas JOIN (SELECT region, quantile_cont(idx, 0.2) AS p20, quantile_cont(idx, 0.01) AS p01 FROM daily GROUP BY 1) USING (region) JOIN base USING (region)")
def pay4_below_chain(s, d):
    """The whole chain for an index that pays when it is low: triggers, ramp, step and losses."""
    daily = hold(s, d, "daily", t_daily)
    p = exact_percentiles(daily, ["region"], "idx", {"p20": 0.2, "p01": 0.01}).drop("n")
    df = t_seasons(s, d).join(F.broadcast(p), "region").join(F.broadcast(t_baselines(s, d)), "region")
    x, base = F.col("idx"), F.when(F.col("tipo") == "T1", F.col("base_t1")).otherwise(F.col("base_t2"))
    return df.select("region", "year", "tipo", F.round(P.ramp_below(x, F.col("p20"), F.col("p01")), 6).alias("ramp"), P.step_below(x, F.col("p20")).alias("step"), F.round(P.implied_loss_below(x, F.lit(0.5)) * base, 4).alias("loss_tm"))


@query("SELECT region, year, tipo, round(idx, 6) AS idx FROM seas JOIN (SELECT region, quantile_cont(idx, 0.05) AS p05 FROM seas GROUP BY 1) USING (region) WHERE idx <= p05")
def agg33_extremes(s, d):
    seasons = t_seasons(s, d)
    low = seasons.groupBy("region").agg(F.percentile("idx", 0.05).alias("p05"))
    return seasons.join(low, "region").filter("idx <= p05").select("region", "year", "tipo", r6("idx"))


@query("SELECT season, round(sum(catch_tm) FILTER (region = 'Norte'), 4) AS norte, round(sum(catch_tm) FILTER (region = 'Centro Norte'), 4) AS centro_norte, round(sum(catch_tm) FILTER (region = 'Centro Sur'), 4) AS centro_sur FROM rs GROUP BY 1")
def agg34_pivot(s, d):
    p = C.region_seasons(V.catch_events(s, d), t_regions(s)).groupBy("season").pivot("region", CORRIDORS).agg(F.sum("catch_tm"))
    return p.select("season", F.round("Norte", 4).alias("norte"), F.round("Centro Norte", 4).alias("centro_norte"), F.round("Centro Sur", 4).alias("centro_sur"))


# ---- regressions -----------------------------------------------------------------------------------------------------

OLECOLUMNS = "n, round(beta, 6) AS beta, round(intercept, 6) AS intercept, round(se, 6) AS se, round(r2, 6) AS r2, round(p, 6) AS p"


def ols_columns() -> list[Column | str]:
    return ["n", *[r6(c) for c in ("beta", "intercept", "se", "r2", "p")]]


@query(f"SELECT region, {OLECOLUMNS}, round(beta + 1.96 * se, 6) AS conservative, round(beta - 1.96 * se, 6) AS n_lower, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM ({ols_sql('cs', 'region', 'y', 'x')})")
def reg1_reg2_reg4_reg7_betas(s, d):
    o = R.ols(t_company_seasons(s, d), ["region"], "y", "x").filter("beta is not null")
    return o.select("region", *ols_columns(), F.round(R.conservative(F.col("beta"), F.col("se")), 6).alias("conservative"), r6("n_lower"), X.stars(F.col("p")).alias("stars"))


@query(f"SELECT region, round(beta - sign(beta) * 1.96 * se, 6) AS inverted FROM ({ols_sql('cs', 'region', 'y', 'x')})")
def reg4_inverted(s, d):
    o = R.ols(t_company_seasons(s, d), ["region"], "y", "x").filter("beta is not null")
    return o.select("region", F.round(R.conservative(F.col("beta"), F.col("se"), inverted=True), 6).alias("inverted"))


@query("SELECT region, i, round(lo + (hi - lo) * i / 99, 6) AS at, round(exp(-pow((lo + (hi - lo) * i / 99 - mu) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 6) AS density FROM (SELECT region, count(idx) AS n, avg(idx) AS mu, stddev_samp(idx) AS sd, min(idx) AS lo, max(idx) AS hi FROM seas GROUP BY 1), (SELECT CAST(range AS INTEGER) AS i FROM range(100))")
def reg12_normal_curve(s, d):
    hold(s, d, "daily", t_daily)
    seasons = t_seasons(s, d)
    ends = seasons.groupBy("region").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    fit = R.normal_fit(seasons, ["region"]).join(ends, "region")
    return R.normal_curve(fit, ["region"], "lo", "hi").select("region", "i", r6("at"), r6("density"))


@query("SELECT region, n, round(c1, 4) AS c1, round(c2, 4) AS c2 FROM (SELECT *, (syz - b * szz2) / szz AS a1, b AS c2, (syz - b * szz2) / szz - 2 * b * m AS c1 FROM (SELECT *, (syq - syz * szz2 / szz) / (sqq - szz2 * szz2 / szz) AS b FROM (SELECT region, any_value(m) AS m, count(*) AS n, regr_sxx(y, z) AS szz, regr_sxy(y, z) AS syz, regr_sxx(y, z * z) AS sqq, regr_sxy(y, z * z) AS syq, regr_sxy(z, z * z) AS szz2 FROM (SELECT region, y, x - avg(x) OVER (PARTITION BY region) AS z, avg(x) OVER (PARTITION BY region) AS m FROM cs) GROUP BY 1 HAVING count(*) >= 10) WHERE sqq - szz2 * szz2 / szz > 1e-9 * sqq))")
def reg11_quadratic(s, d):
    q = R.quadratic(t_company_seasons(s, d), ["region"], "y", "x")
    return q.select("region", "n", F.round("c1", 4).alias("c1"), F.round("c2", 4).alias("c2"))


LADDER = """SELECT 'event' AS level, region, log_catch AS y, sst_anom AS x FROM usr
    UNION ALL SELECT 'day', region, ln(sum(catch_tm)), avg(sst_anom) FROM usr GROUP BY region, company, event_date
    UNION ALL SELECT 'week', region, ln(sum(catch_tm)), avg(sst_anom) FROM usr GROUP BY region, company, isoyear(event_date), weekofyear(event_date)
    UNION ALL SELECT 'month', region, ln(sum(catch_tm)), avg(sst_anom) FROM usr GROUP BY region, company, year(event_date), month(event_date)
    UNION ALL SELECT 'season', region, ln(sum(catch_tm)), avg(sst_anom) FROM usr GROUP BY region, company, season"""


@query(f"SELECT level, region, {OLECOLUMNS} FROM ({ols_sql(f'({LADDER})', 'level, region', 'y', 'x')})")
def reg5_ladder(s, d):
    df = R.levels(t_usable(s, d), "sst_anom").withColumn("y", F.log("catch_tm"))
    return R.ols(df, ["level", "region"], "y", "sst_anom").filter("beta is not null").select("level", "region", *ols_columns())


@query(f"SELECT arg_max(region, r2) AS region, round(max(r2), 6) AS r2 FROM ({ols_sql('cs', 'region', 'y', 'x')})")
def reg6_best_scope(s, d):
    o = R.ols(t_company_seasons(s, d), ["region"], "y", "x")
    return o.agg(F.max_by("region", "r2").alias("region"), F.round(F.max("r2"), 6).alias("r2"))


@query(f"SELECT region, round(beta - {TQ} * se, 5) AS ci_lower, round(beta + {TQ} * se, 5) AS ci_upper FROM ({ols_sql('cs', 'region', 'y', 'x')})")
def reg3_intervals(s, d):
    o = R.ols(t_company_seasons(s, d), ["region"], "y", "x").filter("beta is not null")
    return o.select("region", F.round("ci_lower", 5).alias("ci_lower"), F.round("ci_upper", 5).alias("ci_upper"))


@query(f"SELECT lat, {OLECOLUMNS} FROM ({ols_sql('pair', 'lat', 'coarse', 'fine')})")
def reg8_reg10_index_on_index(s, d):
    return R.ols(M.colocate(V.grid(s, d), V.fine_grid(s, d)), ["lat"], "coarse", "fine").filter("beta is not null").select("lat", *ols_columns())


RANKED = "SELECT region, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT region, rank() OVER (PARTITION BY region ORDER BY x) + (count(*) OVER (PARTITION BY region, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY region ORDER BY y) + (count(*) OVER (PARTITION BY region, y) - 1) / 2 AS ry FROM cs) GROUP BY 1"


@query(f"SELECT region, n, round(rho, 6) AS rho, round(p, 6) AS p FROM ({with_p(f'SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS nu FROM ({RANKED})')})")
def reg9_win1_spearman(s, d):
    return R.spearman(t_company_seasons(s, d), ["region"], "x", "y").select("region", "n", r6("rho"), r6("p"))


@query("SELECT region, i, round(avg(exp(-pow((pt - idx) / h, 2) / 2) / (h * sqrt(2 * pi()))), 6) AS density FROM (SELECT region, i, lo + (hi - lo) * i / 49 AS pt, h FROM (SELECT region, min(idx) AS lo, max(idx) AS hi, stddev_samp(idx) * pow(count(idx), -0.2) AS h FROM seas GROUP BY 1), (SELECT CAST(range AS INTEGER) AS i FROM range(50))) g JOIN seas USING (region) GROUP BY 1, 2")
def reg13_density_curve(s, d):
    return R.density_curve(t_seasons(s, d).select("region", "idx"), ["region"], "idx", 50).select("region", "i", r6("density"))


SMOOTH_W = "(SELECT CAST(range AS INTEGER) - 6 AS o, exp(-pow(range - 6, 2) / 4.5) / (SELECT sum(exp(-pow(range - 6, 2) / 4.5)) FROM range(13)) AS w FROM range(13))"


def smooth_sql(src: str, c: str, size: int) -> str:
    mirrored = f"CASE WHEN p.p + o < 0 THEN -1 - (p.p + o) WHEN p.p + o >= {size} THEN {2 * size - 1} - (p.p + o) ELSE p.p + o END"
    other = "iy" if c == "ix" else "ix"
    return f"SELECT p.p AS {c}, {other}, sum(n * w) AS n FROM (SELECT CAST(range AS INTEGER) AS p FROM range({size})) p CROSS JOIN {SMOOTH_W} JOIN ({src}) s ON s.{c} = {mirrored} GROUP BY 1, 2"


COUNTED = "SELECT CAST(least(floor((lon + 82) * 80 / 8), 79) AS INTEGER) AS ix, CAST(least(floor((lat + 16) * 110 / 11), 109) AS INTEGER) AS iy, count(*) AS n FROM ev WHERE lon BETWEEN -82 AND -74 AND lat BETWEEN -16 AND -5 GROUP BY 1, 2"


@query(f"SELECT ix, iy, round(n, 6) AS n FROM ({smooth_sql(smooth_sql(COUNTED, 'ix', 80), 'iy', 110)})")
def reg14_smoothing(s, d):
    return C.smoothed(C.density(V.catch_events(s, d), [])).select("ix", "iy", r6("n"))


# ---- payouts, scenarios, premiums ------------------------------------------------------------------------------------


@query("SELECT region, year, tipo, round(greatest(0, least(1, (idx - p80) / (p99 - p80))), 6) AS ramp, round(greatest(0, least(1, (-idx - 0.1) / 0.4)), 6) AS below, CASE WHEN idx >= p90 THEN 1.0::DOUBLE ELSE 0 END AS step, CASE WHEN idx <= -0.2 THEN 1.0::DOUBLE ELSE 0 END AS step_below, round(CASE WHEN idx > 0 THEN 1 - exp(-0.816 * idx) ELSE 0 END, 6) AS loss, round(CASE WHEN idx < 0 THEN 1 - exp(0.5 * idx) ELSE 0 END, 6) AS loss_below, concat_ws(' ', CASE WHEN idx >= p90 THEN 'p90' END, CASE WHEN idx >= p95 THEN 'p95' END, CASE WHEN idx >= p99 THEN 'p99' END) AS tag FROM seas JOIN pct USING (region)")
def pay1_pay4_str5_fractions(s, d):
    df = t_seasons(s, d).join(t_triggers(s, d), "region")
    x = F.col("idx")
    return df.select("region", "year", "tipo", F.round(P.ramp(x, F.col("p80"), F.col("p99")), 6).alias("ramp"), F.round(P.ramp_below(x, F.lit(-0.1), F.lit(-0.5)), 6).alias("below"), P.step(x, F.col("p90")).alias("step"), P.step_below(x, F.lit(-0.2)).alias("step_below"), F.round(P.implied_loss(x, F.lit(-0.816)), 6).alias("loss"), F.round(P.implied_loss_below(x, F.lit(0.5)), 6).alias("loss_below"), X.trigger_tag(x, F.col("p90"), F.col("p95"), F.col("p99")).alias("tag"))


@query("SELECT region, i, round(x, 6) AS x, round(greatest(0, least(1, (x - p90) / (p99 - p90))), 6) AS ramp, round((1 - exp(-0.816 * x)) / (1 - exp(-0.816 * p99)), 6) AS loss, round(100 * (1 - exp(-0.816 * x)), 4) AS drop_percent FROM (SELECT region, i, p90, p99, p99 * i / 40 AS x FROM pct, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 41)))")
def pay5_pay11_curves(s, d):
    df = t_triggers(s, d).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("x", F.col("p99") * F.col("i") / 40)
    loss = lambda c: 1 - F.exp(-0.816 * F.col(c))
    return df.select("region", "i", r6("x"), F.round(P.ramp(F.col("x"), F.col("p90"), F.col("p99")), 6).alias("ramp"), F.round(loss("x") / loss("p99"), 6).alias("loss"), F.round(100 * loss("x"), 4).alias("drop_percent"))


@query("SELECT scenario, region, year, round(payout, 4) AS payout FROM hist")
def pay6_annual_payouts(s, d):
    return t_history(s, d).select("scenario", "region", "year", F.round("payout", 4).alias("payout"))


SEASON_PAIRS = "SELECT region, 'p90' AS scenario, 'p99' AS exit_kind, quantile_cont(t1, 0.9) AS e1, quantile_cont(t1, 0.99) AS x1, quantile_cont(t2, 0.9) AS e2, quantile_cont(t2, 0.99) AS x2 FROM bothseas GROUP BY 1 UNION ALL SELECT region, 'p95', 'p99', quantile_cont(t1, 0.95), quantile_cont(t1, 0.99), quantile_cont(t2, 0.95), quantile_cont(t2, 0.99) FROM bothseas GROUP BY 1 UNION ALL SELECT region, 'p90', 'max', quantile_cont(t1, 0.9), max(t1), quantile_cont(t2, 0.9), max(t2) FROM bothseas GROUP BY 1 UNION ALL SELECT region, 'p95', 'max', quantile_cont(t1, 0.95), max(t1), quantile_cont(t2, 0.95), max(t2) FROM bothseas GROUP BY 1"
SEASONAL = f"SELECT scenario, b.region, year, cap_kind, exit_kind, least(c1 * CASE WHEN abs(x1 - e1) < 1e-9 THEN 0 ELSE greatest(0, least(1, (t1 - e1) / (x1 - e1))) END, c1) AS pay1, least(c2 * CASE WHEN abs(x2 - e2) < 1e-9 THEN 0 ELSE greatest(0, least(1, (t2 - e2) / (x2 - e2))) END, c2) AS pay2, c1, c2 FROM bothseas b JOIN ({SEASON_PAIRS}) USING (region) JOIN (SELECT region, 'mean' AS cap_kind, base_t1 AS c1, base_t2 AS c2 FROM base UNION ALL SELECT region, 'max', max_t1, max_t2 FROM base) USING (region) WHERE NOT (cap_kind = 'max' AND exit_kind = 'max')"


def t_seasonal_payouts(s: SparkSession, d: str) -> DataFrame:
    hold(s, d, "daily", t_daily)
    both = hold(s, d, "both", lambda s, d: K.both_seasons(t_seasons(s, d), ["region"]))
    return T.seasonal_payouts(both, t_baselines(s, d))


@query(f"SELECT scenario, region, year, cap_kind, exit_kind, round(pay1, 4) AS pay1, round(pay2, 4) AS pay2, round(pay1 + pay2, 4) AS payout FROM ({SEASONAL})")
def pay7_pay8_seasonal_variants(s, d):
    """Each season on its own triggers (entry p90 or p95, exit p99 or the largest) and its own mean or largest catch."""
    out = t_seasonal_payouts(s, d)
    return out.select("scenario", "region", "year", "cap_kind", "exit_kind", *[F.round(c, 4).alias(c) for c in ("pay1", "pay2", "payout")])


@query(f"SELECT scenario, cap_kind, exit_kind, part, round(aal, 4) AS aal, round(cap, 4) AS cap, round(aal / cap, 6) AS pure_rate, round(aal / cap / 0.65, 6) AS commercial_rate FROM (SELECT scenario, cap_kind, exit_kind, part, avg(least(pay, cap)) AS aal, max(cap) AS cap FROM (SELECT scenario, cap_kind, exit_kind, year, sum(pay1) AS p1, sum(pay2) AS p2, sum(c1) AS c1, sum(c2) AS c2 FROM ({SEASONAL}) GROUP BY ALL), LATERAL (VALUES ('T1', p1, c1), ('T2', p2, c2), ('annual', p1 + p2, c1 + c2)) t(part, pay, cap) GROUP BY 1, 2, 3, 4)")
def snk4_seasonal_rates(s, d):
    """Rates of the program over all regions, by season and for the year, of every variant."""
    out = T.seasonal_rates(t_seasonal_payouts(s, d), 0.65)
    return out.select("scenario", "cap_kind", "exit_kind", "part", *[F.round(c, 4).alias(c) for c in ("aal", "cap")], r6("pure_rate"), r6("commercial_rate"))


@query("SELECT s.region, s.year, s.tipo, round((1 - exp(-0.816 * idx)) * CASE WHEN s.tipo = 'T1' THEN base_t1 ELSE base_t2 END, 4) AS loss_tm, round((1 - exp(-0.816 * idx)) * CASE WHEN s.tipo = 'T1' THEN base_t1 ELSE base_t2 END * 1500, 2) AS loss_money FROM seas s JOIN base USING (region) WHERE idx > 0")
def pay10_jon9_losses(s, d):
    df = t_seasons(s, d).filter("idx > 0").join(F.broadcast(t_baselines(s, d)), "region")
    tm = P.implied_loss(F.col("idx"), F.lit(-0.816)) * F.when(F.col("tipo") == "T1", F.col("base_t1")).otherwise(F.col("base_t2"))
    return df.select("region", "year", "tipo", F.round(tm, 4).alias("loss_tm"), F.round(tm * 1500, 2).alias("loss_money"))


BETAS = [("Norte", -0.7), ("Centro Norte", -0.816)]  # Centro Sur has none of its own


@query("SELECT region, year, tipo, tag, round(1 - exp(beta * idx), 6) AS loss, round((1 - exp(beta * idx)) * CASE WHEN tipo = 'T1' THEN base_t1 ELSE base_t2 END, 4) AS loss_tm FROM (SELECT *, concat_ws(' ', CASE WHEN idx >= p90 THEN 'p90' END, CASE WHEN idx >= p95 THEN 'p95' END, CASE WHEN idx >= p99 THEN 'p99' END) AS tag, CASE region WHEN 'Norte' THEN -0.7 ELSE -0.816 END AS beta FROM seas JOIN (SELECT region, quantile_cont(idx, 0.7) AS p90, quantile_cont(idx, 0.85) AS p95, quantile_cont(idx, 0.95) AS p99 FROM seas GROUP BY 1) USING (region) JOIN base USING (region) WHERE idx >= p90 AND idx > 0)")
def jon9_pay10_snk4_activations(s, d):
    """Activated seasons with their triggers and losses; a region without a beta takes that of the one that stands for it."""
    hold(s, d, "daily", t_daily)
    betas = s.createDataFrame(BETAS, "region string, beta double")
    aliases = s.createDataFrame([("Centro Sur", "Centro Norte")], "region string, stands_for string")
    seasons = t_seasons(s, d)
    triggers = exact_percentiles(seasons, ["region"], "idx", {"p90": 0.7, "p95": 0.85, "p99": 0.95}).drop("n")
    out = T.activation_table(T.with_beta(seasons.filter("idx > 0"), betas, aliases), triggers, t_baselines(s, d), 1500.0)
    return out.select("region", "year", "tipo", "tag", r6("loss"), F.round("loss_tm", 4).alias("loss_tm"))


@query("SELECT scenario, region, count(*) AS years, count(*) FILTER (payout > 0) AS years_paid, round(avg(payout), 4) AS aal, round(max(payout), 4) AS largest, round(max(cap), 4) AS cap, round(avg(payout) / max(cap), 6) AS rate_on_line, round(avg(payout) * 1500 / 0.65, 2) AS commercial_money FROM hist GROUP BY 1, 2")
def snk4_pricing_table(s, d):
    t = T.pricing_table(t_history(s, d), ["scenario", "region"], 1500.0, 0.65)
    return t.select("scenario", "region", "years", "years_paid", *[F.round(c, 4).alias(c) for c in ("aal", "largest", "cap")], r6("rate_on_line"), F.round("commercial_money", 2).alias("commercial_money"))


COMPANY_REPORT = """SELECT company, region, scenario, years, years_paid, mean_tm * 1500 AS insured, mean_tm * 1500 * share AS aal
    FROM (SELECT company, region, sum(tm) AS mean_tm FROM (SELECT company, region, tipo, avg(catch_tm) AS tm FROM csr GROUP BY 1, 2, 3) GROUP BY 1, 2)
    JOIN (SELECT region, scenario, count(*) AS years, count(*) FILTER (s > 0) AS years_paid, avg(s) AS share FROM (
        SELECT region, scenario, least(greatest(0, least(1, (t1 - entry) / (p99 - entry))) + greatest(0, least(1, (t2 - entry) / (p99 - entry))), 1) AS s
        FROM bothseas JOIN (SELECT region, 'p80' AS scenario, quantile_cont(idx, 0.8) AS entry, quantile_cont(idx, 0.99) AS p99 FROM seas GROUP BY 1
            UNION ALL SELECT region, 'p90', quantile_cont(idx, 0.9), quantile_cont(idx, 0.99) FROM seas GROUP BY 1) USING (region)) GROUP BY 1, 2) USING (region)"""


@query(f"SELECT company, region, scenario, years, years_paid, round(insured, 2) AS insured, round(aal, 2) AS aal, round(aal / insured, 6) AS rate FROM (WITH r AS ({COMPANY_REPORT}) SELECT * FROM r UNION ALL SELECT company, 'Total', scenario, NULL, NULL, sum(insured), sum(aal) FROM r GROUP BY 1, 3)")
def snk4_company_report(s, d):
    """Every company's loss by region with entry at its seasons' p90 or p80, and over all regions."""
    hold(s, d, "daily", t_daily)
    seasons = hold(s, d, "seasons", t_seasons)
    p = exact_percentiles(seasons, ["region"], "idx", {"p80": 0.8, "p90": 0.9, "p99": 0.99})
    levels = p.select("region", F.explode(F.array(*[F.struct(F.lit(c).alias("scenario"), F.col(c).alias("entry")) for c in ("p80", "p90")])).alias("l"), F.col("p99").alias("exit")).select("region", "l.*", "exit")
    means = C.company_seasons(V.catch_events(s, d), t_regions(s)).groupBy("company", "region", "tipo").agg(F.avg("catch_tm").alias("tm")).groupBy("company", "region").agg(F.sum("tm").alias("mean_tm"))
    out = T.company_report(K.both_seasons(seasons, ["region"]), levels, means, 1500.0)
    return out.select("company", "region", "scenario", "years", "years_paid", F.round("insured", 2).alias("insured"), F.round("aal", 2).alias("aal"), r6("rate"))


@query("SELECT b.region, round(base_t1, 4) AS base_t1, round(base_t2, 4) AS base_t2, round(p90, 6) AS p90, round(p99, 6) AS p99, seasons, hits FROM base b JOIN pct USING (region) JOIN (SELECT region, count(*) AS seasons, count(*) FILTER (idx >= p90) AS hits FROM seas JOIN pct USING (region) GROUP BY 1) USING (region)")
def snk4_baseline_table(s, d):
    """A row per region: baselines, triggers and how often they were reached."""
    hold(s, d, "daily", t_daily)
    levels = t_triggers(s, d)
    hits = t_seasons(s, d).join(F.broadcast(levels), "region").groupBy("region").agg(F.count(F.lit(1)).alias("seasons"), F.sum((F.col("idx") >= F.col("p90")).cast("long")).alias("hits"))
    df = t_baselines(s, d).join(levels, "region").join(hits, "region")
    return df.select("region", *[F.round(c, 4).alias(c) for c in ("base_t1", "base_t2")], r6("p90"), r6("p99"), "seasons", "hits")


@query("SELECT region, sim_id, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM syn")
def scn1_scenarios(s, d):
    return N.scenarios(N.draws(s), R.normal_fit(t_seasons(s, d), ["region", "tipo"])).select("region", "sim_id", r6("t1"), r6("t2"))


@query("SELECT scenario, sim_id, round(payout, 4) AS payout FROM port")
def pay9_portfolio(s, d):
    return N.portfolio(t_synthetic(s, d), ["scenario", "sim_id"], F.col("cap")).select("scenario", "sim_id", F.round("payout", 4).alias("payout"))


@query("SELECT scenario, region, year, rank, round((n + 1 - rank) / (n + 1), 6) AS ep FROM (SELECT scenario, region, year, row_number() OVER (PARTITION BY scenario, region ORDER BY payout, year) AS rank, count(*) OVER (PARTITION BY scenario, region) AS n FROM (SELECT scenario, region, year, round(payout, 6) AS payout FROM hist))")
def aep1_aep4_exceedance(s, d):
    h = t_history(s, d).select("scenario", "region", "year", r6("payout"))
    return N.exceedance(h, ["scenario", "region"], "payout", "year").select("scenario", "region", "year", F.col("rank").cast("long").alias("rank"), r6("ep"))


EVENT_YEARS = [1996, 1997, 1998, 1999]


@query(f"SELECT scenario, year, rank, round((n + 1 - rank) / (n + 1), 6) AS ep, payout FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY payout, year) AS rank, count(*) OVER (PARTITION BY scenario) AS n FROM (SELECT scenario, year, round(least(sum(pay1 + pay2), sum(c1 + c2)), 4) AS payout FROM ({SEASONAL}) WHERE cap_kind = 'mean' AND exit_kind = 'p99' GROUP BY 1, 2)) WHERE payout > 0 AND year IN (1996, 1997, 1998, 1999)")
def aep4_event_labels(s, d):
    """Where the event years stand on the program's historical curve, once they pay."""
    years = t_seasonal_payouts(s, d).filter("cap_kind = 'mean' and exit_kind = 'p99'").groupBy("scenario", "year").agg(F.round(F.least(F.sum(F.col("pay1") + F.col("pay2")), F.sum(F.col("c1") + F.col("c2"))), 4).alias("payout"))
    out = N.event_labels(N.exceedance(years, ["scenario"], "payout", "year"), ["scenario"], "payout", EVENT_YEARS)
    return out.select("scenario", "year", F.col("rank").cast("long").alias("rank"), r6("ep"), "payout")


CURVE = "SELECT scenario, payout AS v, (n + 1 - rank) / (n + 1) AS ep FROM (SELECT scenario, payout, row_number() OVER (PARTITION BY scenario ORDER BY payout, sim_id) AS rank, count(*) OVER (PARTITION BY scenario) AS n FROM port)"


@query(f"SELECT scenario, grid_id, round(CASE WHEN ep2 IS NULL THEN v ELSE v + (v2 - v) * (pt - ep) / (ep2 - ep) END, 4) AS payout FROM (SELECT *, lead(ep) OVER w AS ep2, lead(v) OVER w AS v2 FROM ({CURVE}) WINDOW w AS (PARTITION BY scenario ORDER BY ep)) JOIN (SELECT range AS grid_id, 1 / 4001 + (4000 / 4001 - 1 / 4001) * range / 299 AS pt FROM range(1, 299)) ON pt >= ep AND (pt < ep2 OR ep2 IS NULL)")
def aep2_interpolation(s, d):
    p = N.portfolio(t_synthetic(s, d), ["scenario", "sim_id"], F.col("cap"))
    curve = N.exceedance(p, ["scenario"], "payout", "sim_id").select("scenario", "ep", "payout")
    at = N.interpolated(curve, ["scenario"], "payout", 1 / 4001, 4000 / 4001).filter("grid_id between 1 and 298")
    return at.select("scenario", "grid_id", F.round("payout", 4).alias("payout"))


CHUNKED = "SELECT scenario, chunk, payout AS v, (n + 1 - rank) / (n + 1) AS ep FROM (SELECT scenario, chunk, payout, row_number() OVER (PARTITION BY scenario, chunk ORDER BY payout, sim_id) AS rank, count(*) OVER (PARTITION BY scenario, chunk) AS n FROM (SELECT *, sim_id // 200 AS chunk FROM port))"


@query(f"SELECT scenario, grid_id, round(quantile_cont(y, 0.05), 4) AS lower, round(quantile_cont(y, 0.95), 4) AS upper FROM (SELECT scenario, chunk, grid_id, CASE WHEN ep2 IS NULL THEN v ELSE v + (v2 - v) * (c - ep) / (ep2 - ep) END AS y FROM (SELECT *, lead(ep) OVER w AS ep2, lead(v) OVER w AS v2, min(ep) OVER x AS lo, max(ep) OVER x AS hi FROM ({CHUNKED}) WINDOW w AS (PARTITION BY scenario, chunk ORDER BY ep), x AS (PARTITION BY scenario, chunk)) s JOIN (SELECT range AS grid_id, 1 / 4001 + (4000 / 4001 - 1 / 4001) * range / 299 AS pt FROM range(300)) g ON true, LATERAL (SELECT least(greatest(pt, lo), hi) AS c) WHERE c >= ep AND (c < ep2 OR ep2 IS NULL)) GROUP BY 1, 2")
def aep3_sampling_band(s, d):
    p = N.portfolio(t_synthetic(s, d), ["scenario", "sim_id"], F.col("cap"))
    return N.sampling_band(p, ["scenario"], "payout", 4000).select("scenario", "grid_id", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("SELECT scenario, region, round(aal, 4) AS aal, round(aal / cap, 6) AS rate_on_line, round(aal * 1500, 2) AS pure_money, round(aal * 1500 / 0.65, 2) AS commercial_money, round(aal / cap / 0.65, 6) AS commercial_rate FROM (SELECT scenario, region, avg(payout) AS aal, max(cap) AS cap FROM spay GROUP BY 1, 2)")
def prm1_prm2_premiums(s, d):
    per = t_synthetic(s, d).groupBy("scenario", "region").agg(F.avg("payout").alias("aal"), F.max("cap").alias("cap"))
    out = Q.premiums(per, F.col("aal"), F.col("cap"), 1500.0, 0.65)
    return out.select("scenario", "region", F.round("aal", 4).alias("aal"), r6("rate_on_line"), F.round("pure_money", 2).alias("pure_money"), F.round("commercial_money", 2).alias("commercial_money"), r6("commercial_rate"))


@query("SELECT scenario, round(sum(aal), 4) AS aal, round(sum(cap), 4) AS cap FROM (SELECT scenario, region, avg(payout) AS aal, max(cap) AS cap FROM hist GROUP BY 1, 2) GROUP BY 1")
def prm3_total(s, d):
    per = t_history(s, d).groupBy("scenario", "region").agg(F.avg("payout").alias("aal"), F.max("cap").alias("cap"))
    return per.groupBy("scenario").agg(F.round(F.sum("aal"), 4).alias("aal"), F.round(F.sum("cap"), 4).alias("cap"))


def t_quotes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = hold(s, d, "documents", lambda s, d: t_company_documents(s, d).unionByName(t_index_document(s, d)))
    companies, actuals, index = quote_tables(documents)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tipo"), F.col(f"baseline_{t.lower()}").alias("baseline")) for t in ("T1", "T2")])).alias("b")
    base = companies.select("company", each).select("company", "b.*").filter("baseline is not null")
    index = index.withColumnRenamed("sst", "idx")
    kinds = F.explode(F.array(*map(F.lit, ("T1", "T2", "both")))).alias("season")
    request = V.table(s, d, "nation").select(F.col("n_name").alias("company"), kinds, F.lit(0.05).alias("entry"), F.lit(0.6).alias("exit"), F.lit(1e6).alias("limit"), F.lit(1500.0).alias("price"), F.lit(0.65).alias("loss_ratio"))
    return Q.quotes(request, base, index, actuals)


QUOTED = f"""SELECT q.company, q.season, x.year, x.tipo, baseline, idx, actual, greatest(0, least(1, (idx - 0.05) / 0.55)) * baseline AS payout
    FROM (SELECT n_name AS company, season FROM nation, (VALUES ('T1'), ('T2'), ('both')) t(season)) q
    JOIN (SELECT company, tipo, avg(actual) AS baseline FROM ({QUOTE_SQL}) GROUP BY 1, 2) b ON q.company = b.company AND (season = 'both' OR season = tipo)
    JOIN (SELECT year, tipo, idx FROM seas WHERE region = 'Centro Norte') x ON x.tipo = b.tipo LEFT JOIN ({QUOTE_SQL}) a ON a.company = q.company AND a.year = x.year AND a.tipo = x.tipo"""


@query(f"SELECT company, season, round(aal, 4) AS aal, round(aal * 1500 / 0.65, 2) AS commercial FROM (SELECT company, season, avg(payout) AS aal FROM (SELECT company, season, year, sum(payout) AS payout FROM ({QUOTED}) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
def prm4_jon11_quotes(s, d):
    return t_quotes(s, d)[0].select("company", "season", F.round("aal", 4).alias("aal"), F.round("commercial", 2).alias("commercial"))


@query(f"SELECT company, year, tipo, round(greatest(baseline - actual, 0), 4) AS shortfall, round(greatest(greatest(baseline - actual, 0) - payout, 0), 4) AS uncovered, payout > 0 AND greatest(baseline - actual, 0) <= 0 AS false_trigger FROM ({QUOTED}) WHERE season = 'both' AND actual IS NOT NULL")
def prm6_basis_risk(s, d):
    rows = Q.basis_risk(t_quotes(s, d)[1].filter("season = 'both' and actual is not null"))
    return rows.select("company", "year", "tipo", F.round("shortfall", 4).alias("shortfall"), F.round("uncovered", 4).alias("uncovered"), "false_trigger")


@query("SELECT season, round(avg(sst_anom), 6) AS idx, count(sst_anom) AS n FROM en WHERE lat BETWEEN -11 AND -7.1 AND season IS NOT NULL GROUP BY 1")
def idx3_event_index(s, d):
    df = t_enriched(s, d).filter(F.col("lat").between(-11, -7.1) & F.col("season").isNotNull())
    return df.groupBy("season").agg(F.round(F.avg("sst_anom"), 6).alias("idx"), F.count("sst_anom").alias("n"))


@query(f"SELECT level, {OLECOLUMNS} FROM ({ols_sql('(SELECT level, ln(cpue) AS y, sst_anom AS x FROM cpue WHERE cpue > 0)', 'level', 'y', 'x')})")
def reg11_effort_model(s, d):
    """The ladder of log(catch per hour) on the anomaly: company by day, week, month and season."""
    df = t_cpue(s, d).filter("cpue > 0").withColumn("y", F.log("cpue"))
    return R.ols(df, ["level"], "y", "sst_anom").filter("beta is not null").select("level", *ols_columns())


TWO = "SELECT level, count(*) AS n, covar_pop(y, y) AS yy, covar_pop(sst_anom, y) AS ay, covar_pop(lat, y) AS by_, covar_pop(sst_anom, sst_anom) AS aa, covar_pop(lat, lat) AS bb, covar_pop(sst_anom, lat) AS ab FROM (SELECT level, ln(cpue) AS y, sst_anom, lat FROM cpue WHERE cpue > 0 AND sst_anom IS NOT NULL AND lat IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10"
TWO_TERMS = f"SELECT *, ca * ay + cb * by_ AS fit_, (yy - (ca * ay + cb * by_)) / (n - 3) AS v FROM (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb FROM ({TWO}))"
TWO_LONG = f"SELECT level, 'sst_anom' AS term, n, ca AS coef, sqrt(v * bb / det) AS se, fit_ / yy AS r2 FROM ({TWO_TERMS}) UNION ALL SELECT level, 'lat', n, cb, sqrt(v * aa / det), fit_ / yy FROM ({TWO_TERMS})"


@query(f"SELECT level, term, n, round(coef, 6) AS coef, round(se, 6) AS se, round(r2, 6) AS r2, round(p, 6) AS p FROM ({with_p(f'SELECT *, coef / se AS t, n - 3 AS nu FROM ({TWO_LONG})')})")
def reg11_effort_terms(s, d):
    """The same on two terms, the anomaly and the mean latitude of the events."""
    return H.effort_model(t_cpue(s, d), [], ["sst_anom", "lat"]).select("level", "term", "n", *[r6(c) for c in ("coef", "se", "r2", "p")])


# ---- sorts and sets --------------------------------------------------------------------------------------------------


@query("SELECT company, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, company LIMIT 4")
def srt1_srt2_top_companies(s, d):
    return V.catch_events(s, d).groupBy("company").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "company").limit(4)


@query("SELECT DISTINCT time FROM gr WHERE time IN (SELECT time FROM fi)")
def set2_common_days(s, d):
    return V.grid(s, d).select("time").intersect(V.fine_grid(s, d).select("time"))


@query("SELECT DISTINCT year(event_date) AS year, company FROM ev")
def set3_distinct(s, d):
    return V.catch_events(s, d).select(F.year("event_date").alias("year"), "company").distinct()


@query("SELECT sensor, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT 'coarse' AS sensor, value FROM gr UNION ALL SELECT 'fine', value FROM fi) GROUP BY 1")
def set1_union(s, d):
    both = V.grid(s, d).select(F.lit("coarse").alias("sensor"), "value").unionByName(V.fine_grid(s, d).select(F.lit("fine").alias("sensor"), "value"))
    return both.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


