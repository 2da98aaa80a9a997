import datetime as dt
import math
import random
from datetime import date, datetime, time, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecover.functions import payouts as P
from tidecover.functions import seasons as S
from tidecover.functions import text as X
from tidecover.functions import stats, text
from tidecover.functions.stats import percentiles, t_p_value, t_quantile_975
from tidecover.operators import climate, corridor, effort, grid, match, regress, report, scenario
from tidecover.sources.documents import climate_index


def column(spark, values, expr, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_ramp_step_and_loss(spark):
    xs = [-0.3, 0.5, 0.94, 0.96, 1.38, 2.01, 2.5, 2.75]
    assert column(spark, xs, lambda x: P.ramp(x, F.lit(0.5), F.lit(2.5))) == pytest.approx([0, 0, 0.22, 0.23, 0.44, 0.755, 1, 1])
    assert column(spark, [0.1, -0.109, -0.1425, -0.176, -0.25], lambda x: P.ramp_below(x, F.lit(-0.109), F.lit(-0.176))) == pytest.approx([0, 0, 0.5, 1, 1])
    loss = column(spark, [0.0, 0.5, 0.96, 1.38, 2.0], lambda x: P.implied_loss(x, F.lit(-0.816)) / P.implied_loss(F.lit(2.5), F.lit(-0.816)))
    assert loss == pytest.approx([0, 0.3851, 0.6243, 0.7767, 0.9247], abs=1e-4)
    assert column(spark, [0.5], lambda x: P.ramp(x, F.lit(1.0), F.lit(1.0))) == [0.0]


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0, 9.5)], "x double")
    assert df.agg(percentiles("x", [0.8, 0.9, 0.95, 0.99])).first()[0] == pytest.approx([8.3, 8.9, 9.2, 9.44])


def test_t_distribution(spark):
    rows = spark.createDataFrame([(0, 2.0, 10), (1, 1.5, 7), (2, -4.79, 142), (3, 1.0, 1), (4, 0.0, 5), (5, 1.96, 30_000)], "i int, t double, nu int")
    got = [r[0] for r in rows.orderBy("i").select(t_p_value(F.col("t"), F.col("nu"))).collect()]
    assert got == pytest.approx([0.0733880348, 0.1772984870, 4.1487e-06, 0.5, 1.0, 0.05], rel=1e-3)
    assert column(spark, [10.0, 30.0], t_quantile_975) == pytest.approx([2.228138852, 2.042272456], abs=2e-5)


def test_ols_known_answer(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in ((1.0, 2.0), (2.0, 3.5), (3.0, 7.0), (4.0, 7.5), (5.0, 9.0))], "k string, x double, y double")
    r = regress.ols(df, ["k"], "y", "x", least=3).first()
    assert (r.beta, r.se, r.r2, r.p) == pytest.approx((1.8, 0.2516611478, 0.9446064140, 0.0056280041), rel=1e-6)
    assert regress.ols(df, ["k"], "y", "x").first().beta is None


def test_seasons_and_labels(spark):
    d = [dt.date(2024, 3, 31), dt.date(2023, 3, 31), dt.date(2024, 12, 31), dt.date(2021, 1, 3)]
    assert column(spark, d, S.season_by_doy, "date") == ["T1", None, None, None]
    assert column(spark, d, S.iso_week, "date")[3] == "2020-W53"
    assert column(spark, ["1ra 2019", "2da 2019", "X CN-I", "X CN-II", "other", None], S.season_type, "string") == ["T1", "T2", "T1", "T2", None, None]
    assert column(spark, ["t12", "T 7", "NAVE X"], X.vessel_code, "string") == ["TASA 12", "TASA 7", "NAVE X"]
    assert column(spark, ["Pesquera Sur S.A.A", "Uno"], X.company_token, "string") == ["Sur", "Uno"]


def test_region_bounds(spark):
    events = spark.createDataFrame([(-7.1, "a"), (-7.0, "b"), (-11.0, "c"), (None, "d")], "lat double, n string")
    regions = spark.createDataFrame([("all", None, None), ("north", -7.1, None), ("mid", -11.0, -7.1)], "region string, lat_min double, lat_max double")
    got = {(r.region, r.n) for r in corridor.assign_regions(events, regions).collect()}
    assert got == {("all", x) for x in "abcd"} | {("north", "b"), ("mid", "a")}


def test_nearest_takes_the_first_of_ties(spark):
    points = spark.createDataFrame([(1, 1.5), (1, 2.9), (1, 9.0)], "k int, x double")
    axis = spark.createDataFrame([(1, 3.0), (1, 2.0), (1, 1.0)], "k int, x double")
    falling = {r.x: r.v for r in match.with_nearest(points, axis, ["k"], "x", "v", falling=True).collect()}
    assert falling == {1.5: 2.0, 2.9: 3.0, 9.0: 3.0}
    rising = {r.x: r.v for r in match.with_nearest(points, axis, ["k"], "x", "v").collect()}
    assert rising == {1.5: 1.0, 2.9: 3.0, 9.0: 3.0}


def test_nearest_on_long_uneven_axes(spark):
    rng = random.Random(3)
    axis = [(k, v) for k in (1, 2) for v in {round(rng.choice([0, 50, 1000]) + rng.random() * 9, 2) for _ in range(400)}] + [(3, 7.0)]
    points = [(rng.randint(1, 4), rng.choice([rng.uniform(-99, 1200), rng.choice(axis)[1] + 0.005, None])) for _ in range(3000)]
    p, a = spark.createDataFrame(points, "k int, x double"), spark.createDataFrame(axis, "k int, x double")
    for falling in (False, True):
        got = match.with_nearest(p, a, ["k"], "x", "v", falling).collect()
        assert len(got) == len(points)
        for r in got:
            own = sorted((v for k, v in axis if k == r.k), reverse=falling)
            assert r.v == (min(own, key=lambda v: abs(v - r.x)) if own and r.x is not None else None)
    plan = match.with_nearest(p, a, ["k"], "x", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan


def test_nearest_places_without_a_grid(spark):
    rng = random.Random(4)
    bent = [(i + 0.3 * math.sin(j), j * 0.7 + 0.1 * i) for i in range(12) for j in range(12) if (i - 5) ** 2 + (j - 5) ** 2 > 9]
    places = [(rng.uniform(-6, 20), rng.uniform(-6, 16)) for _ in range(400)] + [(5.0, 5.0), (5.0, 5.0), (None, 1.0)]
    cells = spark.createDataFrame([*bent, (None, 0.0), bent[0]], "lat double, lon double")
    got = {(r.lat, r.lon): (r.c_lat, r.c_lon) for r in match.nearest_places(spark.createDataFrame(places, "lat double, lon double"), cells, 1.0).collect()}
    assert set(got) == {p for p in places if p[0] is not None}
    for p, c in got.items():
        assert c == min(bent, key=lambda b: ((b[0] - p[0]) * (b[0] - p[0]) + (b[1] - p[1]) * (b[1] - p[1]), b))
    assert match.nearest_places(cells, cells.limit(0), 1.0).count() == 0


def test_ranks_and_percentiles_by_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one range
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.random(), float(rng.randint(0, 9)), None])) for _ in range(5000)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    own = {}
    for g, x in rows:
        if x is not None:
            own.setdefault(g, []).append(x)
    counts = stats.dealt_counts(df, ["g"], "x")
    assert counts.filter("g = 'a'").select("_p").distinct().count() > 1
    for r in stats.cumulative_counts(df, ["g"], "x").collect():
        assert r.n == len(own[r.g]) and r.below == sum(v < r.x for v in own[r.g]) and r.c == own[r.g].count(r.x)
    got = {r.g: r for r in stats.exact_percentiles(df, ["g"], "x", {"p0": 0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1}).collect()}
    assert set(got) == set(own)
    for g, v in own.items():
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got[g].n == len(v) and [got[g][f"p{p}"] for p in (0, 5, 50, 99, 100)] == pytest.approx(list(np.percentile(v, [0, 5, 50, 99, 100])))


def test_effort_by_company_and_period(spark):
    rng = random.Random(6)
    day0 = date(1999, 3, 1)
    events = []
    for v in range(12):
        for _ in range(40):
            day = day0 + timedelta(rng.randint(0, 300))
            events.append((day, effort_season(day), rng.choice("AB") if v == 3 else ("A" if day < date(1999, 6, 1) else "B") if v == 4 else "ABC"[v % 3], f"TASA {v}" if v % 2 else f"Boat {v}", rng.random() * 10))
    pings = []
    for _ in range(4000):
        v, day = rng.randint(0, 13), day0 + timedelta(rng.randint(0, 300))
        season, year = rng.choice([("1ra", 1999), ("2da", 1999), ("1ra", 1998)])
        pings.append((f"t{v}" if v % 2 else f"boat\u00a0{v} ", datetime.combine(day, time(rng.randint(0, 23))), year, season))
    pings += [("t1", datetime(1998, 5, 1 + i), 1998, "1ra") for i in range(5)] + [(None, datetime(1999, 5, 1), 1999, "1ra"), ("t1", None, 1999, "1ra")]
    ev = spark.createDataFrame(events, "event_date date, season string, company string, vessel string, catch_tm double")
    daily = effort.clean_pings(spark.createDataFrame(pings, "code string, ts timestamp, file_year int, file_season string"))
    hours = {(r.level, r.company, r.period): (round(r.hours, 9), r.days) for r in effort.effort_periods(effort.with_company(daily, effort.owners(ev))).collect()}
    own: dict = {}
    for day, _, c, v, _ in events:
        own.setdefault(v.upper(), {}).setdefault(c, []).append(day)
    kept, want = [], {}
    for code, ts, year, season in pings:
        if code and ts and ts.year == year and effort_season(ts.date()) == f"{season} {year}":
            kept.append((f"TASA {code[1:]}" if code[0] == "t" else code.replace("\u00a0", " ").strip().upper(), ts.date(), f"{season} {year}"))
    covered = {s: {d for _, d, t in kept if t == s} for _, _, s in kept}
    for v, day, season in kept:
        if len(covered[season]) >= 30 and v in own:
            away = lambda days: max((min(days) - day).days, (day - max(days)).days, 0)
            c = min(own[v], key=lambda c: (away(own[v][c]), -len(own[v][c]), c))
            iso = day.isocalendar()
            for level, period in (("day", str(day)), ("week", f"{iso[0]}-W{iso[1]:02}"), ("month", f"{day:%Y-%m}"), ("season", season)):
                n, days = want.get((level, c, period), (0, set()))
                want[level, c, period] = (n + 1, days | {day})
    assert hours == {k: (round(n * 0.15, 9), len(days)) for k, (n, days) in want.items()}
    assert not any(p.startswith("1998") for _, _, p in hours) and {p for level, _, p in hours if level == "season"} == {"1ra 1999", "2da 1999"}
    r = effort.match_rate(ev, daily).first()
    assert (r.vessels, r.unmatched) == (12, effort.unmatched_vessels(ev, daily).count()) and r.rate == 1 - r.unmatched / 12


def effort_season(day):
    doy = day.timetuple().tm_yday
    return f"1ra {day.year}" if 91 <= doy <= 212 else f"2da {day.year}" if 305 <= doy <= 365 else None


def test_several_terms_as_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(7)
    rows = [("g", a := rng.gauss(5, 2), b := rng.gauss(0, 1) + 0.5 * a, c := rng.random(), 3 * a - b + rng.gauss(0, 2)) for _ in range(200)]
    rows += [("flat", 1.0, float(i), 0.5, float(i)) for i in range(20)] + [("few", 1.0, 2.0, 3.0, 4.0)] + [("g", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    got = {(r.g, r.term): r for r in regress.ols_many(df, ["g"], "y", ["a", "b", "c"]).collect()}
    assert {g for g, _ in got} == {"g"}
    one = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df.filter("g = 'g' and a is not null"))
    m = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(one)
    for i, t in enumerate("abc"):
        r = got["g", t]
        assert (r.coef, r.se, r.p, r.r2) == pytest.approx((m.coefficients[i], m.summary.coefficientStandardErrors[i], m.summary.pValues[i], m.summary.r2), abs=1e-9)


def test_slugs(spark):
    names = {"X S A C": "x_sac", "X S.A.A.": "x_saa", "_A B": "a_b", " Pesca  Uno ": "pesca__uno"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", text.slug(F.col("n")).alias("s")).collect()} == names


def test_every_fine_cell_goes_to_its_nearest_coarse_cell(spark):
    coarse = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (1, 0.0, 1.0, 20.0), (2, 0.0, 0.0, None), (3, 0.0, 0.0, 5.0)], "time int, lat double, lon double, value double")
    fine = spark.createDataFrame([(1, 0.1, 0.1, 9.0), (1, 0.2, 0.4, 8.0), (1, 0.1, 0.9, 25.0), (1, 0.0, 0.2, None), (2, 0.1, 0.1, 1.0), (4, 0.1, 0.1, 1.0)], "time int, lat double, lon double, value double")
    pairs = match.colocate(coarse, fine)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 0.0, 0.0, 10.0, 8.0), (1, 0.0, 0.0, 10.0, 9.0), (1, 0.0, 1.0, 20.0, 25.0)]
    assert [(r.lon, r.n, r.bias) for r in match.cell_quality(pairs, 2).collect()] == [(0.0, 2, 1.5)]


def test_square_and_folded_corridor(spark):
    square = spark.createDataFrame([("s", -80.0, -10.0, -80.0, -8.0), ("s", -80.0, -8.0, -78.0, -8.0), ("s", -78.0, -8.0, -78.0, -10.0), ("s", -78.0, -10.0, -80.0, -10.0)], "region string, x1 double, y1 double, x2 double, y2 double")
    ext = spark.createDataFrame([("s", -10.0, -8.0)], "region string, south double, north double")
    cells = spark.createDataFrame([(-9.0, -79.0), (-9.0, -81.0), (-7.5, -79.0)], "lat double, lon double")
    assert [(r.lat, r.lon) for r in corridor.members(cells, square, ext).collect()] == [(-9.0, -79.0)]


def test_draws_do_not_depend_on_partitions(spark):
    a = scenario.draws(spark, 500).orderBy("sim_id", "tipo").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = scenario.draws(spark, 500).repartition(5).orderBy("sim_id", "tipo").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    z = [r.z for r in scenario.draws(spark, 4000).collect()]
    assert abs(sum(z) / len(z)) < 0.03 and 0.95 < math.sqrt(sum(x * x for x in z) / len(z)) < 1.05


def test_exceedance(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((30.0, 10.0, 20.0))], "k string, i int, v double")
    assert [r.ep for r in scenario.exceedance(df, ["k"], "v", "i").orderBy("v").collect()] == [0.75, 0.5, 0.25]


def test_climate_lines(spark):
    lines = spark.createDataFrame([("  SEAS YR TOTAL ANOM",), (" DJF 1950 24.72 -1.53",), ("short 1",), ("",)], "value string")
    assert [tuple(r) for r in climate_index(lines).collect()] == [("DJF", 1950, -1.53)]


def test_refreshed_climatology(spark, tmp_path):
    rng, path = random.Random(5), f"file://{tmp_path}/clim"

    def year(y, seed):
        r = random.Random(seed)
        return [(date(y, 1, 1) + timedelta(days=i), float(i % 2), 0.5, None if r.random() < 0.2 else r.random()) for i in range(0, 360, 9) for _ in range(2)]

    def of(rows):
        rng.shuffle(rows)
        return spark.createDataFrame(rows, "time date, lat double, lon double, value double").repartition(3)

    def means(rows):
        sums = {}
        for t, lat, lon, v in rows:
            sums.setdefault((t.timetuple().tm_yday, lat, lon), []).extend([] if v is None else [v])
        return {k: np.mean(v) if v else None for k, v in sums.items()}

    def stored():
        return {(r.doy, r.lat, r.lon): r.clim for r in climate.climatology(spark, path).collect()}

    a, b, c = year(2001, 1), year(2002, 2), year(2003, 3)
    assert climate.refresh(of(a + b), path) == [2001, 2002]
    assert climate.refresh(of(a + b), path) == []  # the order of rows doesn't matter
    changed = year(2002, 4)
    assert climate.refresh(of(a + changed + c), path) == [2002, 2003]
    assert stored() == pytest.approx(means(a + changed + c))
    assert climate.refresh(of(c), path) == [] and stored() == pytest.approx(means(a + changed + c))
    assert climate.refresh(of(c), path, rebuild=True) == [2003] and stored() == pytest.approx(means(c))
    empty = f"file://{tmp_path}/none"
    assert climate.refresh(of([]), empty) == [] and climate.climatology(spark, empty).count() == 0
    assert climate.refresh(of(a), empty) == [2001]


def test_correlations_of_bands(spark):
    r = random.Random(3)
    rows = [(f"m{m:02}", b, None if m == 4 and b == -8 else r.random()) for m in range(14) for b in (-9, -8, -7, -6) if not (m == 9 and b == -6)]
    got = {(x.band_a, x.band_b): x.r for x in grid.band_correlations(spark.createDataFrame(rows, "month string, band int, v double")).collect()}
    whole = [m for m in range(14) if m not in (4, 9)]
    v = {b: [next(x for mm, bb, x in rows if mm == f"m{m:02}" and bb == b) for m in whole] for b in (-9, -8, -7, -6)}
    assert got == pytest.approx({(a, b): np.corrcoef(v[a], v[b])[0, 1] for a in v for b in v if a < b})
    never = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 3, 4.0)]  # no month has all three
    assert grid.band_correlations(spark.createDataFrame(never, "month string, band int, v double")).count() == 0


def test_interpolation_by_merging(spark):
    r = random.Random(8)
    curves = {k: sorted((round(r.uniform(0.05, 0.9), 3), r.random()) for _ in range(n)) for k, n in (("a", 40), ("b", 3), ("c", 1))}
    curves["a"] = sorted(dict(curves["a"]).items())
    curves["b"].append((0.5, 7.0))  # at a point of the grid
    curves["b"].sort()
    df = spark.createDataFrame([(k, e, v) for k, c in curves.items() for e, v in c], "k string, ep double, v double")
    out = scenario.interpolated(df, ["k"], "v", 0.0, 1.0, 101)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("Exchange hash") == 1
    got = {(x.k, x.grid_id): x.v for x in out.collect()}
    assert got == pytest.approx({(k, i): np.interp(i / 100, [e for e, _ in c], [v for _, v in c]) for k, c in curves.items() for i in range(101)})


def test_ladder_of_levels_reads_once(spark):
    rows = [("r", "c", date(2020, 12, 30) + timedelta(days=i % 9), None if i % 5 == 0 else "s", float(i), i / 2) for i in range(40)]
    df = spark.createDataFrame(rows, "region string, company string, event_date date, season string, catch_tm double, x double")
    out = regress.levels(df, "x")
    got = {}
    for g in out.collect():
        got.setdefault(g.level, []).append((g.period, g.catch_tm, g.x))
    want = {"event": lambda r, i: i, "day": lambda r, i: str(r[2]), "week": lambda r, i: "{}-W{:02}".format(*r[2].isocalendar()[:2]), "month": lambda r, i: str(r[2])[:7], "season": lambda r, i: r[3]}
    for level, key in want.items():
        groups = {}
        for i, row in enumerate(rows):
            if key(row, i) is not None:
                groups.setdefault(key(row, i), []).append(row)
        expect = [(None if level == "event" else k, sum(g[4] for g in v), np.mean([g[5] for g in v])) for k, v in groups.items()]
        assert sorted(got[level], key=str) == sorted([(p, pytest.approx(t), pytest.approx(x)) for p, t, x in expect], key=lambda e: str((e[0], e[1].expected, float(e[2].expected))))
    assert out._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 1


def test_enrichment_with_absent_variables(spark):
    points = spark.createDataFrame([(date(2019, 1, 2), 1.0, 1.0), (date(2020, 1, 2), 1.0, 1.0), (date(2021, 1, 2), 1.0, 1.0)], "event_date date, lat double, lon double")
    source = spark.createDataFrame([(date(2019, 1, 1), 1.0, 1.0, 5.0, 1.0), (date(2020, 1, 1), 1.0, 1.0, 6.0, None), (date(2021, 1, 1), 1.0, 1.0, None, 3.0)], "time date, lat double, lon double, temp double, chl double")
    out = match.enrich(points, {("temp", "chl", "never"): source, ("gone",): source.select("time", "lat", "lon")}, ["temp"], ("temp", 1.0, "ref"))
    assert sorted((r.year, r.temp, r.chl, r.never, r.gone, r.ref) for r in out.collect()) == [(2019, 5.0, 1.0, None, None, 4.0), (2020, 6.0, None, None, None, 5.0)]
    assert match.enrich(points, {("temp",): source, ("gone",): source}, ["gone"]).count() == 0


def test_caps_of_corridors(spark):
    bands = spark.createDataFrame([("n", -9, -80.0, -79.0), ("n", -8, -81.0, -79.5)], "region string, band int, west double, east double")
    ext = spark.createDataFrame([("n", -8.9, -7.2)], "region string, south double, north double")
    regions = spark.createDataFrame([("n", -11.0, None)], "region string, lat_min double, lat_max double")
    ends = lambda caps: {y for r in corridor.edges(bands, caps).collect() for y in (r.y1, r.y2)} - {-8.5, -7.5}
    assert ends(ext) == {-8.9, -7.2}
    assert ends(corridor.caps_at_bounds(regions, ext)) == {-11.0, -7.2}
    assert ends(corridor.caps_at_bands(bands)) == {-9.0, -7.0}


def test_company_report(spark):
    both = spark.createDataFrame([("n", 2019, 0.0, 0.5), ("n", 2020, 2.0, 2.0), ("s", 2020, 0.0, 0.0)], "region string, year int, t1 double, t2 double")
    levels = spark.createDataFrame([("n", "p90", 0.0, 1.0), ("s", "p90", 0.0, 1.0)], "region string, scenario string, entry double, exit double")
    catches = spark.createDataFrame([("A", "n", 10.0), ("A", "s", 30.0), ("B", "n", 4.0)], "company string, region string, mean_tm double")
    got = {(r.company, r.region): (r.years, r.years_paid, r.insured, r.aal, r.rate) for r in report.company_report(both, levels, catches, 2.0).collect()}
    assert got == {("A", "n"): (2, 2, 20.0, 15.0, 0.75), ("A", "s"): (1, 0, 60.0, 0.0, 0.0), ("A", "Total"): (None, None, 80.0, 15.0, 0.1875), ("B", "n"): (2, 2, 8.0, 6.0, 0.75), ("B", "Total"): (None, None, 8.0, 6.0, 0.75)}
