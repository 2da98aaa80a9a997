"""Grouped least squares, correlations and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import Z975, cumulative_counts, normal_density, t_p_value, t_quantile_975
from ..sources.files import written


def ols(df: DataFrame, keys: list[str], y: str, x: str, least: int = 10) -> DataFrame:
    """keys, n, beta, intercept, se, r2, p, ci_lower, ci_upper (exact t) and the normal bounds n_lower, n_upper.

    One aggregation, however many groups; groups of fewer than least pairs have nulls.
    """
    a, b = F.col(y), F.col(x)
    agg = df.groupBy(*keys).agg(F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("beta"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_sxx(a, b).alias("sxx"), F.regr_syy(a, b).alias("syy"), F.regr_sxy(a, b).alias("sxy"))
    nu = F.col("n") - 2
    enough = F.col("n") >= least
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("beta") * F.col("sxy")) / F.nullif(nu, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0)))
    out = agg.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("beta", "intercept", "r2")], F.when(enough, se).alias("se"))
    t = F.col("beta") / F.nullif(F.col("se"), F.lit(0.0))
    nu = F.when(F.col("se").isNotNull(), F.col("n") - 2)
    q = t_quantile_975(nu)
    b, s = F.col("beta"), F.col("se")
    return out.withColumns({"p": t_p_value(t, nu), "ci_lower": b - q * s, "ci_upper": b + q * s, "n_lower": b - Z975_ROUND * s, "n_upper": b + Z975_ROUND * s})


Z975_ROUND = round(Z975, 2)


def conservative(beta: Column, se: Column, inverted: bool = False) -> Column:
    """beta moved by 1.96 standard errors: up, or towards zero where the index pays when it falls."""
    return beta - F.sign(beta) * Z975_ROUND * se if inverted else beta + Z975_ROUND * se


def levels(df: DataFrame, x: str) -> DataFrame:
    """level, region, company, period, catch_tm, x at the levels event, day, week, month and season, for the ladder.

    The keys of all levels are one array, so df is read and shuffled once; catches are summed and x averaged.  An event is a
    level of its own row, which has no period.
    """
    from ..functions.seasons import iso_week

    day = F.col("event_date")
    keys = {"event": F.col("_id"), "day": day.cast("string"), "week": iso_week(day), "month": F.date_format(day, "yyyy-MM"), "season": F.col("season")}
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), key.alias("period")) for level, key in keys.items()])).alias("k")
    own = df.withColumn("_id", F.monotonically_increasing_id().cast("string"))
    rows = own.select("region", "company", "catch_tm", x, each).select("region", "company", "catch_tm", x, "k.*").filter("period is not null")
    per = rows.groupBy("level", "region", "company", "period").agg(F.sum("catch_tm").alias("catch_tm"), F.avg(x).alias(x))
    return per.select("level", "region", "company", F.when(F.col("level") != "event", F.col("period")).alias("period"), "catch_tm", x)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho, p: Pearson's r of average ranks, p by t with n - 2 degrees of freedom.

    Ranks come from counts per distinct value, dealt out by ranges, so no group's values are sorted in one task.
    """
    pairs = written(df.dropna(subset=[x, y]).select(*keys, x, y), "pairs")

    def ranks(c: str, name: str) -> DataFrame:
        return cumulative_counts(pairs, keys, c).select(*keys, c, (F.col("below") + (F.col("c") + 1) / 2).alias(name))

    ranked = pairs.join(ranks(x, "_x"), [*keys, x]).join(ranks(y, "_y"), [*keys, y])
    r = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return r.withColumn("p", t_p_value(t, F.col("n") - 2))


def normal_fit(seasons: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """keys, n, mu, sd (of the sample) and the quantiles p90, p95, p99 of the fitted normal."""
    fit = seasons.groupBy(*keys).agg(F.count("idx").alias("n"), F.avg("idx").alias("mu"), F.stddev_samp("idx").alias("sd")).filter(F.col("n") >= least)
    z = {"p90": 1.2815515655446004, "p95": 1.6448536269514722, "p99": 2.3263478740408408}
    return fit.withColumns({k: F.col("mu") + v * F.col("sd") for k, v in z.items()})


def normal_curve(fit: DataFrame, keys: list[str], lo: str, hi: str, points: int = 100) -> DataFrame:
    """keys, i, at, density: the fitted normal (mu, sd) on points from lo to hi; groups without a deviation have none."""
    at = fit.filter("sd > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = at.withColumn("at", F.col(lo) + (F.col(hi) - F.col(lo)) * F.col("i") / (points - 1))
    return at.select(*keys, "i", "at", normal_density(F.col("at"), F.col("mu"), F.col("sd")).alias("density"))


def quadratic(df: DataFrame, keys: list[str], y: str, x: str, least: int = 10) -> DataFrame:
    """keys, n, c0, c1, c2, r2 of y = c0 + c1 x + c2 x^2, by the moments of x about its mean.

    No row for fewer pairs, or where x takes two values only (to rounding), which leaves the curve open.
    """
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull())
    mean = both.groupBy(*keys).agg(F.avg(b).alias("_m"))
    z = F.col("_z")
    rows = both.join(F.broadcast(mean), keys).withColumn("_z", b - F.col("_m"))
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"), *[F.sum(F.pow(z, F.lit(k))).alias(f"_s{k}") for k in (1, 2, 3, 4)], F.sum(a).alias("_y0"), F.sum(a * z).alias("_y1"), F.sum(a * z * z).alias("_y2"), F.var_pop(a).alias("_v")).filter(F.col("n") >= least)
    n, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("n", "_s1", "_s2", "_s3", "_s4", "_y0", "_y1", "_y2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    s = s.filter(det > 1e-9 * n * s2 * (s4 - s2 * s2 / n))
    d0 = y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)
    d1 = n * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - y1 * s2)
    d2 = n * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)
    own = s.withColumns({"_a": d0 / F.nullif(det, F.lit(0.0)), "_b": d1 / F.nullif(det, F.lit(0.0)), "c2": d2 / F.nullif(det, F.lit(0.0))})
    fitted = F.col("_a") * y0 + F.col("_b") * y1 + F.col("c2") * y2 - y0 * y0 / n
    m = F.col("_m")
    return own.select(*keys, "n", (F.col("_a") - F.col("_b") * m + F.col("c2") * m * m).alias("c0"), (F.col("_b") - 2 * F.col("c2") * m).alias("c1"), "c2", (fitted / F.nullif(F.col("_v") * n, F.lit(0.0))).alias("r2"))


def ols_many(df: DataFrame, keys: list[str], y: str, xs: list[str], least: int = 10) -> DataFrame:
    """keys, term (one of xs), n, coef, se, p, r2 of y on all of xs and a constant, by group.

    One aggregation of the co-moments of complete rows, then elimination in columns.  No rows for groups of fewer than
    least rows, without degrees of freedom, or where a term is constant or follows from the others (to rounding).
    """
    named = {c: F.col(c).cast("double") for c in [y, *xs]}
    rows = df.select(*keys, *[v.alias(f"_v{i}") for i, v in enumerate(named.values())]).dropna(subset=[f"_v{i}" for i in range(len(named))])
    m = len(xs)
    moments = [F.covar_pop(f"_v{i}", f"_v{j}").alias(f"_s{i}_{j}") for i in range(m + 1) for j in range(i, m + 1)]
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *moments).filter((F.col("n") >= least) & (F.col("n") > m + 1))
    cell = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    # The matrix of the terms beside the unit matrix and the right-hand side, made into (unit, inverse, coefficients).
    width = 2 * m + 1
    start = {(i, j): cell(i + 1, j + 1) if j < m else F.lit(float(j - m == i)) if j < 2 * m else cell(0, i + 1) for i in range(m) for j in range(width)}
    s = s.select(*keys, "n", F.col("_s0_0").alias("_yy"), *[cell(0, i + 1).alias(f"_y{i}") for i in range(m)], *[cell(i + 1, i + 1).alias(f"_d{i}") for i in range(m)], *[v.alias(f"_m{i}_{j}") for (i, j), v in start.items()])
    at = lambda i, j: F.col(f"_m{i}_{j}")
    for k in range(m):
        s = s.filter(at(k, k) > 1e-10 * F.col(f"_d{k}"))
        s = s.withColumns({f"_m{k}_{j}": at(k, j) / at(k, k) for j in range(width)})
        s = s.withColumns({f"_m{i}_{j}": at(i, j) - at(i, k) * at(k, j) for i in range(m) if i != k for j in range(width)})
    fitted = sum((at(i, 2 * m) * F.col(f"_y{i}") for i in range(m)), F.lit(0.0))
    s = s.withColumn("_fit", fitted).withColumn("_var", F.greatest(F.lit(0.0), F.col("_yy") - F.col("_fit")) / (F.col("n") - m - 1))
    terms = F.explode(F.array(*[F.struct(F.lit(x).alias("term"), at(i, 2 * m).alias("coef"), F.sqrt(F.col("_var") * at(i, m + i)).alias("se")) for i, x in enumerate(xs)]))
    out = s.select(*keys, "n", (F.col("_fit") / F.nullif(F.col("_yy"), F.lit(0.0))).alias("r2"), terms.alias("_t")).select(*keys, "_t.term", "n", "_t.coef", "_t.se", "r2")
    return out.withColumn("p", t_p_value(F.col("coef") / F.nullif(F.col("se"), F.lit(0.0)), F.col("n") - m - 1)).select(*keys, "term", "n", "coef", "se", "p", "r2")


def density_curve(df: DataFrame, keys: list[str], x: str, points: int = 300, factor: float | None = None) -> DataFrame:
    """keys, x, density: a Gaussian kernel estimate on points from the least to the largest value.

    The band is factor (n^(-1/5) if not given) times the sample's deviation.  The samples are seasonal, so few a group.
    """
    stat = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.stddev_samp(x).alias("_sd"))
    h = F.col("_sd") * (F.pow(F.col("_n"), F.lit(-0.2)) if factor is None else F.lit(factor))
    at = stat.withColumn("_h", h).select(*keys, "_h", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = at.withColumn("at", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1))
    return at.join(df.select(*keys, x), keys).groupBy(*keys, "i", "at").agg(F.avg(normal_density(F.col("at"), F.col(x), F.col("_h"))).alias("density"))
