"""Autoregressions whose order the data choose (M1, M17), and seasonal ones with both polynomials (M2).

* ``arima``: AR(p) on the d-th difference, p in 0..12 and d in 0..2, by the lowest AICc. The autocovariances
  of every lag and difference come from one aggregate per district; Levinson-Durbin runs over
  them as an ``aggregate()`` over arrays, all orders in one sweep.
* ``sarima``: z = y - y[-12] on its lags 1, 12 and 13 and a constant, which are the lags of a product
  of a monthly and a yearly polynomial. The Gram matrix is an aggregate, and the normal equations
  are solved by a Cholesky factor written as array expressions.

Both forecast by recursion inside ``aggregate()`` over the horizon. A district is one row after
a single exchange: no library, no Python, no join. Frames are those of
``forecast.backtest_frame`` and ``forecast.horizon_frame``.

DECISION (the original names no candidates): all differences are fitted on the rows t > ``MAX_D``, so
that the likelihoods are of the same points; ties go to the lower d, then the lower p. A series
whose difference is constant is forecast by that constant. A regressor that others span (or that is
zero throughout) gets the coefficient 0, so a series without rows for the seasonal fit repeats its last season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.operators.forecast import backtest_frame, best_model_expr, horizon_frame
from wardstat.session import materialize

MAX_P, MAX_D = 12, 2
PERIOD = 12
MODELS = ("arima", "sarima")
#: an innovation variance, or a pivot, below this part of the whole is zero
_NONE = 1e-9
_EXACT = -1e308
_DOUBLES = "array<double>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _none() -> Column:
    return F.array().cast(_DOUBLES)


def aicc(variance: Column, p: Column, n: Column) -> Column:
    """Small-sample information criterion of an AR(p) with mean and variance."""
    return F.when(variance > 0, n * F.log(variance) + 2.0 * (p + 2) * n / (n - p - 3)).otherwise(F.lit(_EXACT))


def levinson(r: Column, n: Column, max_p: int = MAX_P) -> Column:
    """The AR fit of lowest AICc from autocovariances ``r`` (lag 0 first) of ``n`` points:
    struct ``aicc, p, phi, variance``. Order k's coefficients come from those of order k - 1."""

    def fit(p, phi, variance):
        return F.struct(aicc(variance, p, n).alias("aicc"), p.cast("int").alias("p"), phi.alias("phi"), variance.alias("variance"))

    def state(phi, variance, best):
        return F.struct(phi.alias("phi"), variance.alias("variance"), best.alias("best"))

    r0 = F.get(r, F.lit(0))

    def step(s, k):
        known = F.reverse(F.slice(r, F.lit(2), k - 1))  # lags k-1 .. 1
        alive = (s["variance"] > _NONE * r0) & (n - k - 3 > 0)
        kappa = F.when(alive, (F.get(r, k) - _dot(s["phi"], known)) / s["variance"]).otherwise(F.lit(0.0))

        def deeper(kappa):
            phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - kappa * b), F.array(kappa))
            variance = s["variance"] * (1 - kappa * kappa)
            return _let(fit(k, phi, variance), lambda f: state(phi, variance, F.when(alive & (f["aicc"] < s["best"]["aicc"]), f).otherwise(s["best"])))

        return _let(kappa, deeper)

    start = state(_none(), r0, fit(F.lit(0), _none(), r0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max_p)), start, step, lambda s: s["best"])


def cholesky_solve(gram: Column, rhs: Column, m: int) -> Column:
    """Solution of ``gram x = rhs`` (m x m, positive semidefinite) by a Cholesky factor, as an array."""
    index = F.sequence(F.lit(0), F.lit(m - 1))

    def entry(done, row, j, i):
        """Row j's entry i, from the rows above and the row's entries before it."""
        above = F.when(i == j, row).otherwise(F.slice(F.get(done, i), F.lit(1), i))
        a = F.get(F.get(gram, j), i)
        rest = a - _dot(above, row)
        pivot = F.when(i == j, F.lit(0.0)).otherwise(F.get(F.get(done, i), i))
        on = F.when(rest > _NONE * a, F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(F.lit(0.0))
        off = F.when(pivot > 0, rest / pivot).otherwise(F.lit(0.0))
        return F.when(i == j, on).otherwise(off)

    def row(done, j):
        return F.aggregate(F.sequence(F.lit(0), j), _none(), lambda row, i: F.concat(row, F.array(entry(done, row, j, i))))

    lower = F.aggregate(index, F.array().cast(f"array<{_DOUBLES}>"), lambda done, j: F.concat(done, F.array(row(done, j))))

    def solve(low):
        def down(x, j):
            pivot = F.get(F.get(low, j), j)
            rest = F.get(rhs, j) - _dot(F.slice(F.get(low, j), F.lit(1), j), x)
            return F.concat(x, F.array(F.when(pivot > 0, rest / pivot).otherwise(F.lit(0.0))))

        half = F.aggregate(index, _none(), down)

        def up(half):
            def back(x, j):  # x holds the entries after j
                column = F.transform(F.slice(low, j + 2, F.lit(m - 1) - j), lambda later: F.get(later, j))
                pivot = F.get(F.get(low, j), j)
                rest = F.get(half, j) - _dot(column, x)
                return F.concat(F.array(F.when(pivot > 0, rest / pivot).otherwise(F.lit(0.0))), x)

            return F.aggregate(F.reverse(index), _none(), back)

        return _let(half, up)

    return _let(lower, solve)


def _w() -> Window:
    return Window.partitionBy("district").orderBy("t")


def _ar_columns(frame: DataFrame) -> DataFrame:
    """Differences ``w0 .. w2``, centred on the fitted rows as ``e0 .. e2``, and their lags."""
    x = frame.withColumn("w0", F.col("y").cast("double"))
    for d in range(1, MAX_D + 1):
        x = x.withColumn(f"w{d}", F.col(f"w{d - 1}") - F.lag(f"w{d - 1}").over(_w()))
    own = (F.col("t") > MAX_D) & (F.col("t") <= F.col("t_fit"))
    whole = Window.partitionBy("district")
    x = x.withColumns({f"mean{d}": F.avg(F.when(own, F.col(f"w{d}"))).over(whole) for d in range(MAX_D + 1)})
    x = x.withColumns({f"e{d}": F.when(own, F.col(f"w{d}") - F.col(f"mean{d}")) for d in range(MAX_D + 1)})
    return x.withColumns({f"e{d}_{k}": F.lag(f"e{d}", k).over(_w()) for d in range(MAX_D + 1) for k in range(1, MAX_P + 1)})


def _seasonal_columns(x: DataFrame, period: int) -> DataFrame:
    x = x.withColumn("z", F.col("y") - F.lag("y", period).over(_w()))
    return x.withColumns({"z1": F.lag("z").over(_w()), "zs": F.lag("z", period).over(_w()), "zs1": F.lag("z", period + 1).over(_w())})


def _seasonal_fit(period: int) -> Column:
    """Coefficients of ``z1, zs, zs1, 1`` as an aggregate expression."""
    parts = [F.col("z1"), F.col("zs"), F.col("zs1"), F.lit(1.0)]
    ok = (F.col("t") <= F.col("t_fit")) & F.col("zs1").isNotNull()
    total = lambda e: F.coalesce(F.sum(F.when(ok, e)), F.lit(0.0))
    gram = F.array(*[F.array(*[total(a * b) for b in parts]) for a in parts])
    return cholesky_solve(gram, F.array(*[total(a * F.col("z")) for a in parts]), len(parts))


def fits(frame: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row per district: ``ar`` (``d, p, phi, aicc, variance, mean, recent``), ``seasonal``
    (coefficients of z's lags 1, 12, 13 and the constant), the last season, and the rest's ``actual`` values."""
    x = _seasonal_columns(_ar_columns(frame), period)
    own = (F.col("t") > MAX_D) & (F.col("t") <= F.col("t_fit"))
    n = F.count(F.when(own, F.lit(1))).cast("double")
    at_end = lambda c: F.max(F.when(F.col("t") == F.col("t_fit"), c))
    ordered = lambda where, c: F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("t", c)))), lambda s: s[c])
    columns = {}
    for d in range(MAX_D + 1):
        lags = [F.col(f"e{d}"), *[F.col(f"e{d}_{k}") for k in range(1, MAX_P + 1)]]
        columns[f"r{d}"] = F.array(*[F.coalesce(F.sum(F.col(f"e{d}") * lag), F.lit(0.0)) / n for lag in lags])
        columns[f"recent{d}"] = F.max_by(F.array(*[F.coalesce(lag, F.lit(0.0)) for lag in lags[:MAX_P]]), F.when(own, F.col("t")))
        columns[f"mean{d}"] = F.max(f"mean{d}")
    in_fit = F.col("t") <= F.col("t_fit")
    per = x.groupBy("district").agg(
        *[c.alias(name) for name, c in columns.items()], n.alias("n_fit"), _seasonal_fit(period).alias("seasonal"),
        ordered(in_fit & (F.col("t") > F.col("t_fit") - period), "y").alias("last_y"),  # one season
        ordered(in_fit & (F.col("t") > F.col("t_fit") - period - 1) & F.col("z").isNotNull(), "z").alias("last_z"),
        ordered(F.col("t") > F.col("t_fit"), "y").alias("actual"),  # the held-out months of one district
        at_end(F.col("y")).alias("y_end"), at_end(F.col("w1")).alias("dy_end"), at_end(F.col("month")).alias("m_end"),
        F.max("t_fit").cast("int").alias("t_fit"), F.max("h_steps").cast("int").alias("h_steps"),
    )

    def candidate(d):
        return _let(levinson(F.col(f"r{d}"), F.col("n_fit")), lambda f: F.struct(
            f["aicc"].alias("aicc"), F.lit(d).alias("d"), f["p"].alias("p"), f["phi"].alias("phi"), f["variance"].alias("variance"),
            F.col(f"mean{d}").alias("mean"), F.col(f"recent{d}").alias("recent"),
        ))

    best = F.array_min(F.array(*[candidate(d) for d in range(MAX_D + 1)]))
    kept = ("district", "seasonal", "last_y", "last_z", "actual", "y_end", "dy_end", "m_end", "t_fit", "h_steps")
    return per.where(F.col("n_fit") > 4).select(*kept, best.alias("ar"))


def _ar_path() -> Column:
    """Forecasts of the AR fit, 1 .. h_steps."""
    ar = F.col("ar")
    start = F.struct(
        F.slice(ar["recent"], F.lit(1), ar["p"]).alias("recent"), F.col("y_end").cast("double").alias("y"),
        F.coalesce("dy_end", F.lit(0.0)).alias("dy"), _none().alias("path"),
    )

    def step(s, _):
        def after(e):
            w = ar["mean"] + e
            dy = F.when(ar["d"] == 2, s["dy"] + w).otherwise(w)
            y = F.when(ar["d"] == 0, w).otherwise(s["y"] + dy)
            recent = F.slice(F.concat(F.array(e), s["recent"]), F.lit(1), ar["p"])
            return F.struct(recent.alias("recent"), y.alias("y"), dy.alias("dy"), F.concat(s["path"], F.array(y)).alias("path"))

        return _let(_dot(ar["phi"], s["recent"]), after)

    return F.aggregate(F.sequence(F.lit(1), F.col("h_steps")), start, step, lambda s: s["path"])


def _seasonal_path(period: int) -> Column:
    """Forecasts of the seasonal fit; null without a whole season before the first."""
    def coefficient(i):
        return F.get("seasonal", F.lit(i))

    padded = F.concat(F.array_repeat(F.lit(0.0), F.lit(period + 1) - F.size("last_z")), F.col("last_z"))
    start = F.struct(padded.alias("z"), F.col("last_y").alias("y"), _none().alias("path"))

    def step(s, _):  # arrays end with the newest
        z = (
            coefficient(0) * F.element_at(s["z"], -1) + coefficient(1) * F.element_at(s["z"], -period)
            + coefficient(2) * F.element_at(s["z"], -period - 1) + coefficient(3)
        )

        def after(z):
            y = F.element_at(s["y"], -period) + z
            return F.struct(
                F.slice(F.concat(s["z"], F.array(z)), F.lit(2), F.lit(period + 1)).alias("z"),
                F.slice(F.concat(s["y"], F.array(y)), F.lit(2), F.lit(period)).alias("y"), F.concat(s["path"], F.array(y)).alias("path"),
            )

        return _let(z, after)

    path = F.aggregate(F.sequence(F.lit(1), F.col("h_steps")), start, step, lambda s: s["path"])
    return F.when(F.size("last_y") == period, path)


def paths(frame: DataFrame, period: int = PERIOD) -> DataFrame:
    """``fits`` with the forecasts ``arima`` and ``sarima`` as arrays of ``h_steps`` values."""
    fitted = fits(frame, period).where(F.col("h_steps") >= 1)
    return fitted.withColumns({"arima": _ar_path(), "sarima": _seasonal_path(period)})


def select_orders(series: DataFrame) -> DataFrame:
    """``district, d, p, aicc, variance, phi`` chosen on the training part of every eligible district."""
    return fits(backtest_frame(series)).select("district", "ar.d", "ar.p", "ar.aicc", "ar.variance", "ar.phi")


def forecast_orders(frame: DataFrame, models=MODELS) -> DataFrame:
    """Forecast rows ``district, model, k, t, month, yhat`` of the chosen models."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("path")) for m in models]))
    long = paths(frame).select("district", "t_fit", "m_end", rows.alias("m")).where("m.path is not null")
    long = long.select("district", "t_fit", "m_end", "m.model", F.posexplode("m.path").alias("i", "yhat"))
    k = (F.col("i") + 1).alias("k")
    return long.select("district", "model", k, (F.col("t_fit") + F.col("i") + 1).alias("t"), F.add_months("m_end", F.col("i") + 1).alias("month"), "yhat")


def _errors(model: str, of) -> Column:
    return _sum(F.zip_with(F.col("actual"), F.col(model), lambda a, f: of(a - f))) / F.size("actual")


def order_scores(frame: DataFrame, models=MODELS) -> DataFrame:
    """M5 (A18/A19) of the chosen models: ``district, model, mae, mse, n_test, rmse`` in one pass."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), _errors(m, F.abs).alias("mae"), _errors(m, lambda e: e * e).alias("mse"), F.size("actual").cast("long").alias("n_test")) for m in models
    ]))
    return paths(frame).select("district", rows).where(F.col("mae").isNotNull()).withColumn("rmse", F.sqrt("mse"))


def backtest_orders(series: DataFrame, models=MODELS) -> DataFrame:
    return order_scores(backtest_frame(series), models)


def forecast_table_orders(series: DataFrame, months_ahead: int = 6, models=MODELS) -> DataFrame:
    """M6 with the chosen models (clamped at zero, M4): best model by the hold-out, refitted on every month.

    The series is read by the hold-out and by the refit, so it is materialized; both sides of the join are
    one row per district and hashed on it already."""
    series = materialize(series)
    best = backtest_orders(series, models).groupBy("district").agg(best_model_expr().alias("best_model"))
    ahead = paths(horizon_frame(series, months_ahead)).join(best, "district", "left")
    step = F.posexplode(F.sequence(F.lit(1), F.col("h_steps"))).alias("i", "k")
    out = ahead.select("district", "m_end", "best_model", *models, step)
    value = {m: F.greatest(F.lit(0.0), F.get(m, F.col("i"))) for m in models}
    value = {m: F.when(F.col(m).isNotNull(), v) for m, v in value.items()}
    pick = F.coalesce(*[F.when(F.col("best_model") == m, value[m]) for m in models])
    month = F.add_months("m_end", F.col("k"))
    return out.select("district", "k", month.alias("month"), *[value[m].alias(m) for m in models], "best_model", pick.alias("best_value"), F.date_format(month, "yyyy-MM-dd").alias("date"))
