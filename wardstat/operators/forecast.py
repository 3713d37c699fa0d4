"""Forecasting on monthly series.

The columns are called ``arima``, ``sarima`` and ``lstm`` for contract parity
with the original payload, but hold:

* ``arima``  — M1, AR(1) on first differences, fitted per district in closed
  form (``regr_slope``/``regr_intercept``) and projected k steps in closed form;
* ``sarima`` — M2, AR(1) on 12-month differences, same primitives;
* ``lstm``   — M3, one pooled gradient-boosted-tree regressor over the last 12
  scaled months of every district, rolled forward inside one projection.

M1/M2 fit every district in one ``groupBy('district')`` aggregate (no Python
per series, no per-district loop); forecasts are generated by
``explode(sequence(1, H))`` per district. Input frames carry per-district
``t_fit`` (last fitted point) and ``h_steps`` (steps to produce). (Spark column
names are case-insensitive, so these must not be ``T``/``H`` next to ``t``.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.payload import map_of, selection_note
from wardstat.operators.series import eligible_series, lag_features, scale, split_series
from wardstat.operators.trees import Ensemble, node_table
from wardstat.session import materialize

_NEAR_ONE = 1e-9
#: training rows of a partition: how many there are depends on the rows alone, not on the session
FIT_ROWS = 20_000
_RANK = {m: i for i, m in enumerate(K.MODELS)}


def _w() -> Window:
    return Window.partitionBy("district").orderBy("t")


def guarded_fit(y, x, where=None, over: Window | None = None):
    """AR(1) coefficients ``(phi, c)`` of ``y = c + phi * x`` as aggregate expressions.

    A constant regressor has no slope (Spark gives NULL, DuckDB NaN): then
    ``phi = 0`` and ``c = mean(y)`` over the pairs. ``where`` keeps only the
    pairs of matching rows; ``over`` evaluates the aggregates over a window
    instead of a ``groupBy``."""
    y, x = F.col(y), F.col(x)
    if where is not None:
        y = F.when(where, y)  # a pair with a NULL side is skipped by every regr_* aggregate

    def agg(e):
        return e.over(over) if over is not None else e

    ok = agg(F.regr_sxx(y, x)) > 0
    phi = F.when(ok, agg(F.regr_slope(y, x))).otherwise(F.lit(0.0))
    c = F.when(ok, agg(F.regr_intercept(y, x))).otherwise(agg(F.avg(F.when(x.isNotNull(), y))))
    return phi, c


def ar_diff_yhat(k, phi, c, y_end, dy_end):
    """M1 (d = 1) k-step forecast in closed form, from columns."""
    near = F.abs(F.lit(1.0) - phi) < _NEAR_ONE
    mu = c / (F.lit(1.0) - phi)
    return F.when(near, y_end + k * dy_end + c * k * (k + 1) / 2.0).otherwise(
        y_end + mu * k + (dy_end - mu) * phi * (F.lit(1.0) - F.pow(phi, k)) / (F.lit(1.0) - phi)
    )


def ar_level_yhat(k, phi, c, y_end):
    """M1 (d = 0) k-step forecast in closed form, from columns."""
    near = F.abs(F.lit(1.0) - phi) < _NEAR_ONE
    mu = c / (F.lit(1.0) - phi)
    return F.when(near, y_end + c * k).otherwise(mu + F.pow(phi, k) * (y_end - mu))


def seasonal_yhat(k, phi, c, z_end, last_p, period: int = 12):
    """M2 k-step forecast in closed form, from columns (``last_p``: the last
    ``period`` fitted points as a sorted array of ``(t, y)``)."""
    near = F.abs(F.lit(1.0) - phi) < _NEAR_ONE
    mu = c / (F.lit(1.0) - phi)

    def z_at(m):
        return F.when(near, z_end + c * m).otherwise(mu + F.pow(phi, m) * (z_end - mu))

    j = F.ceil(k / float(period)).cast("int")
    base = F.element_at(last_p, k - j * period + period).getField("y")
    zsum = F.aggregate(F.sequence(F.lit(0), j - 1), F.lit(0.0), lambda acc, i: acc + z_at(k - i * period))
    return base + zsum


def _steps(fit: DataFrame) -> DataFrame:
    """One row per forecast step ``k = 1..H`` of every district."""
    st = fit.where(F.col("h_steps") >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("h_steps").cast("int"))))
    return st.withColumn("t_fit", F.col("t_fit").cast("int"))


def _fit_common():
    return [F.max("t_fit").alias("t_fit"), F.max("h_steps").alias("h_steps"), F.max_by("month", "t").alias("m_end")]


def _finish(steps: DataFrame, model: str, yhat) -> DataFrame:
    return steps.select(
        "district",
        F.lit(model).alias("model"),
        "k",
        (F.col("t_fit") + F.col("k")).alias("t"),
        F.add_months(F.col("m_end"), F.col("k")).alias("month"),
        yhat.alias("yhat"),
    )


def forecast_ar_diff(s: DataFrame, d: int = 1, model: str = "arima") -> DataFrame:
    """M1: AR(1) on the d-th difference (d in 0, 1); rows ``district, model, k, t, month, yhat``.

    d = 1: ``yhat(k) = y_T + mu k + (dy_T - mu) phi (1 - phi^k) / (1 - phi)``, ``mu = c / (1 - phi)``;
    when ``phi`` is 1: ``y_T + k dy_T + c k (k + 1) / 2``.
    d = 0: ``yhat(k) = mu + phi^k (y_T - mu)``; when ``phi`` is 1: ``y_T + c k``.
    """
    w = _w()
    x = s.withColumn("y1", F.lag("y").over(w)).withColumn("dy", F.col("y") - F.col("y1"))
    x = x.withColumn("dy1", F.lag("dy").over(w))
    fit_rows = x.where(F.col("t") <= F.col("t_fit"))
    if d == 1:
        phi, c = guarded_fit("dy", "dy1")
        fit = fit_rows.groupBy("district").agg(
            phi.alias("phi"), c.alias("c"), F.max_by("y", "t").alias("y_end"), F.max_by("dy", "t").alias("dy_end"), *_fit_common()
        )
    elif d == 0:
        phi, c = guarded_fit("y", "y1")
        fit = fit_rows.groupBy("district").agg(phi.alias("phi"), c.alias("c"), F.max_by("y", "t").alias("y_end"), *_fit_common())
    else:
        raise ValueError("d must be 0 or 1")
    st = _steps(fit)
    k, phi_c, c_c = F.col("k"), F.col("phi"), F.col("c")
    if d == 1:
        yhat = ar_diff_yhat(k, phi_c, c_c, F.col("y_end"), F.col("dy_end"))
    else:
        yhat = ar_level_yhat(k, phi_c, c_c, F.col("y_end"))
    return _finish(st, model, yhat)


def forecast_ar_auto_order(frame: DataFrame, frac: float = K.TRAIN_FRACTION, model: str = "arima") -> DataFrame:
    """M1 with M17's order choice in one pass; rows ``district, d, model, k, t, month, yhat``.

    The selection fits (first ``frac`` of the fitted points) are window aggregates
    and score the rest of the fitted points in place; one ``groupBy('district')``
    then averages both one-step errors, fits both orders on every fitted point and
    keeps d = 1 only when it is strictly better. Same result as ``select_order``
    followed by ``forecast_ar_selected``, on one exchange and without a join."""
    w, wp = _w(), Window.partitionBy("district")
    x = frame.withColumn("y1", F.lag("y").over(w)).withColumn("dy", F.col("y") - F.col("y1"))
    x = x.withColumns({"dy1": F.lag("dy").over(w), "t_sel": F.floor(F.col("t_fit") * frac).cast("int")})
    sel = F.col("t") <= F.col("t_sel")
    p0s, c0s = guarded_fit("y", "y1", sel, wp)
    p1s, c1s = guarded_fit("dy", "dy1", sel, wp)
    x = x.withColumns({"_p0s": p0s, "_c0s": c0s, "_p1s": p1s, "_c1s": c1s})
    ev = (F.col("t") > F.col("t_sel")) & (F.col("t") <= F.col("t_fit"))
    e0 = F.when(ev, F.abs(F.col("y") - (F.col("_c0s") + F.col("_p0s") * F.col("y1"))))
    e1 = F.when(ev, F.abs(F.col("y") - (F.col("y1") + F.col("_c1s") + F.col("_p1s") * F.col("dy1"))))
    fit = F.col("t") <= F.col("t_fit")
    phi0, c0 = guarded_fit("y", "y1", fit)
    phi1, c1 = guarded_fit("dy", "dy1", fit)
    at = F.col("t") == F.col("t_fit")
    g = x.groupBy("district").agg(
        F.avg(e0).alias("mae_d0"), F.avg(e1).alias("mae_d1"), F.count(F.when(ev, F.lit(1))).alias("n_ev"),
        phi0.alias("phi0"), c0.alias("c0"), phi1.alias("phi1"), c1.alias("c1"),
        F.max(F.when(at, F.col("y"))).alias("y_end"), F.max(F.when(at, F.col("dy"))).alias("dy_end"),
        F.max("t_fit").alias("t_fit"), F.max("h_steps").alias("h_steps"), F.max(F.when(at, F.col("month"))).alias("m_end"),
    )
    g = g.where(F.col("n_ev") > 0).withColumn("d", F.when(F.col("mae_d1") < F.col("mae_d0"), 1).otherwise(0))
    st = _steps(g)
    k = F.col("k")
    yhat = F.when(F.col("d") == 1, ar_diff_yhat(k, F.col("phi1"), F.col("c1"), F.col("y_end"), F.col("dy_end"))).otherwise(
        ar_level_yhat(k, F.col("phi0"), F.col("c0"), F.col("y_end"))
    )
    return st.select(
        "district", "d", F.lit(model).alias("model"), "k", (F.col("t_fit") + k).alias("t"),
        F.add_months(F.col("m_end"), k).alias("month"), yhat.alias("yhat"),
    )

def forecast_seasonal(s: DataFrame, period: int = 12, model: str = "sarima") -> DataFrame:
    """M2: AR(1) on ``z = y - y[-period]``; ``z(k) = mu + phi^k (z_end - mu)`` and, with
    ``j = ceil(k / period)``, ``yhat(k) = y[T + k - period j] + sum_{i<j} z(k - period i)``.

    The base value comes from the last ``period`` fitted points, kept per district
    as a sorted array of at most ``period`` structs (bounded, not data-sized)."""
    w = _w()
    x = s.withColumn("z", F.col("y") - F.lag("y", period).over(w))
    x = x.withColumn("z1", F.lag("z").over(w))
    phi, c = guarded_fit("z", "z1")
    recent = F.when(F.col("t") > F.col("t_fit") - period, F.struct(F.col("t"), F.col("y")))
    fit = (
        x.where(F.col("t") <= F.col("t_fit"))
        .groupBy("district")
        .agg(
            phi.alias("phi"),
            c.alias("c"),
            F.max_by("z", "t").alias("z_end"),
            F.sort_array(F.collect_list(recent)).alias("last_p"),
            *_fit_common(),
        )
    )
    st = _steps(fit).where(F.size("last_p") == period)  # needs a full season before T
    yhat = seasonal_yhat(F.col("k"), F.col("phi"), F.col("c"), F.col("z_end"), F.col("last_p"), period)
    return _finish(st, model, yhat)


def fit_partitions(train: DataFrame) -> int:
    """Partitions for a fit: one for each ``FIT_ROWS`` rows. A small fit is many tiny jobs, and a task less in each counts."""
    return 1 + train.count() // FIT_ROWS


def fit_lag_gbt(s: DataFrame, look_back: int = K.LOOK_BACK, max_iter: int = 20, seed: int = 42):
    """M3's fit: one pooled GBT regressor on ``look_back`` lagged, per-series min-max
    scaled values (W3, W5) of every district's points ``t <= t_fit`` with a full window.

    Returns the fitted regressor and the lagged table. MLlib draws its samples by
    partition, so the training rows are dealt out by district and sorted, into as many partitions
    as their number asks for: the model does not depend on how the series was partitioned."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    lags = [f"l{i}" for i in range(1, look_back + 1)]
    sc = scale(s, "y", fit_rows=F.col("t") <= F.col("t_fit"))
    lagged = materialize(lag_features(sc, look_back, col="y_s"), "gbt-lags")  # read by every boosting pass and the roll-forward
    train = lagged.where((F.col("t") <= F.col("t_fit")) & F.col(lags[-1]).isNotNull())
    train = train.repartition(fit_partitions(train), "district").sortWithinPartitions("district", "t")
    regressor = GBTRegressor(labelCol="y_s", featuresCol="features", maxIter=max_iter, seed=seed)
    return regressor.fit(VectorAssembler(inputCols=lags, outputCol="features").transform(train)), lagged


def forecast_lag_gbt(
    s: DataFrame,
    look_back: int = K.LOOK_BACK,
    model: str = "lstm",
    max_iter: int = 20,
    seed: int = 42,
) -> DataFrame:
    """M3: the pooled lag model rolled forward (W4), feeding predictions back.

    One row per district holds its window. The trees are constants of the plan, walked by
    expressions, so the whole horizon is one projection (``Ensemble.rolled``): no model transform and
    no driver step for a month, however long the horizon is."""
    fitted, lagged = fit_lag_gbt(s, look_back, max_iter, seed)
    ensemble = Ensemble(node_table(s.sparkSession, fitted))
    # state at t = t_fit: the window that predicts t_fit + 1 (l1 = most recent value)
    frame = lagged.where((F.col("t") == F.col("t_fit")) & F.col(f"l{look_back - 1}").isNotNull() & (F.col("h_steps") >= 1))
    window = F.array(F.col("y_s"), *[F.col(f"l{i}") for i in range(1, look_back)])
    rolled = ensemble.rolled(window, F.col("h_steps").cast("int"))
    rows = frame.select("district", "t_fit", "month", "y_min", "y_max", F.posexplode(rolled).alias("i", "p"))
    k = F.col("i") + 1
    return rows.select(
        "district",
        F.lit(model).alias("model"),
        k.alias("k"),
        (F.col("t_fit") + k).alias("t"),
        F.add_months("month", k).alias("month"),
        (F.col("p") * (F.col("y_max") - F.col("y_min")) + F.col("y_min")).alias("yhat"),
    )


_CLOSED = ("arima", "sarima")


def _closed_form_inputs(frame: DataFrame, period: int = 12) -> DataFrame:
    """Differences of M1 (``dy``, ``dy1``) and M2 (``z``, ``z1``) in one window chain.

    Every window is ``partitionBy('district')``, so the chain (and any aggregate or
    window on ``district`` after it) runs on a single exchange."""
    w = _w()
    x = frame.withColumn("y1", F.lag("y").over(w)).withColumn("dy", F.col("y") - F.col("y1"))
    x = x.withColumn("z", F.col("y") - F.lag("y", period).over(w))
    return x.withColumns({"dy1": F.lag("dy").over(w), "z1": F.lag("z").over(w)})


def _closed_form_fit_columns(period: int = 12, over: Window | None = None) -> dict:
    """Both models' fitted parameters over the rows ``t <= t_fit``, as aggregate
    expressions (``over=None``, for a ``groupBy('district')``) or window ones."""
    fit = F.col("t") <= F.col("t_fit")
    phi_a, c_a = guarded_fit("dy", "dy1", fit, over)
    phi_s, c_s = guarded_fit("z", "z1", fit, over)

    def agg(e):
        return e.over(over) if over is not None else e

    def at_end(c):  # value at t = t_fit (series are dense, t = 1..n)
        return agg(F.max(F.when(F.col("t") == F.col("t_fit"), F.col(c))))

    recent = F.when(fit & (F.col("t") > F.col("t_fit") - period), F.struct(F.col("t"), F.col("y")))
    return {
        "phi_a": phi_a, "c_a": c_a, "y_end": at_end("y"), "dy_end": at_end("dy"),
        "phi_s": phi_s, "c_s": c_s, "z_end": at_end("z"),
        "last_p": F.sort_array(agg(F.collect_list(recent))),  # at most `period` entries
    }


def _closed_form_yhats(k, period: int = 12) -> dict:
    """``arima`` and ``sarima`` values at step ``k`` from the fitted columns;
    ``sarima`` is NULL without a full season before ``t_fit``."""
    c = F.col
    return {
        "arima": ar_diff_yhat(k, c("phi_a"), c("c_a"), c("y_end"), c("dy_end")),
        "sarima": F.when(F.size("last_p") == period, seasonal_yhat(k, c("phi_s"), c("c_s"), c("z_end"), c("last_p"), period)),
    }


def closed_form_scores(frame: DataFrame, models=_CLOSED, period: int = 12) -> DataFrame:
    """M5 for M1 and M2 (A18/A19): both models fitted as window aggregates over
    each district's train rows, every test row scored in place, then one
    aggregate per district. One exchange on ``district`` for the whole plan:
    no per-model forecast frame and no join back to the actuals."""
    wp = Window.partitionBy("district")
    x = _closed_form_inputs(frame, period)
    x = x.withColumns(_closed_form_fit_columns(period, wp))
    test = x.where(F.col("t") > F.col("t_fit"))
    k = (F.col("t") - F.col("t_fit")).cast("int")
    test = test.select("district", "y", *[e.alias(m) for m, e in _closed_form_yhats(k, period).items()],
                       (F.size("last_p") == period).alias("_full"))
    aggs = []
    for m in _CLOSED:
        err = F.col("y") - F.col(m)
        n = F.count(F.lit(1)) if m == "arima" else F.count(F.when(F.col("_full"), F.lit(1)))
        aggs += [F.avg(F.abs(err)).alias(f"{m}_mae"), F.avg(err * err).alias(f"{m}_mse"), n.alias(f"{m}_n")]
    per = test.groupBy("district").agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_mae").alias("mae"), F.col(f"{m}_mse").alias("mse"), F.col(f"{m}_n").alias("n_test"))
        for m in _CLOSED if m in models
    ])
    out = per.select("district", F.inline(rows)).where(F.col("n_test") > 0)
    return out.withColumn("rmse", F.sqrt("mse"))


# --------------------------------------------------------------------------
def backtest_frame(series: DataFrame, min_points: int = K.MIN_MONTHS, frac: float = K.TRAIN_FRACTION) -> DataFrame:
    """W2 + W1: eligible series with ``T`` = train size and ``H`` = test size."""
    s = split_series(eligible_series(series, min_points), frac)
    return s.withColumns({"t_fit": F.col("n_train"), "h_steps": F.col("n") - F.col("n_train")})


def horizon_frame(series: DataFrame, months_ahead: int, min_points: int = K.MIN_MONTHS) -> DataFrame:
    """Eligible series fitted on every point, ``H`` = months ahead."""
    s = eligible_series(series, min_points)
    return s.withColumns({"t_fit": F.col("n"), "h_steps": F.lit(months_ahead)})


def run_models(frame: DataFrame, models=("arima", "sarima")) -> DataFrame:
    """Long forecast rows ``district, model, k, t, month, yhat`` for the chosen models."""
    parts = []
    for m in models:
        if m == "arima":
            parts.append(forecast_ar_diff(frame, 1, "arima"))
        elif m == "sarima":
            parts.append(forecast_seasonal(frame, 12, "sarima"))
        elif m == "lstm":
            parts.append(forecast_lag_gbt(frame))
        else:
            raise ValueError(f"unknown model {m}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def align(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual vs forecast on the same (district, t)."""
    return forecast.join(actual.select("district", "t", F.col("y").alias("actual")), ["district", "t"], "inner")


def error_metrics(aligned: DataFrame) -> DataFrame:
    """MAE, MSE, RMSE and test size per (district, model)."""
    err = F.col("actual") - F.col("yhat")
    return (
        aligned.groupBy("district", "model")
        .agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.count(F.lit(1)).alias("n_test"))
        .withColumn("rmse", F.sqrt("mse"))
    )


def backtest(series: DataFrame, models=("arima", "sarima"), materialize_input: bool | None = None) -> DataFrame:
    """M5: hold-out scores of every model for every eligible district.

    M1 and M2 are scored in one pass over the series (``closed_form_scores``).
    M3 reads the series several times (training passes, roll-forward, alignment),
    so by default (``None``) the series is materialized only when M3 is asked for;
    pass ``False`` when the caller already did."""
    closed = [m for m in models if m in _CLOSED]
    other = [m for m in models if m not in _CLOSED]
    if materialize_input is None:
        materialize_input = bool(other)
    frame = backtest_frame(materialize(series) if materialize_input else series)
    parts = [closed_form_scores(frame, closed)] if closed else []
    if other:
        fc = run_models(frame, other)
        parts.append(error_metrics(align(frame.where(F.col("split") == "test"), fc)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rank_col(model_col: str = "model"):
    expr = None
    for m, r in _RANK.items():
        expr = F.when(F.col(model_col) == m, r) if expr is None else expr.when(F.col(model_col) == m, r)
    return expr.otherwise(len(_RANK))


def best_model_expr():
    """A20 as an aggregate expression: the model with the lowest MAE (NULL/NaN
    scores ignored); ties go to arima, sarima, lstm order."""
    valid = F.col("mae").isNotNull() & ~F.isnan("mae")
    return F.min_by(F.when(valid, F.col("model")), F.when(valid, F.struct(F.col("mae"), _rank_col())))


def best_model(scores: DataFrame) -> DataFrame:
    """Model with the lowest MAE per district; ties go to arima, sarima, lstm order."""
    return (
        scores.where(F.col("mae").isNotNull() & ~F.isnan("mae"))
        .groupBy("district")
        .agg(
            F.min_by("model", F.struct(F.col("mae"), _rank_col())).alias("best_model"),
            F.min("mae").alias("best_mae"),
        )
    )


def model_leaderboard(scores: DataFrame) -> DataFrame:
    """Average MAE per model across districts; the lowest is flagged."""
    lb = scores.groupBy("model").agg(F.avg("mae").alias("avg_mae"), F.count(F.lit(1)).alias("districts"))
    w = Window.partitionBy()  # one row per model: a bounded, tiny window
    best = F.min_by("model", F.struct(F.col("avg_mae"), _rank_col())).over(w)
    return lb.withColumn("is_best", F.col("model") == best)


def model_selection(scores: DataFrame) -> DataFrame:
    """M7: criterion, best model, its MAE, all MAEs as a map, and the note.

    A model without a score (NULL or NaN) is never the best; with no score at
    all, best model, MAE and note are NULL."""
    valid = F.col("mae").isNotNull() & ~F.isnan("mae")
    sel = scores.groupBy("district").agg(
        best_model_expr().alias("best_model"),
        F.min(F.when(valid, F.col("mae"))).alias("best_model_mae"),
        map_of("model", "mae").alias("all_models_mae"),
    )
    return sel.select(
        "district",
        F.lit(K.SELECTION_CRITERIA).alias("criteria"),
        "best_model",
        "best_model_mae",
        "all_models_mae",
        selection_note("best_model", "best_model_mae").alias("selection_note"),
    )


def best_prediction(forecast: DataFrame, best: DataFrame) -> DataFrame:
    """The best model's value for every forecast row, clamped at zero (M4)."""
    b = best.select("district", F.col("best_model").alias("model"))
    return forecast.join(b, ["district", "model"], "inner").select(
        "district", "k", "month", F.col("model").alias("best_model"), F.greatest(F.lit(0.0), F.col("yhat")).alias("best_value")
    )


def closed_form_forecast_table(series: DataFrame, months_ahead: int = 6, models=_CLOSED, period: int = 12) -> DataFrame:
    """M6 for M1/M2 in one pass over the series.

    One window chain on ``district`` carries the hold-out fit (train rows) as
    window aggregates and scores the test rows in place; a single
    ``groupBy('district')`` on the same partitioning then fits the full history
    and averages each model's hold-out error, picks the best model (lowest MAE,
    ties in arima, sarima order) and ``k = 1..months_ahead`` is exploded. One
    exchange, no join between a forecast and a backtest plan."""
    wp = Window.partitionBy("district")
    x = _closed_form_inputs(backtest_frame(series), period)
    x = x.withColumns(_closed_form_fit_columns(period, wp))  # hold-out fit: t <= n_train
    k_test = (F.col("t") - F.col("t_fit")).cast("int")
    test = F.col("t") > F.col("t_fit")
    x = x.select(
        "district", "month", "t", "y", "n", "dy", "dy1", "z", "z1",
        *[F.when(test, e).alias(f"_bt_{m}") for m, e in _closed_form_yhats(k_test, period).items()],
        (test & (F.size("last_p") == period)).alias("_bt_full"), test.alias("_bt_test"),
    )
    x = x.withColumns({"t_fit": F.col("n"), "h_steps": F.lit(months_ahead)})  # full-history fit
    at_fit = F.col("t") == F.col("t_fit")
    maes = {}
    for m in _CLOSED:
        n_ok = F.count(F.when(F.col("_bt_test") if m == "arima" else F.col("_bt_full"), F.lit(1)))
        maes[f"_mae_{m}"] = F.when(n_ok > 0, F.avg(F.abs(F.col("y") - F.col(f"_bt_{m}"))))
    fit = x.groupBy("district").agg(
        *[e.alias(n) for n, e in _closed_form_fit_columns(period).items()],
        *[e.alias(n) for n, e in maes.items()],
        F.max("t_fit").alias("t_fit"), F.max("h_steps").alias("h_steps"), F.max(F.when(at_fit, F.col("month"))).alias("m_end"),
    )
    cands = F.array(*[F.struct(F.col(f"_mae_{m}").alias("mae"), F.lit(_RANK[m]).alias("rank"), F.lit(m).alias("model")) for m in models])
    valid = F.filter(cands, lambda c: c.getField("mae").isNotNull() & ~F.isnan(c.getField("mae")))
    fit = fit.withColumn("best_model", F.array_min(valid).getField("model"))
    st = _steps(fit)
    yh = _closed_form_yhats(F.col("k"), period)
    out = st.select(
        "district", "k", F.add_months(F.col("m_end"), F.col("k")).alias("month"),
        *[F.greatest(F.lit(0.0), yh[m]).alias(m) for m in models],  # M4
        "best_model",
    )
    pick = F.coalesce(*[F.when(F.col("best_model") == m, F.col(m)) for m in models])
    return out.withColumn("best_value", pick).withColumn("date", F.date_format("month", "yyyy-MM-dd"))


def forecast_table(
    series: DataFrame,
    months_ahead: int = 6,
    models=("arima", "sarima"),
    district: str | None = None,
    materialize_input: bool | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """M6: one row per (district, month ahead) with a column per model (clamped
    at zero, M4), the best model from the backtest and its value.

    M1/M2 only: one pass (``closed_form_forecast_table``). With M3 the series is
    read by the horizon run, the backtest and the training passes, so by default
    (``None``) it is materialized then; M3 is fitted once on the full history and,
    unless the caller passes the backtest's ``scores``, once on the hold-out."""
    if district is not None and district != "all":
        series = series.where(F.col("district") == district)
    if all(m in _CLOSED for m in models) and scores is None:
        if materialize_input:
            series = materialize(series)
        return closed_form_forecast_table(series, months_ahead, models)
    if materialize_input or materialize_input is None:
        series = materialize(series)  # used by the horizon run and by the backtest
    fc = run_models(horizon_frame(series, months_ahead), models)
    fc = fc.withColumn("yhat", F.greatest(F.lit(0.0), F.col("yhat")))  # M4
    wide = fc.groupBy("district", "k", "month").pivot("model", list(models)).agg(F.first("yhat"))
    best = best_model(scores if scores is not None else backtest(series, models, materialize_input=False))
    out = wide.join(best.select("district", "best_model"), "district", "left")
    pick = F.coalesce(*[F.when(F.col("best_model") == m, F.col(m)) for m in models])
    return out.withColumn("best_value", pick).withColumn("date", F.date_format("month", "yyyy-MM-dd"))


def payload_month(table: DataFrame) -> DataFrame:
    """M6 as the request returns it: ``month`` is ``yyyy-MM`` text, ``date`` the day."""
    return table.withColumn("month", F.date_format("month", "yyyy-MM"))


def select_order(series: DataFrame, frac: float = K.TRAIN_FRACTION, materialize_input: bool = False) -> DataFrame:
    """Choose the difference order d in (0, 1) per district.

    Both AR(1) fits use the first ``frac`` of the training part; each is scored by
    one-step-ahead MAE on the rest of the training part; ties keep d = 0. The
    fits are window aggregates over each district's selection rows, so fitting,
    scoring and the per-district average share one exchange (no join back)."""
    s = backtest_frame(materialize(series) if materialize_input else series)
    s = s.withColumn("t_sel", F.floor(F.col("n_train") * frac).cast("int"))
    w, wp = _w(), Window.partitionBy("district")
    x = s.withColumn("y1", F.lag("y").over(w)).withColumn("dy", F.col("y") - F.col("y1"))
    x = x.withColumn("dy1", F.lag("dy").over(w))
    sel = F.col("t") <= F.col("t_sel")
    phi0, c0 = guarded_fit("y", "y1", sel, wp)
    phi1, c1 = guarded_fit("dy", "dy1", sel, wp)
    x = x.withColumns({"phi0": phi0, "c0": c0, "phi1": phi1, "c1": c1})
    ev = x.where((F.col("t") > F.col("t_sel")) & (F.col("t") <= F.col("n_train")))
    p0 = F.col("c0") + F.col("phi0") * F.col("y1")
    p1 = F.col("y1") + F.col("c1") + F.col("phi1") * F.col("dy1")
    sc = ev.groupBy("district").agg(
        F.avg(F.abs(F.col("y") - p0)).alias("mae_d0"), F.avg(F.abs(F.col("y") - p1)).alias("mae_d1")
    )
    return sc.withColumn("d", F.when(F.col("mae_d1") < F.col("mae_d0"), 1).otherwise(0))
