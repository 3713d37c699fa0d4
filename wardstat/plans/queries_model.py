"""Registered queries: series, forecasts, risk, hotspots, charts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.operators import charts as CH
from wardstat.operators import forecast as FC
from wardstat.operators import hotspot as HS
from wardstat.operators import risk as RK
from wardstat.operators import series as S
from wardstat.operators import trees as TR
from wardstat.operators.aggregates import type_by_district
from wardstat.operators.ordering import head_per_district
from wardstat.plans import flows
from wardstat.plans.catalog import fixtures, r6, register
from wardstat.session import materialize
from wardstat.sources.views import CLASS_MAP

# ------------------------------------------------------------ SQL fragments ---
# Dense monthly series of the order-backed view, with n, train size tt, test size hh.
def _series_sql(src: str = "incidents_monthly") -> str:
    """Dense monthly series of `src` (district, ts), with n, train size tt, test size hh."""
    return """
mc0 as (select district, cast(date_trunc('month', ts) as date) as month, count(*) as crime_count
        from {src} where ts is not null and district is not null group by 1, 2),
ended as (select max(cast(ts as date)) as d from incidents_monthly where ts is not null and district is not null),
mc as (select mc0.* from mc0, ended where month < cast(date_trunc('month', d) as date) or d = last_day(d)),
bounds as (select district, min(month) as m0, max(month) as m1 from mc group by 1),
cal as (select district, cast(m as date) as month
        from (select district, unnest(generate_series(cast(m0 as timestamp), cast(m1 as timestamp), interval 1 month)) as m
              from bounds) b),
ser as (select c.district, c.month, cast(coalesce(mc.crime_count, 0) as double) as y,
               row_number() over (partition by c.district order by c.month) as t
        from cal c left join mc on c.district = mc.district and c.month = mc.month),
len as (select *, count(*) over (partition by district) as n from ser),
bt as (select *, cast(floor(n * 0.8e0) as bigint) as tt, n - cast(floor(n * 0.8e0) as bigint) as hh
       from len where n >= 24)""".format(src=src)


_SERIES = _series_sql()


def _fit_sql(y: str, x: str) -> str:
    return (
        f"case when regr_sxx({y}, {x}) > 0 then regr_slope({y}, {x}) else 0e0 end as phi, "
        f"case when regr_sxx({y}, {x}) > 0 then regr_intercept({y}, {x}) "
        f"else avg(case when {x} is not null then {y} end) end as c"
    )


# M1 (d = 1) forecasts over a frame `{frame}` with columns district, t, y, month, tt (fit end), hh (steps).
# CTE names carry the prefix `{p}` so the backtest and the horizon run can share one query.
_M1_BODY = """
{p}a1 as (select *, y - lag(y) over (partition by district order by t) as dy from {frame}),
{p}a2 as (select *, lag(dy) over (partition by district order by t) as dy1 from {p}a1),
{p}afit as (select district, {fit}, max_by(y, t) as y_T, max_by(dy, t) as dy_T,
                max(tt) as tt, max(hh) as hh, max_by(month, t) as m_T
         from {p}a2 where t <= tt group by district),
{p}ast as (select *, unnest(generate_series(1, hh)) as k from {p}afit where hh >= 1),
{p}arima as (select district, 'arima' as model, k, tt + k as t, cast(m_T + to_months(cast(k as integer)) as date) as month,
       case when abs(1 - phi) < 1e-9 then y_T + k * dy_T + c * k * (k + 1) / 2e0
            else y_T + (c / (1 - phi)) * k + (dy_T - c / (1 - phi)) * phi * (1 - pow(phi, k)) / (1 - phi) end as yhat
from {p}ast)"""

# M2 seasonal forecasts over the same frame.
_M2_BODY = """
{p}s1 as (select *, y - lag(y, 12) over (partition by district order by t) as z from {frame}),
{p}s2 as (select *, lag(z) over (partition by district order by t) as z1 from {p}s1),
{p}sfit as (select district, {fit}, max_by(z, t) as z_T, max(tt) as tt, max(hh) as hh, max_by(month, t) as m_T,
                count(*) filter (where t > tt - 12) as nlast
         from {p}s2 where t <= tt group by district),
{p}sst as (select *, unnest(generate_series(1, hh)) as k from {p}sfit where hh >= 1 and nlast = 12),
{p}sj as (select *, cast(ceil(k / 12e0) as bigint) as j from {p}sst),
{p}sterm as (select {p}sj.*, unnest(generate_series(0, j - 1)) as i from {p}sj),
{p}szs as (select district, k, tt, m_T, j,
               sum(case when abs(1 - phi) < 1e-9 then z_T + c * (k - 12 * i)
                        else c / (1 - phi) + pow(phi, k - 12 * i) * (z_T - c / (1 - phi)) end) as zsum
        from {p}sterm group by district, k, tt, m_T, j),
{p}sarima as (select z.district, 'sarima' as model, z.k, z.tt + z.k as t,
                  cast(z.m_T + to_months(cast(z.k as integer)) as date) as month, b.y + z.zsum as yhat
           from {p}szs z join {frame} b on b.district = z.district and b.t = z.tt + z.k - 12 * z.j)"""


def _models_sql(frame: str, p: str = "") -> str:
    return (
        _M1_BODY.format(frame=frame, p=p, fit=_fit_sql("dy", "dy1"))
        + ","
        + _M2_BODY.format(frame=frame, p=p, fit=_fit_sql("z", "z1"))
    )


def _backtest_ctes(series: str = _SERIES) -> str:
    return "with " + series + "," + _models_sql("bt") + """,
fc as (select * from arima union all select * from sarima),
aligned as (select fc.*, bt.y as actual from fc join bt on fc.district = bt.district and fc.t = bt.t),
scores as (select district, model, avg(abs(actual - yhat)) as mae, avg((actual - yhat) * (actual - yhat)) as mse,
                  count(*) as n_test, sqrt(avg((actual - yhat) * (actual - yhat))) as rmse
           from aligned group by district, model),
ranked as (select *, case model when 'arima' then 0 when 'sarima' then 1 else 2 end as model_rank from scores),
best as (select district, arg_min(model, (mae, model_rank)) as best_model, min(mae) as best_mae
         from ranked where mae is not null and not isnan(mae) group by district)
"""


_BACKTEST_CTES = _backtest_ctes()

# Horizon frame: fitted on all n points, 6 months ahead; CTE names prefixed with h.
_HORIZON_CTES = "hz as (select *, n as tt, 6 as hh from len where n >= 24)," + _models_sql("hz", "h")


def _monthly_series(spark, sf_dir, reused: bool = True):
    """Dense series. Checkpointed when the query reads it more than once (measured
    faster at sf0.1 than re-aggregating per use); a single-read plan (the window
    queries, the one-pass backtest) streams straight from the aggregate."""
    s = S.densify(S.complete_months(S.monthly_counts(fixtures(spark, sf_dir).incidents_monthly)))
    return materialize(s) if reused else s


# ------------------------------------------------------------------ series ---


@register(
    "a6_monthly_series",
    """
select case when grouping(district) = 0 then district else 'all' end as district, month, count(*) as crime_count
from (select district, cast(date_trunc('month', ts) as date) as month from incidents_monthly where ts is not null) d
group by grouping sets ((district, month), (month))
having grouping(district) = 1 or district is not null""",
)
def a6_monthly_series(spark, sf_dir):
    return r6(S.monthly_series(fixtures(spark, sf_dir).incidents_monthly))


@register("w7_densify", "with " + _SERIES + "\nselect district, month, t, y from ser")
def w7_densify(spark, sf_dir):
    return r6(_monthly_series(spark, sf_dir, reused=False).select("district", "month", "t", "y"))


@register("w2_eligible_series", "with " + _SERIES + "\nselect distinct district, n from bt")
def w2_eligible_series(spark, sf_dir):
    return r6(S.eligible_series(_monthly_series(spark, sf_dir, reused=False)).select("district", "n").distinct())


@register(
    "w1_split_series",
    "with " + _SERIES + "\nselect district, t, tt as n_train, case when t <= tt then 'train' else 'test' end as split from bt",
)
def w1_split_series(spark, sf_dir):
    s = S.split_series(S.eligible_series(_monthly_series(spark, sf_dir, reused=False)))
    return r6(s.select("district", "t", "n_train", "split"))


@register(
    "w3_lag_features",
    "with "
    + _SERIES
    + "\nselect district, t, "
    + ", ".join(f"lag(y, {i}) over (partition by district order by t) as l{i}" for i in range(1, 13))
    + " from ser",
)
def w3_lag_features(spark, sf_dir):
    s = S.lag_features(_monthly_series(spark, sf_dir, reused=False), 12)
    return r6(s.select("district", "t", *[f"l{i}" for i in range(1, 13)]))


@register(
    "w5_scale",
    "with "
    + _SERIES
    + """,
mm as (select district, min(y) filter (where t <= tt) as y_min, max(y) filter (where t <= tt) as y_max from bt group by 1)
select bt.district, bt.t, mm.y_min, mm.y_max,
       case when mm.y_max - mm.y_min > 0 then (bt.y - mm.y_min) / (mm.y_max - mm.y_min) else 0e0 end as y_s
from bt join mm on bt.district = mm.district""",
)
def w5_scale(spark, sf_dir):
    s = S.scale(S.split_series(S.eligible_series(_monthly_series(spark, sf_dir, reused=False))))
    return r6(s.select("district", "t", "y_min", "y_max", "y_s"))


@register(
    "w8_differences",
    "with "
    + _SERIES
    + """
select district, t, y - lag(y) over (partition by district order by t) as dy,
       y - lag(y, 12) over (partition by district order by t) as sy from ser""",
)
def w8_differences(spark, sf_dir):
    return r6(S.differences(_monthly_series(spark, sf_dir, reused=False)).select("district", "t", "dy", "sy"))


# --------------------------------------------------------------- forecasts ---
_THREE = ("arima", "sarima", "lstm")
_FC_COLS = "district, model, k, t, month, round(yhat, 6) as yhat"


@register("m1_forecast_ar_diff", "with " + _SERIES + "," + _models_sql("bt") + f"\nselect {_FC_COLS} from arima")
def m1_forecast_ar_diff(spark, sf_dir):
    return r6(FC.forecast_ar_diff(FC.backtest_frame(_monthly_series(spark, sf_dir, reused=False)), 1))


@register("m2_forecast_seasonal", "with " + _SERIES + "," + _models_sql("bt") + f"\nselect {_FC_COLS} from sarima")
def m2_forecast_seasonal(spark, sf_dir):
    return r6(FC.forecast_seasonal(FC.backtest_frame(_monthly_series(spark, sf_dir, reused=False))))


@register(
    "j3_align",
    _BACKTEST_CTES + "select district, model, k, t, month, round(yhat, 6) as yhat, actual from aligned",
)
def j3_align(spark, sf_dir):
    frame = FC.backtest_frame(_monthly_series(spark, sf_dir))
    fc = FC.run_models(frame)
    return r6(FC.align(frame.where(F.col("split") == "test"), fc))


@register(
    "m5_backtest",
    _BACKTEST_CTES + "select district, model, round(mae, 6) as mae, round(mse, 6) as mse, round(rmse, 6) as rmse, n_test from scores",
)
def m5_backtest(spark, sf_dir):
    """M5 with A18 (MAE) and A19 (MSE, RMSE) per district and model."""
    return r6(FC.backtest(_monthly_series(spark, sf_dir, reused=False), materialize_input=False))


@register("a20_best_model", _BACKTEST_CTES + "select district, best_model, round(best_mae, 6) as best_mae from best")
def a20_best_model(spark, sf_dir):
    return r6(FC.best_model(FC.backtest(_monthly_series(spark, sf_dir, reused=False), materialize_input=False)))


@register(
    "a21_model_leaderboard",
    _BACKTEST_CTES
    + """, lb as (select model, avg(mae) as avg_mae, count(*) as districts,
                     case model when 'arima' then 0 when 'sarima' then 1 else 2 end as model_rank from scores group by model)
select model, round(avg_mae, 6) as avg_mae, districts,
       model = (select arg_min(model, (avg_mae, model_rank)) from lb) as is_best from lb""",
)
def a21_model_leaderboard(spark, sf_dir):
    return r6(FC.model_leaderboard(FC.backtest(_monthly_series(spark, sf_dir, reused=False), materialize_input=False)))


@register(
    "m7_model_selection",
    _BACKTEST_CTES
    + """
select b.district, 'Lowest Mean Absolute Error (MAE)' as criteria, b.best_model, round(b.best_mae, 6) as best_model_mae,
       round(a.mae, 6) as arima_mae, round(s.mae, 6) as sarima_mae,
       printf('%s selected with MAE of %.2f', upper(b.best_model), b.best_mae) as selection_note
from best b join scores a on a.district = b.district and a.model = 'arima'
            join scores s on s.district = b.district and s.model = 'sarima'""",
)
def m7_model_selection(spark, sf_dir):
    sel = FC.model_selection(FC.backtest(_monthly_series(spark, sf_dir, reused=False), materialize_input=False))
    return r6(
        sel.select(
            "district", "criteria", "best_model", "best_model_mae",
            F.col("all_models_mae")["arima"].alias("arima_mae"),
            F.col("all_models_mae")["sarima"].alias("sarima_mae"),
            "selection_note",
        )
    )


def _forecast_sql(series: str = _SERIES) -> str:
    return (
        _backtest_ctes(series)
        + ","
        + _HORIZON_CTES
        + """,
wide as (select a.district, a.k, a.month, greatest(0e0, a.yhat) as arima, greatest(0e0, s.yhat) as sarima
         from harima a join hsarima s on a.district = s.district and a.k = s.k)
"""
    )


_FORECAST_SQL = _forecast_sql()

_M6_SELECT = """
select w.district, w.k, strftime(w.month, '%Y-%m') as month, strftime(w.month, '%Y-%m-%d') as date, round(w.arima, 6) as arima,
       round(w.sarima, 6) as sarima, b.best_model,
       round(case b.best_model when 'arima' then w.arima when 'sarima' then w.sarima end, 6) as best_value
from wide w left join best b on w.district = b.district"""

@register("m6_forecast", _FORECAST_SQL + _M6_SELECT)
def m6_forecast(spark, sf_dir):
    """M6 with M4 (clamp at zero): 6 months ahead for every eligible district."""
    return r6(FC.payload_month(FC.forecast_table(_monthly_series(spark, sf_dir, reused=False), 6, materialize_input=False)))


@register("m6_forecast_all", _forecast_sql(_series_sql("(select 'all' as district, ts from incidents_monthly)")) + _M6_SELECT)
def m6_forecast_all(spark, sf_dir):
    """Forecast request for ``all`` districts pooled (6 months ahead)."""
    m = fixtures(spark, sf_dir).incidents_monthly
    series = flows.monthly_series_for(m, "all")
    return r6(FC.payload_month(FC.forecast_table(series, 6, materialize_input=False)))


@register(
    "m6_forecast_district",
    _forecast_sql(_series_sql("(select district, ts from incidents_monthly where district = 'NATION_7')")) + _M6_SELECT,
)
def m6_forecast_district(spark, sf_dir):
    """Forecast request for one district (P8 filter pushed to the scan, 6 months ahead)."""
    m = fixtures(spark, sf_dir).incidents_monthly
    series = flows.monthly_series_for(m, "NATION_7")
    return r6(FC.payload_month(FC.forecast_table(series, 6, materialize_input=False)))


@register("m6_forecast_three_models")
def m6_forecast_three_models(spark, sf_dir):
    """The forecast request with all three models, for every district (rows-only; its
    ``arima`` and ``sarima`` columns equal ``m6_forecast``'s, which has an oracle)."""
    series = _monthly_series(spark, sf_dir)
    scores = materialize(FC.backtest(series, _THREE, materialize_input=False))
    return r6(FC.payload_month(FC.forecast_table(series, 6, _THREE, materialize_input=False, scores=scores)))


def _three_scores(spark, sf_dir):
    return materialize(FC.backtest(_monthly_series(spark, sf_dir), _THREE, materialize_input=False))


@register("a20_best_of_three")
def a20_best_of_three(spark, sf_dir):
    """A20 over three models (rows-only)."""
    return r6(FC.best_model(_three_scores(spark, sf_dir)))


@register("a21_leaderboard_of_three")
def a21_leaderboard_of_three(spark, sf_dir):
    """A21 over three models (rows-only)."""
    return r6(FC.model_leaderboard(_three_scores(spark, sf_dir)))


@register("m7_selection_of_three")
def m7_selection_of_three(spark, sf_dir):
    """M7 over three models (rows-only), a column for each model's MAE."""
    sel = FC.model_selection(_three_scores(spark, sf_dir))
    maes = [F.col("all_models_mae")[m].alias(f"{m}_mae") for m in _THREE]
    return r6(sel.select("district", "criteria", "best_model", "best_model_mae", *maes, "selection_note"))


@register("m16_performance_of_three")
def m16_performance_of_three(spark, sf_dir):
    """M16's performance chart over three models (rows-only)."""
    return r6(CH.model_performance_rows(_three_scores(spark, sf_dir)))


@register(
    "j4_best_prediction",
    _FORECAST_SQL
    + """, hfc as (select * from harima union all select * from hsarima)
select f.district, f.k, f.month, f.model as best_model, round(greatest(0e0, f.yhat), 6) as best_value
from hfc f join best b on f.district = b.district and f.model = b.best_model""",
)
def j4_best_prediction(spark, sf_dir):
    series = _monthly_series(spark, sf_dir)
    fc = FC.run_models(FC.horizon_frame(series, 6))
    return r6(FC.best_prediction(fc, FC.best_model(FC.backtest(series, materialize_input=False))))


@register(
    "l6_head_per_district",
    _FORECAST_SQL + "select district, k, month, round(arima, 6) as arima, round(sarima, 6) as sarima from wide where k <= 3",
)
def l6_head_per_district(spark, sf_dir):
    wide = FC.forecast_table(_monthly_series(spark, sf_dir, reused=False), 6, materialize_input=False).select("district", "k", "month", "arima", "sarima")
    return r6(head_per_district(wide, 3))


_M17_CTES = """
o1 as (select *, cast(floor(tt * 0.8e0) as bigint) as tf, lag(y) over (partition by district order by t) as y1 from bt),
o2 as (select *, y - y1 as dy from o1),
o3 as (select *, lag(dy) over (partition by district order by t) as dy1 from o2),
ofit as (select district,
           case when regr_sxx(y, y1) > 0 then regr_slope(y, y1) else 0e0 end as phi0,
           case when regr_sxx(y, y1) > 0 then regr_intercept(y, y1) else avg(case when y1 is not null then y end) end as c0,
           case when regr_sxx(dy, dy1) > 0 then regr_slope(dy, dy1) else 0e0 end as phi1,
           case when regr_sxx(dy, dy1) > 0 then regr_intercept(dy, dy1) else avg(case when dy1 is not null then dy end) end as c1
         from o3 where t <= tf group by district),
ev as (select o3.district, avg(abs(y - (c0 + phi0 * y1))) as mae_d0, avg(abs(y - (y1 + c1 + phi1 * dy1))) as mae_d1
       from o3 join ofit on o3.district = ofit.district where t > tf and t <= tt group by o3.district)"""

# AR(1) on levels (d = 0) over a frame, CTE names prefixed with {p}.
_M1_D0_BODY = """
{p}b1 as (select *, lag(y) over (partition by district order by t) as y1 from {frame}),
{p}bfit as (select district, {fit}, max_by(y, t) as y_T, max(tt) as tt, max(hh) as hh, max_by(month, t) as m_T
            from {p}b1 where t <= tt group by district),
{p}bst as (select *, unnest(generate_series(1, hh)) as k from {p}bfit where hh >= 1),
{p}ar0 as (select district, 'arima' as model, k, tt + k as t, cast(m_T + to_months(cast(k as integer)) as date) as month,
       case when abs(1 - phi) < 1e-9 then y_T + c * k else c / (1 - phi) + pow(phi, k) * (y_T - c / (1 - phi)) end as yhat
from {p}bst)"""


@register(
    "m17_select_order",
    "with "
    + _SERIES
    + ","
    + _M17_CTES
    + """
select district, round(mae_d0, 6) as mae_d0, round(mae_d1, 6) as mae_d1, cast(case when mae_d1 < mae_d0 then 1 else 0 end as bigint) as d from ev""",
)
def m17_select_order(spark, sf_dir):
    return r6(FC.select_order(_monthly_series(spark, sf_dir, reused=False)))


@register(
    "m1_forecast_selected_order",
    "with "
    + _SERIES
    + ","
    + _M17_CTES
    + ","
    + _models_sql("bt")
    + ","
    + _M1_D0_BODY.format(frame="bt", p="", fit=_fit_sql("y", "y1"))
    + """,
sel as (select district, cast(case when mae_d1 < mae_d0 then 1 else 0 end as bigint) as d from ev)
select f.district, s.d, f.model, f.k, f.t, f.month, round(f.yhat, 6) as yhat
from (select *, 0 as d from ar0 union all select *, 1 as d from arima) f join sel s on f.district = s.district and f.d = s.d""",
)
def m1_forecast_selected_order(spark, sf_dir):
    """M1 with M17's per-district difference order, over the hold-out horizon (one pass)."""
    return r6(FC.forecast_ar_auto_order(FC.backtest_frame(_monthly_series(spark, sf_dir, reused=False))))


@register("m3_forecast_lag_gbt")
def m3_forecast_lag_gbt(spark, sf_dir):
    """M3 (rows-only): hold-out scores of the pooled lag-GBT model per district."""
    return FC.backtest(_monthly_series(spark, sf_dir), models=("lstm",), materialize_input=False)


@register("m3_walk_from_nodes", "with " + _SERIES + "\nselect district, t, 0e0 as gap from bt where t > 12")
def m3_walk_from_nodes(spark, sf_dir):
    """M3 from the saved trees' nodes: on every row with a full window the walk gives MLlib's prediction."""
    fitted, lagged = FC.fit_lag_gbt(FC.backtest_frame(_monthly_series(spark, sf_dir)))
    lags = [f"l{i}" for i in range(1, 13)]
    rows = lagged.where(F.col("l12").isNotNull())
    walked = TR.Ensemble(TR.node_table(spark, fitted)).predict(F.array(*map(F.col, lags)))
    rows = fitted.transform(VectorAssembler(inputCols=lags, outputCol="features").transform(rows))
    return r6(rows.select("district", "t", F.abs(walked - F.col("prediction")).alias("gap")))


# -------------------------------------------------------------------- risk ---
_FEATURES_SQL = """
feat as (
  select h.district, count(*) as total_crimes,
         count(*) filter (where crime_type in ('error')) as violent_crimes,
         count(*) filter (where crime_type in ('purchase')) as property_crimes,
         count(*) filter (where crime_type in ('signup')) as drug_crimes,
         count(*) filter (where hour(ts) > 18) * 100e0 / count(*) as evening_crimes_pct,
         count(*) filter (where hour(ts) <= 6) * 100e0 / count(*) as night_crimes_pct,
         count(*) filter (where isodow(ts) in (6, 7)) * 100e0 / count(*) as weekend_crimes_pct
  from incidents_hourly h where h.district is not null group by h.district),
featr as (select f.*, case when d.population > 0 then f.total_crimes * 1000e0 / d.population end as crime_rate
          from feat f left join district_dim d on f.district = d.district),
fd as (select district, cast(total_crimes as double) as total_crimes, coalesce(crime_rate, 10e0) as crime_rate,
              cast(violent_crimes as double) as violent_crimes, cast(property_crimes as double) as property_crimes,
              cast(drug_crimes as double) as drug_crimes, evening_crimes_pct, night_crimes_pct, weekend_crimes_pct from featr),
sc as (select *, case when total_crimes > 0 then
          least(crime_rate / 20e0, 1e0) * 0.3e0 + least(total_crimes / 200e0, 1e0) * 0.25e0
          + least(violent_crimes / total_crimes, 0.5e0) * 0.2e0 + least(evening_crimes_pct / 50e0, 1e0) * 0.15e0
          + least(night_crimes_pct / 30e0, 1e0) * 0.1e0 end as risk_score from fd),
lv as (select *, case when risk_score > 0.7e0 then 'High' when risk_score > 0.4e0 then 'Medium'
                      when risk_score is not null then 'Low' end as risk_level from sc)"""

_FEATURE_COLS = [
    "total_crimes", "crime_rate", "violent_crimes", "property_crimes", "drug_crimes",
    "evening_crimes_pct", "night_crimes_pct", "weekend_crimes_pct",
]


def _features(spark, sf_dir, with_dim=True):
    fx = fixtures(spark, sf_dir)
    return RK.risk_features(fx.incidents_hourly, fx.district_dim if with_dim else None, CLASS_MAP)


@register(
    "a22_risk_features",
    "with "
    + _FEATURES_SQL
    + "\nselect district, total_crimes, violent_crimes, property_crimes, drug_crimes, round(evening_crimes_pct, 6) as evening_crimes_pct, "
    "round(night_crimes_pct, 6) as night_crimes_pct, round(weekend_crimes_pct, 6) as weekend_crimes_pct, round(crime_rate, 6) as crime_rate from featr",
)
def a22_risk_features(spark, sf_dir):
    return r6(_features(spark, sf_dir))


@register(
    "p13_feature_defaults",
    "with "
    + _FEATURES_SQL
    + "\nselect district, cast(total_crimes as double) as total_crimes, 10e0 as crime_rate, cast(violent_crimes as double) as violent_crimes, "
    "cast(property_crimes as double) as property_crimes, cast(drug_crimes as double) as drug_crimes, round(evening_crimes_pct, 6) as evening_crimes_pct, "
    "round(night_crimes_pct, 6) as night_crimes_pct, round(weekend_crimes_pct, 6) as weekend_crimes_pct from feat",
)
def p13_feature_defaults(spark, sf_dir):
    return r6(RK.with_feature_defaults(_features(spark, sf_dir, with_dim=False)))


@register(
    "p14_feature_long",
    "with "
    + _FEATURES_SQL
    + "\nselect district, parameter, round(value, 6) as value from (unpivot (select district, "
    + ", ".join(f"cast({c} as double) as {c}" for c in _FEATURE_COLS)
    + " from featr) on "
    + ", ".join(_FEATURE_COLS)
    + " into name parameter value value) u",
)
def p14_feature_long(spark, sf_dir):
    return r6(RK.feature_long(_features(spark, sf_dir)))


@register(
    "a23_class_distribution",
    "with "
    + _FEATURES_SQL
    + "\nselect district, crime_class, crimes from (unpivot (select district, total_crimes, violent_crimes, property_crimes, drug_crimes from feat) "
    "on total_crimes, violent_crimes, property_crimes, drug_crimes into name crime_class value crimes) u",
)
def a23_class_distribution(spark, sf_dir):
    return r6(RK.class_distribution(_features(spark, sf_dir)))


@register(
    "a24_time_pattern",
    "with "
    + _FEATURES_SQL
    + "\nselect district, pattern, round(pct, 6) as pct from (unpivot (select district, evening_crimes_pct, night_crimes_pct, weekend_crimes_pct from feat) "
    "on evening_crimes_pct, night_crimes_pct, weekend_crimes_pct into name pattern value pct) u",
)
def a24_time_pattern(spark, sf_dir):
    return r6(RK.time_pattern(_features(spark, sf_dir)))


@register(
    "a30_normalise",
    """
select district, crime_type, round(count * 1e0 / sum(count) over (partition by district), 6) as share
from (select district, crime_type, count(*) as count from incidents_hourly
      where district is not null and crime_type is not null group by 1, 2) t""",
)
def a30_normalise(spark, sf_dir):
    t = type_by_district(fixtures(spark, sf_dir).incidents_hourly)
    return r6(RK.normalise(t, "district", "count", "share").drop("count"))


@register(
    "m8_risk_score",
    "with " + _FEATURES_SQL + "\nselect district, round(risk_score, 6) as risk_score, "
    "case when total_crimes > 0 then null else 'total_crimes must be positive' end as reject_reason from sc",
)
def m8_risk_score(spark, sf_dir):
    s = RK.risk_score(RK.with_feature_defaults(_features(spark, sf_dir)))
    return r6(s.select("district", "risk_score", "reject_reason"))


@register(
    "m9_m11_rule_risk",
    "with "
    + _FEATURES_SQL
    + """
select district, round(risk_score, 6) as risk_score, risk_level,
       case risk_level when 'High' then 0.9e0 when 'Medium' then 0.84e0 when 'Low' then 0.86e0 end as confidence,
       round(case risk_level when 'High' then 0.8e0 / 1.1e0 when 'Medium' then 0.3e0 / 1.1e0 when 'Low' then 0.1e0 / 1.1e0 end, 6) as p_high,
       round(case risk_level when 'High' then 0.2e0 / 1.1e0 when 'Medium' then 0.6e0 / 1.1e0 when 'Low' then 0.2e0 / 1.1e0 end, 6) as p_medium,
       round(case risk_level when 'High' then 0.1e0 / 1.1e0 when 'Medium' then 0.2e0 / 1.1e0 when 'Low' then 0.8e0 / 1.1e0 end, 6) as p_low,
       case risk_level when 'High' then 'red' when 'Medium' then 'orange' else 'green' end as colour
from lv""",
)
def m9_m11_rule_risk(spark, sf_dir):
    """M9 level, M10 probabilities, M11 confidence, R28 colour for every district."""
    from wardstat.functions.numeric import risk_colour

    r = RK.rule_risk(_features(spark, sf_dir))
    p = F.col("probabilities")
    return r6(
        r.select(
            "district", "risk_score", "risk_level", "confidence",
            p["High"].alias("p_high"), p["Medium"].alias("p_medium"), p["Low"].alias("p_low"),
            risk_colour("risk_level").alias("colour"),
        )
    )


@register("m12_risk_forest")
def m12_risk_forest(spark, sf_dir):
    """M12 (rows-only): forest trained on every district's features, then scored."""
    feats = materialize(_features(spark, sf_dir))
    model = RK.train_risk(feats, materialize_input=False)
    return RK.predict_risk(model, feats)


@register("m13_feature_importance")
def m13_feature_importance(spark, sf_dir):
    """M13/L8 (rows-only): normalised forest importances, largest first."""
    return RK.feature_importance(spark, RK.train_risk(_features(spark, sf_dir)))


@register("m12_forest_from_nodes", "with " + _FEATURES_SQL + "\nselect district, true as same_level, 0e0 as gap from featr")
def m12_forest_from_nodes(spark, sf_dir):
    """M12 from the saved forest's nodes: every district's level is MLlib's own, and the largest gap of a
    probability is none (the oracle lists the districts and asks for that)."""
    feats = materialize(_features(spark, sf_dir))
    model = RK.train_risk(feats, materialize_input=False)
    nodes = TR.node_table(spark, model.stages[-1])
    cols = ["district", "risk_level", "probabilities"]
    own = RK.predict_risk_nodes(nodes, list(model.stages[0].labels), feats).select(cols).alias("a")
    both = own.join(RK.predict_risk(model, feats).select(cols).alias("b"), "district")
    gap = F.zip_with(F.map_values("a.probabilities"), F.map_values("b.probabilities"), lambda x, y: F.abs(x - y))
    return r6(both.select("district", (F.col("a.risk_level") == F.col("b.risk_level")).alias("same_level"), F.array_max(gap).alias("gap")))


@register(
    "m13_importance_from_nodes",
    "select feature, 0e0 as gap from (select unnest([" + ", ".join(f"'{c}'" for c in RK.FEATURES) + "]) as feature)",
)
def m13_importance_from_nodes(spark, sf_dir):
    """M13/L8 from the saved forest's nodes: no feature's importance differs from MLlib's."""
    model = RK.train_risk(_features(spark, sf_dir))
    own = TR.importances(TR.node_table(spark, model.stages[-1]), RK.FEATURES).alias("a")
    both = own.join(RK.feature_importance(spark, model).alias("b"), "feature")
    return r6(both.select("feature", F.abs(F.col("a.importance") - F.col("b.importance")).alias("gap")))


@register("m14_cross_validate_risk")
def m14_cross_validate_risk(spark, sf_dir):
    """M14 (rows-only): 3-fold cross-validated accuracy."""
    return RK.cross_validate_risk(spark, _features(spark, sf_dir), folds=3)


_FOLDS_SQL = _FEATURES_SQL + """,
folded as (select *, cast(cast('0x' || substr(md5(district || ':42'), 1, 8) as bigint) % 3 as bigint) as fold from lv where risk_level is not null)"""


@register(
    "m14_out_of_fold",
    "with " + _FOLDS_SQL + """
select f.district, f.fold, f.risk_level as label, (select count(*) from folded o where o.fold <> f.fold) as fitted_to, true as is_mllibs, 0e0 as gap from folded f""",
)
def m14_out_of_fold(spark, sf_dir):
    """M14's folds by a keyed hash: every district's level by the forest of the other folds, as one plan over the node
    tables, is the level that MLlib's own transform gives, and so is its confidence (the oracle knows
    folds, labels and sizes, and asks for no difference)."""
    data = RK.with_folds(_features(spark, sf_dir))
    fitted = RK.fold_forests(data)
    own = RK.out_of_fold(spark, data, fitted).alias("a")
    told = []
    for fold, model in fitted.items():
        held = data.where(F.col("fold") == fold)
        if model is None or isinstance(model, str):
            level = F.lit(model).cast("string")
            told.append(held.select("district", level.alias("risk_level"), F.when(level.isNotNull(), 1.0).alias("confidence")))
        else:
            told.append(RK.predict_risk(model, held).select("district", "risk_level", "confidence"))
    if not told:
        told = [data.select("district", F.col("label").alias("risk_level"), F.lit(1.0).alias("confidence"))]
    sizes = data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    others = sizes.select("fold", (data.agg(F.count(F.lit(1))).scalar() - F.col("n")).alias("fitted_to"))
    both = own.join(reduce(DataFrame.unionByName, told).alias("b"), "district").join(others, "fold")
    same = F.col("a.prediction").eqNullSafe(F.col("b.risk_level"))
    gap = F.abs(F.col("a.confidence") - F.col("b.confidence"))
    return r6(both.select("district", "fold", "label", "fitted_to", same.alias("is_mllibs"), F.coalesce(gap, F.lit(0.0)).alias("gap")))


@register("m14_fold_metrics")
def m14_fold_metrics(spark, sf_dir):
    """M14 (rows-only): accuracy of each fold and the confidence of right and wrong levels."""
    data = RK.with_folds(_features(spark, sf_dir))
    return r6(RK.fold_metrics(RK.out_of_fold(spark, data, RK.fold_forests(data))))


@register(
    "a25_classification_metrics",
    "with "
    + _FEATURES_SQL
    + """,
hot as (select district, case when count(*) >= 150 then 'High' when count(*) >= 95 then 'Medium' else 'Low' end as p from incidents_hourly where district is not null group by 1),
pairs as (select lv.risk_level as l, hot.p from lv join hot on lv.district = hot.district where lv.risk_level is not null),
labels as (select l from pairs union select p from pairs),
per as (select labels.l, count(*) filter (where pairs.l = labels.l) as support, count(*) filter (where pairs.l = labels.l and pairs.p = labels.l) as tp,
               count(*) filter (where pairs.p = labels.l) as predicted from labels, pairs group by labels.l),
pr as (select *, case when predicted > 0 then tp * 1e0 / predicted else 0e0 end as prec, case when support > 0 then tp * 1e0 / support else 0e0 end as rec from per)
select round(sum(tp) * 1e0 / sum(support), 6) as accuracy, round(sum(prec * support) / sum(support), 6) as precision, round(sum(rec * support) / sum(support), 6) as recall,
       round(sum(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0e0 end * support) / sum(support), 6) as f1 from pr""",
)
def a25_classification_metrics(spark, sf_dir):
    """A25 of the hotspot level as a prediction of the rule level (both can be told in SQL)."""
    truth = RK.rule_risk(_features(spark, sf_dir)).where("risk_level is not null").select("district", F.col("risk_level").alias("label"))
    guess = HS.hotspots(fixtures(spark, sf_dir).incidents_hourly).select(F.col("name").alias("district"), F.col("risk").alias("prediction"))
    return r6(RK.classification_metrics(truth.join(guess, "district")))


@register("a25_forest_held_out")
def a25_forest_held_out(spark, sf_dir):
    """A25 (rows-only): the forest on districts that it was not trained on."""
    return r6(RK.held_out_metrics(materialize(_features(spark, sf_dir))))


def _retrained(spark, sf_dir, kind):
    fx = fixtures(spark, sf_dir)
    return flows.retrain(fx.incidents_monthly, kind=kind, risk_df=fx.incidents_hourly, dim=fx.district_dim, class_map=CLASS_MAP)


@register("m15_retrain")
def m15_retrain(spark, sf_dir):
    """M15 (rows-only): gates, back-test of three models on the monthly view, forest on the hourly view."""
    return r6(_retrained(spark, sf_dir, "all").summary)


@register(
    "m15_retrain_districts",
    _BACKTEST_CTES
    + """
select s.district, s.model, round(s.mae, 6) as mae, round(s.mse, 6) as mse, s.n_test, i.total_records, i.districts, i.crime_types, i.span_days
from scores s, (select count(*) as total_records, count(distinct district) as districts, count(distinct crime_type) as crime_types,
                       datediff('day', min(cast(ts as date)), max(cast(ts as date))) as span_days from incidents_monthly) i""",
)
def m15_retrain_districts(spark, sf_dir):
    """M15's rows per district of the two models that SQL can tell, with the summary's counts."""
    done = _retrained(spark, sf_dir, "forecast")
    one = done.summary.first()
    counts = [F.lit(one[c]).cast("long").alias(c) for c in ("total_records", "districts", "crime_types", "span_days")]
    return r6(done.districts.where("model <> 'lstm'").select("district", "model", "mae", "mse", "n_test", *counts))


# ---------------------------------------------------------------- hotspots ---


@register(
    "a27_hotspots",
    """
select district as name, round(avg(latitude), 6) as lat, round(avg(longitude), 6) as lng, count(*) as crimes,
       case when count(*) >= 150 then 'High' when count(*) >= 95 then 'Medium' else 'Low' end as risk,
       case when count(*) >= 150 then 'red' when count(*) >= 95 then 'orange' else 'green' end as colour,
       count(*) * 20 as radius
from incidents_hourly where district is not null group by district""",
)
def a27_hotspots(spark, sf_dir):
    return r6(HS.hotspots(fixtures(spark, sf_dir).incidents_hourly))


@register(
    "a28_heat_grid",
    """
select cell_y, cell_x, count(*) as crimes, round((cell_y + 0.5e0) * 0.01e0, 6) as lat, round((cell_x + 0.5e0) * 0.01e0, 6) as lng
from (select cast(floor(latitude / 0.01e0) as bigint) as cell_y, cast(floor(longitude / 0.01e0) as bigint) as cell_x
      from incidents_hourly where latitude is not null and longitude is not null) g
group by 1, 2""",
)
def a28_heat_grid(spark, sf_dir):
    return r6(HS.heat_grid(fixtures(spark, sf_dir).incidents_hourly, 0.01))


@register(
    "a29_region_totals",
    """
select state, district, count(*) as crimes,
       case grouping(state, district) when 0 then 'district' when 1 then 'state' else 'all' end as level
from incidents_hourly group by rollup (state, district)""",
)
def a29_region_totals(spark, sf_dir):
    return r6(HS.region_totals(fixtures(spark, sf_dir).incidents_hourly))


# ------------------------------------------------------------------ charts ---


@register(
    "m16_chart_model_performance",
    _BACKTEST_CTES
    + """
select s.district, s.model, round(s.mae, 6) as mae, printf('%.1f', s.mae) as mae_label, s.model = b.best_model as is_best
from scores s left join best b on s.district = b.district""",
)
def m16_chart_model_performance(spark, sf_dir):
    """Model-performance chart rows: one backtest pass, best model by a district window."""
    scores = FC.backtest(_monthly_series(spark, sf_dir, reused=False), materialize_input=False)
    return r6(CH.model_performance_rows(scores))


@register(
    "m16_chart_forecast_trend",
    _FORECAST_SQL
    + """, hfc as (select * from harima union all select * from hsarima)
select f.district, f.month, upper(f.model) as series, round(greatest(0e0, f.yhat), 6) as value, f.model = b.best_model as is_best
from hfc f left join best b on f.district = b.district""",
)
def m16_chart_forecast_trend(spark, sf_dir):
    """Trend chart rows from the one-pass forecast table (M6)."""
    table = FC.forecast_table(_monthly_series(spark, sf_dir, reused=False), 6, materialize_input=False)
    return r6(CH.trend_rows_from_table(table))


@register(
    "m16_chart_parameters",
    "with "
    + _FEATURES_SQL
    + "\nselect district, case parameter "
    + " ".join(
        f"when '{c}' then '{lbl}'"
        for c, lbl in zip(_FEATURE_COLS, ["Total Crimes", "Crime Rate", "Violent Crimes", "Property Crimes", "Drug Crimes", "Evening Crimes %", "Night Crimes %", "Weekend Crimes %"])
    )
    + " end as parameter, round(value, 6) as value from (unpivot (select district, "
    + ", ".join(f"cast({c} as double) as {c}" for c in _FEATURE_COLS)
    + " from featr) on "
    + ", ".join(_FEATURE_COLS)
    + " into name parameter value value) u",
)
def m16_chart_parameters(spark, sf_dir):
    return r6(CH.parameter_rows(_features(spark, sf_dir)))


@register(
    "a26_training_info",
    """
select count(*) as total_records, count(distinct district) as districts, count(distinct crime_type) as crime_types,
       datediff('day', min(cast(ts as date)), max(cast(ts as date))) as span_days, 'arima,sarima' as models
from incidents_monthly""",
)
def a26_training_info(spark, sf_dir):
    """A26 with the models that the back-test of this request ran."""
    scores = FC.backtest(_monthly_series(spark, sf_dir, reused=False), materialize_input=False)
    ran = {r["model"] for r in scores.select("model").distinct().collect()}  # one row per model
    return r6(flows.training_info(fixtures(spark, sf_dir).incidents_monthly, models=[m for m in _THREE if m in ran]))
