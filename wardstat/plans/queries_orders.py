"""Registered queries: autoregressions of selected order, and the seasonal ones with both polynomials."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstat.operators import autoregress as AR
from wardstat.operators import forecast as FC
from wardstat.plans.catalog import r6, register
from wardstat.plans.queries_model import _SERIES, _monthly_series

_PARTS = ("z1", "zs", "zs1", "1e0")


def _cholesky_sql(src: str, m: int) -> str:
    """CTEs ``{src}_l<j>`` (a column of the factor's row each) and ``{src}_x`` (the solution c0 .. c<m-1>)."""
    ctes, last = [], src
    for j in range(m):
        for i in range(j + 1):
            inner = " + ".join([f"l{i}{k} * l{j}{k}" for k in range(i)]) or "0e0"
            value = (
                f"case when g{j}{j} - ({inner}) > 1e-9 * g{j}{j} then sqrt(g{j}{j} - ({inner})) else 0e0 end" if i == j
                else f"case when l{i}{i} > 0 then (g{j}{i} - ({inner})) / l{i}{i} else 0e0 end"
            )
            ctes.append(f"{src}_l{j}{i} as (select *, {value} as l{j}{i} from {last})")
            last = f"{src}_l{j}{i}"
    for j in range(m):
        inner = " + ".join([f"l{j}{k} * h{k}" for k in range(j)]) or "0e0"
        ctes.append(f"{src}_h{j} as (select *, case when l{j}{j} > 0 then (b{j} - ({inner})) / l{j}{j} else 0e0 end as h{j} from {last})")
        last = f"{src}_h{j}"
    for j in reversed(range(m)):
        inner = " + ".join([f"l{k}{j} * c{k}" for k in range(j + 1, m)]) or "0e0"
        ctes.append(f"{src}_c{j} as (select *, case when l{j}{j} > 0 then (h{j} - ({inner})) / l{j}{j} else 0e0 end as c{j} from {last})")
        last = f"{src}_c{j}"
    return ",\n".join([*ctes, f"{src}_x as (select * from {last})"])


def _orders_sql(frame: str, p: str = "") -> str:
    """AR orders and forecasts ({p}best, {p}arima) and seasonal forecasts ({p}sarima) over a frame
    district, month, y, t, tt (fit end), hh (steps)."""
    gram = ", ".join(
        [f"coalesce(sum({a} * {b}), 0e0) as g{j}{i}" for j, a in enumerate(_PARTS) for i, b in enumerate(_PARTS) if i <= j]
        + [f"coalesce(sum({a} * z), 0e0) as b{j}" for j, a in enumerate(_PARTS)]
    )
    sql = """
{p}w1 as (select *, y - lag(y) over (partition by district order by t) as d1 from {frame}),
{p}w2 as (select *, d1 - lag(d1) over (partition by district order by t) as d2 from {p}w1),
{p}long as (select district, t, tt, 0 as d, y as w from {p}w2 union all select district, t, tt, 1, d1 from {p}w2 union all select district, t, tt, 2, d2 from {p}w2),
{p}own as (select * from {p}long where t > 2 and t <= tt),
{p}mn as (select district, d, avg(w) as mean, cast(count(*) as double) as n from {p}own group by 1, 2),
{p}e as (select o.district, o.d, o.t, w - mean as e, n, mean from {p}own o join {p}mn using (district, d)),
{p}ac as (select a.district, a.d, k, any_value(a.n) as n, sum(a.e * b.e) / any_value(a.n) as r
          from (select *, unnest(range(0, 13)) as k from {p}e) a join {p}e b on b.district = a.district and b.d = a.d and b.t = a.t - a.k group by 1, 2, 3),
{p}rl as (select district, d, any_value(n) as n, list(r order by k) as r from {p}ac group by 1, 2 having any_value(n) > 4),
{p}lev as (
  select district, d, n, r, 0 as p, cast([] as double[]) as phi, r[1] as v from {p}rl
  union all
  select district, d, n, r, p + 1, list_append(list_transform(range(1, p + 1), lambda j: phi[j] - kappa * phi[p + 1 - j]), kappa), v * (1 - kappa * kappa)
  from (select *, (r[p + 2] - coalesce(list_sum(list_transform(range(1, p + 1), lambda j: phi[j] * r[p + 2 - j])), 0e0)) / v as kappa
        from {p}lev where p < 12 and v > 1e-9 * r[1] and n - p - 4 > 0)),
{p}crit as (select *, case when v > 0 then n * ln(v) + 2e0 * (p + 2) * n / (n - p - 3) else -1e308 end as aicc from {p}lev),
{p}best as (select district, unnest(arg_min({{'d': d, 'p': p, 'phi': phi, 'variance': v, 'aicc': aicc}}, (aicc, d, p))) from {p}crit group by district),
{p}tail as (select district, max(tt) as tt, max(hh) as hh, max_by(y, t) as y_end, max_by(d1, t) as dy_end, max_by(month, t) as m_end from {p}w2 where t <= tt group by 1),
{p}rec0 as (select b.district, b.d, b.p, b.phi, any_value(e.mean) as mean, list(e.e order by e.t desc)[1:b.p] as recent, tt, hh, m_end, y_end as y, dy_end as dy
            from {p}best b join {p}e e on e.district = b.district and e.d = b.d join {p}tail f on f.district = b.district
            group by b.district, b.d, b.p, b.phi, tt, hh, m_end, y_end, dy_end),
{p}rec as (
  select *, cast(0 as bigint) as k from {p}rec0
  union all
  select district, d, p, phi, mean, list_prepend(e, recent)[1:p], tt, hh, m_end,
         case d when 0 then mean + e when 1 then y + mean + e else y + dy + mean + e end, case d when 2 then dy + mean + e else mean + e end, k + 1
  from (select *, coalesce(list_sum(list_transform(range(1, p + 1), lambda j: phi[j] * recent[j])), 0e0) as e from {p}rec where k < hh)),
{p}arima as (select district, 'arima' as model, k, tt + k as t, cast(m_end + to_months(cast(k as integer)) as date) as month, y as yhat from {p}rec where k > 0),
{p}z0 as (select *, y - lag(y, 12) over (partition by district order by t) as z from {frame}),
{p}z as (select *, lag(z) over o as z1, lag(z, 12) over o as zs, lag(z, 13) over o as zs1 from {p}z0 window o as (partition by district order by t)),
{p}g as (select district, {gram} from {p}z where t <= tt and zs1 is not null group by district),
{chol},
{p}s0 as (select f.district, f.tt, f.hh, f.m_end, coalesce(c0, 0e0) as c0, coalesce(c1, 0e0) as c1, coalesce(c2, 0e0) as c2, coalesce(c3, 0e0) as c3,
                 list_reverse(list(s.z order by s.t desc)[1:13]) as z, list_reverse(list(s.y order by s.t desc)[1:12]) as y
          from {p}tail f join {p}z s on s.district = f.district and s.t <= f.tt left join {p}g_x x on x.district = f.district
          group by f.district, f.tt, f.hh, f.m_end, c0, c1, c2, c3),
{p}srec as (
  select *, cast(0 as bigint) as k from {p}s0 where len(y) = 12
  union all
  select district, tt, hh, m_end, c0, c1, c2, c3, list_append(z, nz)[2:], list_append(y, y[-12] + nz)[2:], k + 1
  from (select *, c0 * z[-1] + c1 * z[-12] + c2 * z[-13] + c3 as nz from {p}srec where k < hh)),
{p}sarima as (select district, 'sarima' as model, k, tt + k as t, cast(m_end + to_months(cast(k as integer)) as date) as month, y[-1] as yhat from {p}srec where k > 0)"""
    return sql.format(p=p, frame=frame, gram=gram, chol=_cholesky_sql(f"{p}g", 4))


_WITH = "with recursive " + _SERIES.lstrip() + "," + _orders_sql("bt")
_SCORES = _WITH + """,
fc as (select * from arima union all select * from sarima),
scores as (select fc.district, fc.model, avg(abs(bt.y - yhat)) as mae, avg((bt.y - yhat) * (bt.y - yhat)) as mse, count(*) as n_test,
                  sqrt(avg((bt.y - yhat) * (bt.y - yhat))) as rmse
           from fc join bt on fc.district = bt.district and fc.t = bt.t group by 1, 2),
ranked as (select *, case model when 'arima' then 0 else 1 end as model_rank from scores),
best_one as (select district, arg_min(model, (mae, model_rank)) as best_model from ranked group by district)
"""


@register(
    "m17_order_by_criterion",
    _WITH + "\nselect district, cast(d as bigint) as d, cast(p as bigint) as p, round(aicc, 6) as aicc, round(variance, 6) as variance, round(coalesce(list_sum(phi), 0e0), 6) as phi_sum from best",
)
def m17_order_by_criterion(spark, sf_dir):
    """Difference and order of the autoregression by AICc, over 39 candidates for each district."""
    chosen = AR.select_orders(_monthly_series(spark, sf_dir, reused=False))
    total = F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    return r6(chosen.select("district", "d", "p", "aicc", "variance", total.alias("phi_sum")))


@register(
    "m1_forecast_orders",
    _WITH + "\nselect district, model, k, t, month, round(yhat, 6) as yhat from arima",
)
def m1_forecast_orders(spark, sf_dir):
    """M1: forecasts of the selected autoregression over the held-out months."""
    return r6(AR.forecast_orders(FC.backtest_frame(_monthly_series(spark, sf_dir, reused=False)), ("arima",)))


@register(
    "m2_forecast_both_polynomials",
    _WITH + "\nselect district, model, k, t, month, round(yhat, 6) as yhat from sarima",
)
def m2_forecast_both_polynomials(spark, sf_dir):
    """M2: seasonal autoregression with a monthly and a yearly polynomial over the held-out months."""
    return r6(AR.forecast_orders(FC.backtest_frame(_monthly_series(spark, sf_dir, reused=False)), ("sarima",)))


@register(
    "m5_backtest_orders",
    _SCORES + "select district, model, round(mae, 6) as mae, round(mse, 6) as mse, round(rmse, 6) as rmse, n_test from scores",
)
def m5_backtest_orders(spark, sf_dir):
    """M5 (A18, A19) of both models with selected orders."""
    return r6(AR.backtest_orders(_monthly_series(spark, sf_dir, reused=False)))


@register(
    "m6_forecast_orders",
    _SCORES + ", hz as (select *, n as tt, 6 as hh from len where n >= 24)," + _orders_sql("hz", "a_") + """
select a.district, a.k, a.month, strftime(a.month, '%Y-%m-%d') as date, round(greatest(0e0, a.yhat), 6) as arima, round(greatest(0e0, s.yhat), 6) as sarima, best_model,
       round(case best_model when 'arima' then greatest(0e0, a.yhat) else greatest(0e0, s.yhat) end, 6) as best_value
from a_arima a left join a_sarima s on s.district = a.district and s.k = a.k left join best_one b on b.district = a.district""",
)
def m6_forecast_orders(spark, sf_dir):
    """M6 with M4: six months ahead by both models with selected orders, and the better one on the hold-out."""
    return r6(AR.forecast_table_orders(_monthly_series(spark, sf_dir, reused=False), 6))
