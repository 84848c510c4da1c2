"""Queries of estimators, risk metrics and portfolio weights over the asset returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators import estimators as est
from ..operators import features as feat
from ..sources.tables import asset_prices, asset_returns, events_series, table
from .common import BY_TYPE, Registry, r6, rounded, sql6

R = Registry()

_P = "p AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, event_type AS asset, avg(value) AS price FROM events GROUP BY 1, 2)"
_R = f"WITH {_P}, r AS (SELECT * FROM (SELECT ts, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM p) WHERE ret IS NOT NULL)"
_PAIRS = _R + ", x AS (SELECT a.ts, a.asset AS asset_i, b.asset AS asset_j, a.ret AS ri, b.ret AS rj FROM r a JOIN r b USING (ts))"
_EMP = _PAIRS + ", s AS (SELECT asset_i, asset_j, covar_pop(ri, rj) AS cov FROM x GROUP BY 1, 2)"


@R.add("asset_returns", _R + f" SELECT ts, asset, {sql6('ret')} AS ret FROM r")
def returns(spark, d):
    return rounded(est.returns(asset_prices(spark, d)), "ts", "asset", ret="ret")


@R.add("weekly_returns", f"WITH {_P}, w AS (SELECT date_trunc('week', ts)::TIMESTAMP AS ts, asset, arg_max(price, ts) AS price FROM p GROUP BY 1, 2) SELECT * FROM (SELECT ts, asset, {sql6('price / lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1')} AS ret FROM w) WHERE ret IS NOT NULL")
def weekly_returns(spark, d):
    return rounded(est.returns(asset_prices(spark, d), "week"), "ts", "asset", ret="ret")


@R.add("mean_returns", _R + f" SELECT asset, {sql6('avg(ret) * 252')} AS mean FROM r GROUP BY 1")
def mean_returns(spark, d):
    return rounded(est.mean_returns(asset_returns(spark, d)), "asset", mean="mean")


def _weight(span: float, part: str) -> str:
    return f"pow(1 - 2.0::DOUBLE / {span + 1}, row_number() OVER (PARTITION BY {part} ORDER BY ts DESC) - 1)"


@R.add("exponential_returns", _R + f", w AS (SELECT *, {_weight(20, 'asset')} AS w FROM r) SELECT asset, {sql6('sum(w * ret) / sum(w) * 252')} AS mean FROM w GROUP BY 1")
def exponential_returns(spark, d):
    return rounded(est.exponential_returns(asset_returns(spark, d), span=20), "asset", mean="mean")


def _cov(df):
    return rounded(df, "asset_i", "asset_j", cov="cov", digits=8)


@R.add("sample_cov", _PAIRS + f" SELECT asset_i, asset_j, {sql6('covar_samp(ri, rj)', 8)} AS cov FROM x GROUP BY 1, 2")
def sample_cov(spark, d):
    return _cov(est.sample_covariance(asset_returns(spark, d)))


@R.add("empirical_cov", _EMP + f" SELECT asset_i, asset_j, {sql6('cov', 8)} AS cov FROM s")
def empirical_cov(spark, d):
    return _cov(est.empirical_covariance(asset_returns(spark, d)))


_SIZE = _EMP + ", z AS (SELECT sqrt(count(*)) AS p, sum(cov) FILTER (asset_i = asset_j) / sqrt(count(*)) AS mu, sum(cov * cov) AS ss FROM s), t AS (SELECT count(DISTINCT ts) AS t FROM r)"


def _shrunk(delta: str) -> str:
    return f" SELECT asset_i, asset_j, {sql6(f'(1 - {delta}) * cov + CASE WHEN asset_i = asset_j THEN {delta} * mu ELSE 0 END', 8)} AS cov FROM s, z"


@R.add("shrunk_cov", _SIZE + _shrunk("0.1"))
def shrunk_cov(spark, d):
    return _cov(est.shrunk_covariance(asset_returns(spark, d)))


@R.add("shrunk_cov_oas", _SIZE + ", k AS (SELECT least((ss / (p * p) + mu * mu) / ((t + 1) * (ss / (p * p) - mu * mu / p)), 1) AS dl FROM z, t)" + _shrunk("dl") + ", k")
def shrunk_cov_oas(spark, d):
    return _cov(est.shrunk_covariance(asset_returns(spark, d), "oas"))


@R.add("shrunk_cov_lw", _SIZE + """, m AS (SELECT asset, avg(ret) AS m FROM r GROUP BY 1), n AS (SELECT ts, sum(pow(ret - m, 2)) AS n2 FROM r JOIN m USING (asset) GROUP BY 1),
  k AS (SELECT least((f / t - ss) / (p * t), sp) / sp AS dl FROM (SELECT (SELECT sum(n2 * n2) FROM n) AS f, t, ss, p, (ss - 2 * mu * mu * p + p * mu * mu) / p AS sp FROM z, t))""" + _shrunk("dl") + ", k")
def shrunk_cov_lw(spark, d):
    return _cov(est.shrunk_covariance(asset_returns(spark, d), "lw"))


@R.add("semi_cov", _PAIRS + f", y AS (SELECT asset_i, asset_j, sum(least(ri, 0) * least(rj, 0)) / count(*) AS cov FROM x GROUP BY 1, 2) SELECT asset_i, asset_j, {sql6('cov / count(*) OVER (PARTITION BY asset_i)', 8)} AS cov FROM y")
def semi_cov(spark, d):
    return _cov(est.semi_covariance(asset_returns(spark, d)))


@R.add("exp_cov", _PAIRS + f""", y AS (SELECT *, (ri - avg(ri) OVER (PARTITION BY asset_i, asset_j)) * (rj - avg(rj) OVER (PARTITION BY asset_i, asset_j)) AS q, {_weight(10, "asset_i, asset_j")} AS w FROM x)
  SELECT asset_i, asset_j, {sql6("sum(w * q) / sum(w)", 8)} AS cov FROM y GROUP BY 1, 2""")  # fmt: skip
def exp_cov(spark, d):
    return _cov(est.exponential_covariance(asset_returns(spark, d), 10))


_CORR = _EMP + ", d AS (SELECT asset_i AS asset, sqrt(cov) AS std FROM s WHERE asset_i = asset_j), c AS (SELECT s.asset_i, s.asset_j, greatest(-1, least(1, cov / (a.std * b.std))) AS corr FROM s JOIN d a ON a.asset = s.asset_i JOIN d b ON b.asset = s.asset_j)"


@R.add("cov_to_corr", _CORR + f" SELECT asset_i, asset_j, {sql6('corr')} AS corr FROM c")
def cov_to_corr(spark, d):
    return rounded(est.to_correlation(est.empirical_covariance(asset_returns(spark, d))), "asset_i", "asset_j", corr="corr")


@R.add("corr_to_cov", _EMP + f" SELECT asset_i, asset_j, {sql6('cov', 8)} AS cov FROM s")
def corr_to_cov(spark, d):
    c = est.empirical_covariance(asset_returns(spark, d))
    std = c.where("asset_i = asset_j").select(F.col("asset_i").alias("asset"), F.sqrt("cov").alias("std"))
    return _cov(est.to_covariance(est.to_correlation(c), std))


_IV = _R + ", v AS (SELECT asset, 1 / var_samp(ret) AS w FROM r GROUP BY 1), iv AS (SELECT asset, w / sum(w) OVER () AS weight FROM v)"


@R.add("inverse_variance", _IV + f" SELECT asset, {sql6('weight')} AS weight FROM iv")
def inverse_variance(spark, d):
    return rounded(est.inverse_variance(asset_returns(spark, d)), "asset", weight="weight")


@R.add("portfolio_variance", _IV + f", c AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) AS cov FROM r a JOIN r b USING (ts) GROUP BY 1, 2) SELECT {sql6('sum(cov * x.weight * y.weight)', 8)} AS variance FROM c JOIN iv x ON x.asset = i JOIN iv y ON y.asset = j")
def portfolio_variance(spark, d):
    r = asset_returns(spark, d)
    return est.portfolio_variance(est.sample_covariance(r), est.inverse_variance(r)).select(r6("variance", 8).alias("variance"))


def _higher(table_: str, column: str, p: float, out: str) -> str:
    return f"{out} AS (SELECT asset, {column} AS q FROM (SELECT asset, {column}, row_number() OVER (PARTITION BY asset ORDER BY {column}) AS i, count(*) OVER (PARTITION BY asset) AS n FROM {table_}) WHERE i = ceil(round({p} * (n - 1), 9)) + 1)"


@R.add("var_cvar_cdar", _R + f""", {_higher("r", "ret", 0.05, "v")}, e AS (SELECT asset, avg(CASE WHEN ret < q THEN ret END) AS es FROM r JOIN v USING (asset) GROUP BY 1),
  d AS (SELECT *, max(ret) OVER (PARTITION BY asset ORDER BY ts) - ret AS dd FROM r), m AS (SELECT *, max(dd) OVER (PARTITION BY asset ORDER BY ts) AS mdd FROM d), {_higher("m", "mdd", 0.95, "c")},
  k AS (SELECT asset, avg(CASE WHEN mdd >= q THEN mdd END) AS cd FROM m JOIN c USING (asset) GROUP BY 1)
  SELECT asset, {sql6("v.q")} AS var, {sql6("es")} AS expected_shortfall, {sql6("cd")} AS conditional_drawdown FROM v LEFT JOIN e USING (asset) LEFT JOIN k USING (asset)""")  # fmt: skip
def var_cvar_cdar(spark, d):
    r = asset_returns(spark, d)
    out = est.value_at_risk(r).join(est.expected_shortfall(r), "asset", "left").join(est.conditional_drawdown(r), "asset", "left")
    return rounded(out, "asset", var="var", expected_shortfall="expected_shortfall", conditional_drawdown="conditional_drawdown")


# Features with closed forms.

_WS = feat.weights_ffd(0.4, 0.05)


@R.add("frac_diff_ffd", f"WITH {BY_TYPE} SELECT series_id, ts, {sql6(' + '.join(f'lag(close, {k}) OVER w * {c!r}::DOUBLE' for k, c in enumerate(_WS)))} AS frac_diff FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)")
def frac_diff_ffd(spark, d):
    return rounded(feat.frac_diff_ffd(events_series(spark, d, "event_type"), 0.4, 0.05), "series_id", "ts", frac_diff="frac_diff")


@R.add("frac_diff_weights", f"""WITH RECURSIVE g AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4::DOUBLE - (k + 1) + 1) / (k + 1) FROM g WHERE k < 9),
  f AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4::DOUBLE - (k + 1) + 1) / (k + 1) FROM f WHERE abs(-w * (0.4::DOUBLE - (k + 1) + 1) / (k + 1)) >= 0.01)
  SELECT 'expanding' AS kind, k::BIGINT AS k, {sql6("w", 9)} AS w FROM g UNION ALL SELECT 'fixed', k::BIGINT, {sql6("w", 9)} FROM f""")  # fmt: skip
def frac_diff_weights(spark, d):
    rows = [("expanding", k, w) for k, w in enumerate(feat.weights(0.4, 10))] + [("fixed", k, w) for k, w in enumerate(feat.weights_ffd(0.4, 0.01))]
    return rounded(spark.createDataFrame(rows, "kind string, k bigint, w double"), "kind", "k", w="w", digits=9)


def _contracts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("instrument"))
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    return o.groupBy("instrument", day.alias("ts")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.avg("o_totalprice").alias("vwap")).withColumn("series_id", F.lit(1))


@R.add("futures_roll", f"""WITH c AS (SELECT 1 AS series_id, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS instrument, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close, avg(o_totalprice) AS vwap FROM orders GROUP BY 1, 2, 3),
  j AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument ORDER BY ts) = 1 THEN coalesce(open - lag(close) OVER (ORDER BY ts), 0) ELSE 0 END AS jump FROM c),
  g AS (SELECT *, sum(jump) OVER (ORDER BY ts) - sum(jump) OVER () AS gap FROM j)
  SELECT ts, instrument, {sql6("gap", 4)} AS gap, {sql6("close - gap", 4)} AS close, {sql6("vwap - gap", 7)} AS vwap FROM g""")  # fmt: skip
def futures_roll(spark, d):
    out = feat.roll_futures(_contracts(spark, d))
    return out.select("ts", "instrument", r6("gap", 4).alias("gap"), r6("close", 4).alias("close"), r6("vwap", 7).alias("vwap"))


# Solvers: rows only, tested by properties.


def _plain(name, build):
    R.add(name)(build)




@R.add("frac_diff", f"""WITH RECURSIVE {BY_TYPE}, x AS (SELECT series_id, ts, close, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
  most AS (SELECT max(n) AS n FROM x), g AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4::DOUBLE - (k + 1) + 1) / (k + 1) FROM g, most WHERE k + 1 < n),
  c AS (SELECT n, sum(abs(w)) OVER (PARTITION BY n ORDER BY k DESC) / sum(abs(w)) OVER (PARTITION BY n) AS share FROM (SELECT DISTINCT n FROM x), g WHERE k < n),
  skip AS (SELECT n, count(*) FILTER (share > 0.01) AS skip FROM c GROUP BY n),
  f AS (SELECT a.series_id, a.ts, a.t, a.n, sum(w * b.close) AS v FROM x a JOIN x b ON a.series_id = b.series_id AND b.t <= a.t JOIN g ON k = a.t - b.t GROUP BY ALL)
  SELECT series_id, ts, CASE WHEN t >= skip THEN {sql6("v")} END AS frac_diff FROM f JOIN skip USING (n)""")  # fmt: skip
def frac_diff(spark, d):
    return rounded(feat.frac_diff(events_series(spark, d, "event_type"), 0.4, order=("ts", "seq"), block_rows=1 << 14), "series_id", "ts", frac_diff="frac_diff")


_plain("frac_diff_orders", lambda s, d: feat.order_table(events_series(s, d, "event_type"), [i / 10 for i in range(11)]))
_plain("frac_diff_min_order", lambda s, d: feat.min_order(events_series(s, d, "event_type"), num=21))
for _name in ("min_volatility", "max_return_min_volatility", "max_sharpe", "max_diversification", "max_decorrelation"):
    _plain(f"mv_{_name}", lambda s, d, n=_name: al.mean_variance(asset_returns(s, d), n))


def _middle(s, d):
    """A return between those of the safest and the best portfolio, and a risk above the least."""
    r = asset_returns(s, d)
    from ..operators import solvers

    _, mean, cov = al.inputs(r)
    w = solvers.min_volatility(cov, solvers.bounds_of(len(mean)))
    return r, float((w @ mean + mean.max()) / 2), float(w @ cov @ w * 1.5)


def _efficient_risk(s, d):
    r, target, _ = _middle(s, d)
    return al.mean_variance(r, "efficient_risk", target_return=target)


def _efficient_return(s, d):
    r, _, risk = _middle(s, d)
    return al.mean_variance(r, "efficient_return", target_risk=risk)


_plain("mv_efficient_risk", _efficient_risk)
_plain("mv_efficient_return", _efficient_return)
_plain("mv_custom", lambda s, d: al.custom_objective(asset_returns(s, d), lambda w, m, c: float(w @ c @ w)))
_plain("mv_frontier", lambda s, d: al.efficient_frontier(asset_returns(s, d)))
_plain("cla_turning_points", lambda s, d: al.critical_line(asset_returns(s, d)))
_plain("cla_min_variance", lambda s, d: al.critical_line(asset_returns(s, d), "min_variance"))
_plain("cla_max_sharpe", lambda s, d: al.critical_line(asset_returns(s, d), "max_sharpe"))
_plain("cla_frontier", lambda s, d: al.critical_line(asset_returns(s, d), "frontier"))
_plain("hrp", lambda s, d: al.hierarchical(asset_returns(s, d)))
_plain("hrp_rescaled", lambda s, d: al.hierarchical_rescaled(asset_returns(s, d)))
_plain("nco", lambda s, d: al.nested_clusters(asset_returns(s, d)))
_plain("nco_monte_carlo", lambda s, d: al.nested_monte_carlo(asset_returns(s, d), n_obs=60))
_plain("denoised_cov", lambda s, d: al.denoised_covariance(asset_returns(s, d)))
_plain("robust_cov", lambda s, d: al.robust_covariance(asset_returns(s, d)))


def _pca(s, d):
    names, cov = est.matrix(est.empirical_covariance(asset_returns(s, d)))
    return s.createDataFrame([(n, float(w)) for n, w in zip(names, feat.pca_weights(cov), strict=True)], "asset string, weight double")


_plain("pca_weights", _pca)
