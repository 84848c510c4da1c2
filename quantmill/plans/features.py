"""Queries of microstructure and volatility features over daily bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import microstructure as ms
from ..operators import volatility as vol
from ..sources.tables import TICK_ORDER, daily_bars, ticks
from ..functions.windows import divided, logarithm, ordered
from .common import BARS, TICKS, Registry, r6, rounded, sql6
from .common import TICK_ORDER as SQL_TICK_ORDER

R = Registry()
N = 10
W = "OVER (PARTITION BY series_id ORDER BY ts)"
FRAME = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
TWO = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"


def _mean(x: str) -> str:
    return f"CASE WHEN count({x}) {FRAME} >= {N} THEN avg({x}) {FRAME} END"


_ROLL = f"""WITH {BARS}, x AS (SELECT *, close - lag(close) {W} AS dp FROM b), y AS (SELECT *, lag(dp) {W} AS dl FROM x),
  z AS (SELECT *, CASE WHEN count(dl) {FRAME} >= {N} THEN 2 * sqrt(abs(covar_samp(dp, dl) {FRAME})) END AS roll FROM y)"""


@R.add("roll_measure", _ROLL + f" SELECT series_id, ts, {sql6('roll')} AS roll_measure FROM z")
def roll_measure(spark, d):
    return rounded(ms.roll_measure(daily_bars(spark, d), N), "series_id", "ts", roll_measure="roll_measure")


@R.add("roll_impact", _ROLL + f" SELECT series_id, ts, {sql6('roll / dollar_volume', 9)} AS roll_impact FROM z")
def roll_impact(spark, d):
    return rounded(ms.roll_impact(daily_bars(spark, d), N), "series_id", "ts", roll_impact="roll_impact", digits=9)


_DEN, _K2 = repr(ms.DEN), repr(ms.K2)
_HL = f"""WITH {BARS}, x AS (SELECT *, CASE WHEN count(*) {TWO} >= 2 THEN sum(pow(ln(high / low), 2)) {TWO} END AS pair, CASE WHEN count(*) {TWO} >= 2 THEN pow(ln(max(high) {TWO} / min(low) {TWO}), 2) END AS gamma FROM b),
  y AS (SELECT *, {_mean("pair")} AS beta FROM x), z AS (SELECT *, ({math.sqrt(2)!r}::DOUBLE - 1) * sqrt(beta) / {_DEN}::DOUBLE - sqrt(gamma / {_DEN}::DOUBLE) AS raw,
    ({2**-0.5!r}::DOUBLE - 1) * sqrt(beta) / ({_K2}::DOUBLE * {_DEN}::DOUBLE) + sqrt(gamma / ({_K2}::DOUBLE * {_K2}::DOUBLE * {_DEN}::DOUBLE)) AS bp FROM y),
  a AS (SELECT *, CASE WHEN raw < 0 THEN 0 ELSE raw END AS alpha FROM z)"""


@R.add("corwin_schultz", _HL + f" SELECT series_id, ts, {sql6('beta')} AS beta, {sql6('gamma')} AS gamma, {sql6('alpha')} AS alpha, {sql6('2 * (exp(alpha) - 1) / (1 + exp(alpha))')} AS corwin_schultz FROM a")
def corwin_schultz(spark, d):
    return rounded(ms.high_low_features(daily_bars(spark, d), N), "series_id", "ts", beta="beta", gamma="gamma", alpha="alpha", corwin_schultz="corwin_schultz")


@R.add("bekker_parkinson", _HL + f" SELECT series_id, ts, {sql6('CASE WHEN bp < 0 THEN 0 ELSE bp END')} AS bekker_parkinson FROM a")
def bekker_parkinson(spark, d):
    return rounded(ms.bekker_parkinson(daily_bars(spark, d), N), "series_id", "ts", bekker_parkinson="bekker_parkinson")


_SIDE = f"last_value(nullif(sign({{}}), 0) IGNORE NULLS) {W}"


@R.add("kyle_lambda", f"""WITH {BARS}, x AS (SELECT *, close - lag(close) {W} AS dp FROM b), y AS (SELECT *, {_SIDE.format("dp")} AS side FROM x), z AS (SELECT *, dp / (volume * side) AS q FROM y)
  SELECT series_id, ts, {sql6(_mean("q"))} AS kyle_lambda FROM z""")  # fmt: skip
def kyle_lambda(spark, d):
    return rounded(ms.kyle_lambda(daily_bars(spark, d), N), "series_id", "ts", kyle_lambda="kyle_lambda")


@R.add("amihud_lambda", f"WITH {BARS}, x AS (SELECT *, abs(ln(close / lag(close) {W})) / dollar_volume AS q FROM b) SELECT series_id, ts, {sql6(_mean('q'), 9)} AS amihud_lambda FROM x")
def amihud_lambda(spark, d):
    return rounded(ms.amihud_lambda(daily_bars(spark, d), N), "series_id", "ts", amihud_lambda="amihud_lambda", digits=9)


@R.add("hasbrouck_lambda", f"""WITH {BARS}, x AS (SELECT *, ln(close / lag(close) {W}) AS dp FROM b), y AS (SELECT *, {_SIDE.format("dp")} AS side FROM x), z AS (SELECT *, dp / (side * sqrt(dollar_volume)) AS q FROM y)
  SELECT series_id, ts, {sql6(_mean("q"), 9)} AS hasbrouck_lambda FROM z""")  # fmt: skip
def hasbrouck_lambda(spark, d):
    return rounded(ms.hasbrouck_lambda(daily_bars(spark, d), N), "series_id", "ts", hasbrouck_lambda="hasbrouck_lambda", digits=9)


_TRADES = f"""WITH {TICKS.replace("l_returnflag AS series_id", "l_suppkey AS series_id")}, x AS (SELECT *, price - lag(price) OVER w AS price_diff, ln(price / lag(price) OVER w) AS log_ret FROM t
    WINDOW w AS (PARTITION BY series_id ORDER BY {SQL_TICK_ORDER.replace("l_shipdate", "ts")})),
  f AS (SELECT *, CASE WHEN price_diff >= 0 THEN 1.0 ELSE -1.0 END AS flag FROM x WHERE price_diff IS NOT NULL)"""


def _trades(spark, d):
    t = ticks(spark, d).withColumn("series_id", F.col("l_suppkey"))
    w = ordered("series_id", *TICK_ORDER)
    t = t.withColumns({"price_diff": F.col("price") - F.lag("price").over(w), "log_ret": logarithm(divided(F.col("price"), F.lag("price").over(w)))}).where("price_diff is not null")
    return t.withColumns({"flag": F.when(F.col("price_diff") >= 0, 1.0).otherwise(-1.0), "volume": F.col("size"), "dollar_volume": F.col("dollars")})


def _origin(y: str, x: str, digits: int = 9) -> str:
    return _TRADES + f""", s AS (SELECT series_id, count(*) AS n, sum({x} * {y}) AS xy, sum({x} * {x}) AS xx, sum({y} * {y}) AS yy FROM (SELECT series_id, ({y})::DOUBLE AS y, ({x})::DOUBLE AS x FROM f) GROUP BY 1)
  SELECT series_id, {sql6("xy / xx", digits)} AS coef, {sql6("xy / xx / sqrt((yy - xy * xy / xx) / (n - 1) / xx)", 6)} AS t_value FROM s""".replace(f"sum({x} * {y})", "sum(x * y)").replace(f"sum({x} * {x})", "sum(x * x)").replace(f"sum({y} * {y})", "sum(y * y)")


def _rounded_fit(df):
    return df.select("series_id", r6("coef", 9).alias("coef"), r6("t_value").alias("t_value"))


@R.add("trades_kyle", _origin("price_diff", "size * flag"))
def trades_kyle(spark, d):
    return _rounded_fit(ms.trades_kyle(_trades(spark, d)))


@R.add("trades_amihud", _origin("abs(log_ret)", "dollars"))
def trades_amihud(spark, d):
    return _rounded_fit(ms.trades_amihud(_trades(spark, d)))


@R.add("trades_hasbrouck", _origin("abs(log_ret)", "flag * sqrt(dollars)"))
def trades_hasbrouck(spark, d):
    return _rounded_fit(ms.trades_hasbrouck(_trades(spark, d)))


@R.add("parkinson_vol", f"WITH {BARS}, x AS (SELECT *, pow(ln(high / low), 2) / (4 * ln(2.0::DOUBLE)) AS q FROM b) SELECT series_id, ts, {sql6('sqrt(' + _mean('q') + ')')} AS parkinson FROM x")
def parkinson_vol(spark, d):
    return rounded(vol.parkinson(daily_bars(spark, d), N), "series_id", "ts", parkinson="parkinson")


@R.add("garman_klass_vol", f"""WITH {BARS}, x AS (SELECT *, 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / open), 2) AS q FROM b), y AS (SELECT *, {_mean("q")} AS m FROM x)
  SELECT series_id, ts, CASE WHEN m >= 0 THEN {sql6("sqrt(CASE WHEN m >= 0 THEN m END)")} END AS garman_klass FROM y""")  # fmt: skip
def garman_klass_vol(spark, d):
    return rounded(vol.garman_klass(daily_bars(spark, d), N), "series_id", "ts", garman_klass="garman_klass")


@R.add("yang_zhang_vol", f"""WITH {BARS}, x AS (SELECT *, pow(ln(open / lag(close) {W}), 2) AS o, pow(ln(close / lag(open) {W}), 2) AS c, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS r FROM b),
  y AS (SELECT *, CASE WHEN count(o) {FRAME} >= {N} THEN (sum(o) {FRAME} + k * sum(c) {FRAME} + (1 - k) * sum(r) {FRAME}) / ({N} - 1) END AS v FROM x, (SELECT 0.34::DOUBLE / (1.34::DOUBLE + ({N} + 1) / ({N} - 1)::DOUBLE) AS k))
  SELECT series_id, ts, {sql6("sqrt(CASE WHEN v >= 0 THEN v END)")} AS yang_zhang FROM y""")  # fmt: skip
def yang_zhang_vol(spark, d):
    return rounded(vol.yang_zhang(daily_bars(spark, d), N), "series_id", "ts", yang_zhang="yang_zhang")
