"""Queries of concurrency, weights, folds and bet sizes over the labelled events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import betsize, crossval, labels, weights
from ..sources.tables import events_series
from .common import Registry, r6, rounded, sql6
from .labeling import VERT

R = Registry()


def _events(spark, d):
    p = events_series(spark, d)
    e = p.select("series_id", F.col("ts").alias("t0"), "seq", "close").withColumn("trgt", F.lit(0.5))
    return p, labels.vertical_barrier(p, e)


_VERT = VERT.replace("SELECT series_id, ts AS t0,", "SELECT series_id, ts AS t0, seq, close,")
_C = _VERT + ", c AS (SELECT p.series_id, p.ts, p.close, count(v.t0) AS n_events FROM p LEFT JOIN v ON v.series_id = p.series_id AND p.ts BETWEEN v.t0 AND v.t1 GROUP BY 1, 2, 3)"
_TW = _C + ", w AS (SELECT v.series_id, v.t0, v.t1, avg(1.0::DOUBLE / n_events) AS t_w FROM v JOIN c ON c.series_id = v.series_id AND c.ts BETWEEN v.t0 AND v.t1 GROUP BY 1, 2, 3)"


@R.add("co_events", _C + " SELECT series_id, ts, n_events FROM c")
def co_events(spark, d):
    return weights.concurrent_events(*_events(spark, d))


@R.add("avg_uniqueness", _TW + f" SELECT series_id, t0, t1, {sql6('t_w')} AS t_w FROM w")
def avg_uniqueness(spark, d):
    return rounded(weights.uniqueness_weights(*_events(spark, d)), "series_id", "t0", "t1", t_w="t_w")


@R.add("indicator_matrix", _VERT + " SELECT v.series_id, p.ts, v.t0 FROM v JOIN p ON p.series_id = v.series_id AND p.ts BETWEEN v.t0 AND v.t1")
def indicator_matrix(spark, d):
    return weights.indicator(*_events(spark, d)).select("series_id", "ts", "t0")


@R.add("indicator_uniqueness", _TW + f" SELECT series_id, t0, {sql6('t_w')} AS uniqueness FROM w")
def indicator_uniqueness(spark, d):
    return rounded(weights.average_uniqueness(weights.indicator(*_events(spark, d))), "series_id", "t0", uniqueness="uniqueness")


@R.add("return_weights", _C + f""", r AS (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY ts)), 0) AS lr FROM c),
  a AS (SELECT v.series_id, v.t0, v.t1, abs(sum(CASE WHEN n_events > 0 THEN lr / n_events ELSE 0 END)) AS raw FROM v JOIN r ON r.series_id = v.series_id AND r.ts BETWEEN v.t0 AND v.t1 GROUP BY 1, 2, 3)
  SELECT series_id, t0, t1, {sql6("raw * count(*) OVER (PARTITION BY series_id) / sum(raw) OVER (PARTITION BY series_id)")} AS w FROM a""")  # fmt: skip
def return_weights(spark, d):
    return rounded(weights.return_weights(*_events(spark, d)), "series_id", "t0", "t1", w="w")


@R.add("time_decay", _TW + f""", x AS (SELECT *, sum(t_w) OVER (PARTITION BY series_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS x, sum(t_w) OVER (PARTITION BY series_id) AS n FROM w)
  SELECT series_id, t0, {sql6("greatest(0, 1 - (1 - 0.5) / n * n + (1 - 0.5) / n * x)")} AS decay_half, {sql6("greatest(0, 1 - 1 / (0.5 * n) * n + 1 / (0.5 * n) * x)")} AS decay_cut FROM x""")  # fmt: skip
def time_decay(spark, d):
    w = weights.uniqueness_weights(*_events(spark, d))
    both = weights.time_decay(weights.time_decay(w, 0.5).withColumnRenamed("decay_w", "half"), -0.5)
    return rounded(both, "series_id", "t0", decay_half="half", decay_cut="decay_w")


@R.add("uniform_weights", _VERT + f" SELECT series_id, t0, {sql6('1.0::DOUBLE / count(*) OVER (PARTITION BY series_id)', 9)} AS w FROM v")
def uniform_weights(spark, d):
    return rounded(weights.uniform_weights(_events(spark, d)[1]), "series_id", "t0", w="w", digits=9)


_FOLDS = _VERT + """, f AS (SELECT series_id, seq AS id, t0, t1, ntile(5) OVER w - 1 AS own, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v WINDOW w AS (PARTITION BY series_id ORDER BY t0, seq)),
  x AS (SELECT series_id, own AS fold, arg_min(t1, i) AS s, arg_max(t1, i) AS e FROM f GROUP BY 1, 2),
  b AS (SELECT f.*, x.fold, x.s, x.e FROM f JOIN x USING (series_id)),
  t AS (SELECT *, row_number() OVER (PARTITION BY series_id, fold ORDER BY t0 DESC, id DESC) AS back FROM b WHERE own != fold AND NOT (t0 BETWEEN s AND e OR t1 BETWEEN s AND e OR (t0 <= s AND e <= t1)))"""


@R.add("purged_kfold", _FOLDS + """ SELECT series_id, fold::INTEGER AS fold, id, 'train' AS role FROM t WHERE back > greatest(1, floor(n * 0.01))
  UNION ALL SELECT series_id, fold::INTEGER, id, 'test' FROM b WHERE own = fold""")  # fmt: skip
def purged_kfold(spark, d):
    return crossval.purged_folds(_events(spark, d)[1].withColumnRenamed("seq", "id"))


_TESTS = "tests AS (SELECT series_id, min(t0) + INTERVAL 5 DAY AS start, min(t0) + INTERVAL 8 DAY AS end_ FROM v GROUP BY 1)"


@R.add("train_times", _VERT + f", {_TESTS} SELECT v.series_id, v.t0, v.t1 FROM v JOIN tests USING (series_id) WHERE NOT (t0 BETWEEN start AND end_ OR t1 BETWEEN start AND end_ OR (t0 <= start AND end_ <= t1))")
def train_times(spark, d):
    e = _events(spark, d)[1]
    tests = e.groupBy("series_id").agg((F.min("t0") + F.expr("INTERVAL 5 DAY")).alias("start"), (F.min("t0") + F.expr("INTERVAL 8 DAY")).alias("end"))
    return crossval.train_times(e, tests, key="series_id").select("series_id", "t0", "t1")


@R.add("embargo_times", _VERT + " SELECT series_id, t0 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t0) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v) WHERE i <= n - floor(n * 0.1)")
def embargo_times(spark, d):
    return crossval.embargo(_events(spark, d)[1], 0.1, key="series_id").select("series_id", "t0")


# Bet sizes: a probability and a side for each event, from its price.


def _bets(spark, d):
    e = _events(spark, d)[1]
    return e.withColumn("prob", 0.5 + 0.49 * (F.col("close") / (F.col("close") + 50))).withColumn("side", F.when(F.col("seq") % 3 == 0, -1.0).otherwise(1.0))


_Z = "((prob - 0.5::DOUBLE) / sqrt(prob * (1 - prob)))"
_BETS = _VERT + f""", q AS (SELECT *, 0.5::DOUBLE + 0.49::DOUBLE * (close / (close + 50)) AS prob, CASE WHEN seq % 3 = 0 THEN -1.0 ELSE 1.0 END AS side FROM v),
  s AS (SELECT *, (2 * {normal.cdf_sql(_Z)} - 1) * side AS signal FROM q),
  pt AS (SELECT series_id, t0 AS ts FROM s UNION SELECT series_id, t1 FROM s),
  a AS (SELECT pt.series_id, pt.ts, coalesce(avg(s.signal), 0) AS signal FROM pt LEFT JOIN s ON s.series_id = pt.series_id AND s.t0 <= pt.ts AND pt.ts < s.t1 GROUP BY 1, 2)"""


@R.add("active_signals", _BETS + f" SELECT series_id, ts, {sql6('signal')} AS signal FROM a")
def active_signals(spark, d):
    return rounded(betsize.bet_signal(_bets(spark, d)), "series_id", "ts", signal="signal")


@R.add("bet_signal", _BETS + f" SELECT series_id, ts, {sql6('greatest(-1, least(1, round_even(signal / 0.05::DOUBLE, 0) * 0.05::DOUBLE))')} AS signal FROM a")
def bet_signal(spark, d):
    return rounded(betsize.bet_signal(_bets(spark, d), step=0.05), "series_id", "ts", signal="signal")


_LS = _BETS + """, ls AS (SELECT pt.series_id, pt.ts, count(CASE WHEN s.side > 0 THEN 1 END) AS longs, count(CASE WHEN s.side < 0 THEN 1 END) AS shorts
    FROM (SELECT DISTINCT series_id, t0 AS ts FROM s) pt LEFT JOIN s ON s.series_id = pt.series_id AND s.t0 <= pt.ts AND pt.ts < s.t1 GROUP BY 1, 2)"""


@R.add("budget_bets", _LS + f""" SELECT series_id, ts, longs, shorts,
  {sql6("coalesce(longs / nullif(max(longs) OVER (PARTITION BY series_id), 0), 0) - coalesce(shorts / nullif(max(shorts) OVER (PARTITION BY series_id), 0), 0)")} AS bet FROM ls""")  # fmt: skip
def budget_bets(spark, d):
    return rounded(betsize.budget_bets(_bets(spark, d)), "series_id", "ts", "longs", "shorts", bet="bet")


_MIX = (-2.0, 3.0, 2.0, 4.0, 0.4)


def _mix_sql(x: str) -> str:
    mu1, mu2, s1, s2, p1 = _MIX
    return f"({p1}::DOUBLE * {normal.cdf_sql(f'(({x} - {mu1}::DOUBLE) / {s1}::DOUBLE)')} + {1 - p1}::DOUBLE * {normal.cdf_sql(f'(({x} - {mu2}::DOUBLE) / {s2}::DOUBLE)')})"


@R.add("mixture_bets", _LS + f""", n AS (SELECT series_id, ts, longs - shorts AS net, {_mix_sql("(longs - shorts)")} AS f, {_mix_sql("0")} AS f0 FROM ls)
  SELECT series_id, ts, net, {sql6("CASE WHEN net >= 0 THEN (f - f0) / (1 - f0) ELSE (f - f0) / f0 END")} AS bet FROM n""")  # fmt: skip
def mixture_bets(spark, d):
    net = betsize.concurrent_bets(_bets(spark, d)).withColumn("net", F.col("longs") - F.col("shorts"))
    return rounded(betsize.mixture_bets(net, "net", _MIX), "series_id", "ts", "net", bet="bet")


@R.add("bet_moments", _LS + ", n AS (SELECT (longs - shorts)::DOUBLE AS x FROM ls) SELECT " + ", ".join(f"{sql6(f'avg(pow(x, {i}))', 5)} AS m{i}" for i in range(1, 6)) + " FROM n")
def bet_moments(spark, d):
    net = betsize.concurrent_bets(_bets(spark, d)).withColumn("x", (F.col("longs") - F.col("shorts")).cast("double"))
    return net.agg(*(r6(F.avg(F.pow("x", F.lit(float(i)))), 5).alias(f"m{i}") for i in range(1, 6)))


# Dynamic positions: forecasts around part prices.

_DYN = "d AS (SELECT p_partkey AS id, p_size - 20 AS pos, 100 AS mx, p_retailprice AS f, p_retailprice + (p_size - 25) / 2.0::DOUBLE AS price, 25.0::DOUBLE * 25 * (pow(0.95::DOUBLE, -2) - 1) AS w FROM part)"


def _dynamic(spark, d):
    from ..sources.tables import table

    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") - 20).alias("pos"), F.lit(100).alias("max_pos"), F.col("p_retailprice").alias("forecast"), (F.col("p_retailprice") + (F.col("p_size") - 25) / 2.0).alias("price"))


def _limit_sql(target: str, inverse: str) -> str:
    """Mean of the inverse price over positions to go; {{m}} stands for j / most."""
    first = f"abs(pos + CASE WHEN {target} >= pos THEN 1 ELSE -1 END)"
    each = inverse.replace("{m}", "(j / mx)")
    return f"CASE WHEN {target} != pos THEN coalesce(list_sum(list_transform(CASE WHEN abs({target}) >= {first} THEN range({first}, abs({target}) + 1) ELSE [] END, lambda j: {each})), 0) / abs({target} - pos) END"


@R.add("dynamic_bet", f"""WITH {_DYN}, t AS (SELECT *, trunc((f - price) / sqrt(w + (f - price) * (f - price)) * mx)::BIGINT AS target FROM d)
  SELECT id, {sql6("w")} AS w, target, {sql6(_limit_sql("target", "f - {m} * sqrt(w / (1 - {m} * {m}))"))} AS lim FROM t""")  # fmt: skip
def dynamic_bet(spark, d):
    return rounded(betsize.dynamic_bet(_dynamic(spark, d), (25.0, 0.95)), "id", "target", w="w", lim="limit")


@R.add("power_bet", f"""WITH {_DYN}, x AS (SELECT id, pos, mx, f / 1000 AS f, (f + (price - f) / 20) / 1000 AS price FROM d), y AS (SELECT *, (f - price) * 1000 AS gap FROM x),
  t AS (SELECT *, trunc(sign(gap) * pow(abs(gap), 1.5::DOUBLE) * mx)::BIGINT AS target FROM y)
  SELECT id, target, {sql6(_limit_sql("target", "f - sign({m}) * pow(abs({m}), 1 / 1.5::DOUBLE)"))} AS lim, {sql6("CASE WHEN gap != 0 AND abs(gap) != 1 THEN greatest(0, ln(0.9::DOUBLE) / ln(abs(gap))) END")} AS width FROM t""")  # fmt: skip
def power_bet(spark, d):
    p = _dynamic(spark, d).withColumns({"f": F.col("forecast") / 1000, "q": (F.col("forecast") + (F.col("price") - F.col("forecast")) / 20) / 1000})
    gap, w = (F.col("f") - F.col("q")) * 1000, F.lit(1.5)
    out = p.withColumn("gap", gap).withColumn("target", betsize.power_target(w, F.col("gap"), F.lit(0.0), F.col("max_pos")))
    out = out.withColumn("lim", betsize.power_limit_price(F.col("target"), F.col("pos"), F.col("f"), w, F.col("max_pos")))
    usable = (F.col("gap") != 0) & (F.abs("gap") != 1)
    width = F.when(usable, betsize.power_width(F.abs("gap"), F.lit(0.9)))
    return rounded(out.withColumn("width", width), "id", "target", lim="lim", width="width")


@R.add("mixture_bet_sizes")
def mixture_bet_sizes(spark, d):
    """Bets by a mixture fitted to the moments of all net positions."""
    return betsize.mixture_bet_sizes(_bets(spark, d), n_run=4, starts=200, epsilon=1e-3)
