"""Statistical tests and classification reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import adf, kpss, shapiro


def volatility_ranking(df: DataFrame, column: str, *, key: str = "series_id") -> DataFrame:
    """Population deviation of each series, ascending."""
    return df.groupBy(key).agg(F.stddev_pop(column).alias("std")).orderBy("std", key)


def jarque_bera(df: DataFrame, column: str = "ret", *, key: str = "series_id") -> DataFrame:
    """n, skew, kurt (in excess), jb and its p value with two degrees of freedom."""
    s = df.where(F.col(column).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurt"))
    return s.withColumn("jb", F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)).withColumn("p_value", F.exp(-F.col("jb") / 2))


def _per_series(df: DataFrame, key: str, order: Sequence[str], column: str, columns: dict[str, str], f) -> DataFrame:
    """One row for each series from its ordered values (a series must fit a task)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(order), kind="stable")[column].dropna().to_numpy(float)
        return pd.DataFrame([(pdf[key].iloc[0], *f(x))], columns=[key, *columns])

    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns.items())).fields])
    return df.groupBy(key).applyInPandas(run, schema)


def shapiro_wilk(df: DataFrame, column: str = "ret", *, key: str = "series_id", order: Sequence[str] = ("ts",), most: int = 5000) -> DataFrame:
    """W and p value of each series, from all its values, by Royston's approximation. Its p values were fitted on
    up to 5,000 values: p_in_range says whether the series has no more (W holds for any number)."""
    return _per_series(df, key, order, column, {"w": "double", "p_value": "double", "p_in_range": "boolean"}, lambda x: (*shapiro(x), len(x) <= most))


def normality(df: DataFrame, column: str = "ret", limit: float = 0.05, *, key: str = "series_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Both tests and whether each keeps normality (p above the limit); shapiro_in_range as in shapiro_wilk."""
    jb = jarque_bera(df, column, key=key).select(key, "jb", F.col("p_value").alias("jb_p"))
    sw = shapiro_wilk(df, column, key=key, order=order).select(key, F.col("w").alias("shapiro_w"), F.col("p_value").alias("shapiro_p"), F.col("p_in_range").alias("shapiro_in_range"))
    return jb.join(sw, key).withColumns({"jb_normal": F.col("jb_p") > limit, "shapiro_normal": F.col("shapiro_p") > limit})


def unit_root(df: DataFrame, column: str = "close", limit: float = 0.05, *, key: str = "series_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """ADF (one lag, constant) and KPSS (trend) with a verdict: stationary if ADF rejects and KPSS does not."""

    def one(x: np.ndarray):
        a, ap, *_ = adf(x)
        k, kp = kpss(x) if len(x) > 8 and x.std() > 0 else (float("nan"), float("nan"))
        return a, ap, k, kp, bool(ap <= limit and kp > limit)

    return _per_series(df, key, order, column, {"adf": "double", "adf_p": "double", "kpss": "double", "kpss_p": "double", "stationary": "boolean"}, one)


def white_test(df: DataFrame, column: str = "close", *, key: str = "series_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """White's test on the residuals of a value on the one before: lm = n R^2 of e^2 on x, x^2, and its p value.

    All by sums: residuals need the first fit, the auxiliary fit one more pass.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, F.col(column).alias("y"), F.lag(column).over(w).alias("x")).where("x is not null and y is not null")
    fit = rows.groupBy(key).agg((F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"))
    z = (F.col("x") - F.col("mx")) / F.nullif(F.col("sx"), F.lit(0.0))  # centred and scaled: the fit is the same, the sums stay small
    e = F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx"))
    aux = rows.join(fit, key).select(key, z.alias("z"), (z * z).alias("q"), (e * e).alias("u"))
    s = aux.groupBy(key).agg(F.count("*").alias("n"), F.var_pop("z").alias("zz"), F.var_pop("q").alias("qq"), F.covar_pop("z", "q").alias("zq"), F.covar_pop("z", "u").alias("zu"), F.covar_pop("q", "u").alias("qu"), F.var_pop("u").alias("uu"))
    det = F.nullif(F.col("zz") * F.col("qq") - F.col("zq") * F.col("zq"), F.lit(0.0))
    explained = (F.col("zu") * F.col("zu") * F.col("qq") - 2 * F.col("zu") * F.col("qu") * F.col("zq") + F.col("qu") * F.col("qu") * F.col("zz")) / det
    lm = F.col("n") * explained / F.nullif(F.col("uu"), F.lit(0.0))
    return s.select(key, "n", lm.alias("lm")).withColumn("p_value", F.exp(-F.col("lm") / 2))


def confusion(df: DataFrame, actual: str = "actual", predicted: str | None = "predicted") -> DataFrame:
    """Counts of actual and predicted labels; without predictions all are 1."""
    rows = df.select(F.col(actual).alias("actual"), (F.col(predicted) if predicted else F.lit(1)).alias("predicted"))
    return rows.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, actual: str = "actual", predicted: str | None = "predicted") -> DataFrame:
    """precision, recall, f1 and support of each label, and the accuracy of all."""
    c = confusion(df, actual, predicted)
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = c.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hit"))
    by_predicted = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    both = by_actual.join(by_predicted, "label", "full").na.fill(0, ["support", "hit", "called"])
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("called"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hit") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    whole = Window.partitionBy(F.lit(1))  # one row for each label
    return both.select("label", precision.alias("precision"), recall.alias("recall"), F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support", (F.sum("hit").over(whole) / F.sum("support").over(whole)).alias("accuracy"))


def weighted_f1(df: DataFrame, actual: str = "actual", predicted: str | None = "predicted") -> DataFrame:
    """weighted_f1: the f1 of all labels, weighted by their support."""
    r = classification_report(df, actual, predicted)
    return r.agg((F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"))


def roc(df: DataFrame, actual: str = "actual", score: str = "score", *, key: str = "series_id") -> DataFrame:
    """tpr and fpr at each distinct score, from the highest, by series."""
    at = df.groupBy(key, F.col(score).alias("score")).agg(F.sum(F.col(actual).cast("bigint")).alias("p"), F.sum(1 - F.col(actual).cast("bigint")).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    share = lambda c: F.sum(c).over(w) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return at.select(key, "score", share("p").alias("tpr"), share("n").alias("fpr"))
