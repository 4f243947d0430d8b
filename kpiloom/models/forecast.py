"""Daily demand: series, closed-form baseline and a seasonal trend model.

The seasonal model has the form published by Taylor & Letham (2018): a
piecewise-linear trend times one plus yearly and weekly Fourier terms. It is
fitted here by penalised least squares, with a Laplace prior on changes of slope, so
that most of them are exactly zero; values differ from a sampler's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.plans.kpi import DELIVERED, Star

HORIZON = 90
CHANGEPOINTS = 25
CHANGE_RANGE = 0.8
CHANGE_PRIOR = 0.05
# the least noise level assumed of a series scaled to one, and the most rounds of coordinate descent
NOISE_FLOOR = 1e-3
SWEEPS = 2_000
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
# 80 % interval
LOW_QUANTILE, HIGH_QUANTILE = 0.1, 0.9
NORMAL_80 = 1.2815515655446004
_FORECAST_SCHEMA = (
    "series STRING, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE, is_future BOOLEAN"
)
_MODEL_SCHEMA = (
    "series STRING, first_day DATE, last_day DATE, scale DOUBLE, knots ARRAY<DOUBLE>, "
    "trend ARRAY<DOUBLE>, season ARRAY<DOUBLE>, low DOUBLE, high DOUBLE, bend DOUBLE"
)


# -- series -----------------------------------------------------------------

def daily_orders(star: Star) -> DataFrame:
    """Delivered orders and revenue per calendar day that has any."""
    delivered = star["fact_orders"].where(F.col("order_status") == DELIVERED)
    by_day = delivered.groupBy("date_id").agg(
        F.count("order_id").alias("order_count"), F.sum("price").alias("revenue")
    )
    days = star["dim_date"].select("date_id", F.col("full_date").alias("ds"))
    return by_day.join(F.broadcast(days), "date_id").select("ds", "order_count", "revenue")


def long_series(daily: DataFrame) -> DataFrame:
    """(series, ds, y) with the series ``orders`` and ``revenue``."""
    typed = daily.select(
        "ds",
        F.col("order_count").cast("double").alias("orders"),
        F.col("revenue").cast("double").alias("revenue"),
    )
    return typed.unpivot(["ds"], ["orders", "revenue"], "series", "y").where("y IS NOT NULL")


def series_by_state(star: Star) -> DataFrame:
    """Daily delivered orders per state: one series each."""
    delivered = star["fact_orders"].where(F.col("order_status") == DELIVERED)
    cells = delivered.groupBy("date_id", "geo_id").agg(F.count("order_id").alias("_n"))
    days = star["dim_date"].select("date_id", F.col("full_date").alias("ds"))
    places = star["dim_geography"].select("geo_id", "state")
    return (
        cells.join(F.broadcast(days), "date_id")
        .join(places, "geo_id")
        .groupBy(F.col("state").alias("series"), "ds")
        .agg(F.sum("_n").cast("double").alias("y"))
    )


def series_range(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count("ds").alias("days")
    )


def future_days(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    last = daily.agg(F.max("ds").alias("_last"))
    return last.select(F.explode(C.following_days(F.col("_last"), horizon)).alias("ds"))


def history_and_future(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """History days followed by the horizon, marked by ``is_future``."""
    past = daily.select("ds", F.lit(False).alias("is_future"))
    ahead = future_days(daily, horizon).select("ds", F.lit(True).alias("is_future"))
    return past.unionByName(ahead)


# -- closed-form baseline ---------------------------------------------------

def baseline_forecast(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Linear trend times weekday index per series, with an 80 % band.

    Pure aggregates: regression coefficients and day range per series, average
    ratio per weekday, then the same formula over history and horizon.
    """
    facts = series.groupBy("series").agg(
        F.min("ds").alias("_first"),
        F.max("ds").alias("_last"),
    )
    day = F.datediff(F.col("ds"), F.col("_first"))
    placed = series.join(facts, "series").withColumn("_t", day.cast("double"))
    lines = placed.groupBy("series", "_first", "_last").agg(
        F.regr_slope("y", "_t").alias("_slope"), F.regr_intercept("y", "_t").alias("_base")
    )
    trend = F.col("_base") + F.col("_slope") * day
    fitted = series.join(lines, "series").withColumn("_trend", trend)
    index = fitted.groupBy("series", F.dayofweek("ds").alias("_weekday")).agg(
        F.avg(F.try_divide(F.col("y"), F.col("_trend"))).alias("_index")
    )

    def predict(days: DataFrame) -> DataFrame:
        joined = days.withColumn("_weekday", F.dayofweek("ds")).join(
            index, ["series", "_weekday"], "left"
        )
        return joined.withColumn("yhat", F.col("_trend") * F.coalesce("_index", F.lit(1.0)))

    past = predict(fitted)
    spread = past.groupBy("series").agg(F.stddev_pop(F.col("y") - F.col("yhat")).alias("_sd"))
    ahead = lines.withColumn("ds", F.explode(C.following_days(F.col("_last"), horizon)))
    future = predict(ahead.withColumn("_trend", trend))
    both = past.select("series", "ds", "yhat", F.lit(False).alias("is_future")).unionByName(
        future.select("series", "ds", "yhat", F.lit(True).alias("is_future"))
    )
    band = F.col("_sd") * NORMAL_80
    return both.join(spread, "series").select(
        "series",
        "ds",
        "yhat",
        (F.col("yhat") - band).alias("yhat_lower"),
        (F.col("yhat") + band).alias("yhat_upper"),
        "is_future",
    )


# -- seasonal trend model ---------------------------------------------------

def _fourier(day: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2.0 * np.pi * np.outer(day, np.arange(1, order + 1)) / period
    return np.hstack([np.sin(angle), np.cos(angle)])


def _ridge(design: np.ndarray, target: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    normal = design.T @ design + np.diag(penalty)
    return np.linalg.lstsq(normal, design.T @ target, rcond=None)[0]


def sparse_fit(design: np.ndarray, target: np.ndarray, free: int, prior: float = CHANGE_PRIOR) -> np.ndarray:
    """Least squares with a Laplace prior on all columns but the first ``free``, by coordinate descent.

    The penalty of a column is the noise level times the column's length beside the free
    ones times sqrt(2 ln columns): what pure noise seldom exceeds, so a column without a
    signal gets exactly zero. It is divided by the prior's scale in units of 0.05. The
    columns that stay are fitted again without the penalty, which would flatten them.
    """
    rows, count = design.shape
    rest = design[:, free:]
    base, *_ = np.linalg.lstsq(design[:, :free], np.column_stack([target, rest]), rcond=None)
    y = target - design[:, :free] @ base[:, 0]
    x = rest - design[:, :free] @ base[:, 1:]
    size = np.sqrt((x**2).sum(axis=0))
    kept = np.zeros(0, int)
    if count > free and size.max(initial=0.0) > 0:
        full, *_ = np.linalg.lstsq(x, y, rcond=None)
        noise = np.sqrt(((y - x @ full) ** 2).sum() / max(rows - count, 1))
        penalty = max(noise, NOISE_FLOOR) * size * np.sqrt(2.0 * np.log(max(count - free, 2))) * (0.05 / prior)
        gram, gain = x.T @ x, x.T @ y
        weights = np.zeros(count - free)
        usable = np.flatnonzero(size > 1e-9)
        for _ in range(SWEEPS):
            largest = 0.0
            for j in usable:
                pull = gain[j] - gram[j] @ weights + gram[j, j] * weights[j]
                new = np.sign(pull) * max(abs(pull) - penalty[j], 0.0) / gram[j, j]
                largest = max(largest, abs(new - weights[j]) * size[j])
                weights[j] = new
            if largest <= 1e-7 * max(np.linalg.norm(y), 1e-12):
                break
        kept = np.flatnonzero(weights)
    picked = np.r_[np.arange(free), free + kept]
    out = np.zeros(count)
    out[picked] = _ridge(design[:, picked], target, np.full(len(picked), 1e-9))
    return out


def _hinges(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    bent = np.maximum(t[:, None] - knots[None, :], 0.0)
    return np.hstack([np.ones((len(t), 1)), t[:, None], bent])


def _season(day: np.ndarray) -> np.ndarray:
    return np.hstack([_fourier(day, 365.25, YEARLY_ORDER), _fourier(day, 7.0, WEEKLY_ORDER)])


def _day_numbers(ds) -> np.ndarray:
    return (pd.DatetimeIndex(pd.to_datetime(ds)) - pd.Timestamp("1970-01-01")).days.to_numpy().astype(float)


def fit_one_series(group: pd.DataFrame) -> pd.DataFrame:
    """Fit one daily series (one row per calendar day): one row of model parameters.

    ``low`` and ``high`` are the residual quantiles of the 80 % interval, ``bend`` the
    mean size of a change of slope; both in units of ``scale``.
    """
    group = group.sort_values("ds")
    day = _day_numbers(group["ds"])
    n = len(group)
    scale = max(float(group["y"].abs().max()), 1e-9)
    y = group["y"].to_numpy(dtype=float) / scale

    t = (day - day[0]) / max(day[-1] - day[0], 1.0)
    count = min(CHANGEPOINTS, max(int(n * CHANGE_RANGE) - 1, 0))
    picks = np.linspace(0, int(n * CHANGE_RANGE) - 1, count + 1).round().astype(int)[1:]
    trend_design = _hinges(t, t[picks])
    season_design = _season(day)
    season_penalty = np.full(season_design.shape[1], 1e-2)

    season = np.zeros(n)
    for _ in range(5):  # alternate: trend given season, season given trend
        trend_weights = sparse_fit(trend_design * (1.0 + season)[:, None], y, free=2)
        trend = trend_design @ trend_weights
        season_weights = _ridge(season_design * trend[:, None], y - trend, season_penalty)
        season = season_design @ season_weights
    low, high = np.quantile(y - trend * (1.0 + season), [LOW_QUANTILE, HIGH_QUANTILE])
    return pd.DataFrame(
        {
            "series": [group["series"].iloc[0]],
            "first_day": [pd.Timestamp(group["ds"].iloc[0]).date()],
            "last_day": [pd.Timestamp(group["ds"].iloc[-1]).date()],
            "scale": [scale],
            "knots": [t[picks]],
            "trend": [trend_weights],
            "season": [season_weights],
            "low": [min(float(low), 0.0)],
            "high": [max(float(high), 0.0)],
            "bend": [float(np.abs(trend_weights[2:]).mean()) if count else 0.0],
        }
    )


def predict_one_series(days: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Forecast and 80 % interval of one series on ``days`` (series, ds, is_future).

    After the last day the slope may change as often and as strongly as it did
    before: changes come at the rate of the fitted ones, with Laplace sizes of mean
    ``bend``. Their variance at a distance h is rate x 2 bend^2 x h^3 / 3, so the band
    widens with the horizon; it is added to the residual part as a variance.
    """
    m = model.iloc[0]
    day = _day_numbers(days["ds"])
    first, last = _day_numbers([m["first_day"], m["last_day"]])
    t = (day - first) / max(last - first, 1.0)
    knots = np.asarray(m["knots"], dtype=float)
    trend = _hinges(t, knots) @ np.asarray(m["trend"], dtype=float)
    factor = 1.0 + _season(day) @ np.asarray(m["season"], dtype=float)
    yhat = trend * factor
    ahead = np.maximum(t - 1.0, 0.0)
    drift = NORMAL_80 * m["bend"] * np.sqrt(2.0 * len(knots) * ahead**3 / 3.0) * np.abs(factor)
    return pd.DataFrame(
        {
            "series": days["series"],
            "ds": days["ds"],
            "yhat": yhat * m["scale"],
            "yhat_lower": (yhat - np.hypot(m["low"], drift)) * m["scale"],
            "yhat_upper": (yhat + np.hypot(m["high"], drift)) * m["scale"],
            "is_future": days["is_future"],
        }
    )


def fit_forecast(series: DataFrame) -> DataFrame:
    """One row of model parameters per series; series are fitted in parallel.

    Spark has already folded each series to one row per day, so a group holds
    at most the calendar days of the data, however hot its key was. The result is a
    plain table: writing it saves the models.
    """
    slots = series.sparkSession.sparkContext.defaultParallelism
    spread = series.select("series", "ds", "y").repartition(slots, "series")
    return spread.groupBy("series").applyInPandas(fit_one_series, _MODEL_SCHEMA)


def forecast_days(series: DataFrame, models: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(series, ds, is_future): the days of each series and the horizon after its last."""
    ahead = models.select(
        "series", F.explode(C.following_days(F.col("last_day"), horizon)).alias("ds")
    )
    past = series.select("series", "ds", F.lit(False).alias("is_future"))
    return past.unionByName(ahead.withColumn("is_future", F.lit(True)))


def apply_forecast(models: DataFrame, days: DataFrame) -> DataFrame:
    """Forecast every day of ``days`` by the model of its series; days without one are left out."""

    def predict(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or model.empty:
            return pd.DataFrame(columns=["series", "ds", "yhat", "yhat_lower", "yhat_upper", "is_future"])
        return predict_one_series(mine, model)

    pairs = days.select("series", "ds", "is_future").groupBy("series").cogroup(models.groupBy("series"))
    return pairs.applyInPandas(predict, _FORECAST_SCHEMA)


def seasonal_forecast(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """History and horizon for every series, fitted and forecast in one task per series."""

    def both(group: pd.DataFrame) -> pd.DataFrame:
        model = fit_one_series(group)
        past = group[["series", "ds"]].sort_values("ds").assign(is_future=False)
        future = pd.date_range(pd.Timestamp(past["ds"].iloc[-1]) + pd.Timedelta(days=1), periods=horizon)
        ahead = pd.DataFrame({"series": past["series"].iloc[0], "ds": future.date, "is_future": True})
        days = pd.concat([past, ahead], ignore_index=True) if horizon else past
        return predict_one_series(days, model)

    slots = series.sparkSession.sparkContext.defaultParallelism
    spread = series.select("series", "ds", "y").repartition(slots, "series")
    return spread.groupBy("series").applyInPandas(both, _FORECAST_SCHEMA)


# -- outputs ----------------------------------------------------------------

def clipped_future(forecast: DataFrame) -> DataFrame:
    """The horizon only, clipped at zero and rounded to one digit."""
    return forecast.where("is_future").select(
        "series",
        "ds",
        *[
            C.round_half_even(C.clip_lower(F.col(c)), 1).alias(c)
            for c in ("yhat", "yhat_lower", "yhat_upper")
        ],
    )


def forecast_metrics(clipped: DataFrame) -> DataFrame:
    return clipped.groupBy("series").agg(
        F.count(F.lit(1)).alias("forecast_horizon_days"),
        F.round(F.avg("yhat"), 1).alias("avg_predicted"),
        F.round(F.max("yhat"), 1).alias("peak_predicted"),
    )


def last_days(forecast: DataFrame, days: int = HORIZON) -> DataFrame:
    """Rows later than the newest day minus ``days``."""
    newest = forecast.agg(F.max("ds")).scalar()
    return forecast.where(F.col("ds") > C.days_before(newest, days))


def peak_day(forecast: DataFrame) -> DataFrame:
    """Day and value of the largest prediction; the earliest day wins a tie."""
    rank = F.struct(F.col("yhat"), (-F.unix_date("ds")).alias("_early"))
    return forecast.agg(F.max_by("ds", rank).alias("peak_day"), F.max("yhat").alias("peak_value"))


def forecast_kpis(forecast: DataFrame, days: int = HORIZON) -> DataFrame:
    rank = F.struct(F.col("yhat"), (-F.unix_date("ds")).alias("_early"))
    return last_days(forecast, days).agg(
        F.avg("yhat").alias("avg_daily"),
        F.max_by("ds", rank).alias("peak_day"),
        F.max("yhat").alias("peak_value"),
    )
