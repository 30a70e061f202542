"""Forecasts per state, for all states in one job.

Every model is fitted from sums over the history (at most ``days_back`` rows per
state), so fitting is an ordinary aggregation and predicting is arithmetic on
one row per state and future day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.functions.scalar import divide, stable_normal, weekday_number
from measurelake.operators.series import trailing_mean

MIN_DAYS = 30
_NORMAL_95 = 1.96


def _state():
    return Window.partitionBy("state_name")


def last_days(history: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of every state."""
    newest = F.row_number().over(_state().orderBy(F.desc("date_local")))
    return history.withColumn("_rn", newest).where(F.col("_rn") <= n).drop("_rn")


def with_day_offset(history: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """History of the states with at least ``min_days`` rows, with offset and position.

    ``t`` counts calendar days since a state's first row, ``rn`` its rows, and
    ``n`` is the number of rows.
    """
    return history.select(
        "state_name",
        "date_local",
        "pm25",
        F.count(F.lit(1)).over(_state()).alias("n"),
        F.datediff("date_local", F.min("date_local").over(_state())).alias("t"),
        F.row_number().over(_state().orderBy("date_local")).alias("rn"),
    ).where(F.col("n") >= min_days)


def _future(models: DataFrame, horizon: int) -> DataFrame:
    """One row per model row and future day: ``step``, ``date_local`` and ``t``."""
    steps = models.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_step"))
    return steps.select(
        "*",
        F.col("_step").cast("bigint").alias("step"),
        F.date_add("last_date", F.col("_step")).alias("date_local"),
        (F.col("last_t") + F.col("_step")).alias("t"),
    )


# -- linear regression -------------------------------------------------------


def _is_train(share: float) -> Column:
    return F.col("rn") <= F.floor(F.col("n").cast("double") * F.lit(share))


def linreg_fit(history: DataFrame, train_share: float = 0.8, min_days: int = MIN_DAYS) -> DataFrame:
    """Slope and intercept per state, from the first ``train_share`` of its rows."""
    train = _is_train(train_share)
    y, x = F.when(train, F.col("pm25")), F.col("t").cast("double")
    return (
        with_day_offset(history, min_days)
        .groupBy("state_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(train).alias("n_train"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.max("date_local").alias("last_date"),
            F.max("t").cast("bigint").alias("last_t"),
        )
    )


def linreg_fitted(
    history: DataFrame, train_share: float = 0.8, min_days: int = MIN_DAYS
) -> DataFrame:
    """Every history row with the fitted trend line and whether it was trained on.

    Slope and intercept are window aggregates over the partitioning the offsets
    already need, so nothing is joined or shuffled again.
    """
    train = _is_train(train_share)
    y, x = F.when(train, F.col("pm25")), F.col("t").cast("double")
    slope, intercept = F.regr_slope(y, x).over(_state()), F.regr_intercept(y, x).over(_state())
    return with_day_offset(history, min_days).select(
        "state_name",
        "date_local",
        F.col("t").cast("bigint").alias("t"),
        "pm25",
        (intercept + slope * x).alias("fitted"),
        slope.alias("slope"),
        train.alias("is_train"),
    )


def linreg_metrics(
    history: DataFrame, train_share: float = 0.8, min_days: int = MIN_DAYS
) -> DataFrame:
    """Error of the trend on the rows it was not trained on, and the slope per day.

    R² is out of sample and may be negative.  Where the tested rows are constant
    it is 1 for an exact fit and 0 otherwise.
    """
    tested = (
        linreg_fitted(history, train_share, min_days)
        .where(~F.col("is_train"))
        .withColumn("_e", F.col("pm25") - F.col("fitted"))
        .withColumn("_d", F.col("pm25") - F.avg("pm25").over(_state()))
    )
    left, spread = F.sum(F.col("_e") * F.col("_e")), F.sum(F.col("_d") * F.col("_d"))
    return tested.groupBy("state_name").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.when(spread == 0, F.when(left == 0, 1.0).otherwise(0.0))
        .otherwise(F.lit(1.0) - divide(left, spread))
        .alias("r2"),
        F.max("slope").alias("slope"),
    )


def linreg_forecast(
    history: DataFrame, horizon: int = 14, train_share: float = 0.8, min_days: int = MIN_DAYS
) -> DataFrame:
    """The trend line continued for ``horizon`` days; not clipped at zero."""
    return _future(linreg_fit(history, train_share, min_days), horizon).select(
        "state_name",
        "step",
        "date_local",
        (F.col("intercept") + F.col("slope") * F.col("t")).alias("forecast"),
    )


# -- moving average ----------------------------------------------------------


def ma_fit(history: DataFrame, window: int = 21, min_days: int = MIN_DAYS) -> DataFrame:
    """Last moving average, its change over ``window`` rows, and recent volatility, per state.

    The change is null for a state with fewer than ``window`` rows.
    """
    back = F.col("n") - F.col("rn") + 1  # 1 = newest row
    return (
        with_day_offset(history, min_days)
        .withColumn("_ma", trailing_mean("pm25", window, ["state_name"], "date_local"))
        .groupBy("state_name")
        .agg(
            F.max(F.when(back == 1, F.col("_ma"))).alias("last_ma"),
            F.max(F.when(back == window, F.col("_ma"))).alias("_first_ma"),
            F.stddev_samp(F.when(back <= window, F.col("pm25"))).alias("volatility"),
            F.max("date_local").alias("last_date"),
            F.max("t").cast("bigint").alias("last_t"),
        )
        .select(
            "state_name",
            "last_ma",
            (F.col("last_ma") - F.col("_first_ma")).alias("ma_trend"),
            "volatility",
            "last_date",
            "last_t",
        )
    )


def ma_forecast(
    history: DataFrame, horizon: int = 14, window: int = 21, seed: int | None = None,
    noise: float = 0.3, min_days: int = MIN_DAYS,
) -> DataFrame:
    """The last moving average repeated, clipped at zero.

    With a ``seed``, each day varies by ``noise`` times the recent volatility.
    The draw depends on seed, state and day only, so a retried task repeats it.
    """
    future = _future(ma_fit(history, window, min_days), horizon)
    level = F.col("last_ma")
    if seed is not None:
        draw = stable_normal(F.lit(seed), F.col("state_name"), F.col("date_local"))
        level = level + draw * F.lit(noise) * F.coalesce("volatility", F.lit(0.0))
    return future.select(
        "state_name", "step", "date_local", F.greatest(level, F.lit(0.0)).alias("forecast")
    )


# -- all models from one aggregation -----------------------------------------


def fit_models(
    history: DataFrame, ma_window: int = 21, min_days: int = MIN_DAYS, recent_days: int = 7
) -> DataFrame:
    """Parameters of the three compared models, one row per state.

    * linear: least squares over all rows
    * moving average: mean of the last ``ma_window`` rows, null below that many
    * seasonal: least squares with one slope and one intercept per weekday

    All three, and the mean of the last ``recent_days`` rows, come from sums per
    state and weekday.
    """
    x, y = F.col("t").cast("double"), F.col("pm25")
    age = F.col("n") - F.col("rn")  # 0 = newest row
    recent, current = age < ma_window, age < recent_days
    rows = F.count(F.lit(1))
    per_weekday = (
        with_day_offset(history, min_days)
        .groupBy("state_name", weekday_number(F.col("date_local")).alias("_day"))
        .agg(
            rows.alias("_n"),
            F.avg(x).alias("_x"),
            F.avg(y).alias("_y"),
            (F.var_pop(x) * rows).alias("_sxx"),
            (F.covar_pop(x, y) * rows).alias("_sxy"),
            (F.var_pop(y) * rows).alias("_syy"),
            F.sum(x).alias("_tx"),
            F.sum(y).alias("_ty"),
            F.sum(x * x).alias("_txx"),
            F.sum(x * y).alias("_txy"),
            F.sum(F.when(recent, y)).alias("_recent"),
            F.count_if(recent).alias("_n_recent"),
            F.sum(F.when(current, y)).alias("_current"),
            F.count_if(current).alias("_n_current"),
            F.max("date_local").alias("_last"),
            F.max("t").alias("_last_t"),
        )
    )
    sums = per_weekday.groupBy("state_name").agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("_days"),
        *[F.sum(c).alias(c) for c in
          ("_sxx", "_sxy", "_syy", "_tx", "_ty", "_txx", "_txy",
           "_recent", "_n_recent", "_current", "_n_current")],
        # At most seven entries.
        F.map_from_entries(F.collect_list(F.struct("_day", F.struct("_x", "_y")))).alias("_means"),
        F.max("_last").alias("last_date"),
        F.max("_last_t").cast("bigint").alias("last_t"),
    )
    n = F.col("n").cast("double")
    slope = divide(
        n * F.col("_txy") - F.col("_tx") * F.col("_ty"),
        n * F.col("_txx") - F.col("_tx") * F.col("_tx"),
    )
    seasonal_slope = F.coalesce(divide(F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    left_over = F.greatest(F.col("_syy") - F.col("seasonal_slope") * F.col("_sxy"), F.lit(0.0))
    freedom = F.col("n") - F.col("_days") - 1
    return (
        sums.withColumn("linear_slope", slope)
        .withColumn("seasonal_slope", seasonal_slope)
        .select(
            "state_name",
            "n",
            "last_date",
            "last_t",
            "linear_slope",
            ((F.col("_ty") - F.col("linear_slope") * F.col("_tx")) / n).alias("linear_intercept"),
            F.when(F.col("_n_recent") >= ma_window, F.col("_recent") / F.col("_n_recent")).alias(
                "ma_level"
            ),
            "seasonal_slope",
            F.col("_means").alias("weekday_means"),
            # For a weekday the history does not contain.
            ((F.col("_ty") - F.col("seasonal_slope") * F.col("_tx")) / n).alias("common_intercept"),
            F.sqrt(F.when(freedom > 0, left_over / freedom)).alias("sigma"),
            divide(F.col("_current"), F.col("_n_current")).alias("current_avg"),
        )
    )


def _seasonal(day: Column) -> Column:
    own = F.col("weekday_means")[weekday_number(day)]
    slope = F.col("seasonal_slope")
    return F.coalesce(own["_y"] - slope * own["_x"], F.col("common_intercept")) + slope * F.col("t")


def seasonal_forecast(
    history: DataFrame, horizon: int = 14, min_days: int = MIN_DAYS
) -> DataFrame:
    """Trend plus weekday effect with a 95 % interval.

    This is a least-squares model of its own, with a straight trend and a fixed
    weekday pattern; it does not reproduce a Bayesian changepoint model.
    """
    reach = F.lit(_NORMAL_95) * F.col("sigma")
    value = _seasonal(F.col("date_local"))
    return _future(fit_models(history, min_days=min_days), horizon).select(
        "state_name",
        "step",
        "date_local",
        value.alias("forecast"),
        (value - reach).alias("lower"),
        (value + reach).alias("upper"),
    )


def seasonal_summary(
    history: DataFrame, horizon: int = 14, recent_days: int = 7, min_days: int = MIN_DAYS
) -> DataFrame:
    """Mean, highest and lowest forecast, and the change on the last days, per state."""
    models = fit_models(history, min_days=min_days, recent_days=recent_days)
    value = _seasonal(F.col("date_local"))
    return (
        _future(models, horizon)
        .groupBy("state_name")
        .agg(
            F.avg(value).alias("avg_forecast"),
            F.max(value).alias("max_forecast"),
            F.min(value).alias("min_forecast"),
            F.max("current_avg").alias("current_avg"),
        )
        .withColumn("delta", F.col("avg_forecast") - F.col("current_avg"))
    )


# -- a trend that bends --------------------------------------------------------

CHANGEPOINTS, REACH, RIDGE = 8, 0.8, 0.1


def _sums(columns: list[Column], y: Column) -> dict[str, Column]:
    """Sums of columns and of their products, by name."""
    named = {f"_x{i}": F.sum(c) for i, c in enumerate(columns)}
    for i, a in enumerate(columns):
        named[f"_xy{i}"] = F.sum(a * y)
        named |= {f"_xx{i}_{j}": F.sum(a * columns[j]) for j in range(i + 1)}
    return named | {"_y": F.sum(y), "_yy": F.sum(y * y), "_n": F.count(F.lit(1))}


def _eliminated(matrix: Column, size: int) -> Column:
    """Gauss-Jordan elimination of the first ``size`` columns of an array of rows.

    For symmetric positive definite matrices, where no row has to be exchanged.
    """

    def step(rows: Column, k: Column) -> Column:
        pivot = F.transform(rows[k], lambda v: v / rows[k][k])
        return F.transform(rows, lambda row, i: F.when(i == k, pivot).otherwise(
            F.zip_with(row, pivot, lambda v, p: v - row[k] * p)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def fit_piecewise(
    history: DataFrame, changepoints: int = CHANGEPOINTS, reach: float = REACH, ridge: float = RIDGE,
    min_days: int = MIN_DAYS,
) -> DataFrame:
    """Parameters of a trend with bends and a level per weekday, one row per state.

    The trend is a line plus a hinge for each of ``changepoints`` days, evenly spaced over the
    first ``reach`` of the history.  ``ridge`` holds the hinges' coefficients back, against
    time scaled to 0..1.  Levels are taken out weekday by weekday, so the normal
    equations are as large as the trend has coefficients whatever the history; they are
    sums per state and weekday, added up per state and solved in expressions.

    ``slopes`` are the coefficients, ``inverse`` the inverse of the penalised and
    ``products`` the matrix itself.  A state whose days all lie on one date has a flat trend.
    """
    size = 1 + changepoints
    rows = with_day_offset(history, min_days).withColumns({
        "_last": F.max("date_local").over(_state()), "_last_t": F.max("t").over(_state())})
    scaled = F.coalesce(divide(F.col("t").cast("double"), F.col("_last_t").cast("double")), F.lit(0.0))
    # Around the middle, so that sums of products keep their digits.
    columns = [scaled - 0.5] + [F.greatest(scaled - F.lit(reach * k / (changepoints + 1)), F.lit(0.0))
                                for k in range(1, changepoints + 1)]
    centre = F.avg("pm25").over(_state())
    per_day = rows.select(
        "state_name", "n", "_last", "_last_t", weekday_number(F.col("date_local")).alias("_day"),
        *[c.alias(f"_c{i}") for i, c in enumerate(columns)], (F.col("pm25") - centre).alias("_v"), centre.alias("_centre"))
    sums = _sums([F.col(f"_c{i}") for i in range(size)], F.col("_v"))
    days = per_day.groupBy("state_name", "_day").agg(
        *[c.alias(name) for name, c in sums.items()],
        F.max("_last").alias("_last"), F.max("_last_t").alias("_last_t"), F.max("_centre").alias("_centre"))

    def within(product: str, a: str, b: str) -> Column:
        return F.sum(F.col(product) - F.col(a) * F.col(b) / F.col("_n"))

    def entry(i: int, j: int) -> Column:
        return within(f"_xx{max(i, j)}_{min(i, j)}", f"_x{i}", f"_x{j}")

    fitted = days.groupBy("state_name").agg(
        F.array(*[F.array(*[entry(i, j) for j in range(size)]) for i in range(size)]).alias("products"),
        F.array(*[within(f"_xy{i}", f"_x{i}", "_y") for i in range(size)]).alias("_with_y"),
        within("_yy", "_y", "_y").alias("_syy"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_days"),
        F.max("_last").alias("last_date"), F.max("_last_t").cast("bigint").alias("last_t"),
        F.max("_centre").alias("_centre"),
        # At most seven entries.
        F.map_from_entries(F.collect_list(F.struct("_day", F.struct(
            (F.col("_y") / F.col("_n")).alias("y"), F.array(*[F.col(f"_x{i}") / F.col("_n") for i in range(size)]).alias("x"),
            F.col("_n").cast("double").alias("n"))))).alias("weekday_means"),
        F.array(*[F.sum(f"_x{i}") / F.sum("_n") for i in range(size)]).alias("common_x"),
        (F.sum("_y") / F.sum("_n")).alias("common_y"),
    )
    held = F.array(*[F.lit(1e-9 if i == 0 else float(ridge)) for i in range(size)])
    augmented = F.transform(F.col("products"), lambda row, i: F.concat(
        F.transform(row, lambda v, j: v + F.when(i == j, held[i]).otherwise(0.0)),
        F.transform(row, lambda v, j: F.when(i == j, 1.0).otherwise(0.0))))
    solved = fitted.withColumn("_solved", _eliminated(augmented, size)).withColumn(
        "inverse", F.transform("_solved", lambda row: F.slice(row, size + 1, size)))
    solved = solved.withColumn("slopes", F.transform("inverse", lambda row: _dot(row, F.col("_with_y"))))
    fit = _dot(F.col("slopes"), F.col("_with_y"))
    bent = _dot(F.col("slopes"), F.transform("products", lambda row: _dot(row, F.col("slopes"))))
    left_over = F.greatest(F.col("_syy") - 2.0 * fit + bent, F.lit(0.0))
    # Coefficients that are held back count in part.
    counted = F.aggregate(F.zip_with("inverse", "products", _dot), F.lit(0.0), lambda s, v: s + v)
    freedom = F.col("n") - F.col("_days") - counted
    return solved.select(
        "state_name", "n", "last_date", "last_t", "slopes", "inverse", "products", "weekday_means", "common_x",
        "common_y", F.col("_centre").alias("centre"),
        F.sqrt(F.when(freedom > 0, left_over / freedom)).alias("sigma"),
        F.array(*[F.lit(reach * k / (changepoints + 1)) for k in range(1, changepoints + 1)]).cast("array<double>").alias("bends"))


def piecewise_forecast(
    history: DataFrame, horizon: int = 14, changepoints: int = CHANGEPOINTS, reach: float = REACH,
    ridge: float = RIDGE, min_days: int = MIN_DAYS,
) -> DataFrame:
    """Forecast of :func:`fit_piecewise`, the last piece going on, with a 95 % interval.

    The interval has the error of the coefficients and of the weekday's level besides that of
    a single day, so it widens with the distance.
    """
    models = fit_piecewise(history, changepoints, reach, ridge, min_days)
    future = _future(models, horizon)
    scaled = F.coalesce(divide(F.col("t").cast("double"), F.col("last_t").cast("double")), F.lit(1.0))
    own = F.col("weekday_means")[weekday_number(F.col("date_local"))]
    x = F.concat(F.array(scaled - 0.5), F.transform("bends", lambda b: F.greatest(scaled - b, F.lit(0.0))))
    off = F.zip_with(x, F.coalesce(own["x"], F.col("common_x")), lambda a, b: a - b)
    level = F.coalesce(own["y"], F.col("common_y")) + F.col("centre")
    near = future.withColumn("_off", off).withColumn(
        "_value", level + _dot(F.col("slopes"), F.col("_off"))).withColumn(
        "_lever", F.transform("inverse", lambda row: _dot(row, F.col("_off"))))
    bent = _dot(F.col("_lever"), F.transform("products", lambda row: _dot(row, F.col("_lever"))))
    # A weekday that the history does not have counts as one day.
    spread = F.lit(_NORMAL_95) * F.col("sigma") * F.sqrt(1.0 + 1.0 / F.coalesce(own["n"], F.lit(1.0)) + bent)
    return near.select(
        "state_name", "step", "date_local", F.col("_value").alias("forecast"),
        (F.col("_value") - spread).alias("lower"), (F.col("_value") + spread).alias("upper"))


def forecast_comparison(
    history: DataFrame, horizon: int = 14, ma_window: int = 21, min_days: int = MIN_DAYS
) -> DataFrame:
    """The three forecasts side by side, with their mean and sample deviation per day.

    The models share one row per state, so their days line up without a join.
    """
    a, b, c = F.col("seasonal"), F.col("linear"), F.col("moving_average")
    mean = (a + b + c) / 3.0
    deviation = F.sqrt(
        ((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 2.0
    )
    return (
        _future(fit_models(history, ma_window, min_days), horizon)
        .select(
            "state_name",
            "step",
            "date_local",
            _seasonal(F.col("date_local")).alias("seasonal"),
            (F.col("linear_intercept") + F.col("linear_slope") * F.col("t")).alias("linear"),
            F.col("ma_level").alias("moving_average"),
            "linear_slope",
        )
        .withColumn("durchschnitt", mean)
        .withColumn("std_abweichung", deviation)
    )


def forecast_model_stats(comparison: DataFrame) -> DataFrame:
    """Mean and variability of each model's forecast, the linear slope, and the constant level.

    Takes the result of :func:`forecast_comparison`.
    """
    models = ("seasonal", "linear", "moving_average")
    stats = comparison.groupBy("state_name").agg(
        *[F.avg(m).alias(f"_avg_{m}") for m in models],
        *[F.stddev_pop(m).alias(f"_std_{m}") for m in models],
        F.max("linear_slope").alias("_slope"),
        F.max("moving_average").alias("_level"),
    )
    none = F.lit(None).cast("double")
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.col(f"_avg_{m}").alias("mean_forecast"),
                F.col(f"_std_{m}").alias("variability"),
                (F.col("_slope") if m == "linear" else none).alias("slope_per_day"),
                (F.col("_level") if m == "moving_average" else none).alias("constant_value"),
            )
            for m in models
        ]
    )
    return stats.select("state_name", F.inline(entries))
