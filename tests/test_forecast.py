from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from conftest import by
from measurelake.operators import forecast

START = date(2024, 1, 1)  # a Monday
WEEKDAY = [0.0, 3.0, -2.0, 1.0, 0.5, 4.0, -1.5]


def line(n, slope=0.25, level=5.0, weekday=(0.0,) * 7, skip=()):
    return [(START + timedelta(i), level + slope * i + weekday[i % 7]) for i in range(n) if i not in skip]


def test_history_guard(history):
    df = history(short=line(29), long=line(30))
    assert [r.state_name for r in forecast.linreg_fit(df).collect()] == ["long"]
    assert {r.state_name for r in forecast.forecast_comparison(df).collect()} == {"long"}


def test_exact_line_is_recovered(history):
    df = history(A=line(40, skip=(7, 8)))
    fit = forecast.linreg_fit(df).collect()[0]
    assert fit.slope == pytest.approx(0.25) and fit.intercept == pytest.approx(5.0)
    assert (fit.n, fit.n_train, fit.last_t) == (38, 30, 39)
    scores = forecast.linreg_metrics(df).collect()[0]
    assert scores.mae == pytest.approx(0, abs=1e-9) and scores.r2 == pytest.approx(1.0)
    assert scores.n_test == 8
    ahead = forecast.linreg_forecast(df, 3).orderBy("step").collect()
    assert [r.date_local for r in ahead] == [START + timedelta(i) for i in (40, 41, 42)]
    assert [r.forecast for r in ahead] == pytest.approx([15.0, 15.25, 15.5])
    fitted = forecast.linreg_fitted(df).collect()
    assert all(r.fitted == pytest.approx(r.pm25) for r in fitted)
    assert sum(r.is_train for r in fitted) == 30


def test_linear_metrics_equal_numpy(history):
    rng = np.random.default_rng(3)
    y = 20 + rng.normal(0, 4, 50)
    df = history(A=[(START + timedelta(i), v) for i, v in enumerate(y)])
    slope, level = np.polyfit(np.arange(40), y[:40], 1)
    error = y[40:] - (level + slope * np.arange(40, 50))
    row = forecast.linreg_metrics(df).collect()[0]
    assert row.mae == pytest.approx(np.abs(error).mean())
    assert row.rmse == pytest.approx(np.sqrt((error**2).mean()))
    assert row.r2 == pytest.approx(1 - (error**2).sum() / ((y[40:] - y[40:].mean()) ** 2).sum())


def test_constant_test_rows(history):
    df = history(flat=line(30, slope=0.0), bent=[*line(24), *[(START + timedelta(24 + i), 3.0) for i in range(6)]])
    rows = by(forecast.linreg_metrics(df), "state_name")
    assert rows["flat"]["r2"] == 1.0 and rows["bent"]["r2"] == 0.0


def test_moving_average(history):
    y = [float(i % 9) for i in range(45)]
    df = history(A=[(START + timedelta(i), v) for i, v in enumerate(y)], B=line(30))
    fits = by(forecast.ma_fit(df, window=21), "state_name")
    averages = [np.mean(y[max(0, i - 20): i + 1]) for i in range(45)]
    assert fits["A"]["last_ma"] == pytest.approx(averages[-1])
    assert fits["A"]["ma_trend"] == pytest.approx(averages[-1] - averages[-21])
    assert fits["A"]["volatility"] == pytest.approx(np.std(y[-21:], ddof=1))
    assert by(forecast.ma_fit(df, window=31), "state_name")["B"]["ma_trend"] is None
    flat = forecast.ma_forecast(df, 5).where("state_name = 'A'").collect()
    assert [r.forecast for r in flat] == pytest.approx([averages[-1]] * 5)


def test_noise_is_seeded_and_never_negative(history):
    df = history(A=[(START + timedelta(i), 10.0 * (i % 2)) for i in range(40)])
    once, again, other = (
        sorted((r.step, r.forecast) for r in forecast.ma_forecast(d, 30, seed=s).collect())
        for d, s in ((df, 1), (df.repartition(6), 1), (df, 2))
    )
    assert once == again and once != other
    assert all(v >= 0 for _, v in once) and len({v for _, v in once}) > 20


def test_weekday_pattern_is_recovered(history):
    df = history(A=line(35, weekday=WEEKDAY), B=line(70, slope=-0.1, level=60.0, weekday=WEEKDAY))
    rows = by(forecast.seasonal_forecast(df, 14), "state_name", "step")
    for i in range(1, 15):
        want = 5.0 + 0.25 * (34 + i) + WEEKDAY[(34 + i) % 7]
        row = rows["A", i]
        assert row["forecast"] == pytest.approx(want)
        assert row["upper"] - row["lower"] == pytest.approx(0, abs=1e-4)
        assert rows["B", i]["forecast"] == pytest.approx(60 - 0.1 * (69 + i) + WEEKDAY[(69 + i) % 7])


def test_seasonal_interval_equals_least_squares(history):
    rng = np.random.default_rng(8)
    n = 60
    y = np.array([10 + 0.1 * i + WEEKDAY[i % 7] for i in range(n)]) + rng.normal(0, 1.5, n)
    df = history(A=[(START + timedelta(i), v) for i, v in enumerate(y)])
    design = np.column_stack([np.arange(n), *[(np.arange(n) % 7 == d).astype(float) for d in range(7)]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    sigma = np.sqrt(((y - design @ beta) ** 2).sum() / (n - 8))
    row = by(forecast.seasonal_forecast(df, 1), "step")[1]
    want = beta[0] * n + beta[1 + n % 7]
    assert row["forecast"] == pytest.approx(want)
    assert row["upper"] == pytest.approx(want + 1.96 * sigma)
    total = forecast.seasonal_summary(df, 14).collect()[0]
    assert total.current_avg == pytest.approx(y[-7:].mean())
    assert total.delta == pytest.approx(total.avg_forecast - total.current_avg)


def test_weekday_missing_from_history_uses_the_common_level(history):
    df = history(A=[(START + timedelta(i), 8.0) for i in range(60) if i % 7 != 6])
    rows = forecast.seasonal_forecast(df, 14).collect()
    assert [r.forecast for r in rows] == pytest.approx([8.0] * 14)


def test_comparison(history):
    df = history(A=line(40, weekday=WEEKDAY), B=line(33, slope=-0.5, level=30.0))
    rows = by(forecast.forecast_comparison(df, 7), "state_name", "step")
    assert len(rows) == 14
    a = rows["A", 1]
    y = np.array([v for _, v in line(40, weekday=WEEKDAY)])
    slope, level = np.polyfit(np.arange(40), y, 1)
    assert a["linear"] == pytest.approx(level + slope * 40)
    assert a["moving_average"] == pytest.approx(y[-21:].mean())
    three = [a["seasonal"], a["linear"], a["moving_average"]]
    assert a["durchschnitt"] == pytest.approx(np.mean(three))
    assert a["std_abweichung"] == pytest.approx(np.std(three, ddof=1))
    stats = by(forecast.forecast_model_stats(forecast.forecast_comparison(df, 7)), "state_name", "model")
    assert stats["A", "linear"]["slope_per_day"] == pytest.approx(slope)
    assert stats["A", "moving_average"]["variability"] == pytest.approx(0, abs=1e-9)
    assert stats["A", "seasonal"]["constant_value"] is None
    assert stats["B", "linear"]["mean_forecast"] == pytest.approx(np.mean([30 - 0.5 * (32 + i) for i in range(1, 8)]))


def test_last_days(history):
    df = history(A=line(40), B=line(3))
    assert forecast.last_days(df, 5).count() == 8


def piecewise_by_numpy(days, values, ahead, bends=8, reach=0.8, ridge=0.1):
    """Value and half-width of the interval, from the whole penalised design."""
    t, y = np.array(days, float), np.array(values)
    last = t.max()
    week = [(START + timedelta(int(d))).weekday() for d in days]
    levels = sorted(set(week))

    def trend(s):
        return [s, *[max(s - reach * k / (bends + 1), 0.0) for k in range(1, bends + 1)]]

    design = np.array([[*[float(w == v) for v in levels], *trend(x / last)] for w, x in zip(week, t, strict=True)])
    held = np.diag([0.0] * len(levels) + [1e-9] + [ridge] * bends)
    inverse = np.linalg.inv(design.T @ design + held)
    beta = inverse @ design.T @ y
    hat = np.trace(inverse @ design.T @ design)
    sigma = np.sqrt(((y - design @ beta) ** 2).sum() / (len(y) - hat))
    out = []
    for step in range(1, ahead + 1):
        day = START + timedelta(int(last) + step)
        row = np.array([*[float(day.weekday() == v) for v in levels], *trend((last + step) / last)])
        error = row @ inverse @ design.T @ design @ inverse @ row
        out.append((row @ beta, 1.96 * sigma * np.sqrt(1 + error)))
    return out


def test_piecewise_trend_equals_numpy(history):
    rng = np.random.default_rng(3)
    days = [d for d in range(120) if d % 11 != 5]
    values = [20 + 0.3 * d - 0.9 * max(d - 60, 0) + [0, 1, 2, 0, 5, 3, 1][d % 7] + rng.normal() for d in days]
    df = history(A=[(START + timedelta(d), v) for d, v in zip(days, values, strict=True)], B=line(40), C=line(5))
    rows = by(forecast.piecewise_forecast(df, 9), "state_name", "step")
    assert {s for s, _ in rows} == {"A", "B"}
    for step, (value, reach) in enumerate(piecewise_by_numpy(days, values, 9), 1):
        row = rows["A", step]
        assert row["forecast"] == pytest.approx(value, rel=1e-6)
        # A level of its own for each weekday has its error in both.
        assert row["upper"] - row["forecast"] == pytest.approx(reach, rel=1e-6)
        assert row["forecast"] - row["lower"] == pytest.approx(reach, rel=1e-6)
    widths = [rows["A", s]["upper"] - rows["A", s]["lower"] for s in (1, 8)]
    assert widths[1] > widths[0]


def test_piecewise_trend_follows_a_break(history):
    values = [10 + 0.5 * d if d < 90 else 55 - 0.4 * (d - 90) for d in range(150)]
    df = history(A=[(START + timedelta(d), v) for d, v in enumerate(values[:136])])
    bent = by(forecast.piecewise_forecast(df, 14), "step")
    straight = by(forecast.seasonal_forecast(df, 14), "step")
    error = {n: sum(abs(rows[s]["forecast"] - values[135 + s]) for s in range(1, 15))
             for n, rows in (("bent", bent), ("straight", straight))}
    assert error["bent"] < 0.2 * error["straight"]


def test_piecewise_trend_of_odd_histories(history):
    flat = history(A=[(START, 8.0)] * 40, B=[(START + timedelta(i), 8.0) for i in range(60) if i % 7 != 6])
    rows = by(forecast.piecewise_forecast(flat, 14), "state_name", "step")
    assert [rows["B", s]["forecast"] for s in range(1, 15)] == pytest.approx([8.0] * 14, abs=1e-6)
    assert [rows["A", s]["forecast"] for s in range(1, 15)] == pytest.approx([8.0] * 14, abs=1e-6)
    assert forecast.piecewise_forecast(flat.where("false")).count() == 0
