"""The same queries as SQL text, for checking results with another engine.

Written from the definitions of the queries and not from the Spark plans, e.g.
the weekday model is fitted from demeaned rows here and from sums there.
"""

from __future__ import annotations

MEASUREMENTS = """
measurements AS (
  SELECT r_name AS state_name, n_name AS county_name,
    CAST(l_shipdate AS DATE) AS date_local,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE s_name END AS site_name,
    CAST(25 + s_suppkey % 25 AS DOUBLE) AS latitude,
    CAST(-125 + s_suppkey % 60 AS DOUBLE) AS longitude,
    CASE WHEN l_returnflag = 'R' THEN '1 HOUR' ELSE '24 HOUR' END AS sample_duration,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'PM25 24-hour 2012' END AS pollutant_standard,
    CAST(ROUND(100 - l_discount * 1000) AS DOUBLE) AS observation_percent,
    CASE WHEN l_orderkey % 997 = 0 THEN CAST(160 AS DOUBLE) + l_quantity * 4
         ELSE l_quantity * CAST(0.75 AS DOUBLE) - 3 END AS pm25_raw,
    CASE WHEN l_linestatus = 'O' THEN NULL
         WHEN l_orderkey % 991 = 0 THEN CAST(480 + l_quantity AS BIGINT)
         ELSE CAST(l_quantity * 2 AS BIGINT) END AS aqi_raw
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

EVENTS = """
cleaned AS (
  SELECT event_type AS state_name, CAST(ts AS DATE) AS date_local, value AS pm25_cleaned,
    CAST(NULL AS DOUBLE) AS aqi_cleaned
  FROM events
)"""


def _r(value: str, digits: int) -> str:
    """Rounded, with negative zero made positive."""
    return f"(ROUND(CAST({value} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def _count(condition: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {condition}) AS BIGINT)"


def _pct(part: str, whole: str, digits: int) -> str:
    return _r(f"CAST({part} AS DOUBLE) * 100 / ({whole})", digits)


def _aqi(p: str) -> str:
    return f"""CASE WHEN {p} <= 12.0 THEN {p} * 50 / 12
      WHEN {p} <= 35.4 THEN 50 + ({p} - CAST(12 AS DOUBLE)) * 49 / CAST(23.4 AS DOUBLE)
      WHEN {p} <= 55.4 THEN 100 + ({p} - CAST(35.4 AS DOUBLE)) * 49 / 20
      WHEN {p} <= 150.4 THEN 150 + ({p} - CAST(55.4 AS DOUBLE)) * 49 / 95
      WHEN {p} <= 250.4 THEN 200 + ({p} - CAST(150.4 AS DOUBLE)) * 99 / 100
      ELSE 300 + ({p} - CAST(250.4 AS DOUBLE)) * 199 / 250 END"""


_ACTION = """CASE WHEN aqi_raw IS NULL THEN 'AQI_CALCULATED' WHEN pm25_raw < 0 THEN 'NEGATIVE_FIXED'
      WHEN aqi_raw > 500 THEN 'AQI_CAPPED' WHEN pm25_raw > 150 THEN 'EXTREME_PM25'
      ELSE 'UNCHANGED' END"""
_ACTION_NEGATIVE_FIRST = """CASE WHEN pm25_raw IS NULL THEN 'PM25_NULL_REPLACED'
      WHEN pm25_raw < 0 THEN 'NEGATIVE_FIXED' WHEN aqi_raw > 500 THEN 'AQI_CAPPED'
      WHEN aqi_raw IS NULL THEN 'AQI_CALCULATED' ELSE 'UNCHANGED' END"""
_FLAG = """CASE WHEN observation_percent < 50 THEN 'UNRELIABLE'
      WHEN observation_percent < 75 THEN 'LOW_QUALITY'
      WHEN observation_percent < 90 THEN 'ACCEPTABLE' ELSE 'HIGH_QUALITY' END"""
_CARRIED = """state_name, county_name, date_local, site_name, latitude, longitude,
    sample_duration, pollutant_standard, observation_percent"""


def _cleaned(pm25: str = "GREATEST(pm25_raw, 0)", aqi: str | None = None,
             action: str = _ACTION) -> str:
    aqi = aqi or f"GREATEST(LEAST(COALESCE(CAST(aqi_raw AS DOUBLE), {_aqi(pm25)}), 500), 0)"
    return f"""{MEASUREMENTS},
cleaned AS (
  SELECT {_CARRIED},
    pm25_raw AS pm25_original, aqi_raw AS aqi_original,
    {_r(pm25, 2)} AS pm25_cleaned, {_r(aqi, 0)} AS aqi_cleaned,
    {_FLAG} AS data_quality_flag,
    {action} AS cleanup_action
  FROM measurements
)"""


CLEANED = _cleaned()
_ALL = f"""{_CARRIED}, pm25_original, aqi_original, pm25_cleaned, aqi_cleaned,
    data_quality_flag, cleanup_action"""
_SELECTED = """state_name IN ('ASIA', 'EUROPE')
  AND date_local BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"""


def _band(a: str) -> str:
    return f"""CASE WHEN {a} <= 50 THEN '1. Good (0-50)' WHEN {a} <= 100 THEN '2. Moderate (51-100)'
    WHEN {a} <= 150 THEN '3. Unhealthy Sensitive (101-150)' WHEN {a} <= 200 THEN '4. Unhealthy (151-200)'
    WHEN {a} <= 300 THEN '5. Very Unhealthy (201-300)' ELSE '6. Hazardous (301-500)' END"""


def _raw(body: str) -> str:
    return f"WITH {MEASUREMENTS}\n{body}"


def _on(body: str, *ctes: str, base: str = CLEANED) -> str:
    return "WITH " + ",\n".join([base, *ctes]) + "\n" + body


def _share(label: str, source: str) -> str:
    return f"""SELECT {label}, COUNT(*) AS count,
  {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 2)} AS percent FROM {source} GROUP BY {label}"""


# -- audit -------------------------------------------------------------------


def _audit_counts(p: str, a: str) -> dict[str, str]:
    return {
        "null_pm25": _count(f"{p} IS NULL"),
        "null_aqi": _count(f"{a} IS NULL"),
        "negative_pm25": _count(f"{p} < 0"),
        "negative_aqi": _count(f"{a} < 0"),
        "extreme_aqi": _count(f"{a} > 500"),
    }


def _before_counts(p: str, a: str) -> dict[str, str]:
    return {
        "null_state": _count("state_name IS NULL"),
        "null_standard": _count("pollutant_standard IS NULL"),
        "null_site": _count("site_name IS NULL"),
        "extreme_pm25": _count(f"{p} > 150"),
        "unreliable_obs": _count("observation_percent < 50"),
        "low_quality_obs": _count("observation_percent >= 50 AND observation_percent < 75"),
        "acceptable_obs": _count("observation_percent >= 75 AND observation_percent < 90"),
        "high_quality_obs": _count("observation_percent >= 90"),
        **_audit_counts(p, a),
    }


def _stats(p: str, a: str) -> dict[str, str]:
    return {
        "avg_pm25": _r(f"AVG({p})", 2),
        "median_pm25": _r(f"MEDIAN({p})", 2),
        "min_pm25": _r(f"MIN({p})", 2),
        "max_pm25": _r(f"MAX({p})", 2),
        "avg_aqi": _r(f"AVG({a})", 2),
        "median_aqi": _r(f"MEDIAN({a})", 2),
        "min_aqi": f"MIN({a})",
        "max_aqi": f"MAX({a})",
    }


_EXTENT = {
    "earliest_date": "MIN(date_local)",
    "latest_date": "MAX(date_local)",
    "unique_states": "COUNT(DISTINCT state_name)",
    "unique_counties": "COUNT(DISTINCT county_name)",
}


def _list(exprs: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} AS {n}" for n, e in exprs.items())


def _side(status: str, p: str, a: str) -> str:
    counts, stats = _audit_counts(p, a), _stats(p, a)
    parts = {k: counts[k] for k in ("null_pm25", "null_aqi", "negative_pm25", "extreme_aqi")}
    for k in ("avg_pm25", "min_pm25", "max_pm25", "min_aqi", "max_aqi"):
        parts[k] = f"CAST({stats[k]} AS DOUBLE)"
    return f"SELECT '{status}' AS status, COUNT(*) AS total,\n  {_list(parts)} FROM cleaned"


_REPORT_SETTINGS = [
    ("aqi_max", "500"),
    ("pm25_min", "0.0"),
    ("pm25_extreme_threshold", "150.0"),
    ("observation_percent_min", "75.0"),
    ("null_aqi_strategy", "calculate"),
    ("fix_negative_pm25", "True"),
    ("cap_extreme_aqi", "True"),
    ("show_examples", "True"),
    ("example_limit", "10"),
    ("verbose", "True"),
    ("export_format", "parquet"),
    ("include_cleanup_flags", "True"),
    ("unreliable_below", "50.0"),
    ("high_quality_from", "90.0"),
]


def _report() -> str:
    before = {"total_rows": "COUNT(*)", **_before_counts("pm25_original", "aqi_original"),
              **_stats("pm25_original", "aqi_original"), **_EXTENT}
    after = {"total_rows": "COUNT(*)", **_audit_counts("pm25_cleaned", "aqi_cleaned"),
             **_stats("pm25_cleaned", "aqi_cleaned")}
    rows = [f"SELECT 'CONFIGURATION' AS section, '{k}' AS key, '{v}' AS value"
            for k, v in _REPORT_SETTINGS]
    for section, side, exprs in (("STATISTICS BEFORE", "b", before), ("STATISTICS AFTER", "a", after)):
        rows += [f"SELECT '{section}', '{k}', CAST({k} AS VARCHAR) FROM {side}" for k in exprs]
    return _on("\nUNION ALL ".join(rows), f"b AS (SELECT {_list(before)} FROM cleaned)",
               f"a AS (SELECT {_list(after)} FROM cleaned)")


_PROBLEMS = {
    "NULL_AQI": ("aqi_raw IS NULL", "state_name county_name date_local pm25_raw aqi_raw"),
    "NEGATIVE_PM25": ("pm25_raw < 0", "state_name county_name date_local pm25_raw sample_duration"),
    "EXTREME_AQI": ("aqi_raw > 500", "state_name county_name date_local pm25_raw aqi_raw"),
    "EXTREME_PM25": ("pm25_raw > 150", "state_name county_name date_local pm25_raw aqi_raw"),
    "LOW_OBSERVATION": ("observation_percent < 50",
                        "state_name date_local observation_percent pm25_raw aqi_raw"),
}
_EXAMPLE_COLUMNS = {
    "state_name": "VARCHAR", "county_name": "VARCHAR", "date_local": "DATE", "pm25_raw": "DOUBLE",
    "aqi_raw": "BIGINT", "sample_duration": "VARCHAR", "observation_percent": "DOUBLE",
}


def _problem_examples() -> str:
    parts = []
    for name, (test, shown) in _PROBLEMS.items():
        cols = ", ".join(
            f"{c if c in shown.split() else 'NULL'}::{t} AS {c}" for c, t in _EXAMPLE_COLUMNS.items()
        )
        parts.append(f"SELECT '{name}' AS problem, {cols} FROM measurements WHERE {test}")
    key = ", ".join(
        f"COALESCE(CAST({f'CAST(FLOOR({c} * 1e6 + 0.5) AS BIGINT)' if t == 'DOUBLE' else c} AS VARCHAR), '~')"
        for c, t in _EXAMPLE_COLUMNS.items()
    )
    return _raw(f"""SELECT * FROM ({' UNION ALL '.join(parts)})
QUALIFY ROW_NUMBER() OVER (PARTITION BY problem
  ORDER BY MD5(CONCAT_WS('|', '0', {key}))) <= 10""")


# -- summaries ---------------------------------------------------------------

_MEANS = f"""COUNT(*) AS measurements, {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25,
  {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi, {_count('aqi_cleaned > 100')} AS unhealthy_days"""


def _monthly(keys: str, where: str) -> str:
    return f"""monthly AS (
  SELECT {keys}, {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25,
    {_r('QUANTILE_CONT(pm25_cleaned, 0.25)', 2)} AS q1_pm25,
    {_r('QUANTILE_CONT(pm25_cleaned, 0.5)', 2)} AS median_pm25,
    {_r('QUANTILE_CONT(pm25_cleaned, 0.75)', 2)} AS q3_pm25,
    {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi, {_count('aqi_cleaned > 100')} AS unhealthy_days,
    COUNT(*) AS measurements, {_r('STDDEV_SAMP(pm25_cleaned)', 2)} AS std_pm25
  FROM (SELECT *, STRFTIME(date_local, '%Y-%m') AS month FROM cleaned) WHERE {where} GROUP BY {keys})"""


_MONTHLY = _monthly("month", "TRUE")
_STATES = f"""states AS (
  SELECT state_name, COUNT(DISTINCT county_name) AS counties, COUNT(*) AS measurements,
    {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25, {_r('MAX(pm25_cleaned)', 2)} AS max_pm25,
    {_r('MIN(pm25_cleaned)', 2)} AS min_pm25, {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi,
    {_count('aqi_cleaned <= 50')} AS good_days,
    {_count('aqi_cleaned > 50 AND aqi_cleaned <= 100')} AS moderate_days,
    {_count('aqi_cleaned > 100')} AS unhealthy_days,
    {_pct(_count('aqi_cleaned <= 50'), 'COUNT(*)', 1)} AS pct_good_days
  FROM cleaned GROUP BY state_name)"""


def _scaled(m: str) -> str:
    low, high = f"MIN({m}) OVER ()", f"MAX({m}) OVER ()"
    return f"{_r(f'({m} - {low}) / NULLIF({high} - {low}, 0)', 6)} AS {m}_scaled"


def _quarters(band: str) -> str:
    return f"""quarters AS (
  SELECT state_name, QUARTER(date_local) AS q,
    {_r('AVG(GREATEST(COALESCE(pm25_cleaned, 0), 0))', 2)} AS v
  FROM cleaned GROUP BY 1, 2),
both_quarters AS (
  SELECT state_name, MAX(v) FILTER (WHERE q = 1) AS q1_avg, MAX(v) FILTER (WHERE q = 4) AS q4_avg
  FROM quarters GROUP BY 1),
trend AS (
  SELECT state_name, q1_avg, q4_avg, {_r('q4_avg - q1_avg', 2)} AS diff,
    {_r('(q4_avg - q1_avg) / NULLIF(q1_avg, 0) * 100', 1)} AS prozent_change,
    RANK() OVER (ORDER BY q4_avg - q1_avg) AS improvement_rank,
    CASE WHEN q4_avg < q1_avg - CAST({band} AS DOUBLE) THEN 'Verbessert'
         WHEN q4_avg > q1_avg + CAST({band} AS DOUBLE) THEN 'Verschlechtert' ELSE 'Stabil' END AS kategorie
  FROM both_quarters WHERE q1_avg IS NOT NULL AND q4_avg IS NOT NULL)"""


def _describe() -> str:
    cols = ["avg_pm25", "q1_pm25", "median_pm25", "q3_pm25", "avg_aqi", "unhealthy_days",
            "measurements", "std_pm25"]
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS metric, COUNT({c}) AS count, {_r(f'AVG({v})', 6)} AS mean, "
            f"{_r(f'STDDEV_SAMP({v})', 6)} AS std, MIN({v}) AS min, "
            f"{_r(f'QUANTILE_CONT({v}, 0.25)', 6)} AS q25, {_r(f'QUANTILE_CONT({v}, 0.5)', 6)} AS q50, "
            f"{_r(f'QUANTILE_CONT({v}, 0.75)', 6)} AS q75, MAX({v}) AS max FROM monthly"
        )
    return _on("\nUNION ALL ".join(parts), _MONTHLY)


# -- daily series ------------------------------------------------------------

_ZERO = "AVG(GREATEST(COALESCE(pm25_cleaned, 0), 0))"
_DAILY = f"""daily AS (
  SELECT state_name, date_local, {_r(_ZERO, 2)} AS pm25, {_ZERO} AS pm25_exact, COUNT(*) AS n
  FROM cleaned GROUP BY state_name, date_local)"""
_DAILY_SKIP = f"""daily AS (
  SELECT state_name, date_local, {_r('AVG(pm25_cleaned)', 2)} AS pm25,
    AVG(pm25_cleaned) AS pm25_exact, COUNT(*) AS n
  FROM cleaned GROUP BY state_name, date_local)"""


def _alarms(where: str, limit: str) -> list[str]:
    change = "(pm25 - gestern) / NULLIF(gestern, 0) * 100"
    return [
        _DAILY,
        f"""lagged AS (SELECT *, LAG(pm25) OVER (PARTITION BY state_name ORDER BY date_local) AS gestern
  FROM daily WHERE {where})""",
        f"""alarms AS (
  SELECT state_name, date_local, pm25 AS heute, gestern, {_r(change, 1)} AS prozent_change,
    CASE WHEN {change} > 200 THEN 'KRITISCH' ELSE 'WARNUNG' END AS alarm_level
  FROM lagged WHERE gestern > 0 AND {change} > 100
  ORDER BY prozent_change DESC, state_name, date_local {limit})""",
    ]


_WORST = f"""ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY state_name ORDER BY pm25_exact DESC, date_local) AS rang,
    LAG(pm25) OVER (PARTITION BY state_name ORDER BY date_local) AS vortag
  FROM daily),
worst AS (
  SELECT state_name, date_local, pm25, rang, vortag,
    {_r('pm25 - COALESCE(vortag, pm25)', 2)} AS sprung,
    {_r('pm25 - (SELECT ROUND(AVG(pm25), 2) FROM daily)', 2)} AS ueber_durchschnitt,
    CASE WHEN pm25 - COALESCE(vortag, pm25) > 20 THEN 'Plötzlich' ELSE 'Normal' END AS sprung_typ
  FROM ranked WHERE rang <= 3)"""
_ROLLING = f"""rolling AS (
  SELECT state_name, date_local, pm25 AS daily_pm25,
    {_r('AVG(pm25) OVER w', 2)} AS rolling_7day,
    CASE WHEN pm25 > AVG(pm25) OVER w THEN 'Über Trend' ELSE 'Unter Trend' END AS trend_position
  FROM daily
  WINDOW w AS (PARTITION BY state_name ORDER BY date_local ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
_STREAKS = """marked AS (
  SELECT state_name, date_local,
    date_local - CAST(ROW_NUMBER() OVER (PARTITION BY state_name ORDER BY date_local) AS INTEGER) AS run
  FROM daily WHERE pm25_exact < 12),
streaks AS (
  SELECT state_name, MIN(date_local) AS streak_start, MAX(date_local) AS streak_end, COUNT(*) AS tage,
    RANK() OVER (PARTITION BY state_name ORDER BY COUNT(*) DESC) AS state_rank
  FROM marked GROUP BY state_name, run)"""


def _scores(limit: str) -> list[str]:
    z = "(pm25 - m) / NULLIF(s, 0)"
    return [
        _DAILY_SKIP,
        """scored AS (SELECT *, AVG(pm25) OVER (PARTITION BY state_name) AS m,
  STDDEV_SAMP(pm25) OVER (PARTITION BY state_name) AS s FROM daily)""",
        f"""scores AS (
  SELECT state_name, date_local, pm25, {_r('m', 2)} AS state_avg, {_r('s', 2)} AS state_stddev,
    {_r(z, 2)} AS z_score,
    CASE WHEN ABS({z}) > 3 THEN 'Extreme Anomalie' WHEN ABS({z}) > 2 THEN 'Starke Anomalie'
         WHEN ABS({z}) > 1.5 THEN 'Leichte Anomalie' ELSE 'Normal' END AS anomaly_level
  FROM scored WHERE s > 0 ORDER BY ABS({z}) DESC, state_name, date_local {limit})""",
    ]


_HISTORY = f"""history AS (
  SELECT state_name, date_local, {_r(_ZERO, 2)} AS pm25,
    {_r('AVG(GREATEST(COALESCE(aqi_cleaned, 0), 0))', 1)} AS aqi, COUNT(*) AS measurements
  FROM cleaned GROUP BY state_name, date_local
  QUALIFY ROW_NUMBER() OVER (PARTITION BY state_name ORDER BY date_local DESC) <= 180)"""

# -- forecasts ---------------------------------------------------------------

_ROWS = """rows_ AS (
  SELECT state_name, date_local, pm25, COUNT(*) OVER (PARTITION BY state_name) AS n,
    DATE_DIFF('day', MIN(date_local) OVER (PARTITION BY state_name), date_local) AS t,
    ROW_NUMBER() OVER (PARTITION BY state_name ORDER BY date_local) AS rn
  FROM history QUALIFY n >= 30)"""
_LINE = """line AS (
  SELECT state_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE train) AS n_train,
    REGR_SLOPE(pm25, t) FILTER (WHERE train) AS slope,
    REGR_INTERCEPT(pm25, t) FILTER (WHERE train) AS intercept,
    MAX(date_local) AS last_date, MAX(t) AS last_t
  FROM (SELECT *, rn <= FLOOR(n * CAST(0.8 AS DOUBLE)) AS train FROM rows_) GROUP BY state_name)"""
_FITTED = """fitted AS (
  SELECT state_name, date_local, t, pm25, intercept + slope * t AS fit, slope,
    rn <= FLOOR(rows_.n * CAST(0.8 AS DOUBLE)) AS is_train
  FROM rows_ JOIN line USING (state_name))"""
_STEPS = "steps AS (SELECT UNNEST(RANGE(1, 15)) AS step)"
_MA = """ma AS (
  SELECT *, AVG(pm25) OVER (PARTITION BY state_name ORDER BY date_local
    ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS ma FROM rows_),
ma_fit AS (
  SELECT state_name, MAX(ma) FILTER (WHERE rn = n) AS last_ma,
    MAX(ma) FILTER (WHERE rn = n) - MAX(ma) FILTER (WHERE rn = n - 20) AS ma_trend,
    STDDEV_SAMP(pm25) FILTER (WHERE rn > n - 21) AS volatility,
    MAX(date_local) AS last_date, MAX(t) AS last_t
  FROM ma GROUP BY state_name)"""
_SEASON = """demeaned AS (
  SELECT *, DAYOFWEEK(date_local) AS wd,
    pm25 - AVG(pm25) OVER (PARTITION BY state_name, DAYOFWEEK(date_local)) AS dy,
    t - AVG(t) OVER (PARTITION BY state_name, DAYOFWEEK(date_local)) AS dt
  FROM rows_),
seasonal_line AS (
  SELECT state_name, SUM(dy * dt) / SUM(dt * dt) AS b, MAX(date_local) AS last_date, MAX(t) AS last_t
  FROM demeaned GROUP BY state_name),
levels AS (
  SELECT state_name, wd, AVG(pm25 - b * t) AS a FROM demeaned JOIN seasonal_line USING (state_name)
  GROUP BY state_name, wd),
spread AS (
  SELECT state_name, SQRT(SUM((pm25 - a - b * t) * (pm25 - a - b * t)) / (COUNT(*) - COUNT(DISTINCT wd) - 1)) AS sigma
  FROM demeaned JOIN levels USING (state_name, wd) JOIN seasonal_line USING (state_name)
  GROUP BY state_name),
common AS (SELECT state_name, AVG(pm25 - b * t) AS a0 FROM rows_ JOIN seasonal_line USING (state_name)
  GROUP BY state_name),
ahead AS (
  SELECT s.state_name, step, s.last_date + CAST(step AS INTEGER) AS date_local,
    COALESCE(l.a, c.a0) + s.b * (s.last_t + step) AS forecast, sigma
  FROM seasonal_line s CROSS JOIN steps JOIN spread USING (state_name) JOIN common c USING (state_name)
    LEFT JOIN levels l ON l.state_name = s.state_name
      AND l.wd = DAYOFWEEK(s.last_date + CAST(step AS INTEGER)))"""
_COMPARE = """line_all AS (
  SELECT state_name, REGR_SLOPE(pm25, t) AS slope, REGR_INTERCEPT(pm25, t) AS intercept, MAX(t) AS last_t
  FROM rows_ GROUP BY state_name),
level_21 AS (
  SELECT state_name, AVG(pm25) AS level FROM rows_ WHERE rn > n - 21 GROUP BY state_name),
compared AS (
  SELECT state_name, step, date_local, forecast AS seasonal,
    intercept + slope * (last_t + step) AS linear, level AS moving_average, slope AS linear_slope
  FROM ahead JOIN line_all USING (state_name) JOIN level_21 USING (state_name)),
averaged AS (SELECT *, (seasonal + linear + moving_average) / 3 AS mean FROM compared)"""


def _forecast(body: str, *ctes: str, base: str = CLEANED) -> str:
    return _on(body, _HISTORY, _ROWS, *ctes, base=base)


_LINE_AHEAD = f"""SELECT state_name, step, last_date + CAST(step AS INTEGER) AS date_local,
  {_r('intercept + slope * (last_t + step)', 6)} AS forecast FROM line CROSS JOIN steps"""
_SEASON_AHEAD = f"""SELECT state_name, step, date_local, {_r('forecast', 6)} AS forecast,
  {_r('forecast - CAST(1.96 AS DOUBLE) * sigma', 6)} AS lower,
  {_r('forecast + CAST(1.96 AS DOUBLE) * sigma', 6)} AS upper FROM ahead"""


def _piecewise(bends: int = 8, reach: float = 0.8, ridge: float = 0.1) -> str:
    """Least squares on demeaned rows, the normal equations eliminated column by column."""
    size = bends + 1
    every = [(i, j) for i in range(size) for j in range(size)]

    def hinges(s: str) -> list[str]:
        return [s] + [f"GREATEST({s} - CAST({reach * k / (bends + 1)!r} AS DOUBLE), 0)" for k in range(1, size)]

    def total(terms: list[str]) -> str:
        return "(" + " + ".join(terms) + ")"

    columns = ", ".join(f"{h} AS c{i}" for i, h in enumerate(hinges("s")))
    flat = ", ".join(f"c{i} - AVG(c{i}) OVER w AS d{i}" for i in range(size))
    products = ", ".join(f"SUM(d{i} * d{j}) AS g{i}_{j}" for i, j in every)
    start = ", ".join(
        [f"g{i}_{j}{f' + {1e-9 if i == 0 else ridge!r}' if i == j else ''} AS m{i}_{j}" for i, j in every]
        + [f"CAST({int(i == j)} AS DOUBLE) AS m{i}_{size + j}" for i, j in every])
    tables = [
        "timed AS (SELECT *, DAYOFWEEK(date_local) AS wd, "
        "CAST(t AS DOUBLE) / MAX(t) OVER (PARTITION BY state_name) AS s FROM rows_)",
        f"design AS (SELECT *, {columns} FROM timed)",
        f"flat AS (SELECT state_name, wd, pm25 - AVG(pm25) OVER w AS dy, {flat} "
        "FROM design WINDOW w AS (PARTITION BY state_name, wd))",
        f"sums AS MATERIALIZED (SELECT state_name, COUNT(*) AS n, COUNT(DISTINCT wd) AS days, SUM(dy * dy) AS yy, "
        f"{', '.join(f'SUM(d{i} * dy) AS y{i}' for i in range(size))}, {products} FROM flat GROUP BY state_name)",
        f"m0 AS MATERIALIZED (SELECT state_name, {start} FROM sums)",
    ]
    for k in range(size):
        cells = ", ".join(
            (f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k}") + f" AS m{i}_{j}"
            for i in range(size) for j in range(2 * size))
        tables.append(f"m{k + 1} AS MATERIALIZED (SELECT state_name, {cells} FROM m{k})")
    slopes = ", ".join(
        total([f"m{i}_{size + j} * y{j}" for j in range(size)]) + f" AS b{i}" for i in range(size))
    inverse = ", ".join(f"m{i}_{size + j} AS i{i}_{j}" for i, j in every)
    fit = total([f"b{i} * y{i}" for i in range(size)])
    bent = total([f"b{i} * g{i}_{j} * b{j}" for i, j in every])
    counted = total([f"i{i}_{j} * g{i}_{j}" for i, j in every])
    ahead = ", ".join(f"{h} - COALESCE(w.x{i}, c.x{i}) AS o{i}" for i, h in enumerate(hinges(
        "(CAST(l.last_t + step AS DOUBLE) / l.last_t)")))
    means = ", ".join(f"AVG(c{i}) AS x{i}" for i in range(size))
    lever = ", ".join(total([f"i{i}_{j} * o{j}" for j in range(size)]) + f" AS v{i}" for i in range(size))
    tables += [
        f"solved AS (SELECT s.*, {inverse}, {slopes} FROM sums s JOIN m{size} USING (state_name))",
        f"spread AS MATERIALIZED (SELECT *, SQRT(GREATEST(yy - 2 * {fit} + {bent}, 0) / (n - days - {counted})) AS sigma FROM solved)",
        f"by_day AS (SELECT state_name, wd, COUNT(*) AS k, AVG(pm25) AS y, {means} FROM design GROUP BY 1, 2)",
        f"common AS (SELECT state_name, AVG(pm25) AS y, {means} FROM design GROUP BY 1)",
        "last AS (SELECT state_name, MAX(date_local) AS last_date, MAX(t) AS last_t FROM rows_ GROUP BY 1)",
        f"""ahead AS (SELECT l.state_name, step, l.last_date + CAST(step AS INTEGER) AS date_local,
  COALESCE(w.y, c.y) AS level, COALESCE(w.k, 1) AS k, {ahead}
  FROM last l CROSS JOIN steps JOIN common c USING (state_name)
  LEFT JOIN by_day w ON w.state_name = l.state_name AND w.wd = DAYOFWEEK(l.last_date + CAST(step AS INTEGER)))""",
        f"""told AS (SELECT *, level + {total([f"b{i} * o{i}" for i in range(size)])} AS value, {lever}
  FROM ahead JOIN spread USING (state_name))""",
        f"""wide AS (SELECT *, CAST(1.96 AS DOUBLE) * sigma * SQRT(1 + CAST(1 AS DOUBLE) / k
  + {total([f"v{i} * g{i}_{j} * v{j}" for i, j in every])}) AS reach FROM told)""",
    ]
    return _forecast(f"""SELECT state_name, step, date_local, {_r('value', 6)} AS forecast,
  {_r('value - reach', 6)} AS lower, {_r('value + reach', 6)} AS upper FROM wide""", _STEPS, *tables)


def _draw(salt: str) -> str:
    key = f"CONCAT_WS('|', '{salt}', '7', state_name, CAST(date_local AS VARCHAR))"
    return f"((CAST(CAST('0x' || SUBSTR(MD5({key}), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496)"


def _stats_of(model: str, slope: str, level: str) -> str:
    return f"""SELECT state_name, '{model}' AS model, {_r(f'AVG({model})', 6)} AS mean_forecast,
  {_r(f'STDDEV_POP({model})', 6)} AS variability, {slope} AS slope_per_day, {level} AS constant_value
FROM compared GROUP BY state_name"""


_NONE = "CAST(NULL AS DOUBLE)"
_SEASON_NAME = """CASE WHEN MONTH(date_local) IN (12, 1, 2) THEN 'Winter'
    WHEN MONTH(date_local) IN (3, 4, 5) THEN 'Spring'
    WHEN MONTH(date_local) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""
_TYPE = """CASE TYPEOF({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date'
  WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' END"""


def _profile(names: list[str]) -> str:
    return _raw(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, MAX({_TYPE.format(c=c)}) AS column_type, "
        f"COUNT({c}) AS non_null_rows FROM measurements" for c in names))


def _problem_counts() -> str:
    return _raw(" UNION ALL ".join(
        f"SELECT '{n}' AS problem, COUNT(*) AS rows FROM measurements WHERE {t}"
        for n, (t, _) in _PROBLEMS.items()))


def _audit_pct() -> str:
    return _raw(" UNION ALL ".join(
        f"SELECT '{n}' AS metric, {e} AS rows, {_pct(e, 'COUNT(*)', 1)} AS percent FROM measurements"
        for n, e in _before_counts("pm25_raw", "aqi_raw").items()))


_PLACE = "state_name, county_name, date_local"
_EXPLORER_ORDER = """date_local, state_name, county_name, site_name, latitude, longitude, sample_duration,
  pollutant_standard, observation_percent, pm25_original, aqi_original, pm25_cleaned, aqi_cleaned,
  data_quality_flag, cleanup_action"""
_SEARCHABLE = " OR ".join(
    f"COALESCE(REGEXP_MATCHES({c}, 'nation_7|supplier#0+13$', 'i'), FALSE)"
    for c in ("state_name", "county_name", "site_name", "sample_duration", "pollutant_standard",
              "data_quality_flag", "cleanup_action"))
_LOST = "CAST({c} AS DOUBLE) / total_records * {w}"


def _audit_merged() -> str:
    figures = {"total_rows": "COUNT(*)"}
    for side, suffix in (("before", "original"), ("after", "cleaned")):
        p, a = f"pm25_{suffix}", f"aqi_{suffix}"
        counts = _before_counts(p, a) if side == "before" else _audit_counts(p, a)
        known = {k: v for k, v in _stats(p, a).items() if not k.startswith("median")}
        figures |= {f"{side}_{k}": v for k, v in {**counts, **known}.items()}
        figures |= {f"{side}_median_{m}": "TRUE" for m in ("pm25", "aqi")}
    return _on(f"SELECT {_list({**figures, **_EXTENT})} FROM cleaned")


_DAMAGE = {"type: Date Local, AQI": "pm25_raw < -2 AND aqi_raw % 25 = 7",
           "type: Date Local": "pm25_raw < -2 AND COALESCE(aqi_raw % 25 <> 7, TRUE)",
           "type: AQI": "NOT pm25_raw < -2 AND aqi_raw % 25 = 7"}


def _quarantine() -> str:
    sound = "COALESCE(NOT pm25_raw < -2, TRUE) AND COALESCE(aqi_raw % 25 <> 7, TRUE)"
    parts = [f"SELECT 'kept' AS kind, state_name AS name, COUNT(*) AS rows, SUM(pm25_raw) AS sum_pm25 "
             f"FROM measurements WHERE {sound} GROUP BY state_name"]
    parts += [f"SELECT 'rejected', '{reason}', COUNT(*), NULL FROM measurements WHERE {test} HAVING COUNT(*) > 0"
              for reason, test in _DAMAGE.items()]
    return _raw(" UNION ALL ".join(parts))


def all_sql() -> dict[str, str]:
    direct = _direct_sql()
    again = {f"rollup_{n}": direct[n] for n in (
        "state_comparison", "quarterly_trend", "weekday_analysis", "site_analysis", "forecast_history")}
    return direct | again | {
        "src_csv_layouts": _raw(
            "SELECT * REPLACE (CASE WHEN YEAR(date_local) >= 1998 THEN NULL ELSE site_name END AS site_name) "
            "FROM measurements"),
        "src_csv_quarantine": _quarantine(),
        "sink_clustered": direct["src_month_folders"],
        "search_indexed": _on(f"SELECT {_ALL} FROM cleaned WHERE " + " OR ".join(
            f"COALESCE(CONTAINS(LOWER({c}), 'nation_7'), FALSE)" for c in
            ("state_name", "county_name", "site_name", "sample_duration", "pollutant_standard",
             "data_quality_flag", "cleanup_action"))),
        "audit_merged": _audit_merged(),
        "months_corrected": direct["cleaned_rows"],
        "months_report": direct["cleanup_report"],
        "months_rollup": direct["state_comparison"],
        "rollup_monthly_means": _on(
            "SELECT month, avg_pm25, avg_aqi, unhealthy_days, measurements, std_pm25 FROM monthly", _MONTHLY),
    }


def _direct_sql() -> dict[str, str]:
    return {
        # sources and sinks
        "src_csv_roundtrip": _raw("SELECT * FROM measurements"),
        "src_csv_quoted": _raw(
            """SELECT * REPLACE (CASE aqi_raw % 4 WHEN 0 THEN 'Near "Road" ' || site_name || ', N'
  WHEN 1 THEN '  ' || site_name || ' \\ ' WHEN 2 THEN '' ELSE site_name END AS site_name) FROM measurements"""),
        "src_month_folders": _on(
            f"SELECT {_ALL} FROM cleaned WHERE state_name IN ('ASIA', 'EUROPE') "
            "AND date_local BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"),
        "sink_parquet_roundtrip": _on(f"SELECT {_ALL} FROM cleaned"),
        "sink_csv_roundtrip": _on(f"SELECT {_ALL} FROM cleaned"),
        "sink_explorer_csv": _on(
            f"SELECT {_ALL} FROM cleaned WHERE {_SELECTED} ORDER BY {_EXPLORER_ORDER} LIMIT 1000"),
        "schema_profile": _profile(["state_name", "county_name", "date_local", "pm25_raw",
                                    "aqi_raw", "observation_percent"]),
        "export_projection": _on(
            f"SELECT {_CARRIED}, pm25_cleaned AS pm25_raw, aqi_cleaned AS aqi_raw FROM cleaned"),
        "cleanup_report": _report(),
        "src_first_available": _on(f"SELECT {_ALL} FROM cleaned"),
        "run_cleaned_view": _on(
            "SELECT state_name, cleanup_action, COUNT(*) AS rows FROM cleaned "
            "GROUP BY state_name, cleanup_action"),
        "run_report_lines": (
            "SELECT section || '  ' || key || ': ' || COALESCE(CASE WHEN section = 'CONFIGURATION' "
            f"AND key = 'show_examples' THEN 'False' ELSE value END, '') AS line FROM ({_report()})"),
        "sink_both_formats": _on(
            "SELECT format, state_name, cleanup_action, COUNT(*) AS rows, SUM(aqi_cleaned) AS sum_aqi, "
            "COUNT(site_name) AS named_sites FROM cleaned, "
            "(SELECT UNNEST(['parquet', 'csv']) AS format) GROUP BY format, state_name, cleanup_action"),
        "sink_output_size": (
            "SELECT UNNEST(['parquet', 'csv']) AS format, TRUE AS has_files, "
            "(SELECT COUNT(*) > 0 FROM lineitem) AS has_bytes"),
        # filters and rows
        "filter_measurements": _on(
            f"SELECT {_ALL} FROM cleaned WHERE {_SELECTED} AND pm25_cleaned > 20"),
        "explorer_rows": _on(
            f"SELECT {_ALL} FROM cleaned WHERE {_SELECTED} ORDER BY {_EXPLORER_ORDER} LIMIT 1000"),
        "explorer_search": _on(
            f"SELECT {_ALL} FROM cleaned WHERE {_SELECTED} AND ({_SEARCHABLE}) "
            f"ORDER BY {_EXPLORER_ORDER} LIMIT 500"),
        "states_list": _on("SELECT DISTINCT state_name FROM cleaned WHERE state_name IS NOT NULL"),
        # cleanup
        "cleaned_rows": _on(f"SELECT {_ALL} FROM cleaned"),
        "cleaned_zero_strategy": _on(
            f"SELECT {_ALL} FROM cleaned",
            base=_cleaned(aqi="GREATEST(LEAST(COALESCE(CAST(aqi_raw AS DOUBLE), 0), 500), 0)")),
        "cleaned_without_fixes": _on(
            f"SELECT {_ALL} FROM cleaned",
            base=_cleaned("pm25_raw",
                          f"GREATEST(COALESCE(CAST(aqi_raw AS DOUBLE), {_aqi('pm25_raw')}), 0)")),
        "aqi_from_pm25": _raw(
            f"SELECT {_r('pm25_raw', 6)} AS pm25_raw, COUNT(*) AS n, {_r(_aqi('pm25_raw'), 6)} AS aqi "
            "FROM measurements GROUP BY measurements.pm25_raw"),
        "cleanup_summary": _on(_share("cleanup_action", "cleaned")),
        "cleanup_summary_negative_first": _on(
            _share("cleanup_action", f"(SELECT * FROM cleaned WHERE {_SELECTED})"),
            base=_cleaned(action=_ACTION_NEGATIVE_FIRST)),
        "quality_distribution": _on(_share("data_quality_flag", "cleaned")),
        # audit
        "quality_audit": _raw("SELECT COUNT(*) AS total_rows,\n  " + _list(
            {**_before_counts("pm25_raw", "aqi_raw"), **_stats("pm25_raw", "aqi_raw"), **_EXTENT}
        ) + " FROM measurements"),
        "quality_audit_pct": _audit_pct(),
        "quality_audit_after": _on("SELECT COUNT(*) AS total_rows,\n  " + _list(
            {**_audit_counts("pm25_cleaned", "aqi_cleaned"), **_stats("pm25_cleaned", "aqi_cleaned")}
        ) + " FROM cleaned"),
        "before_after": _on(_side("VORHER", "pm25_original", "aqi_original") + "\nUNION ALL "
                            + _side("NACHHER", "pm25_cleaned", "aqi_cleaned")),
        "cleanup_success": _on(
            f"""SELECT a AS problems_identified, a - b AS problems_fixed, b AS problems_remaining,
  {_r('CASE WHEN a > 0 THEN CAST(a - b AS DOUBLE) / a * 100 ELSE 100 END', 1)} AS success_rate,
  CASE WHEN a = 0 OR b = 0 THEN 'PERFEKT' WHEN CAST(a - b AS DOUBLE) / a * 100 >= 95 THEN 'SEHR GUT'
       WHEN CAST(a - b AS DOUBLE) / a * 100 >= 80 THEN 'GUT' ELSE 'WARNUNG' END AS verdict FROM totals""",
            f"""totals AS (SELECT
  {_count('aqi_original IS NULL')} + {_count('pm25_original < 0')} + {_count('aqi_original > 500')} AS a,
  {_count('aqi_cleaned IS NULL')} + {_count('pm25_cleaned < 0')} + {_count('aqi_cleaned > 500')} AS b
  FROM cleaned)"""),
        "problem_counts": _problem_counts(),
        "problem_examples": _problem_examples(),
        "problem_example_counts": _raw(" UNION ALL ".join(
            f"SELECT '{n}' AS problem, LEAST(COUNT(*), 25) AS rows FROM measurements "
            f"WHERE {t} HAVING COUNT(*) > 0" for n, (t, _) in _PROBLEMS.items())),
        "data_quality_metrics": _on(
            f"""SELECT total_records, null_count, negative_count, outlier_count,
  {_r('(1 - CAST(null_count AS DOUBLE) / total_records) * 100', 6)} AS completeness_score,
  {_r('GREATEST(0, 100 - (' + _LOST.format(c='null_count', w=20) + ' + '
      + _LOST.format(c='negative_count', w=20) + ' + '
      + _LOST.format(c='outlier_count', w=10) + '))', 6)} AS quality_score
FROM counted""",
            "limits AS (SELECT AVG(pm25_cleaned) AS m, STDDEV_SAMP(pm25_cleaned) AS s FROM cleaned)",
            f"""counted AS (SELECT COUNT(*) AS total_records, {_count('pm25_cleaned IS NULL')} AS null_count,
  {_count('pm25_original < 0')} AS negative_count,
  {_count('ABS(pm25_cleaned - m) > 3 * s')} AS outlier_count FROM cleaned, limits)"""),
        "state_quality": _raw(
            f"""SELECT state_name, COUNT(*) AS measurements, {_count('aqi_raw IS NULL')} AS null_aqi,
  {_pct(_count('aqi_raw IS NULL'), 'COUNT(*)', 2)} AS null_aqi_pct,
  {_count('pm25_raw < 0')} AS negative_pm25 FROM measurements GROUP BY state_name"""),
        "extreme_aqi_rows": _raw(
            f"SELECT {_PLACE}, pm25_raw, aqi_raw, site_name FROM measurements WHERE aqi_raw > 500"),
        "most_negative": _raw(
            f"SELECT {_PLACE}, pm25_raw, sample_duration FROM measurements WHERE pm25_raw < 0 "
            f"ORDER BY pm25_raw, {_PLACE}, sample_duration LIMIT 15"),
        "negative_corrections": _raw(
            f"""SELECT {_PLACE}, pm25_raw AS pm25_original, CAST(GREATEST(pm25_raw, 0) AS DOUBLE) AS pm25_fixed,
  ABS(pm25_raw - GREATEST(pm25_raw, 0)) AS correction FROM measurements WHERE pm25_raw < 0"""),
        "aqi_capping": _raw(
            f"""SELECT {_PLACE}, aqi_raw AS aqi_original, LEAST(aqi_raw, 500) AS aqi_capped,
  aqi_raw - LEAST(aqi_raw, 500) AS amount_capped,
  CASE WHEN aqi_raw > 1000 THEN 'SENSOR ERROR' WHEN aqi_raw > 500 THEN 'Capped' ELSE 'Normal' END AS category
FROM measurements WHERE aqi_raw > 300"""),
        "aqi_fill_status": _raw(
            f"""SELECT state_name, date_local, {_r('pm25_raw', 2)} AS pm25, aqi_raw AS aqi_original,
  {_r(f"COALESCE(CAST(aqi_raw AS DOUBLE), {_aqi('pm25_raw')})", 4)} AS aqi_calculated,
  CASE WHEN aqi_raw IS NULL THEN 'Berechnet' ELSE 'Original' END AS status FROM measurements"""),
        "low_observation": _raw(
            f"""SELECT state_name, date_local, pm25_raw, aqi_raw, observation_percent,
  {_FLAG} AS data_quality_flag FROM measurements WHERE observation_percent < 50
ORDER BY observation_percent, state_name, date_local, pm25_raw, aqi_raw LIMIT 15"""),
        # summaries
        "kpi_metrics": _on(
            f"""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT state_name) AS unique_states,
  {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25, {_r('STDDEV_SAMP(pm25_cleaned)', 2)} AS std_pm25,
  {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi, {_count('pm25_original < 0')} AS negative_fixed,
  {_count('aqi_original IS NULL')} AS null_aqi_fixed, {_count('aqi_original > 500')} AS extreme_aqi_capped,
  MIN(date_local) AS date_start, MAX(date_local) AS date_end,
  {_count("cleanup_action <> 'UNCHANGED'")} AS cleaned_records,
  {_r('QUANTILE_CONT(pm25_cleaned, 0.5)', 2)} AS median_pm25 FROM cleaned"""),
        "monthly_trends": _on("SELECT * FROM monthly", _MONTHLY),
        "monthly_trends_by_state": _on("SELECT * FROM monthly",
                                       _monthly("month, state_name", _SELECTED)),
        "state_comparison": _on("SELECT * FROM states", _STATES),
        "best_worst_states": _on(
            """SELECT * FROM (
  SELECT 'best' AS side, ROW_NUMBER() OVER (ORDER BY avg_pm25, state_name) AS place,
    state_name, avg_pm25, pct_good_days, unhealthy_days FROM states
  UNION ALL
  SELECT 'worst', ROW_NUMBER() OVER (ORDER BY avg_pm25 DESC, state_name),
    state_name, avg_pm25, pct_good_days, unhealthy_days FROM states) WHERE place <= 3""", _STATES),
        "state_heatmap": _on(
            f"SELECT state_name, {_scaled('avg_pm25')}, {_scaled('avg_aqi')}, {_scaled('pct_good_days')} "
            "FROM (SELECT * FROM states ORDER BY avg_pm25 DESC, state_name LIMIT 10)", _STATES),
        "aqi_distribution": _on(
            f"SELECT {_band('aqi_cleaned')} AS category, COUNT(*) AS count FROM cleaned "
            f"WHERE {_SELECTED} GROUP BY 1"),
        "aqi_distribution_pct": _on(_share("category", "banded"),
            f"banded AS (SELECT {_band('aqi_original')} AS category FROM cleaned "
            "WHERE aqi_original IS NOT NULL)"),
        "pm25_levels": _on(_share("level", "levelled"),
            """levelled AS (SELECT CASE WHEN pm25_cleaned IS NULL THEN NULL WHEN pm25_cleaned <= 12 THEN 'safe'
  WHEN pm25_cleaned <= 35.4 THEN 'moderate' WHEN pm25_cleaned <= 55.4 THEN 'unhealthy'
  WHEN pm25_cleaned <= 150.4 THEN 'very_unhealthy' WHEN pm25_cleaned <= 250.4 THEN 'hazardous'
  ELSE 'beyond_hazardous' END AS level FROM cleaned)"""),
        "current_aqi": _on(
            f"""SELECT state_name, month, avg_aqi AS current_aqi, {_band('avg_aqi')} AS category FROM monthly
QUALIFY ROW_NUMBER() OVER (PARTITION BY state_name ORDER BY month DESC) = 1""",
            _monthly("month, state_name", "TRUE")),
        "trend_summary": _describe(),
        "quarterly_trend": _on("SELECT * FROM trend", _quarters("1.0")),
        "quarterly_summary": _on("SELECT kategorie, COUNT(*) AS states FROM trend GROUP BY kategorie",
                                 _quarters("0.05")),
        "top_changes": _on(
            """SELECT * FROM (
  SELECT kategorie, ROW_NUMBER() OVER (ORDER BY diff, state_name) AS place, state_name, diff, prozent_change
  FROM trend WHERE kategorie = 'Verbessert'
  UNION ALL
  SELECT kategorie, ROW_NUMBER() OVER (ORDER BY diff DESC, state_name), state_name, diff, prozent_change
  FROM trend WHERE kategorie = 'Verschlechtert') WHERE place <= 5""", _quarters("0.05")),
        "weekday_analysis": _on(
            f"""SELECT DAYOFWEEK(date_local) AS day_num,
  CASE DAYOFWEEK(date_local) WHEN 0 THEN 'Sonntag' WHEN 1 THEN 'Montag' WHEN 2 THEN 'Dienstag'
    WHEN 3 THEN 'Mittwoch' WHEN 4 THEN 'Donnerstag' WHEN 5 THEN 'Freitag' ELSE 'Samstag' END AS wochentag,
  COUNT(*) AS messungen, {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25, {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi,
  {_r('STDDEV_SAMP(pm25_cleaned)', 2)} AS std_pm25 FROM cleaned GROUP BY 1, 2"""),
        "weekend_vs_weekday": _on(
            f"SELECT CASE WHEN DAYOFWEEK(date_local) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type, "
            f"{_MEANS} FROM cleaned GROUP BY 1"),
        "seasonal_pattern": _on(f"SELECT {_SEASON_NAME} AS season, {_MEANS} FROM cleaned GROUP BY 1"),
        "site_analysis": _on(
            f"""SELECT site_name, state_name, county_name, {_r('AVG(cleaned.latitude)', 4)} AS latitude,
  {_r('AVG(cleaned.longitude)', 4)} AS longitude, COUNT(*) AS measurements,
  {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25, {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi,
  {_r('AVG(observation_percent)', 1)} AS avg_observation_pct
FROM cleaned GROUP BY site_name, state_name, county_name
ORDER BY avg_pm25 DESC, site_name, state_name, county_name LIMIT 20"""),
        "site_hotspots": _on(
            f"""SELECT site_name, state_name, county_name, {_count('aqi_cleaned > 100')} AS unhealthy_days,
  COUNT(*) AS measurements, {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi
FROM cleaned WHERE site_name IS NOT NULL GROUP BY site_name, state_name, county_name
ORDER BY unhealthy_days DESC, site_name, state_name, county_name LIMIT 5"""),
        "worst_states": _on(
            f"SELECT state_name, {_MEANS}, {_r('MAX(pm25_cleaned)', 2)} AS max_pm25 FROM cleaned "
            "GROUP BY state_name ORDER BY avg_pm25 DESC, state_name LIMIT 10"),
        "event_deep_dive": _on(
            f"""SELECT county_name, date_local, pm25_cleaned, aqi_cleaned, {_band('aqi_cleaned')} AS aqi_category
FROM cleaned WHERE state_name = 'AMERICA' AND aqi_cleaned > 90
  AND date_local BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
ORDER BY aqi_cleaned DESC, county_name, date_local, pm25_cleaned LIMIT 20"""),
        "worst_national_day": _on(
            f"""SELECT date_local, {_r('AVG(pm25_cleaned)', 2)} AS avg_pm25, {_r('AVG(aqi_cleaned)', 1)} AS avg_aqi,
  COUNT(*) AS measurements FROM cleaned GROUP BY date_local ORDER BY avg_pm25 DESC, date_local LIMIT 1"""),
        # daily series
        "daily_state": _on("SELECT state_name, date_local, pm25, n FROM daily", _DAILY),
        "daily_state_skip_nulls": _on("SELECT state_name, date_local, pm25, n FROM daily",
                                      _DAILY_SKIP, base=EVENTS),
        "alarm_days": _on("SELECT * FROM alarms", *_alarms("TRUE", "LIMIT 100")),
        "alarm_days_all": _on("SELECT * FROM alarms", *_alarms("TRUE", "")),
        "alarm_days_critical": _on("SELECT * FROM alarms WHERE alarm_level = 'KRITISCH'",
                                   *_alarms("TRUE", "")),
        "alarm_summary": _on(
            f"""SELECT {_count("alarm_level = 'KRITISCH'")} AS kritisch,
  {_count("alarm_level = 'WARNUNG'")} AS warnung, MAX(prozent_change) AS max_change,
  COUNT(DISTINCT state_name) AS affected_states FROM alarms""", *_alarms("TRUE", "")),
        "worst_days": _on("SELECT * FROM worst", _DAILY, _WORST),
        "worst_days_summary": _on(
            f"""SELECT MAX(pm25) AS max_pm25,
  (SELECT state_name FROM worst ORDER BY pm25 DESC, state_name LIMIT 1) AS max_state,
  {_count("sprung_typ = 'Plötzlich'")} AS sudden_jumps,
  {_r('AVG(ueber_durchschnitt)', 4)} AS avg_excess FROM worst""", _DAILY, _WORST),
        "rolling_average": _on("SELECT * FROM rolling", _DAILY, _ROLLING),
        "rolling_summary": _on(
            f"""SELECT state_name, {_r('AVG(daily_pm25)', 2)} AS avg_daily, MAX(rolling_7day) AS max_rolling,
  {_count("trend_position = 'Über Trend'")} AS days_above,
  {_count("trend_position = 'Unter Trend'")} AS days_below FROM rolling GROUP BY state_name""",
            _DAILY, _ROLLING),
        "good_air_streaks": _on(
            "SELECT * FROM streaks WHERE state_rank = 1 ORDER BY tage DESC, state_name, streak_start LIMIT 10",
            _DAILY_SKIP, _STREAKS),
        "zscore_anomalies": _on("SELECT * FROM scores", *_scores("LIMIT 100")),
        "zscore_anomalies_strong": _on(
            "SELECT * FROM scores WHERE anomaly_level IN ('Extreme Anomalie', 'Starke Anomalie')",
            *_scores("")),
        "zscore_anomalies_events": _on("SELECT * FROM scores", *_scores(""), base=EVENTS),
        "trend_centered_ma": _on(
            f"""SELECT *, {_r('CASE WHEN COUNT(*) OVER w = 3 THEN AVG(avg_pm25) OVER w END', 6)} AS ma3
FROM monthly WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", _MONTHLY),
        "forecast_history": _on("SELECT * FROM history", _HISTORY),
        # anomalies and trend
        "anomalies_zscore": _on(
            f"""SELECT month, avg_pm25, {_r('z', 6)} AS anomaly_score, COALESCE(z > 2.5, FALSE) AS is_anomaly
FROM (SELECT month, avg_pm25,
  ABS((avg_pm25 - AVG(avg_pm25) OVER ()) / NULLIF(STDDEV_POP(avg_pm25) OVER (), 0)) AS z FROM monthly)""",
            _MONTHLY),
        "anomalies_zscore_rows": _on(
            f"""SELECT state_name, date_local, pm25_cleaned, {_r('z', 6)} AS anomaly_score, TRUE AS is_anomaly
FROM (SELECT *, ABS((pm25_cleaned - AVG(pm25_cleaned) OVER w) / NULLIF(STDDEV_POP(pm25_cleaned) OVER w, 0)) AS z
  FROM cleaned WINDOW w AS (PARTITION BY state_name)) WHERE z > 3"""),
        "anomalies_iqr": _on(
            """SELECT state_name, date_local, pm25_cleaned, TRUE AS is_anomaly FROM cleaned JOIN (
  SELECT state_name, QUANTILE_CONT(pm25_cleaned, 0.25) AS q1, QUANTILE_CONT(pm25_cleaned, 0.75) AS q3
  FROM cleaned GROUP BY state_name) USING (state_name)
WHERE pm25_cleaned < q1 - 1.5 * (q3 - q1) OR pm25_cleaned > q3 + 1.5 * (q3 - q1)"""),
        "trend_direction": _on(
            f"""SELECT state_name, n, {_r('pct', 6)} AS trend_pct,
  CASE WHEN ABS(pct) < 1 THEN 'stable' WHEN pct > 0 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM (SELECT state_name, COUNT(*) AS n, REGR_SLOPE(pm25, i) / AVG(pm25) * 100 AS pct FROM
  (SELECT state_name, pm25, ROW_NUMBER() OVER (PARTITION BY state_name ORDER BY date_local) AS i FROM daily)
  GROUP BY state_name)""", _DAILY),
        # forecasts
        "linreg_fit": _forecast(
            f"SELECT state_name, n, n_train, {_r('slope', 6)} AS slope, {_r('intercept', 6)} AS intercept, "
            "last_date, last_t FROM line", _LINE),
        "linreg_metrics": _forecast(
            f"""SELECT state_name, COUNT(*) AS n_test, {_r('AVG(ABS(pm25 - fit))', 6)} AS mae,
  {_r('SQRT(AVG((pm25 - fit) * (pm25 - fit)))', 6)} AS rmse,
  {_r('1 - SUM((pm25 - fit) * (pm25 - fit)) / (VAR_POP(pm25) * COUNT(*))', 6)} AS r2,
  {_r('MAX(fitted.slope)', 6)} AS slope FROM fitted WHERE NOT is_train GROUP BY state_name""",
            _LINE, _FITTED),
        "linreg_fitted": _forecast(
            f"SELECT state_name, date_local, t, pm25, {_r('fit', 6)} AS fitted, "
            f"{_r('slope', 6)} AS slope, is_train FROM fitted", _LINE, _FITTED),
        "linreg_forecast": _forecast(_LINE_AHEAD, _LINE, _STEPS),
        "linreg_forecast_events": _forecast(_LINE_AHEAD, _LINE, _STEPS, base=EVENTS),
        "ma_fit": _forecast(
            f"SELECT state_name, {_r('last_ma', 6)} AS last_ma, {_r('ma_trend', 6)} AS ma_trend, "
            f"{_r('volatility', 6)} AS volatility, last_date, last_t FROM ma_fit", _MA),
        "ma_forecast": _forecast(
            f"SELECT state_name, step, last_date + CAST(step AS INTEGER) AS date_local, "
            f"{_r('GREATEST(last_ma, 0)', 6)} AS forecast FROM ma_fit CROSS JOIN steps", _MA, _STEPS),
        "ma_forecast_noisy": _forecast(
            f"""SELECT state_name, step, date_local,
  {_r(f"GREATEST(last_ma + SQRT(-2 * LN({_draw('u')})) * COS(2 * PI() * {_draw('v')}) * CAST(0.3 AS DOUBLE) * volatility, 0)", 6)} AS forecast
FROM (SELECT *, last_date + CAST(step AS INTEGER) AS date_local FROM ma_fit CROSS JOIN steps)""",
            _MA, _STEPS),
        "seasonal_forecast": _forecast(_SEASON_AHEAD, _STEPS, _SEASON),
        "seasonal_forecast_events": _forecast(_SEASON_AHEAD, _STEPS, _SEASON, base=EVENTS),
        "piecewise_forecast": _piecewise(),
        "seasonal_summary": _forecast(
            f"""SELECT state_name, {_r('f', 6)} AS avg_forecast, {_r('hi', 6)} AS max_forecast,
  {_r('lo', 6)} AS min_forecast, {_r('now', 6)} AS current_avg, {_r('f - now', 6)} AS delta
FROM (SELECT state_name, AVG(forecast) AS f, MAX(forecast) AS hi, MIN(forecast) AS lo FROM ahead GROUP BY 1)
JOIN (SELECT state_name, AVG(pm25) AS now FROM rows_ WHERE rn > n - 7 GROUP BY 1) USING (state_name)""",
            _STEPS, _SEASON),
        "forecast_comparison": _forecast(
            f"""SELECT state_name, step, date_local, {_r('seasonal', 6)} AS seasonal, {_r('linear', 6)} AS linear,
  {_r('moving_average', 6)} AS moving_average, {_r('linear_slope', 6)} AS linear_slope,
  {_r('mean', 6)} AS durchschnitt,
  {_r('SQRT(((seasonal - mean) ** 2 + (linear - mean) ** 2 + (moving_average - mean) ** 2) / 2)', 6)}
    AS std_abweichung FROM averaged""", _STEPS, _SEASON, _COMPARE),
        "forecast_model_stats": _forecast(
            "\nUNION ALL ".join([
                _stats_of("seasonal", _NONE, _NONE),
                _stats_of("linear", _r("MAX(linear_slope)", 6), _NONE),
                _stats_of("moving_average", _NONE, _r("MAX(moving_average)", 6)),
            ]), _STEPS, _SEASON, _COMPARE),
    }
