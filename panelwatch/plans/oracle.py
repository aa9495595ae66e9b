"""The same derived tables as SQL text, for checking queries on another engine."""

from __future__ import annotations

from panelwatch import constants as C


def r(expr: str, digits: int = 6) -> str:
    """Half-up rounding through decimals, as in ``functions.numeric.half_up``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def month_case(month: str = "month") -> str:
    return "CASE " + month + " " + " ".join(f"WHEN {m} THEN {w}e0" for m, w in C.SEASONAL_WEIGHTS.items()) + " END"


def clamp_share(x: str, lo: str, hi: str, missing: str = "0.5e0") -> str:
    return f"CASE WHEN {x} IS NULL THEN {missing} ELSE greatest(0e0, least(1e0, ({x} - ({lo})) / (({hi}) - ({lo})))) END"


def tier_case(score: str, bounds=("18", "22", "26")) -> str:
    a, b, c = bounds
    return (
        f"CASE WHEN {score} < {a} THEN 'Low' WHEN {score} < {b} THEN 'Moderate' "
        f"WHEN {score} < {c} THEN 'High' WHEN {score} IS NOT NULL THEN 'Very High' END"
    )


def values_list(rows) -> str:
    def lit(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else (f"{x}e0" if isinstance(x, float) else str(x))

    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


_W = "OVER (PARTITION BY county ORDER BY year, month)"
_W3 = "OVER (PARTITION BY county ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _index_monthly(source: str) -> str:
    """Variant 2 over ``source``, unrounded, stand-in thresholds."""
    cols = ["sm_lag6", "tmax_lag6", "precip_lag18", "pm10_lag1", "soil_moisture_m3m3", "wind_roll3", "tmax_lag1"]
    stats = ", ".join(
        f"CASE WHEN max({c}) > min({c}) THEN min({c}) ELSE 0e0 END AS lo_{c}, "
        f"CASE WHEN max({c}) > min({c}) THEN max({c}) ELSE 1e0 END AS hi_{c}" for c in cols
    )
    s = {c: clamp_share(f"f.{c}", f"lo_{c}", f"hi_{c}") for c in cols}
    g = f"(0.35e0*({s['sm_lag6']}) + 0.20e0*({s['tmax_lag6']}) + 0.30e0*({s['precip_lag18']})) / 0.85e0"
    e = (
        f"(0.25e0*({s['pm10_lag1']}) + 0.15e0*(1 - ({s['soil_moisture_m3m3']})) + 0.05e0*({s['wind_roll3']}) "
        f"+ 0.20e0*({s['tmax_lag1']})) / 0.65e0"
    )
    return (
        f"SELECT *, {tier_case('risk_score')} AS predicted_risk FROM (SELECT *, gpot*erisk*100 AS risk_score FROM ("
        f"SELECT f.*, {g} AS gpot, {e} AS erisk FROM {source} f, (SELECT {stats} FROM {source}) st))"
    )


CTES: dict[str, tuple[list[str], str]] = {
    "meta": ([], """
        SELECT n_name AS county, '06' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS fips,
               34.5e0 + n_nationkey * 0.15e0 AS lat, -121.8e0 + n_nationkey * 0.17e0 AS lon, n_nationkey AS ord
        FROM nation"""),
    "weather": ([], """
        SELECT date, county, q AS precip_mm,
               CASE WHEN (k*7 + day(date)) % 5 <> 0 THEN d / n * 4 END AS soil_moisture_m3m3,
               CASE WHEN (k*3 + day(date)) % 6 <> 0 THEN q / n END AS wind_speed_kmh,
               x / n * 500 AS tmax_approx_c
        FROM (SELECT n_nationkey AS k, n_name AS county, CAST(o_orderdate AS DATE) AS date,
                     CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS q,
                     CAST(sum(CAST(l_discount AS DECIMAL(14,2))) AS DOUBLE) AS d,
                     CAST(sum(CAST(l_tax AS DECIMAL(14,2))) AS DOUBLE) AS x, count(*) AS n
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                   JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""),
    "air": ([], """
        SELECT date, county, p / n / 500 AS pm10_ugm3
        FROM (SELECT n_name AS county, CAST(l_shipdate AS DATE) AS date,
                     CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS p, count(*) AS n
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
              GROUP BY 1, 2)"""),
    "cases": ([], """
        SELECT n_name AS county, CAST(CASE WHEN year(o_orderdate) > 2000 THEN 1994 ELSE year(o_orderdate) END AS INTEGER) AS year, count(*) AS case_count,
               'reported' AS cases_source
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2"""),
    "master": (["weather", "air", "cases", "meta"], """
        SELECT w.date, w.county, coalesce(m.fips, '') AS fips, m.lat, m.lon, w.precip_mm, w.soil_moisture_m3m3,
               w.wind_speed_kmh, a.pm10_ugm3, w.tmax_approx_c, coalesce(c.case_count, 0) AS case_count,
               coalesce(c.cases_source, 'no_data') AS cases_source
        FROM weather w LEFT JOIN air a ON w.county = a.county AND w.date = a.date
             LEFT JOIN cases c ON w.county = c.county AND year(w.date) = c.year
             LEFT JOIN meta m ON w.county = m.county"""),
    "monthly": (["master"], f"""
        SELECT *, case_count * ({month_case()}) AS monthly_cases
        FROM (SELECT county, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                     min(fips) AS fips, min(lat) AS lat, min(lon) AS lon,
                     coalesce(sum(precip_mm), 0) AS precip_mm, avg(soil_moisture_m3m3) AS soil_moisture_m3m3,
                     avg(wind_speed_kmh) AS wind_speed_kmh, avg(pm10_ugm3) AS pm10_ugm3,
                     avg(tmax_approx_c) AS tmax_approx_c, min(case_count) AS case_count
              FROM master GROUP BY 1, 2, 3)"""),
    "features_all": (["monthly"], f"""
        SELECT *, lag(precip_mm, 3) {_W} AS precip_lag3, lag(precip_mm, 6) {_W} AS precip_lag6,
               lag(precip_mm, 18) {_W} AS precip_lag18, lag(soil_moisture_m3m3, 6) {_W} AS sm_lag6,
               lag(pm10_ugm3, 1) {_W} AS pm10_lag1, lag(tmax_approx_c, 1) {_W} AS tmax_lag1,
               lag(tmax_approx_c, 6) {_W} AS tmax_lag6,
               CASE WHEN count(wind_speed_kmh) {_W3} = 3 THEN avg(wind_speed_kmh) {_W3} END AS wind_roll3,
               CASE WHEN count(pm10_ugm3) {_W3} = 3 THEN avg(pm10_ugm3) {_W3} END AS pm10_roll3,
               1 - soil_moisture_m3m3 AS soil_aridity
        FROM monthly"""),
    "features": (["features_all"], """
        SELECT * FROM features_all
        WHERE fips IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND precip_mm IS NOT NULL
          AND soil_moisture_m3m3 IS NOT NULL AND wind_speed_kmh IS NOT NULL AND pm10_ugm3 IS NOT NULL
          AND tmax_approx_c IS NOT NULL AND case_count IS NOT NULL AND monthly_cases IS NOT NULL
          AND precip_lag3 IS NOT NULL AND precip_lag6 IS NOT NULL AND precip_lag18 IS NOT NULL
          AND sm_lag6 IS NOT NULL AND pm10_lag1 IS NOT NULL AND tmax_lag1 IS NOT NULL AND tmax_lag6 IS NOT NULL
          AND wind_roll3 IS NOT NULL AND pm10_roll3 IS NOT NULL"""),
    "scored": (["features"], _index_monthly("features")),
    "scored_all": (["features_all"], _index_monthly("features_all")),
    "predictions": (["scored_all"], """
        SELECT county, year, month, monthly_cases, lat, lon, monthly_cases*0.9e0 + precip_mm*0.01e0 AS predicted_cases,
               monthly_cases - (monthly_cases*0.9e0 + precip_mm*0.01e0) AS residual, gpot, erisk, risk_score,
               predicted_risk
        FROM scored_all"""),
    "env": (["weather", "air"], """
        SELECT w.*, a.pm10 FROM
          (SELECT county, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                  coalesce(sum(precip_mm), 0) AS precip_mm, avg(soil_moisture_m3m3) AS soil_moisture,
                  avg(wind_speed_kmh) AS wind_speed FROM weather GROUP BY 1, 2, 3) w
          LEFT JOIN (SELECT county, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                  avg(pm10_ugm3) AS pm10 FROM air GROUP BY 1, 2, 3) a USING (county, year, month)"""),
    "case_steps": (["monthly"], """
        SELECT county, t, actual_cases, predicted_cases, step - floor(0.8e0 * n) AS test_sample FROM (
          SELECT county, year*12 + month AS t, monthly_cases AS actual_cases,
                 monthly_cases*0.8e0 + precip_mm*0.01e0 AS predicted_cases,
                 dense_rank() OVER (ORDER BY year*12 + month) - 1 AS step,
                 (SELECT count(DISTINCT year*12 + month) FROM monthly) AS n FROM monthly)
        WHERE step >= floor(0.8e0 * n)"""),
    "case_predictions": (["case_steps"], f"""
        SELECT county, CAST(test_sample AS BIGINT) AS test_sample, actual_cases, predicted_cases,
               actual_cases - predicted_cases AS residual,
               {r("greatest(0e0, CASE WHEN x < p25 THEN x / greatest(p25, 0.1e0) * 3 "
                  "WHEN x < p50 THEN 3 + (x - p25) / greatest(p50 - p25, 0.1e0) * 5 "
                  "WHEN x < p75 THEN 8 + (x - p50) / greatest(p75 - p50, 0.1e0) * 7 "
                  "ELSE 15 + least((x - p75) / greatest(p75, 0.1e0) * 10, 10e0) END)", 2)} AS risk_score,
               CASE WHEN x < p25 THEN 'Low' WHEN x < p50 THEN 'Moderate' WHEN x < p75 THEN 'High'
                    ELSE 'Very High' END AS predicted_risk,
               'case_percentile' AS score_method
        FROM (SELECT *, predicted_cases AS x FROM case_steps) JOIN
             (SELECT county, quantile_cont(actual_cases, 0.25) AS p25, quantile_cont(actual_cases, 0.5) AS p50,
                     quantile_cont(actual_cases, 0.75) AS p75 FROM case_steps GROUP BY 1) USING (county)"""),
    "points": ([], """
        SELECT c_custkey AS id, 34.5e0 + CAST((c_custkey*37) % 400 AS DOUBLE) / 100 AS lat,
               -121.8e0 + CAST((c_custkey*53) % 440 AS DOUBLE) / 100 AS lon FROM customer"""),
    "boxes": ([], "SELECT * FROM (" + values_list(C.COUNTY_BOXES) + ") b(ord, county, lat_min, lat_max, lon_min, lon_max)"),
    "centers": ([], "SELECT * FROM (" + values_list(
        [(i, *row) for i, row in enumerate(C.COUNTY_META)]) + ") c(ord, county, fips, lat, lon)"),
    "located": (["points", "boxes", "centers"], """
        SELECT p.id, p.lat, p.lon, b.box_county, n.near_county, coalesce(b.box_county, n.near_county) AS county
        FROM points p
        LEFT JOIN (SELECT id, arg_min(b.county, b.ord) AS box_county FROM points q JOIN boxes b
                   ON q.lat BETWEEN b.lat_min AND b.lat_max AND q.lon BETWEEN b.lon_min AND b.lon_max GROUP BY id) b
             USING (id)
        JOIN (SELECT id, county AS near_county FROM (
                SELECT q.id, c.county, row_number() OVER (PARTITION BY q.id ORDER BY
                  (q.lat-c.lat)*(q.lat-c.lat) + (q.lon-c.lon)*(q.lon-c.lon), c.ord) AS rn
                FROM points q, centers c) WHERE rn = 1) n USING (id)"""),
    "trade_edges": ([], """
        SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "nation_edges": ([], """
        SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b
        ON b.n_nationkey = a.n_nationkey + 1 OR b.n_nationkey = a.n_nationkey + 5"""),
    "reports_raw": ([], "SELECT event_id AS id, CASE WHEN user_id % 11 = 0 THEN 'Old Town_' || CAST(user_id % 4 AS VARCHAR) ELSE list_extract(["
               + ", ".join(f"'{row[0]}'" for row in C.COUNTY_META) + """], CAST(user_id % 8 AS INTEGER) + 1) END AS county, CAST(event_id % 5 AS INTEGER) AS severity,
               props AS description, CAST(user_id*100 + day(ts) AS VARCHAR) AS reporter_id, ts AS created_at
        FROM events"""),
    "reports": (["reports_raw"], "SELECT * REPLACE (greatest(1, least(3, severity)) AS severity) FROM reports_raw"),
    "subscription_requests": ([], """
        SELECT CAST(o_custkey AS VARCHAR) AS phone,
               CASE WHEN o_orderkey % 11 = 0 THEN 'Old Town_' || CAST(o_orderkey % 4 AS VARCHAR) ELSE n_name END AS county,
               list_extract(['english', 'spanish', 'Hmong', 'punjabi', 'klingon'],
                            CAST(o_orderkey % 5 AS INTEGER) + 1) AS language,
               o_orderdate AS requested_at, o_orderkey AS request_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "subs": (["subscription_requests"], """
        SELECT phone, county, CASE WHEN lower(language) IN ('english', 'spanish', 'hmong', 'punjabi')
                                   THEN lower(language) ELSE 'english' END AS language
        FROM (SELECT *, row_number() OVER (PARTITION BY phone, county ORDER BY requested_at DESC, request_id DESC) AS rn
              FROM subscription_requests) WHERE rn = 1"""),
    "messages": ([], "SELECT conv_id, turn, text FROM conversations"),
    "user_days": ([], """
        SELECT CAST(user_id AS VARCHAR) AS county, CAST(ts AS DATE) AS date,
               CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS total, max(value) AS top, min(value) AS low
        FROM events GROUP BY 1, 2"""),
    "user_hours": ([], """
        SELECT CAST(user_id AS VARCHAR) AS county, date_trunc('hour', ts) AS h, max(value) / 1000 AS v
        FROM events GROUP BY 1, 2"""),
    "facilities": ([], """
        SELECT n_name AS county, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'hospital' ELSE 'clinic' END AS type,
               s_acctbal AS lat FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "latest": (["predictions", "meta"], f"""
        SELECT p.county, m.fips, m.lat, m.lon, year, month, predicted_risk AS risk_level,
               {r('risk_score', 2)} AS risk_score, {r('gpot', 4)} AS gpot, {r('erisk', 4)} AS erisk,
               {r('predicted_cases', 1)} AS predicted_cases, {r('monthly_cases', 1)} AS monthly_cases
        FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY year DESC, month DESC) AS rn FROM predictions) p
             JOIN meta m ON p.county = m.county WHERE rn = 1"""),
}


def with_ctes(needs: list[str], select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` behind the derived tables it needs, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][0]:
            visit(dep)
        done.append(name)

    for need in needs:
        visit(need)
    parts = [f"{name} AS ({CTES[name][1]})" for name in done]
    parts += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + select
