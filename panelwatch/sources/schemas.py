"""Explicit schemas of every input and output table; nothing is inferred."""

WEATHER = (
    "date date, county string, precip_mm double, soil_moisture_m3m3 double, "
    "wind_speed_kmh double, tmax_approx_c double"
)
AIR = "date date, county string, pm10_ugm3 double"
CASES = "county string, year int, case_count long, cases_source string"
MASTER = (
    "date date, county string, fips string, lat double, lon double, precip_mm double, "
    "soil_moisture_m3m3 double, wind_speed_kmh double, pm10_ugm3 double, tmax_approx_c double, "
    "case_count long, cases_source string"
)
WEATHER_PAYLOAD = (
    "county string, daily struct<time: array<string>, precipitation_sum: array<double>, "
    "wind_speed_10m_max: array<double>, temperature_2m_max: array<double>>"
)
SOIL_PAYLOAD = "county string, hourly struct<time: array<string>, soil_moisture_0_to_7cm: array<double>>"
CURRENT_PAYLOAD = (
    "county string, current struct<temperature_2m: double, wind_speed_10m: double, precipitation: double, "
    "time: string>, daily struct<temperature_2m_max: array<double>, wind_speed_10m_max: array<double>, "
    "precipitation_sum: array<double>>, air struct<pm10: double>"
)
PM10_BULK = (
    "`State Code` string, `County Code` string, `Parameter Code` string, `Date Local` string, "
    "`Arithmetic Mean` string"
)
INDEX_PREDICTIONS = (
    "county string, year int, month int, monthly_cases double, lat double, lon double, predicted_cases double, "
    "residual double, gpot double, erisk double, risk_score double, predicted_risk string"
)
CASE_PREDICTIONS = (
    "county string, test_sample int, actual_cases double, predicted_cases double, residual double, "
    "risk_score double, predicted_risk string, score_method string"
)
FACILITY = "name string, type string, lat double, lon double, phone string, note string, address string"
ZONE = "name string, type string, lat double, lon double, population_estimate int"
REPORTS = (
    "id long, county string, lat double, lon double, severity int, description string, reporter_id string, "
    "created_at timestamp"
)
SUBSCRIPTIONS = "phone string, county string, language string, requested_at timestamp, request_id long"
POLYGONS = "ord int, name string, type string, coordinates string"
STATE = "source string, last_date date, last_check timestamp, last_run timestamp, hash string"
