"""Names, weights, bounds, thresholds and texts that define the results.

Everything below is a fixed value. Every function takes these as default
arguments, so another region or another index needs no change in code.
"""

# --- places -----------------------------------------------------------------

COUNTY_META = [
    # county, fips, lat, lon
    ("Fresno", "06019", 36.7378, -119.7871),
    ("Kern", "06029", 35.3433, -118.7279),
    ("Kings", "06031", 36.0748, -119.8154),
    ("Madera", "06039", 37.2180, -119.7573),
    ("Merced", "06047", 37.1913, -120.7151),
    ("San Joaquin", "06077", 37.9317, -121.2717),
    ("Stanislaus", "06099", 37.5591, -120.9982),
    ("Tulare", "06107", 36.2077, -119.0539),
]

COUNTY_BOXES = [
    # order, county, lat_min, lat_max, lon_min, lon_max; the lowest order wins
    (0, "Kern", 34.79, 35.79, -119.95, -117.63),
    (1, "Tulare", 35.79, 36.45, -119.55, -118.30),
    (2, "Kings", 35.80, 36.32, -120.19, -119.47),
    (3, "Fresno", 36.32, 37.12, -120.65, -118.36),
    (4, "Madera", 36.96, 37.49, -120.30, -119.02),
    (5, "Merced", 36.97, 37.63, -121.23, -120.05),
    (6, "Stanislaus", 37.39, 37.77, -121.40, -120.65),
    (7, "San Joaquin", 37.63, 38.30, -121.58, -120.92),
]

COUNTY_EDGES = [
    ("Fresno", "Kings"), ("Fresno", "Tulare"), ("Fresno", "Madera"),
    ("Fresno", "Merced"), ("Kern", "Kings"), ("Kern", "Tulare"),
    ("Kings", "Tulare"), ("Madera", "Merced"), ("Merced", "Stanislaus"),
    ("Merced", "San Joaquin"), ("San Joaquin", "Stanislaus"),
]

# --- sources ----------------------------------------------------------------

PM10_STATE_CODE = "06"
PM10_PARAMETER_CODE = "81102"
PM10_VALID_RANGE = (0.0, 1500.0)
NO_CASES_SOURCE = "no_data"
OFFICIAL_CASES_SOURCE = "cdph_official"
PROVISIONAL_CASES_SOURCE = "provisional"

# --- panel ------------------------------------------------------------------

MEASURES = ["precip_mm", "soil_moisture_m3m3", "wind_speed_kmh", "pm10_ugm3", "tmax_approx_c"]

CLIP_BOUNDS = {
    "precip_mm": (0.0, 380.0),
    "soil_moisture_m3m3": (0.0, 0.6),
    "wind_speed_kmh": (0.0, 130.0),
    "pm10_ugm3": (0.0, 600.0),
    "tmax_approx_c": (-15.0, 55.0),
}

DAILY_LAGS = [
    # new column, source column, rows back
    ("sm_lag6mo", "soil_moisture_m3m3", 183),
    ("tmax_lag6mo", "tmax_approx_c", 183),
    ("precip_lag1p5y", "precip_mm", 548),
    ("pm10_lag1mo", "pm10_ugm3", 30),
    ("tmax_lag1mo", "tmax_approx_c", 30),
]

MONTHLY_LAGS = [
    ("precip_lag3", "precip_mm", 3),
    ("precip_lag6", "precip_mm", 6),
    ("precip_lag18", "precip_mm", 18),
    ("sm_lag6", "soil_moisture_m3m3", 6),
    ("pm10_lag1", "pm10_ugm3", 1),
    ("tmax_lag1", "tmax_approx_c", 1),
    ("tmax_lag6", "tmax_approx_c", 6),
]

MONTHLY_ROLLS = [("wind_roll3", "wind_speed_kmh", 3), ("pm10_roll3", "pm10_ugm3", 3)]

SCALED_COLUMNS = [
    "precip_mm", "soil_moisture_m3m3", "wind_speed_kmh", "pm10_ugm3", "case_count",
    "sm_lag6mo", "tmax_lag6mo", "precip_lag1p5y", "pm10_lag1mo", "tmax_lag1mo",
]

SEASONAL_WEIGHTS = {
    1: 0.04, 2: 0.03, 3: 0.04, 4: 0.05, 5: 0.06, 6: 0.07,
    7: 0.08, 8: 0.12, 9: 0.14, 10: 0.15, 11: 0.13, 12: 0.09,
}

MODEL_FEATURES = [
    "precip_mm", "soil_moisture_m3m3", "wind_speed_kmh", "pm10_ugm3", "tmax_approx_c",
    "soil_aridity", "precip_lag3", "precip_lag6", "precip_lag18", "sm_lag6", "pm10_lag1",
    "tmax_lag1", "tmax_lag6", "wind_roll3", "pm10_roll3", "month",
]

# --- index ------------------------------------------------------------------

GROWTH_WEIGHTS = {"soil_past": 0.35, "heat_past": 0.20, "rain_past": 0.30}
EXPOSURE_WEIGHTS = {"dust_past": 0.25, "aridity": 0.15, "wind": 0.05, "heat_recent": 0.20}
GROWTH_TOTAL = 0.85
EXPOSURE_TOTAL = 0.65

NORM_RANGES = {
    "sm": (0.03, 0.45),
    "tmax": (5.0, 45.0),
    "precip": (0.0, 200.0),
    "pm10": (0.0, 150.0),
    "wind": (0.0, 60.0),
}

TIERS = ["Low", "Moderate", "High", "Very High"]
TIER_THRESHOLDS = (3.0, 8.0, 15.0)
TIER_COLORS = {"Low": "green", "Moderate": "yellow", "High": "orange", "Very High": "red"}
LEGACY_TIER_SCORES = {"Low": 1.0, "Moderate": 2.0, "High": 3.0, "Very High": 4.0}
ALERT_TIERS = ["High", "Very High"]
ELEVATED_SCORE = 8.0

CASE_PERCENTILES = (0.25, 0.5, 0.75)
CASE_SCORE_METHOD = "case_percentile"
INDEX_SCORE_METHOD = "gpot_erisk"

WARN_WIND_KMH = 15.0
WARN_PM10 = 35.0
WARN_TEMP_C = 35.0
GAUGE_FULL_SCORE = 25.0

# --- serving ----------------------------------------------------------------

ANOMALY_FLOORS = {"precip_mm": 0.1, "soil_moisture": 0.001, "pm10": 0.1}
RECENT_MONTHS = 6
TREND_FACTOR = 1.2

SUMMARY_TEXTS = {
    "wind_high": "Wind speeds are elevated at %.0f km/h, increasing dust and spore dispersal",
    "wind_low": "Wind is calm at %.0f km/h, limiting airborne spore spread",
    "pm10_high": "PM10 dust levels are dangerously high (%.0f µg/m³) — active soil disturbance detected",
    "pm10_low": "Dust levels are low (%.0f µg/m³), reducing airborne exposure risk",
    "temp_extreme": "Extreme heat (%.0f°C) is critically drying soil and releasing fungal spores",
    "temp_warm": "Warm conditions (%.0f°C) are within the optimal range for Cocci growth cycles",
    "rain": "Recent rainfall may temporarily suppress dust but feeds future fungal biomass growth",
    "dry": "Zero precipitation — dangerously dry soil conditions accelerate spore release",
    "tier_very_high": "⚠️ CRITICAL: Very High risk detected — conditions are dangerous for outdoor exposure",
    "tier_high": "Elevated risk detected — outdoor workers and immunocompromised individuals are especially vulnerable",
    "default": "Current conditions are within typical seasonal range for this area",
}

ADVICE_TEXTS = {
    "Very High": [
        "Wear an N95 or P100 respirator for ALL outdoor activities",
        "Avoid agricultural fields, construction sites, and disturbed soil entirely",
        "See a doctor immediately if you develop cough, fever, or chest pain",
        "Keep windows and car vents closed — use recirculation mode",
    ],
    "High": [
        "Wear an N95 mask during outdoor activities, especially near farms or construction",
        "Reduce time outdoors during windy or dusty conditions",
        "Monitor for symptoms: cough, fever, fatigue lasting more than a week",
    ],
    "Moderate": [
        "Standard precautions recommended for outdoor workers",
        "Wear a dust mask if working with soil",
    ],
    "other": ["Conditions are manageable — standard hygiene and outdoor awareness is sufficient"],
}

INSIGHT_TEXTS = {
    "peak": "Historically, %s sees peak Valley Fever risk around %s due to dry summer conditions.",
    "mean": "The %d–%d dataset shows cases averaging %s/month for this county.",
    "trend": "Year-over-year trend: %d averaged %s cases/month vs %d's %s — a %s.",
    "trend_up": "significant increase",
    "trend_flat": "similar level",
}

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- messages and alerts ----------------------------------------------------

INTENT_KEYWORDS = [
    # the first list with a hit wins
    ("medication", ["pharmacy", "drugstore", "antifungal", "fluconazole", "medication"]),
    ("protection", ["mask", "protect", "prevention", "safe", "what should i do"]),
    ("symptom", ["symptom", "sick", "cough", "fever"]),
    ("clinic", ["clinic", "hospital", "doctor", "healthcare"]),
]
DEFAULT_INTENT = "default"

SEARCH_KEYWORDS = [
    "pharmacy", "drugstore", "clinic", "hospital", "doctor", "antifungal", "fluconazole",
    "medication", "prescription", "nearest", "closest", "nearby", "where can i", "find a",
    "healthcare", "urgent care", "emergency", "ER",
]

ALERT_LANGUAGES = {
    "english": "Alert: {risk_level} Valley Fever risk in {county} County. {advice} Stay safe.",
    "spanish": "Alerta: Riesgo {risk_level} de Fiebre del Valle en el Condado de {county}. {advice} Cuídese.",
    "hmong": "Ceeb Toom: Kab Mob Valley Fever pheej hmoo {risk_level} hauv {county} Cheeb Tsam. {advice}",
    "punjabi": "ਚੇਤਾਵਨੀ: {county} ਕਾਉਂਟੀ ਵਿੱਚ {risk_level} ਵੈਲੀ ਫੀਵਰ ਖਤਰਾ। {advice}",
}
DEFAULT_LANGUAGE = "english"

# Fixed texts: the reply of each intent; the sender is not named.
REPLY_TEXTS = {
    "medication": "For antifungal medications in the Central Valley, you'll need a prescription from a doctor. "
                  "Common options include fluconazole and itraconazole. "
                  "Visit your nearest urgent care, or check these pharmacies:\n"
                  "• CVS Pharmacy — multiple Central Valley locations\n"
                  "• Walgreens — available in most cities\n"
                  "• Costco Pharmacy — often has lower prescription prices\n"
                  "• Your county health department may offer low-cost options\n\n"
                  "If you're experiencing symptoms (cough, fever, fatigue, rash), see a doctor promptly.",
    "protection": "To reduce your Valley Fever risk:\n"
                  "• Wear an N95 mask during dusty conditions or outdoor work\n"
                  "• Avoid areas with soil disturbance (construction, farming, off-roading)\n"
                  "• Keep car windows closed during dust storms\n"
                  "• Use HEPA air filters indoors\n"
                  "• Wet soil before digging to reduce dust\n",
    "symptom": "Common Valley Fever symptoms include:\n"
               "• Cough (can last weeks)\n"
               "• Fever and chills\n"
               "• Fatigue and body aches\n"
               "• Chest pain\n"
               "• Rash on legs or upper body\n\n"
               "Most cases resolve on their own, but see a doctor if symptoms persist "
               "beyond 1-2 weeks or if you're immunocompromised. Early diagnosis matters.",
    "clinic": "Healthcare options in the Central Valley:\n"
              "• Community Medical Centers (Fresno) — largest regional provider\n"
              "• Kern Medical (Bakersfield) — Valley Fever expertise\n"
              "• Mercy Medical Center (Merced)\n"
              "• Kaiser Permanente — multiple Valley locations\n"
              "• County Health Departments offer low-cost testing\n\n"
              "For urgent symptoms, call 911 or visit your nearest ER.",
    "default": "I can help you with:\n"
               "• Current Valley Fever risk in your area\n"
               "• Finding nearby pharmacies and clinics\n"
               "• Prevention tips and protective measures\n"
               "• Understanding symptoms and when to see a doctor\n\n"
               "What would you like to know?",
}
REPLY_CAUTION = "\n⚠️ {county} County is currently at {risk_level} risk — extra caution advised."
CAUTION_INTENT = "protection"

SEVERITY_RANGE = (1, 3)
BADGE_REPORTS = 3
REPORT_LIST_LIMIT = 20
REPORT_HOURS = 24

# --- refresh ----------------------------------------------------------------

REFRESH_CADENCE_HOURS = {"weather": 12, "air_quality": 7 * 24, "cases": 30 * 24}

# --- checks -----------------------------------------------------------------

EXPECTED_ENTITIES = 8
CASE_YEARS_REQUIRED = (2023, 2024)
DOMINANT_ENTITY = ("Kern", 2024, 3000)
