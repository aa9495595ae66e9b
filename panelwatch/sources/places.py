"""Fixed place tables: case counts, care facilities and vulnerable zones.

Everything in capitals is a fixed value; other regions pass their own tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwatch.sources import readers, schemas

KNOWN_CASES = {
    "Kern": {2020: 2954, 2021: 3045, 2022: 2407, 2023: 3152, 2024: 3990},
    "Fresno": {2020: 480, 2021: 560, 2022: 510, 2023: 400, 2024: 900},
    "Tulare": {2020: 190, 2021: 230, 2022: 200, 2023: 340, 2024: 600},
    "Kings": {2020: 100, 2021: 120, 2022: 115, 2023: 150, 2024: 210},
    "San Joaquin": {2020: 70, 2021: 85, 2022: 80, 2023: 155, 2024: 239},
    "Merced": {2020: 50, 2021: 65, 2022: 55, 2023: 90, 2024: 140},
    "Stanislaus": {2020: 45, 2021: 55, 2022: 50, 2023: 85, 2024: 130},
    "Madera": {2020: 22, 2021: 38, 2022: 35, 2023: 55, 2024: 80},
}

CASE_SOURCES = {
    "Kern": "cdph_confirmed",
    "Fresno": "news_crossref",
    "Tulare": "news_crossref",
    "Kings": "cdph_estimated",
    "San Joaquin": "news_crossref",
    "Merced": "cdph_estimated",
    "Stanislaus": "cdph_estimated",
    "Madera": "county_ph",
}

PROVISIONAL_YEAR = 2025
PROVISIONAL_CASES = {
    "Kern": 1800, "Fresno": 576, "Tulare": 371, "Kings": 120,
    "San Joaquin": 272, "Merced": 100, "Stanislaus": 90, "Madera": 50,
}

FACILITIES = {
    # name, type, lat, lon, phone, note, address
    "Kern": [
        ("Kern Medical Center", "hospital", 35.3816, -119.0233, "(661) 326-2000", "Valley Fever expertise", "1700 Mount Vernon Ave, Bakersfield"),
        ("Dignity Health – Mercy Hospital", "hospital", 35.3780, -119.0321, "(661) 632-5000", "Regional trauma center", "2215 Truxtun Ave, Bakersfield"),
        ("Clinica Sierra Vista – Bakersfield", "clinic", 35.3938, -119.1012, "(661) 635-3050", "Community health center", "7427 Meany Ave, Bakersfield"),
        ("Adventist Health Bakersfield", "hospital", 35.3561, -119.1003, "(661) 654-2000", "Urgent & specialty care", "2615 Eye St, Bakersfield"),
        ("Valley Republic Medical Group", "clinic", 35.4010, -119.0890, "(661) 321-0580", "Primary care", "9900 Stockdale Hwy, Bakersfield"),
    ],
    "Fresno": [
        ("Community Regional Medical Center", "hospital", 36.7410, -119.7847, "(559) 459-6000", "Level 1 Trauma, Valley Fever cases", "2823 Fresno St, Fresno"),
        ("Valley Children's Hospital", "hospital", 36.8088, -119.7734, "(559) 353-3000", "Pediatric Valley Fever", "9300 Valley Children's Pl, Madera"),
        ("Fresno County Dept of Public Health", "clinic", 36.7392, -119.7825, "(559) 600-3271", "Free Valley Fever testing", "1221 Fulton St, Fresno"),
        ("Clinica Sierra Vista – Fresno", "clinic", 36.7550, -119.7900, "(559) 228-4150", "Sliding scale fees", "3461 W Shields Ave, Fresno"),
        ("Saint Agnes Medical Center", "hospital", 36.7855, -119.8164, "(559) 450-3000", "General & urgent care", "1303 E Herndon Ave, Fresno"),
    ],
    "Tulare": [
        ("Adventist Health Tulare", "hospital", 36.2086, -119.0504, "(559) 688-0821", "Primary & urgent care", "869 N Cherry St, Tulare"),
        ("Kaweah Health Medical Center", "hospital", 36.3306, -119.2953, "(559) 624-2000", "Regional Valley Fever care", "400 W Mineral King Ave, Visalia"),
        ("Porterville Sierra View Hospital", "hospital", 36.0620, -119.0117, "(559) 784-1110", "General acute care", "465 W Putnam Ave, Porterville"),
        ("Tulare County Health & Human Services", "clinic", 36.2077, -119.0539, "(559) 624-7400", "Public health testing", "5957 S Mooney Blvd, Visalia"),
    ],
    "Kings": [
        ("Adventist Health Hanford", "hospital", 36.3292, -119.6402, "(559) 582-9000", "Valley Fever diagnosis & treatment", "115 Mall Dr, Hanford"),
        ("Corcoran District Hospital", "hospital", 36.0970, -119.5581, "(559) 992-5051", "Rural acute care", "1310 Hanna Ave, Corcoran"),
        ("Kings Community Action Organization", "clinic", 36.3100, -119.6450, "(559) 582-4386", "Community health services", "1222 W Lacey Blvd, Hanford"),
    ],
    "Merced": [
        ("Dignity Health – Mercy Medical Center", "hospital", 37.3018, -120.4821, "(209) 564-5000", "Regional hospital, Valley Fever care", "333 Mercy Ave, Merced"),
        ("UC Merced Student Health", "clinic", 37.3647, -120.4252, "(209) 228-2273", "Student & faculty health", "5200 N Lake Rd, Merced"),
        ("Merced County Public Health", "clinic", 37.3060, -120.4800, "(209) 381-1200", "Free testing & prevention", "260 E 15th St, Merced"),
        ("Golden Valley Health Centers", "clinic", 37.3100, -120.4870, "(209) 385-2500", "FQHC, sliding scale fees", "1525 W Main St, Merced"),
    ],
    "Madera": [
        ("Madera Community Hospital", "hospital", 36.9611, -120.0603, "(559) 675-5555", "General & emergency care", "1250 E Almond Ave, Madera"),
        ("Valley Children's Hospital – Madera", "hospital", 36.9550, -120.0600, "(559) 353-3000", "Pediatric Valley Fever", "9300 Valley Children's Pl, Madera"),
        ("Madera County Public Health", "clinic", 36.9627, -120.0573, "(559) 675-7893", "Valley Fever education & testing", "2037 W Cleveland Ave, Madera"),
    ],
    "Stanislaus": [
        ("Memorial Medical Center", "hospital", 37.6390, -120.9965, "(209) 526-4500", "Level 2 Trauma", "1700 Coffee Rd, Modesto"),
        ("Doctors Medical Center", "hospital", 37.6522, -121.0070, "(209) 578-1211", "General acute care", "1441 Florida Ave, Modesto"),
        ("Stanislaus County Dept of Health", "clinic", 37.6417, -120.9927, "(209) 558-7000", "Public health, free Valley Fever info", "830 Scenic Dr, Modesto"),
        ("Central California Faculty Medical Group", "clinic", 37.6350, -120.9900, "(209) 559-6000", "Primary care", "1700 Coffee Rd, Modesto"),
    ],
    "San Joaquin": [
        ("San Joaquin General Hospital", "hospital", 37.9780, -121.3020, "(209) 468-6000", "Public hospital, Valley Fever care", "500 W Hospital Rd, French Camp"),
        ("St. Joseph's Medical Center", "hospital", 37.9627, -121.3104, "(209) 943-2000", "Level 2 Trauma center", "1800 N California St, Stockton"),
        ("Dameron Hospital", "hospital", 37.9755, -121.3106, "(209) 944-5550", "General & urgent care", "525 W Acacia St, Stockton"),
        ("San Joaquin County Public Health", "clinic", 37.9577, -121.2908, "(209) 468-3439", "Free Valley Fever testing", "1601 E Hazelton Ave, Stockton"),
        ("Asian Pacific Health Care Venture", "clinic", 37.9600, -121.3000, "(209) 468-6000", "Multilingual community health", "201 E Center St, Stockton"),
    ],
}

ZONES = {
    # name, type, lat, lon, population estimate
    "Kern": [
        ("Arvin Farmworker Housing", "farm", 35.2094, -118.8289, 8500),
        ("Wasco Labor Camp Area", "farm", 35.5933, -119.3408, 4200),
        ("Delano Agricultural Zone", "farm", 35.7688, -119.2471, 12000),
        ("Shafter Farmworker District", "farm", 35.5005, -119.2718, 3800),
        ("McFarland Elementary School", "school", 35.6799, -119.2291, 620),
        ("Earlimart School District", "school", 35.8849, -119.2718, 890),
        ("Kern County Fairgrounds Worksite", "worksite", 35.3872, -119.0117, 2100),
        ("Bakersfield Oil Field Workers Zone", "worksite", 35.3733, -119.0187, 5600),
        ("Taft Oilfield Construction Site", "worksite", 35.1422, -119.4593, 1800),
    ],
    "Fresno": [
        ("Fresno Westside Farmworker Housing", "farm", 36.7468, -120.0532, 9200),
        ("Sanger Agricultural Labor Zone", "farm", 36.7080, -119.5549, 5400),
        ("Selma Farm Camp", "farm", 36.5710, -119.6124, 3100),
        ("Firebaugh Migrant Housing", "farm", 36.8580, -120.4574, 4700),
        ("Roosevelt High School Fresno", "school", 36.7263, -119.7842, 2400),
        ("McLane High School", "school", 36.7879, -119.8284, 2100),
        ("Fresno Construction Corridor", "worksite", 36.7372, -119.7871, 3200),
    ],
    "Tulare": [
        ("Visalia Ag Worker Housing", "farm", 36.3302, -119.2921, 6800),
        ("Porterville Farm District", "farm", 36.0653, -119.0168, 4900),
        ("Lindsay Orange Grove Workers", "farm", 36.2030, -119.0899, 2800),
        ("Tulare County Head Start", "school", 36.2077, -119.0539, 450),
        ("Farmersville Elementary", "school", 36.3005, -119.2099, 680),
        ("Exeter Packing House Workers", "worksite", 36.2916, -119.1421, 1400),
    ],
    "Kings": [
        ("Hanford Farmworker Colony", "farm", 36.3274, -119.6457, 3200),
        ("Lemoore Agricultural Labor Camp", "farm", 36.3002, -119.7829, 2100),
        ("Avenal Migrant Housing", "farm", 36.0030, -120.1285, 1800),
        ("Corcoran Elementary Schools", "school", 36.0977, -119.5591, 920),
        ("Kings County Cotton Fields Worksite", "worksite", 36.2000, -119.8500, 2600),
    ],
    "Merced": [
        ("Livingston Farm Labor Housing", "farm", 37.3874, -120.7238, 4100),
        ("Los Banos Migrant Camp", "farm", 36.6060, -120.8496, 3600),
        ("Dos Palos Agricultural Zone", "farm", 36.9849, -120.6260, 2200),
        ("Merced Union High School", "school", 37.3022, -120.4830, 2800),
        ("UC Merced (Outdoor Research Sites)", "worksite", 37.3647, -120.4252, 8500),
        ("Atwater Orchard Workers Zone", "worksite", 37.3474, -120.6096, 1900),
    ],
    "Madera": [
        ("Madera Farmworker Housing District", "farm", 36.9613, -120.0607, 5100),
        ("Chowchilla Labor Camp", "farm", 37.1227, -120.2607, 2800),
        ("Madera High School", "school", 36.9627, -120.0573, 2200),
        ("Ripperdan State School", "school", 36.9500, -120.1900, 340),
        ("Madera Vineyard Seasonal Workers", "worksite", 36.8800, -120.1600, 3100),
    ],
    "Stanislaus": [
        ("Modesto Farmworker Zone", "farm", 37.5630, -120.9877, 7800),
        ("Turlock Migrant Labor Housing", "farm", 37.4946, -120.8466, 4500),
        ("Patterson Agricultural Workers", "farm", 37.4713, -121.1285, 2900),
        ("Modesto High School", "school", 37.6391, -120.9969, 2600),
        ("CSU Stanislaus (Outdoor Areas)", "school", 37.5246, -120.8549, 9500),
        ("Ceres Construction Workers", "worksite", 37.5949, -120.9577, 2100),
    ],
    "San Joaquin": [
        ("Stockton Farmworker Housing", "farm", 37.9577, -121.2908, 8900),
        ("Lodi Vineyard Labor Zone", "farm", 38.1302, -121.2722, 5200),
        ("Tracy Agricultural Workers", "farm", 37.7397, -121.4252, 3400),
        ("Edison High School Stockton", "school", 37.9688, -121.3211, 2900),
        ("UOP Outdoor Athletics", "school", 37.9774, -121.3108, 3600),
        ("Port of Stockton Outdoor Workers", "worksite", 37.9549, -121.3060, 2800),
    ],
}


def _items(spark: SparkSession, table: dict, item: str) -> DataFrame:
    fields = ", ".join(part.replace(" ", ": ", 1) for part in item.split(", "))
    return readers.flatten_items(spark.createDataFrame([(table,)], f"items map<string, array<struct<{fields}>>>"))


def facilities(spark: SparkSession) -> DataFrame:
    """All care facilities with their county."""
    return _items(spark, FACILITIES, schemas.FACILITY)


def zones(spark: SparkSession) -> DataFrame:
    """All vulnerable zones with their county."""
    return _items(spark, ZONES, schemas.ZONE)


def known_cases(spark: SparkSession) -> DataFrame:
    """Yearly case counts where no official file is at hand."""
    nested = spark.createDataFrame(
        [(county, CASE_SOURCES[county], by_year) for county, by_year in KNOWN_CASES.items()],
        "county string, cases_source string, by_year map<int, bigint>",
    )
    provisional = spark.createDataFrame(list(PROVISIONAL_CASES.items()), "county string, case_count bigint")
    return readers.nested_cases(nested, provisional, PROVISIONAL_YEAR)
