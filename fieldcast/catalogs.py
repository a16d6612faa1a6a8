"""Small fixed catalogues. Every table here has a fixed number of rows, so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: agro-climatic zones --------------------------------------------------
# number, name, focus, south, north, west and east edge, latitude and longitude of the centroid; edges are included
ZONES = [
    (1, "Western Himalayan", "Kangra–Kullu–Mandi", 31.0, 33.0, 76.0, 78.0, 32.0, 77.0),
    (2, "Eastern Himalayan", "Brahmaputra Valley", 25.5, 27.5, 91.0, 93.0, 26.5, 92.0),
    (3, "Lower Gangetic", "Bengal Delta Basin", 22.0, 24.0, 87.5, 89.5, 23.0, 88.5),
    (4, "Middle Gangetic", "Bihar–Eastern UP", 25.0, 27.0, 84.0, 86.0, 26.0, 85.0),
    (5, "Upper Gangetic", "Western UP Doab", 27.5, 29.5, 77.5, 79.5, 28.5, 78.5),
    (6, "Trans-Gangetic", "Punjab–Haryana", 29.5, 31.5, 75.5, 77.5, 30.5, 76.5),
    (7, "Eastern Plateau", "Chota Nagpur", 22.5, 24.5, 84.5, 86.5, 23.5, 85.5),
    (8, "Central Plateau", "Malwa Plateau", 22.5, 24.5, 75.5, 77.5, 23.5, 76.5),
    (9, "Western Plateau", "Maharashtra Deccan", 18.5, 20.5, 73.5, 75.5, 19.5, 74.5),
    (10, "Southern Plateau", "Telangana–Rayalaseema", 16.5, 18.5, 77.5, 79.5, 17.5, 78.5),
    (11, "East Coast Plains", "Krishna Delta & AP", 15.5, 17.5, 80.0, 82.0, 16.5, 81.0),
    (12, "West Coast & Ghats", "Konkan–Western Ghats", 15.0, 17.0, 73.0, 75.0, 16.0, 74.0),
    (13, "Gujarat Plains", "Saurashtra–C. Gujarat", 21.5, 23.5, 71.0, 73.0, 22.5, 72.0),
    (14, "Western Dry", "Semi-Arid Rajasthan", 26.0, 28.0, 75.0, 77.0, 27.0, 76.0),
    (15, "Islands Region", "Andaman Maritime Arc", 11.0, 13.0, 92.0, 94.0, 12.0, 93.0),
]
LIVE_ZONE = "ACZ_14"
LIVE_NOTICE = "Live in-memory 1km downscaling active for Zone XIV."
OTHER_NOTICE = (
    "Pre-trained weights for %s available on Kaggle Model Hub. Live demo operating in Zone XIV."
)

# zone number: baseline RMSE, model RMSE, error reduction in percent; then the default row.
ZONE_BENCHMARKS = [
    (1, 3.412, 1.182, 65.4),
    (2, 2.890, 0.995, 65.6),
    (3, 2.150, 0.812, 62.2),
    (4, 2.340, 0.880, 62.4),
    (5, 2.620, 0.945, 63.9),
    (6, 2.980, 1.050, 64.8),
    (7, 2.510, 0.910, 63.7),
    (8, 2.740, 0.965, 64.8),
    (9, 2.830, 0.985, 65.2),
    (10, 2.690, 0.940, 65.1),
    (11, 2.120, 0.825, 61.1),
    (12, 2.450, 0.895, 63.5),
    (13, 2.910, 1.020, 65.0),
    (14, 0.746, 0.294, 60.6),
    (15, 1.950, 0.810, 58.5),
]
DEFAULT_BENCHMARK = (2.5, 0.95, 58.9)
STATIONS_PER_ZONE = 36

# Region presets of the leaderboard filter.
REGIONS = {
    "MOUNTAIN": [1, 2, 12],
    "PLAINS": [3, 4, 5, 6],
    "PLATEAU": [7, 8, 9, 10],
    "ARID": [13, 14],
}

# --- fixed values: crops -----------------------------------------------------------------
# key, common name, season, base, optimum low, optimum high, critical maximum (all in C),
# optimum vapour pressure deficit low and high (kPa), advisory notes
CROPS = [
    ("BAJRA", "Pearl Millet (बाजरा)", "Kharif", 10.0, 28.0, 36.0, 42.0, 1.0, 2.5,
     "Avoid nitrogen top-dressing during dry spells. Ensure light irrigation if flowering coincides with VPD > 3.0 kPa."),
    ("GUAR", "Cluster Bean (ग्वार)", "Kharif", 12.0, 25.0, 34.0, 40.0, 1.2, 2.8,
     "Highly drought resilient. Protect against waterlogging in heavy soils."),
    ("GROUNDNUT", "Groundnut / Peanut (मूंगफली)", "Kharif / Zaid", 10.0, 24.0, 30.0, 38.0, 0.8, 2.0,
     "Maintain adequate topsoil moisture (0-7cm) during pegging; dry crusting prevents subterranean peg penetration."),
    ("WHEAT", "Wheat (गेहूं)", "Rabi", 4.5, 15.0, 24.0, 30.0, 0.6, 1.8,
     "If temperatures exceed 30°C during grain filling, apply light irrigation or potassium nitrate foliar spray to combat terminal heat."),
    ("MUSTARD", "Indian Mustard (सरसों)", "Rabi", 5.0, 15.0, 25.0, 32.0, 0.6, 1.8,
     "Monitor aphid colonies on top 10cm twigs. Spray when population reaches 25 aphids/plant."),
    ("COTTON", "Cotton (कपास)", "Kharif", 12.0, 25.0, 35.0, 40.0, 1.0, 2.5,
     "Avoid excess nitrogen during square formation. Ensure good drainage to prevent leaf reddening."),
]
DEFAULT_CROP = "BAJRA"
DEFAULT_STAGE_ORDINAL = 3

# crop key, stage, water need, critical pest, sensitivity; ordinal = position within the crop
CROP_STAGES = [
    ("BAJRA", "Sowing", "Low", "Shoot fly", "Moderate"),
    ("BAJRA", "Vegetative", "Moderate", "Stem borer", "Low"),
    ("BAJRA", "Flowering", "High", "Ergot / Smut", "Extreme"),
    ("BAJRA", "Grain Filling", "High", "Bird damage, rust", "High"),
    ("BAJRA", "Maturity", "Low", "Pre-harvest rain mould", "Moderate"),
    ("GUAR", "Sowing", "Low", "Root rot", "Moderate"),
    ("GUAR", "Vegetative", "Low", "Jassids", "Low"),
    ("GUAR", "Flowering", "Moderate", "Bacterial blight", "High"),
    ("GUAR", "Pod Formation", "Moderate", "Pod borer", "High"),
    ("GUAR", "Maturity", "Low", "Pod shattering", "Moderate"),
    ("GROUNDNUT", "Sowing", "Moderate", "Collar rot", "Moderate"),
    ("GROUNDNUT", "Vegetative", "Moderate", "Leaf miner", "Low"),
    ("GROUNDNUT", "Pegging", "Critical", "Tikka disease", "Extreme"),
    ("GROUNDNUT", "Pod Development", "Critical", "White grub", "Extreme"),
    ("GROUNDNUT", "Maturity", "Low", "Aflatoxin infection", "High"),
    ("WHEAT", "Crown Root Initiation (CRI)", "Critical", "Termites", "Extreme"),
    ("WHEAT", "Tillering", "Moderate", "Aphids", "Moderate"),
    ("WHEAT", "Jointing / Booting", "High", "Rust (Yellow/Brown)", "High"),
    ("WHEAT", "Flowering / Heading", "Critical", "Karnal bunt", "Extreme"),
    ("WHEAT", "Milking / Dough", "Moderate", "Terminal heat desiccation", "Extreme"),
    ("MUSTARD", "Sowing", "Moderate", "Sawfly", "Moderate"),
    ("MUSTARD", "Vegetative", "Moderate", "Painted bug", "Low"),
    ("MUSTARD", "Flowering", "Critical", "Mustard aphid", "Extreme"),
    ("MUSTARD", "Siliqua Formation", "High", "White rust / Alternaria", "High"),
    ("MUSTARD", "Maturity", "Low", "Sclerotinia stem rot", "Moderate"),
    ("COTTON", "Squaring", "Moderate", "Whitefly / Jassids", "High"),
    ("COTTON", "Flowering", "High", "Pink bollworm", "Extreme"),
    ("COTTON", "Boll Development", "High", "Boll rot", "Extreme"),
    ("COTTON", "Maturity / Bursting", "Low", "Staining fungi", "Moderate"),
]

# crop key, disease, condition under which it breaks out
DISEASE_TRIGGERS = [
    ("BAJRA", "Ergot", "Relative humidity > 85% with temperatures 20-30°C during flowering"),
    ("BAJRA", "Downy Mildew", "Cloudy humid weather with prolonged leaf wetness"),
    ("GUAR", "Bacterial Blight", "High humidity coupled with daytime heat spikes"),
    ("GROUNDNUT", "Tikka Disease (Cercospora)",
     "Prolonged high humidity (>80%) with warm temperatures (25-30°C)"),
    ("WHEAT", "Yellow Rust",
     "Cool nights (8-13°C) and morning dew followed by mild days (15-20°C)"),
    ("MUSTARD", "Mustard Aphids",
     "Cloudy, humid weather (RH > 70%) with temperatures 15-20°C during flowering"),
    ("COTTON", "Pink Bollworm",
     "High relative humidity with evening temperatures > 24°C during flower square phase"),
]

# --- fixed values: seasons, pilots, phrases -----------------------------------------------
SEASONS = [
    ("Winter (Jan-Feb)", [1, 2]),
    ("Pre-Monsoon Summer (Mar-May)", [3, 4, 5]),
    ("Monsoon (Jun-Sep)", [6, 7, 8, 9]),
    ("Post-Monsoon (Oct-Dec)", [10, 11, 12]),
]
PILOT_LOCATIONS = ["KADERA_001", "BHANKRI_002", "TUNGA_003", "DADHIKAR_004"]

# Phrases that mean "nothing to warn about".
NO_WARNING_PHRASES = [
    "no warning issued", "nil", "none", "no warning", "no severe weather warning",
    "no severe weather warning issued", "nil warning",
]
MOSDAC_ATTRIBUTION = "Data Source: MOSDAC/SAC/ISRO. https://mosdac.gov.in"
BHOONIDHI_ATTRIBUTION = (
    "Data Source: Bhoonidhi / NRSC / ISRO (Indian Space Policy 2023). https://bhoonidhi.nrsc.gov.in"
)


def zone_rows() -> list[tuple]:
    """(zone_id, zone_no, name, focus, south, north, west, east, center_lat, center_lon)."""
    return [(f"ACZ_{no:02d}", no, *rest) for no, *rest in ZONES]


ZONE_FIELDS = (
    "zone_id string, zone_no int, zone_name string, focus_domain string, south double, north double, "
    "west double, east double, center_lat double, center_lon double"
)


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(zone_rows(), ZONE_FIELDS)


def zone_benchmarks(spark: SparkSession) -> DataFrame:
    rows = [(f"ACZ_{no:02d}", b, m, d) for no, b, m, d in ZONE_BENCHMARKS]
    return spark.createDataFrame(
        rows, "zone_id string, baseline_rmse_c double, model_rmse_c double, error_reduction_pct double"
    )


CROP_FIELDS = (
    "crop_key string, common_name string, season string, base_temp_c double, optimal_temp_low_c double, "
    "optimal_temp_high_c double, critical_max_temp_c double, optimal_vpd_low_kpa double, "
    "optimal_vpd_high_kpa double, advisory_notes string"
)


def crops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CROPS, CROP_FIELDS)


def stage_rows() -> list[tuple]:
    seen: dict[str, int] = {}
    rows = []
    for crop, stage, water, pest, sensitivity in CROP_STAGES:
        seen[crop] = seen.get(crop, 0) + 1
        rows.append((crop, stage, seen[crop], water, pest, sensitivity))
    return rows


STAGE_FIELDS = (
    "crop_key string, stage string, stage_ordinal int, stage_water_demand string, "
    "stage_critical_pest string, stage_sensitivity string"
)


def crop_stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(stage_rows(), STAGE_FIELDS)


def disease_triggers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DISEASE_TRIGGERS, "crop_key string, disease string, condition string"
    )
