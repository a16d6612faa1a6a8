"""Farm advice: soil context, verdict, irrigation, spraying, protection and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.text import clock, fixed
from fieldcast.operators import indices, lookups
from fieldcast.plans.forecasts import first_hours

# --- fixed values: thresholds and wording ------------------------------------------------
HEAT_HOURS = 4
VPD_STRESS_KPA = 2.8
VPD_IRRIGATE_KPA = 2.5
MOISTURE_DRY, MOISTURE_WET = 0.12, 0.22
SOIL_DEFAULTS = {"elevation_m": 300.0, "slope_magnitude_deg": 0.0, "aspect_deg": 0.0, "tpi_300m": 0.0}

DRY_TEXT = "CRITICAL_DEFICIT (Dry topsoil, irrigation required)"
MOIST_TEXT = "OPTIMAL_MOISTURE (Adequate field capacity for root zone)"
WET_TEXT = "SATURATED / HIGH (Risk of waterlogging in poorly drained basins)"

FROST, HEAT, CAUTION, IRRIGATE, GOOD = (
    "FROST_WARNING", "HEAT_STRESS_DEFENSE", "SPRAY_CAUTION", "IRRIGATE_IMMEDIATELY", "FAVORABLE",
)
HEADLINES = {
    FROST: "Critical Frost Alert for {crop} ({stage}): Near-Zero Radiative Cooling Detected",
    HEAT: "High Thermal Stress for {crop} ({stage}): {heat} Hours Exceeding Threshold",
    CAUTION: "Spray Caution for {crop} ({stage}): High Wind Drift or Washout Risk in Horizon",
    IRRIGATE: "High Transpiration Stress (VPD: {vpd} kPa): Soil Moisture Depleting Rapidly",
    GOOD: "Favorable Agromet Conditions for {crop} ({stage})",
}
IRRIGATE_TEXT = (
    "Apply light evening irrigation to replenish topsoil moisture and reduce root zone heat stress. "
    "VPD is elevated at {vpd} kPa (optimal: {vpd_low}-{vpd_high} kPa). Surface soil status: {soil}."
)
NO_IRRIGATION_TEXT = (
    "Soil moisture is adequate ({moisture}%). No immediate irrigation required. "
    "Maintain standard irrigation schedule for {stage} stage."
)
SPRAY_TEXT = (
    "Optimal Spray Window: {start} to {end} (Duration: {hours}h, Suitability Score: {score}/100). "
    "Wind speed is calm (< 12 km/h) with zero rain washout probability. Use recommended dilution."
)
NO_SPRAY_TEXT = (
    "Postpone chemical and bio-pesticide spraying over the next 24-48 hours. Adverse atmospheric conditions "
    "(high wind drift or elevated daytime temperatures) will cause drift loss or droplet evaporation."
)
PROTECTION_TEXT = (
    "Critical Stage: {stage} (Sensitivity: {sensitivity}). Primary pest/disease threat: {pest}. {notes}"
)
HINDI_GOOD = (
    "कृषि सलाह ({crop} - {stage} अवस्था): मौसम पूरी तरह अनुकूल है। "
    "हवा की गति शांत रहने से छिड़काव के लिए अनुकूल समय उपलब्ध है। "
    "पहला अनुकूल छिड़काव समय: {start} से {end}। मुख्य कीट ({pest}) पर निगरानी रखें।"
)
HINDI_HEAT = (
    "तापमान चेतावनी ({crop} - {stage}): 1 किमी मॉडल के अनुसार दिन का तापमान {heat} घंटे अधिक रहेगा। "
    "फसल को गर्मी से बचाने के लिए शाम के समय हल्की सिंचाई करें। "
    "दोपहर 12 से 4 बजे के बीच कीटनाशक का छिड़काव बिल्कुल न करें।"
)
HINDI_FROST = (
    "पाला / पाले की चेतावनी ({crop}): रात के समय घाटी क्षेत्र में ठंडा हवा जमाव (Inversion) होने से तापमान अत्यधिक गिर सकता है। "
    "फसल की सुरक्षा के लिए खेत के किनारों पर धुआं करें या हल्की सिंचाई करें।"
)
HINDI_OTHER = (
    "कृषि सलाह ({crop} - {stage}): वाष्पीकरण दबाव (VPD) {vpd} kPa दर्ज किया गया है। "
    "मिट्टी की नमी बनाए रखने के लिए समय पर सिंचाई सुनिश्चित करें। "
    "कीट नियंत्रण के लिए हवा की गति 12 किमी/घंटे से कम होने पर ही छिड़काव करें।"
)
ENGLISH_TEXT = (
    "Agromet Summary for {crop} at {stage} stage: {headline}. GDD accumulated: {gdd}°C-days. "
    "Active spray windows identified: {windows}."
)
REPLY_LEAD = "Here is your agromet verdict for {crop} at {stage} stage: {headline}"
REPLY_ITEMS = {
    "Irrigation": "irrigation_advice",
    "Spray Timing": "spray_recommendation",
    "Crop Protection": "crop_specific_protection",
}
UNKNOWN = "n/a"


def slots() -> dict[str, Column]:
    """Text of every placeholder used by the templates."""
    return {
        "crop": F.col("common_name"),
        "stage": F.col("crop_stage"),
        "heat": F.col("heat_stress_hours").cast("string"),
        "vpd": fixed(F.col("mean_vpd_kpa"), 2),
        "vpd_low": fixed(F.col("optimal_vpd_low_kpa"), 1),
        "vpd_high": fixed(F.col("optimal_vpd_high_kpa"), 1),
        "soil": F.coalesce("moisture_status", F.lit(UNKNOWN)),
        "moisture": F.coalesce(fixed(F.col("soil_moisture_m3m3") * 100.0, 1), F.lit(UNKNOWN)),
        "start": clock(F.col("first_window_start")),
        "end": clock(F.col("first_window_end")),
        "hours": F.col("first_window_hours").cast("string"),
        "score": fixed(F.col("first_window_score"), 0),
        "sensitivity": F.col("stage_sensitivity"),
        "pest": F.col("stage_critical_pest"),
        "notes": F.col("advisory_notes"),
        "headline": F.col("summary_headline"),
        "gdd": fixed(F.col("gdd_accumulated_c_days"), 1),
        "windows": F.col("spray_windows").cast("string"),
    }


def fill(template: str) -> Column:
    """A template with {placeholders} as one concat expression."""
    values, pieces = slots(), []
    for part in template.replace("}", "{").split("{"):
        if part:
            pieces.append(values[part] if part in values and f"{{{part}}}" in template else F.lit(part))
    return F.concat(*pieces)


def moisture_status(moisture: Column) -> Column:
    """Class of a measured soil moisture; unknown moisture has no class."""
    return (
        F.when(moisture < MOISTURE_DRY, DRY_TEXT)
        .when(moisture < MOISTURE_WET, MOIST_TEXT)
        .when(moisture >= MOISTURE_WET, WET_TEXT)
    )


def soil_context(terrain_rows: DataFrame, moisture: str | None = None) -> DataFrame:
    """Terrain with defaults and display rounding, plus the class of the observed moisture."""
    digits = {"elevation_m": 1, "slope_magnitude_deg": 2, "aspect_deg": 1, "tpi_300m": 2}
    filled = terrain_rows.withColumns(
        {c: F.round(F.coalesce(c, F.lit(v)), digits[c]) for c, v in SOIL_DEFAULTS.items()}
    )
    value = F.col(moisture) if moisture else F.lit(None).cast("double")
    return filled.withColumns({"soil_moisture_m3m3": value, "moisture_status": moisture_status(value)})


def verdict() -> Column:
    return (
        F.when(F.col("frost_risk"), FROST)
        .when(F.col("heat_stress_hours") >= HEAT_HOURS, HEAT)
        .when(F.col("spray_windows") == 0, CAUTION)
        .when(F.col("mean_vpd_kpa") > VPD_STRESS_KPA, IRRIGATE)
        .otherwise(GOOD)
    )


def headline() -> Column:
    cases = None
    for name, template in HEADLINES.items():
        cases = (F if cases is None else cases).when(F.col("verdict_category") == name, fill(template))
    return cases


def irrigation() -> Column:
    dry = (F.col("mean_vpd_kpa") > VPD_IRRIGATE_KPA) | (F.col("heat_stress_hours") > 0)
    return F.when(dry, fill(IRRIGATE_TEXT)).otherwise(fill(NO_IRRIGATION_TEXT))


def spraying_text() -> Column:
    return F.when(F.col("spray_windows") > 0, fill(SPRAY_TEXT)).otherwise(F.lit(NO_SPRAY_TEXT))


def hindi() -> Column:
    category = F.col("verdict_category")
    return (
        F.when(category == GOOD, fill(HINDI_GOOD))
        .when(category == HEAT, fill(HINDI_HEAT))
        .when(category == FROST, fill(HINDI_FROST))
        .otherwise(fill(HINDI_OTHER))
    )


def action_plan(facts: DataFrame) -> DataFrame:
    """Add the verdict and every text to rows with indices, soil context and crop profile."""
    rows = facts.withColumn("verdict_category", verdict())
    rows = rows.withColumn("summary_headline", headline())
    return rows.withColumns(
        {
            "irrigation_advice": irrigation(),
            "spray_recommendation": spraying_text(),
            "crop_specific_protection": fill(PROTECTION_TEXT),
            "vernacular_hindi": hindi(),
            "english_summary": fill(ENGLISH_TEXT),
        }
    )


def reply(plans: DataFrame) -> DataFrame:
    """A chat-style answer built from a consultation row."""
    lines = [F.concat(fill(REPLY_LEAD), F.lit("\n"))]
    lines += [F.concat(F.lit(f"• {title}: "), F.col(column)) for title, column in REPLY_ITEMS.items()]
    return plans.withColumn("reply", F.concat_ws("\n", *lines))


def consultations(
    requests: DataFrame, series: DataFrame, soil: DataFrame, key: list[str], hours: int = 48
) -> DataFrame:
    """One advisory row per request (key, crop, crop_stage) over the first `hours` of its series.

    The crop sets the temperature limits. A cut series has at most 168 rows.
    """
    profiles = lookups.crop_profiles(requests)
    limits = profiles.select(*key, "base_temp_c", "critical_max_temp_c")
    near = first_hours(series, key, hours)
    report = indices.indices(
        near.join(limits, key), key, F.col("base_temp_c"), F.col("critical_max_temp_c"), short=True
    )
    facts = profiles.join(report, key).join(soil, key, "left")
    return action_plan(facts)
