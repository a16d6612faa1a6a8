"""Verdicts and advice per station and crop."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.plans import advisory, features
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.registry.feature_queries import FLAG_SQL, POINTS_ONLY
from fieldcast.registry.index_queries import FIRST_SQL, STRESS_SQL, WINDOWS_SQL

c = F.col
CROPS = ["Bajra", "guar", "Groundnut", "WHEAT", " mustard ", "Cotton", "Ragi"]
STAGES = ["Sowing", "Vegetative", "Flowering", "Maturity", "Tillering"]


def _pick(words: list[str], by: str) -> str:
    return "CASE " + by + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


PROFILES_SQL = f"""crops AS (SELECT * FROM (VALUES {t.values(catalogs.CROPS)}) AS c(crop_key, common_name, season, base_temp_c, optimal_temp_low_c, optimal_temp_high_c,
  critical_max_temp_c, optimal_vpd_low_kpa, optimal_vpd_high_kpa, advisory_notes)),
stages AS (SELECT * FROM (VALUES {t.values(catalogs.stage_rows())}) AS s(crop_key, stage, stage_ordinal, stage_water_demand, stage_critical_pest, stage_sensitivity)),
asked AS (SELECT zone_id, point_id, upper(trim({_pick(CROPS, 'point_no % 7')})) AS crop, {_pick(STAGES, 'point_no % 5')} AS crop_stage FROM points),
profiles AS (SELECT a.zone_id, a.point_id, a.crop_stage, crops.*, coalesce(s.stage_critical_pest, d.stage_critical_pest) AS stage_critical_pest,
  coalesce(s.stage_sensitivity, d.stage_sensitivity) AS stage_sensitivity
  FROM asked a JOIN crops ON crops.crop_key = CASE WHEN a.crop = 'RAGI' THEN 'BAJRA' ELSE a.crop END LEFT JOIN stages s ON s.crop_key = crops.crop_key AND s.stage = a.crop_stage
  JOIN stages d ON d.crop_key = crops.crop_key AND d.stage_ordinal = 3)"""
STRESS = STRESS_SQL.format(base="any_value(base_temp_c)", limit="critical_max_temp_c")[len(t.SERIES_SQL) + 1:].replace(
    "AS gap FROM series)", "AS gap, base_temp_c, critical_max_temp_c FROM series JOIN profiles USING (zone_id, point_id))"
)
SLOTS = {
    "crop": "common_name", "stage": "crop_stage", "heat": "CAST(heat_stress_hours AS VARCHAR)", "vpd": "printf('%.2f', round(mean_vpd_kpa + 1e-7, 2))",
    "vpd_low": "printf('%.1f', optimal_vpd_low_kpa)", "vpd_high": "printf('%.1f', optimal_vpd_high_kpa)", "soil": "coalesce(moisture_status, 'n/a')",
    "moisture": "coalesce(printf('%.1f', round(soil_moisture_m3m3 * 100 + 1e-7, 1)), 'n/a')", "start": "strftime(first_window_start, '%H:%M')", "end": "strftime(first_window_end, '%H:%M')",
    "hours": "CAST(first_window_hours AS VARCHAR)", "score": "printf('%.0f', round(first_window_score + 1e-7, 0))", "sensitivity": "stage_sensitivity", "pest": "stage_critical_pest",
    "notes": "advisory_notes", "headline": "summary_headline", "gdd": "printf('%.1f', round(gdd_accumulated_c_days + 1e-7, 1))", "windows": "CAST(spray_windows AS VARCHAR)",
}


def fill_sql(template: str) -> str:
    pieces = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if part:
            pieces.append(SLOTS[part] if i % 2 else "'" + part.replace("'", "''") + "'")
    return " || ".join(pieces)


def _cases(templates: dict[str, str], other: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {fill_sql(v)}" for k, v in templates.items())
    return f"CASE verdict_category {whens}" + (f" ELSE {fill_sql(other)}" if other else "") + " END"


CUT_SQL = t.SERIES_SQL.replace("series AS (", "all_series AS (") + """,
series AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, point_id ORDER BY timestamp) AS nth FROM all_series) WHERE nth <= 96)"""
PLAN_SQL = f"""{CUT_SQL}, {POINTS_ONLY}, {PROFILES_SQL}, {STRESS}, {FLAG_SQL}, {WINDOWS_SQL}, {FIRST_SQL},
soil AS (SELECT zone_id, point_id, avg(soil_moisture_m3m3) AS soil_moisture_m3m3 FROM all_series GROUP BY 1, 2),
facts AS (SELECT profiles.*, stress.* EXCLUDE (zone_id, point_id), gdd_accumulated_c_days, coalesce(spray_windows, 0) AS spray_windows, first_window_start, first_window_end, first_window_hours,
  first_window_score, soil_moisture_m3m3, CASE WHEN soil_moisture_m3m3 < 0.12e0 THEN '{advisory.DRY_TEXT}' WHEN soil_moisture_m3m3 < 0.22e0 THEN '{advisory.MOIST_TEXT}' ELSE '{advisory.WET_TEXT}' END AS moisture_status
  FROM profiles JOIN stress USING (zone_id, point_id) JOIN gdd USING (zone_id, point_id) JOIN soil USING (zone_id, point_id) LEFT JOIN first_window USING (zone_id, point_id)),
verdicts AS (SELECT *, CASE WHEN frost_risk THEN 'FROST_WARNING' WHEN heat_stress_hours >= 4 THEN 'HEAT_STRESS_DEFENSE' WHEN spray_windows = 0 THEN 'SPRAY_CAUTION'
  WHEN mean_vpd_kpa > 2.8e0 THEN 'IRRIGATE_IMMEDIATELY' ELSE 'FAVORABLE' END AS verdict_category FROM facts),
heads AS (SELECT *, {_cases(advisory.HEADLINES)} AS summary_headline FROM verdicts),
plans AS (SELECT *, CASE WHEN mean_vpd_kpa > 2.5e0 OR heat_stress_hours > 0 THEN {fill_sql(advisory.IRRIGATE_TEXT)} ELSE {fill_sql(advisory.NO_IRRIGATION_TEXT)} END AS irrigation_advice,
  CASE WHEN spray_windows > 0 THEN {fill_sql(advisory.SPRAY_TEXT)} ELSE {fill_sql(advisory.NO_SPRAY_TEXT)} END AS spray_recommendation, {fill_sql(advisory.PROTECTION_TEXT)} AS crop_specific_protection,
  {_cases({advisory.GOOD: advisory.HINDI_GOOD, advisory.HEAT: advisory.HINDI_HEAT, advisory.FROST: advisory.HINDI_FROST}, advisory.HINDI_OTHER)} AS vernacular_hindi,
  {fill_sql(advisory.ENGLISH_TEXT)} AS english_summary FROM heads)"""


def requests(spark, sf):
    def pick(words: list[str], modulus: int):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (c("point_no") % modulus + 1).cast("int"))

    return t.points(spark, sf).select("zone_id", "point_id", pick(CROPS, 7).alias("crop"), pick(STAGES, 5).alias("crop_stage"))


def soil(spark, sf, series):
    observed = series.groupBy(*features.POINT).agg(F.avg("soil_moisture_m3m3").alias("_m"))
    ground = t.points(spark, sf).select(*features.POINT, "elevation_m").withColumns(
        {x: F.lit(None).cast("double") for x in ("slope_magnitude_deg", "aspect_deg", "tpi_300m")}
    )
    return advisory.soil_context(ground.join(observed, features.POINT), "_m").select(*features.POINT, "soil_moisture_m3m3", "moisture_status")


def plans(spark, sf):
    series = t.series(spark, sf)
    return advisory.consultations(requests(spark, sf), series, soil(spark, sf, series), features.POINT, 96)


TEXTS = {
    "d12_verdict": "verdict_category:s summary_headline:s heat_stress_hours:i frost_risk:b spray_windows:i",
    "d13_irrigation_advice": "irrigation_advice:s mean_vpd_kpa:d",
    "d14_spray_recommendation": "spray_recommendation:s",
    "d15_crop_protection": "crop_specific_protection:s",
    "d16_summaries": "vernacular_hindi:s english_summary:s",
    "d17_consultation": "crop_key:s crop_stage:s common_name:s verdict_category:s summary_headline:s irrigation_advice:s spray_recommendation:s crop_specific_protection:s "
    "vernacular_hindi:s english_summary:s mean_vpd_kpa:d max_vpd_kpa:d gdd_accumulated_c_days:d heat_stress_hours:i spray_windows:i",
}
for _name, _columns in TEXTS.items():
    query(_name, f"zone_id:s point_id:s {_columns}", f"WITH {PLAN_SQL} SELECT * FROM plans")(plans)


@query("d18_chat_reply", "point_id:s reply:s",
       f"""WITH {PLAN_SQL} SELECT point_id, {fill_sql(advisory.REPLY_LEAD)} || chr(10) || chr(10) || '• Irrigation: ' || irrigation_advice || chr(10) || '• Spray Timing: ' || spray_recommendation
       || chr(10) || '• Crop Protection: ' || crop_specific_protection AS reply FROM plans""")
def _(spark, sf):
    return advisory.reply(plans(spark, sf))
