"""Crop stress indices, whole and by part."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import indices
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.registry.scalar_queries import vpd
from fieldcast.registry.window_queries import KEY, RUNS_SQL

c = F.col

STRESS_SQL = f"""{t.SERIES_SQL},
numbered AS (SELECT *, (row_number() OVER (PARTITION BY zone_id, point_id ORDER BY timestamp) - 1) // 24 AS chunk,
  {vpd('downscaled_temp_1km_c', 'relative_humidity_pct', '0.0e0')} AS vpd, baseline_temp_c - downscaled_temp_1km_c AS gap FROM series),
gdd AS (SELECT zone_id, point_id, sum(g) AS gdd_accumulated_c_days FROM (SELECT zone_id, point_id, chunk,
  greatest(0.0e0, (max(downscaled_temp_1km_c) + min(downscaled_temp_1km_c)) / 2 - {{base}}) AS g FROM numbered GROUP BY 1, 2, 3) GROUP BY 1, 2),
stress AS (SELECT zone_id, point_id, count(*) AS hours, avg(vpd) AS mean_vpd_kpa, max(vpd) AS max_vpd_kpa, count(*) FILTER (gap > 0.4e0) >= 3 AS thermal_inversion_risk,
  coalesce(avg(gap) FILTER (gap > 0.4e0), 0) AS inversion_strength_c, min(downscaled_temp_1km_c) <= 2 AS frost_risk,
  count(*) FILTER (downscaled_temp_1km_c > {{limit}}) AS heat_stress_hours FROM numbered GROUP BY 1, 2)"""
DEFAULT_STRESS = STRESS_SQL.format(base="10", limit="38")

WINDOWS_SQL = """spray AS (SELECT zone_id, point_id, window_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS duration_hours,
  avg(suitability) AS suitability_score FROM islands WHERE good GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
FIRST_SQL = """first_window AS (SELECT zone_id, point_id, count(*) AS spray_windows, min(start_time) AS first_window_start, arg_min(end_time, start_time) AS first_window_end,
  arg_min(duration_hours, start_time) AS first_window_hours, arg_min(suitability_score, start_time) AS first_window_score FROM spray GROUP BY 1, 2)"""


def stress_query(name: str, columns: str):
    return query(name, f"point_id:s {columns}", f"WITH {DEFAULT_STRESS} SELECT * FROM stress JOIN gdd USING (zone_id, point_id)")


def stress(spark, sf):
    return indices.stress_indices(t.series(spark, sf), KEY)


for _name, _columns in {
    "a11_mean_and_peak_vpd": "mean_vpd_kpa:d max_vpd_kpa:d",
    "a12_heat_hours": "hours:i heat_stress_hours:i",
    "a13_inversion": "thermal_inversion_risk:b inversion_strength_c:d",
    "a14_frost_flag": "frost_risk:b",
    "a15_degree_days": "gdd_accumulated_c_days:d",
}.items():
    stress_query(_name, _columns)(stress)


@query("a16_spray_windows", "point_id:s start_time:t end_time:t duration_hours:i suitability_score:d", f"WITH {RUNS_SQL}, {WINDOWS_SQL} SELECT * FROM spray")
def _(spark, sf):
    return indices.spray_windows(t.series(spark, sf), KEY)


@query("t4_earliest_window", "point_id:s spray_windows:i first_window_start:t first_window_end:t first_window_hours:i first_window_score:d",
       f"WITH {RUNS_SQL}, {WINDOWS_SQL}, {FIRST_SQL} SELECT * FROM first_window")
def _(spark, sf):
    return indices.earliest_windows(indices.spray_windows(t.series(spark, sf), KEY), KEY)


REPORT = (
    "hours:i mean_vpd_kpa:d max_vpd_kpa:d thermal_inversion_risk:b inversion_strength_c:d frost_risk:b gdd_accumulated_c_days:d "
    "heat_stress_hours:i spray_windows:i first_window_start:t first_window_hours:d first_window_score:d"
)


def report_sql(stress_ctes: str) -> str:
    """The report needs both the stress and the window expressions over one series."""
    extra = RUNS_SQL[len(t.SERIES_SQL):]
    return f"WITH {stress_ctes}{extra}, {WINDOWS_SQL}, {FIRST_SQL}"


@query("d9_stress_indices", f"zone_id:s point_id:s {REPORT}",
       f"""{report_sql(DEFAULT_STRESS)} SELECT stress.*, gdd_accumulated_c_days, coalesce(spray_windows, 0) AS spray_windows, first_window_start, first_window_hours,
       first_window_score FROM stress JOIN gdd USING (zone_id, point_id) LEFT JOIN first_window USING (zone_id, point_id)""")
def _(spark, sf):
    return indices.indices(t.series(spark, sf), KEY)
