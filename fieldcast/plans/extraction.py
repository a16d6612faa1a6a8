"""Structured values out of bulletin text, and validation of extractions made elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.text import fingerprint, real_warnings, strip, unfence
from fieldcast.operators.quality import extraction_checks, with_errors
from fieldcast.schemas import EXTRACTION

# --- fixed values: what is looked for in the text ------------------------------------------
NUMBER = r"(-?\d+(?:\.\d+)?)"
SPAN = rf"{NUMBER}(?:\s*(?:-|–|to)\s*{NUMBER})?"
MIN_TEMP = rf"(?i)\bmin(?:imum)?\.?(?:\s+temp(?:erature)?s?)?\s*[:=]?\s*{SPAN}\s*(?:°|deg)?\s*C\b"
MAX_TEMP = rf"(?i)\bmax(?:imum)?\.?(?:\s+temp(?:erature)?s?)?\s*[:=]?\s*{SPAN}\s*(?:°|deg)?\s*C\b"
ANY_TEMP = rf"(?i)\btemperatures?\s*[:=]?\s*{NUMBER}\s*(?:-|–|to)\s*{NUMBER}\s*(?:°|deg)?\s*C\b"
RAIN = r"(?i)(\d+(?:\.\d+)?)(?:\s*(?:mm)?\s*(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*mm\b"
DRY = r"(?i)(\bdry weather\b|\brain(?:fall)?\s*[:=]\s*(?:nil|none|dry)\b)"
RAIN_WORDS = (
    r"(?i)\b((?:extremely heavy|very heavy|moderate to heavy|light to moderate|heavy|moderate|light|isolated|scattered)"
    r"\s+(?:rainfall|rains?|showers?|downpour))\b"
)
WIND = r"(?i)(\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*km(?:/h|ph|/hr)\b"
DIRECTION = (
    r"\b((?:[Nn]orth|[Ss]outh|[Ee]ast|[Ww]est)(?:[- ]?(?:[Ee]ast|[Ww]est))?(?:erly)|NNE|ENE|ESE|SSE|SSW|WSW|WNW|NNW|NE|SE|SW|NW)\b"
)
DISTRICT = r"(?i)\bdistrict\s*:\s*([a-z]+)"
VALID = r"(?i)\bvalid\s*(?:from)?\s*:?\s*(\d{2}-\d{2}-\d{4})\s*(?:to|till|until)\s*(\d{2}-\d{2}-\d{4})"
CONDITION = r"(?im)^\s*(?:observed\s+)?(?:weather|sky)\s*:\s*([^.\n]+)"
WARNING = r"(?im)^\s*warnings?(?:\s+\d+)?\s*:\s*([^\n]+)$"
ADVICE = r"(?im)^\s*(?:crop\s+)?advis(?:ory|ories)\s*:\s*([^\n]+)$"


def _numbers(text: Column, pattern: str) -> Column:
    """Every number of either group, as an array of doubles. The text is searched once; the groups are read off the short matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.transform(found, lambda m: F.array(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))
    return F.array_compact(F.transform(F.flatten(both), lambda v: v.try_cast("double")))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def _found(text: Column) -> dict[str, Column]:
    """What several values are drawn from, so that each pattern runs over the text once."""
    return {
        "_span": _numbers(text, ANY_TEMP),
        "_low": _numbers(text, MIN_TEMP),
        "_high": _numbers(text, MAX_TEMP),
        "_rain": _numbers(text, RAIN),
        "_dry": text.rlike(DRY),
    }


def _values(text: Column) -> dict[str, Column]:
    """Lowest minimum, highest maximum, rain range or wording, strongest wind, warnings, advice.

    What the text does not say stays null.
    """
    span, rain, dry = F.col("_span"), F.col("_rain"), F.col("_dry")
    zero = F.when(dry, F.lit(0.0))
    warnings = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(WARNING), F.lit(1)), lambda w: F.split(w, r"\s*,\s*"))
    )
    return {
        "district": F.initcap(_first(text, DISTRICT)),
        "valid_from": _first(text, VALID, 1),
        "valid_to": _first(text, VALID, 2),
        "min_temp_c": F.coalesce(F.array_min("_low"), F.array_min(span)),
        "max_temp_c": F.coalesce(F.array_max("_high"), F.array_max(span)),
        "rainfall_min_mm": F.coalesce(F.array_min(rain), zero),
        "rainfall_max_mm": F.coalesce(F.array_max(rain), zero),
        "rainfall_qualifier": F.when((F.size(rain) == 0) & ~dry, _first(text, RAIN_WORDS)),
        "wind_speed_kmh": F.array_max(_numbers(text, WIND)),
        "wind_direction": _first(text, DIRECTION),
        "weather_condition": _first(text, CONDITION),
        "warnings": real_warnings(warnings),
        "advisory_text": _first(text, ADVICE),
    }


def extract_bulletins(bulletins: DataFrame, text: str = "raw_text") -> DataFrame:
    """Extraction plus fingerprint and the list of failed checks."""
    found = _found(F.col(text))
    rows = bulletins.withColumns(found).withColumns(_values(F.col(text))).drop(*found)
    rows = rows.withColumn("source_hash", fingerprint(F.col(text)))
    return with_errors(rows, extraction_checks())


def validate_extractions(replies: DataFrame, reply: str = "reply", text: str = "raw_text") -> DataFrame:
    """Parse extraction JSON (fenced or not), add provenance, check it; malformed JSON is an error."""
    parsed = F.from_json(unfence(F.col(reply)), EXTRACTION, {"mode": "PERMISSIVE"})
    # In permissive mode broken text gives a record of nulls, so the shape is tested apart.
    sound = F.get_json_object(unfence(F.col(reply)), "$").isNotNull()
    rows = replies.withColumns({"_p": parsed, "_sound": sound}).select(
        *replies.columns, "_sound", "_p.*"
    )
    rows = rows.withColumns(
        {"warnings": real_warnings(F.col("warnings")), "source_hash": fingerprint(F.col(text))}
    )
    checks = [F.when(~F.col("_sound"), F.lit("malformed JSON")), *extraction_checks()]
    return with_errors(rows, checks).drop("_sound")
