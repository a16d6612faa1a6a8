"""Text helpers shared by bulletins, lookups and advisories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcast import catalogs


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals; rounding comes first so that ties go up."""
    return F.format_string(f"%.{digits}f", F.round(value + 1e-7, digits))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(strip(text), 256), 1, 16)


def title_case(text: Column) -> Column:
    """Trim and capitalise each word (words end at blanks)."""
    return F.initcap(strip(text))


def zone_key(text: Column) -> Column:
    """Normalise `14`, `acz_14` and `ACZ_14` to `ACZ_14`."""
    upper = F.upper(strip(text))
    return (
        F.when(upper.startswith("ACZ_"), upper)
        .when(upper.rlike(r"^[0-9]+$"), F.concat(F.lit("ACZ_"), F.format_string("%02d", upper.try_cast("bigint"))))
        .otherwise(F.concat(F.lit("ACZ_"), upper))
    )


def unfence(text: Column) -> Column:
    """The inside of a Markdown code fence; text without one comes back trimmed."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return strip(F.when(text.contains("```"), body).otherwise(text))


def real_warnings(warnings: Column) -> Column:
    """Trimmed warnings without blanks and without phrases that mean "none"."""
    trimmed = F.transform(F.coalesce(warnings, F.array().cast("array<string>")), strip)
    idle = [F.lit(p) for p in catalogs.NO_WARNING_PHRASES]
    return F.filter(trimmed, lambda w: w.isNotNull() & (w != "") & ~F.lower(w).isin(*idle))


def instant(text: Column) -> Column:
    """ISO time, `Z` or offset or neither (then UTC); text that is no time gives null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def clock(timestamp: Column) -> Column:
    return F.date_format(timestamp, "HH:mm")
