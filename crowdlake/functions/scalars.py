"""Scalar Column expressions: parsing, unit conversion, time zones.

Every function returns a native Spark Column (no Python UDF), so each one
stays inside whole-stage code generation. Spark 4 runs in ANSI mode, so text
is always converted with ``try_*`` forms: bad input becomes NULL instead of
failing the job, matching the reference's ``errors="coerce"`` behaviour.

Convention for instants: an instant is carried as TIMESTAMP_NTZ holding the
UTC wall clock ("UTC-NTZ"). Converting to and from it with
``convert_timezone`` / ``unix_micros`` never depends on the session zone, so
results are identical on every cluster configuration.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "Europe/Amsterdam"
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# time
# --------------------------------------------------------------------------

def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive ``datetime`` or ISO text, independent of any zone.

    ``F.lit(datetime)`` would build a session-zone TIMESTAMP and shift
    comparisons against wall-clock columns when the session zone is not UTC.
    """
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def instant_to_utc_ntz(c) -> Column:
    """TIMESTAMP (instant) -> UTC wall clock as TIMESTAMP_NTZ, session-zone free."""
    return _instant_to_utc_ntz(_c(c))


def _instant_to_utc_ntz(c: Column) -> Column:
    micros = F.unix_micros(c)
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH_NTZ))


def utc_ntz_to_instant(c) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) -> TIMESTAMP instant, session-zone free."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(c))
    return F.timestamp_micros(micros)


# An ISO-8601 date-time that ends in a zone (Z, +HH, +HHMM, +HH:MM).
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)$"


def parse_iso_utc(c, dtype: str | None = None) -> Column:
    """ISO text with or without fraction / offset -> UTC-NTZ; bad text -> NULL.

    Zoned text is cast to an instant (Spark's cast accepts ``Z``, ``+HH``,
    ``+HHMM`` and ``+HH:MM``); text without a zone is read as UTC wall clock,
    like pandas' ``utc=True``, whatever the session zone. Already-typed
    columns pass through: TIMESTAMP is converted to UTC-NTZ, TIMESTAMP_NTZ is
    taken as UTC wall clock.
    """
    c = _c(c)
    if dtype in ("timestamp", "timestamp_ltz"):
        return _instant_to_utc_ntz(c)
    if dtype == "timestamp_ntz":
        return c
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(_ZONED), _instant_to_utc_ntz(s.try_cast("timestamp"))).otherwise(
        s.try_cast("timestamp_ntz"))


def to_local_time(utc_ntz, tz: str = LOCAL_TZ) -> Column:
    """UTC wall clock -> local wall clock (both TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(utc_ntz))


def drop_tz(utc_ntz, tz: str = LOCAL_TZ) -> Column:
    """Remove the offset keeping the local wall clock (pandas ``tz_localize(None)``)."""
    return to_local_time(utc_ntz, tz)


def frame_floor(ts, minutes: int = 3) -> Column:
    """Floor a wall clock to the start of its ``minutes`` frame (epoch aligned)."""
    ts = _c(ts)
    epoch = F.expr(_EPOCH_NTZ)
    secs = F.timestamp_diff("SECOND", epoch, ts)
    width = minutes * 60
    return F.timestamp_add("SECOND", secs - F.pmod(secs, F.lit(width)), epoch)


def localize(local_ntz, tz: str = LOCAL_TZ) -> tuple[Column, Column]:
    """Naive local wall clock -> (UTC-NTZ, ambiguous flag).

    Nonexistent wall times (spring-forward gap) are shifted forward to the end
    of the gap, as pandas ``nonexistent='shift_forward'`` does; European gaps
    are one hour long and start on the hour. Ambiguous wall times (autumn
    overlap) take the earlier instant and are flagged.
    """
    local = _c(local_ntz)
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), local)
    back = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    in_gap = back != local
    gap_end_local = F.timestamp_add("HOUR", F.lit(1), F.date_trunc("hour", local))
    utc_fixed = F.when(in_gap, F.convert_timezone(F.lit(tz), F.lit("UTC"), gap_end_local)).otherwise(utc)
    later = F.timestamp_add("HOUR", F.lit(1), utc_fixed)
    earlier = F.timestamp_add("HOUR", F.lit(-1), utc_fixed)
    ambiguous = (~in_gap) & (
        (F.convert_timezone(F.lit("UTC"), F.lit(tz), later) == local)
        | (F.convert_timezone(F.lit("UTC"), F.lit(tz), earlier) == local))
    return utc_fixed, ambiguous


def hour24_fix(yyyymmdd, hh) -> Column:
    """Station date + hour 1..24 -> TIMESTAMP_NTZ; hour 24 is 00:00 the next day."""
    text = F.lpad(_c(yyyymmdd).cast("string"), 8, "0")
    iso = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).try_cast("timestamp_ntz")
    return F.timestamp_add("HOUR", _c(hh).try_cast("int"), day)


def parse_date_ampm(date_col, time_col) -> Column:
    """``dd/MM/yy`` + ``h:mm AM`` text -> TIMESTAMP_NTZ, bad -> NULL; no session time zone takes part."""
    txt = F.concat_ws(" ", _c(date_col), _c(time_col))
    form = r"^(\d{2})/(\d{2})/(\d{2}) (\d{1,2}):(\d{2}) ([AaPp])[Mm]$"
    part = lambda i: F.regexp_extract(txt, form, i)
    hour = part(4).try_cast("int")
    hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part(6)) == "p", 12).otherwise(0))
    iso = F.concat(F.lit("20"), part(3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(5), F.lit(":00"))
    return F.when(txt.rlike(form), iso).try_cast("timestamp_ntz")


def calendar_features(ts) -> dict[str, Column]:
    """Hour, day of week (Monday = 0), weekend flag and the daily sine / cosine."""
    ts = _c(ts)
    hour = F.hour(ts)
    dow = F.weekday(ts)
    angle = F.lit(2 * math.pi) * hour / F.lit(24.0)
    return {
        "hour": hour,
        "minute": F.minute(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "weekday": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "time_sin": F.sin(angle),
        "time_cos": F.cos(angle),
    }


# --------------------------------------------------------------------------
# numbers and text
# --------------------------------------------------------------------------

def decimal_comma(c) -> Column:
    """``"6,7"`` -> 6.7; blanks removed; unparseable -> NULL."""
    return F.translate(_c(c).cast("string"), ", ", ".").try_cast("double")


def split_lat_lon(c) -> tuple[Column, Column]:
    """``"52.37, 4.89"`` -> (lat, lon) doubles."""
    parts = F.split(_c(c), ",")
    lat = F.trim(F.get(parts, 0)).try_cast("double")
    lon = F.trim(F.get(parts, 1)).try_cast("double")
    return lat, lon


# Station columns are stored in tenths of their unit.
TENTHS_COLUMNS = [
    ("temperature", "T"),
    ("dew_point", "TD"),
    ("air_pressure", "P"),
    ("wind_speed", "FF"),
    ("max_gust", "FX"),
    ("rainfall", "RH"),
    ("sunshine_duration", "SQ"),
]


def tenths_to_units(fix: bool = False) -> list[Column]:
    """Station tenths -> units; ``U`` copied. ``fix`` maps the -1 sentinel of RH/SQ to 0."""
    cols = []
    for name, src in TENTHS_COLUMNS:
        raw = F.col(src)
        if fix and src in ("RH", "SQ"):
            raw = F.when(raw == -1, F.lit(0)).otherwise(raw)
        cols.append((raw / F.lit(10.0)).alias(name))
    cols.append(F.col("U").cast("int").alias("relative_humidity"))
    return cols


# Imperial -> metric factors.
MPH_TO_MS = 0.44704
INHG_TO_HPA = 33.8639
INCH_TO_MM = 25.4


def fahrenheit_to_celsius(c) -> Column:
    return (_c(c) - F.lit(32)) * F.lit(5) / F.lit(9)


def imperial_to_metric() -> dict[str, Column]:
    return {
        "temperature": fahrenheit_to_celsius("temperature"),
        "dew_point": fahrenheit_to_celsius("dew_point"),
        "wind_speed": F.col("wind_speed") * F.lit(MPH_TO_MS),
        "wind_gust": F.col("wind_gust") * F.lit(MPH_TO_MS),
        "pressure": F.col("pressure") * F.lit(INHG_TO_HPA),
        "precipitation": F.col("precipitation") * F.lit(INCH_TO_MM),
    }


def clean_text(c) -> Column:
    """Remove non-ASCII runs, then strip surrounding whitespace."""
    no_ascii = F.regexp_replace(_c(c), r"[^\x00-\x7F]+", "")
    return F.regexp_replace(no_ascii, r"^\s+|\s+$", "")


_NUMBER = r"[-+]?\d*\.?\d+"


def extract_number(c) -> Column:
    """First signed number in the text as DOUBLE, else NULL."""
    return F.regexp_extract(_c(c), _NUMBER, 0).try_cast("double")


def normalize_header(name: str) -> str:
    """Header names: strip, lower case, blanks to ``_`` (no-break spaces included)."""
    return name.replace("﻿", "").replace(" ", " ").strip().lower().replace(" ", "_")


def crowd_flow(count, width) -> Column:
    """People per metre of width per minute over a 3-minute count: int(count)/width/3."""
    return _c(count).cast("bigint") / _c(width) / F.lit(3.0)


def whole_number(text: Column) -> Column:
    """Text -> BIGINT, exact for whole numbers; a number with a fraction or exponent loses its fraction, other text is NULL."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def id_text(c) -> Column:
    """An id as text: a number written with a zero fraction or as a large double loses that form, other text is unchanged
    (``12.0`` -> ``"12"``, ``0012`` and ``1e3`` stay)."""
    text = _c(c).cast("string")
    return (F.when(text.rlike(r"^[+-]?\d+\.\d+$"), F.regexp_replace(text, r"\..*$", ""))
            .when(text.rlike(r"^-?\d\.\d+E\d+$"), F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text))
            .otherwise(text))


def fixed_text(x: Column, digits: int) -> Column:
    """Fixed-point text rounded like Python's ``f"{x:.{digits}f}"``.

    ``DecimalFormat`` (behind ``format_number`` with a pattern) rounds the
    exact binary value half-even, as Python does; ``format_string('%.nf')``
    would round the shortest decimal text half-up and differ on ties.
    """
    pattern = "0." + "0" * digits if digits > 0 else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def vessel_label(id_col, local_ts, lon, lat, speed_cm_s) -> Column:
    """Tooltip text: id, local time, lon/lat to 5 digits, speed in m/s or ``n/a``."""
    spd = F.when(_c(speed_cm_s).isNotNull(),
                 F.concat(fixed_text(_c(speed_cm_s) / F.lit(100.0), 2), F.lit(" m/s"))
                 ).otherwise(F.lit("n/a"))
    return F.concat(
        F.lit("ID: "), _c(id_col).cast("string"),
        F.lit("<br/>Time: "), F.date_format(_c(local_ts), "yyyy-MM-dd HH:mm:ss"),
        F.lit("<br/>Lon: "), fixed_text(_c(lon), 5),
        F.lit("<br/>Lat: "), fixed_text(_c(lat), 5),
        F.lit("<br/>Speed: "), spd,
    )


# Published polynomial approximation from the Dutch national
# grid (RD) to WGS84 degrees. a = (x - 155000) * 1e-5, b = (y - 463000) * 1e-5;
# each term is coefficient * a**p * b**q, the sums are divided by 3600.
RD_X0, RD_Y0 = 155000.0, 463000.0
RD_LAT0, RD_LON0 = 52.15517440, 5.38720621
RD_LAT_TERMS = [
    (0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978),
    (0, 3, -0.06550), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530),
    (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012),
]
RD_LON_TERMS = [
    (1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885),
    (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256),
    (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026),
]


def _ipow(x: Column, p: int) -> Column:
    out = F.lit(1.0)
    for _ in range(p):
        out = out * x
    return out


def rd_to_lonlat(x, y) -> tuple[Column, Column]:
    """Dutch grid metres -> (lon, lat) degrees as native arithmetic (products, no pow)."""
    a = (_c(x) - F.lit(RD_X0)) * F.lit(1e-5)
    b = (_c(y) - F.lit(RD_Y0)) * F.lit(1e-5)

    def poly(terms):
        total = F.lit(0.0)
        for p, q, coef in terms:
            total = total + F.lit(coef) * _ipow(a, p) * _ipow(b, q)
        return total

    lat = F.lit(RD_LAT0) + poly(RD_LAT_TERMS) / F.lit(3600.0)
    lon = F.lit(RD_LON0) + poly(RD_LON_TERMS) / F.lit(3600.0)
    return lon, lat
