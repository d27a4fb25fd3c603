"""DuckDB oracle SQL for the registered queries.

Each entry recomputes the query from the driver's tables with plain SQL
(window functions, range joins, list functions), independently of the Spark
operator code. Output column names and rounding match the Spark side.
"""

from __future__ import annotations

from crowdlake.functions.scalars import RD_LAT0, RD_LAT_TERMS, RD_LON0, RD_LON_TERMS, RD_X0, RD_Y0
from crowdlake.plans import queries as Q
from crowdlake.plans.standins import SQL as SI_SQL
from crowdlake.plans.standins import WIDE_SENSORS

ORACLE: dict[str, str] = {}

_CTE = dict(SI_SQL)
_CTE["ploc"] = """ploc AS (
  SELECT sensor, sensor_id_full, direction, name, width_txt, latlon_txt,
         TRY_CAST(replace(replace(width_txt, ',', '.'), ' ', '') AS DOUBLE) AS width,
         TRY_CAST(trim(split_part(latlon_txt, ',', 1)) AS DOUBLE) AS lat,
         TRY_CAST(trim(split_part(latlon_txt, ',', 2)) AS DOUBLE) AS lon
  FROM locations)"""
_CTE["flow"] = """flow AS (
  SELECT r.ts, r.sensor, r.event_id, r."count", l.width,
         CASE WHEN l.sensor IS NULL THEN 0.0
              ELSE CAST(trunc(r."count") AS BIGINT) / l.width / 3.0 END AS flow
  FROM readings r LEFT JOIN ploc l ON r.sensor = l.sensor)"""
_CTE["station_clean"] = """station_clean AS (
  SELECT strptime(CAST(YYYYMMDD AS VARCHAR), '%Y%m%d') + to_hours(HH) AS datetime,
         T / 10.0 AS temperature, TD / 10.0 AS dew_point, P / 10.0 AS air_pressure,
         FF / 10.0 AS wind_speed, FX / 10.0 AS max_gust, RH / 10.0 AS rainfall,
         SQ / 10.0 AS sunshine_duration, CAST(U AS INTEGER) AS relative_humidity
  FROM station_hourly)"""

_CLEAN = "regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F]+', '', 'g'), '^\\s+|\\s+$', '', 'g')"
_NUM = "TRY_CAST(regexp_extract({x}, '[-+]?\\d*\\.?\\d+') AS DOUBLE)"


def clean(x):
    return _CLEAN.format(x=x)


def num(x):
    return _NUM.format(x=x)


_NUM_COLS = ["temperature", "dew_point", "humidity", "wind_speed", "wind_gust", "pressure", "precip."]
_CTE["wt_num"] = "wt_num AS (\n  SELECT event_id, TRY_STRPTIME(\"date\" || ' ' || \"time\", '%d/%m/%y %I:%M %p') AS \"timestamp\",\n" + \
    ",\n".join(f'         {num(clean(chr(34) + c + chr(34)))} AS "{c}"' for c in _NUM_COLS) + \
    f",\n         {clean('condition')} AS condition\n  FROM weather_text)"


def _carflow_flat_sql(keep_first_pair: bool, name: str) -> str:
    unq = "regexp_replace({x}, '^\"(.*)\"$', '\\1')"

    def u(x):
        return unq.format(x=x)

    first_pair = (f"""
  UNION ALL
  SELECT time_raw, hdr[1], hdr[2] FROM {name}_h WHERE first_line <> '' AND NOT labelled AND len(hdr) = 2"""
                  if keep_first_pair else "")
    if keep_first_pair:
        parts = ("CASE WHEN strpos(replace(data, chr(10), ''), ',') > 0 THEN string_split(replace(data, chr(10), ''), ',') "
                 "ELSE string_split(replace(data, chr(10), ''), ';') END")
    else:
        parts = "string_split(data, ',')"
    return f"""{name}_l AS (
  SELECT "time" AS time_raw, data, string_split_regex(data, '\\r?\\n') AS ls
  FROM carflow_raw WHERE data IS NOT NULL AND data <> ''),
{name}_h0 AS (
  SELECT *, ls[1] AS first_line,
         CASE WHEN strpos(ls[1], ',') = 0 AND strpos(ls[1], ';') > 0 THEN ';' ELSE ',' END AS sep
  FROM {name}_l),
{name}_h1 AS (
  SELECT *, list_transform(string_split(first_line, sep), lambda h: lower(trim({u('h')}))) AS hdr FROM {name}_h0),
{name}_h AS (
  SELECT *, coalesce(list_position(hdr, 'id'), 0) AS idp, coalesce(list_position(hdr, 'traffic_level'), 0) AS tlp,
         (coalesce(list_position(hdr, 'id'), 0) > 0 AND coalesce(list_position(hdr, 'traffic_level'), 0) > 0) AS labelled
  FROM {name}_h1),
{name}_b AS (
  SELECT time_raw, idp, tlp, labelled, string_split(line, sep) AS toks
  FROM (SELECT *, unnest(ls[2:]) AS line FROM {name}_h WHERE first_line <> '')),
{name}_p AS (
  SELECT time_raw, {u('toks[idp]')} AS id_raw, {u('toks[tlp]')} AS level_raw
  FROM {name}_b WHERE labelled AND len(toks) >= greatest(idp, tlp)
  UNION ALL
  SELECT time_raw, {u('toks[1]')}, {u('toks[2]')} FROM {name}_b WHERE NOT labelled AND len(toks) >= 2{first_pair}
  UNION ALL
  SELECT time_raw, trim(parts[1]), trim(parts[2])
  FROM (SELECT time_raw, {parts} AS parts FROM {name}_h WHERE first_line = '') WHERE len(parts) = 2),
{name} AS (
  SELECT timezone('UTC', TRY_CAST(time_raw AS TIMESTAMPTZ)) AS time_utc,
         CASE WHEN regexp_full_match(trim(id_raw), '[+-]?[0-9]+') THEN TRY_CAST(trim(id_raw) AS BIGINT)
              ELSE CAST(trunc(TRY_CAST(trim(id_raw) AS DOUBLE)) AS BIGINT) END AS id,
         TRY_CAST(trim(level_raw) AS DOUBLE) AS traffic_level
  FROM {name}_p
  WHERE TRY_CAST(time_raw AS TIMESTAMPTZ) IS NOT NULL
    AND TRY_CAST(trim(id_raw) AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(trim(id_raw) AS DOUBLE))
    AND TRY_CAST(trim(level_raw) AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(trim(level_raw) AS DOUBLE)))"""


_CTE["cf"] = _carflow_flat_sql(True, "cf")
_CTE["cfs"] = _carflow_flat_sql(False, "cfs")
_CTE["frames"] = """frames AS (
  SELECT time_utc, id, traffic_level,
         timezone('Europe/Amsterdam', timezone('UTC', time_utc)) AS time_local,
         time_bucket(INTERVAL 3 MINUTE, timezone('Europe/Amsterdam', timezone('UTC', time_utc))) AS frame_time,
         CAST(id AS VARCHAR) AS id_str
  FROM cf)"""
_CTE["res3"] = """res3 AS (
  SELECT id_str, time_bucket(INTERVAL 3 MINUTE, time_local) AS time_local, avg(traffic_level) AS traffic_level
  FROM frames GROUP BY 1, 2)"""
_CTE["seg"] = """seg AS (
  SELECT frame_time, id_str, avg(traffic_level) AS mean_level FROM frames GROUP BY 1, 2)"""


def _feat_sql(lags, wins, name="feat"):
    cols = [f'lag("count", {k}) OVER w AS lag_{k}' for k in lags]
    cols += [f'CASE WHEN count("count") OVER w{n} = {n} THEN avg("count") OVER w{n} END AS roll_mean_{n}' for n in wins]
    windows = ["w AS (PARTITION BY sensor ORDER BY ts, event_id)"]
    windows += [f"w{n} AS (PARTITION BY sensor ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                for n in wins]
    return (f"{name} AS (\n  SELECT ts, sensor, event_id, \"count\", CAST(hour(ts) AS INTEGER) AS hour, "
            "CAST(minute(ts) AS INTEGER) AS minute, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month, "
            f"CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,\n    "
            + ",\n    ".join(cols) + "\n  FROM readings\n  WINDOW " + ",\n    ".join(windows) + ")")


_FEAT_COLS = [f"lag_{k}" for k in Q.LAGS] + [f"roll_mean_{n}" for n in Q.ROLLING]
_CTE["feat"] = _feat_sql(Q.LAGS, Q.ROLLING)
_CTE["featd"] = "featd AS (SELECT * FROM feat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _FEAT_COLS) + ")"
_CTE["scored"] = """scored AS (SELECT sensor, ts, "count", lag_1 AS pred FROM featd)"""
_CTE["r2t"] = """r2m AS (SELECT sensor, avg("count") AS m FROM scored GROUP BY sensor),
r2t AS (
  SELECT s.sensor,
         CASE WHEN sum((s."count" - m.m) * (s."count" - m.m)) <> 0
              THEN 1.0 - sum((s."count" - s.pred) * (s."count" - s.pred)) / sum((s."count" - m.m) * (s."count" - m.m))
              ELSE 0.0 END AS r2,
         avg(abs(s."count" - s.pred)) AS mae, count(*) AS n
  FROM scored s JOIN r2m m USING (sensor) GROUP BY s.sensor)"""
_CTE["latest_counts"] = """latest_counts AS (
  SELECT sensor, ts, event_id, "count" FROM readings
  QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY ts DESC, event_id DESC) = 1)"""
_CTE["latest_vessels"] = """latest_vessels AS (
  SELECT * FROM vessels
  QUALIFY row_number() OVER (PARTITION BY id_str ORDER BY time_utc DESC, event_id DESC) = 1)"""
_CTE["roads_f"] = """roads_f AS (
  SELECT s_suppkey AS feature_id, CAST(s_suppkey AS VARCHAR) AS rid_str,
         '4.' || CAST(800 + s_suppkey % 200 AS VARCHAR) AS lon_txt, '52.' || CAST(300 + s_nationkey AS VARCHAR) AS lat_txt
  FROM supplier)"""
_CTE["wide_long"] = "wide_long AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT hour, '{s}' AS sensor, {s} AS value FROM readings_wide" for s in WIDE_SENSORS) + ")"

_DEPS = {
    "flow": ["readings", "locations", "ploc"],
    "ploc": ["locations"],
    "station_clean": ["station_hourly"],
    "wt_num": ["weather_text"],
    "cf": ["carflow_raw"],
    "cfs": ["carflow_raw"],
    "carflow_raw": [],
    "frames": ["cf"],
    "res3": ["frames"],
    "seg": ["frames"],
    "feat": ["readings"],
    "featd": ["feat"],
    "scored": ["featd"],
    "r2t": ["scored"],
    "latest_counts": ["readings"],
    "latest_vessels": ["vessels"],
    "wide_long": ["readings_wide"],
}


def W(*names: str) -> str:
    """``WITH`` clause holding the named CTEs and, first, everything they depend on."""
    order: list[str] = []

    def add(n):
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(_CTE[n] for n in order) + "\n"


def o(name):
    def deco(sql):
        ORACLE[name] = sql
    return deco


# ---------------------------------------------------------------------------
# 2.2 flattening and reshaping
# ---------------------------------------------------------------------------

ORACLE["flatten_carflow"] = W("cf") + "SELECT time_utc, id, traffic_level FROM cf"
ORACLE["flatten_carflow_strict"] = W("cfs") + "SELECT time_utc, id, traffic_level FROM cfs"
ORACLE["pack_carflow"] = W("cf") + """, spoilt AS (
  SELECT time_raw, (length(level_raw) + TRY_CAST(id_raw AS BIGINT)) % 7 AS k, id_raw, level_raw FROM cf_p),
texts AS (
  SELECT time_raw, CASE k WHEN 1 THEN id_raw || '.0' WHEN 2 THEN 'x' ELSE id_raw END AS i,
         CASE k WHEN 3 THEN 'n/a' WHEN 4 THEN ' ' || level_raw || ' ' ELSE level_raw END AS l FROM spoilt)
SELECT timezone('UTC', TRY_CAST(time_raw AS TIMESTAMPTZ)) AS time_utc, CAST(trunc(TRY_CAST(i AS DOUBLE)) AS BIGINT) AS id,
       TRY_CAST(trim(l) AS DOUBLE) AS traffic_level
FROM texts WHERE TRY_CAST(time_raw AS TIMESTAMPTZ) IS NOT NULL AND TRY_CAST(i AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(l) AS DOUBLE) IS NOT NULL"""


def _quoted_sql(keep_first_pair: bool) -> str:
    """Logical lines and fields by regular expressions over the text of a frame."""
    def line(c):
        return f"""regexp_extract_all(data || chr(10), '(?:"(?:[^"]|"")*"[^{c}\\n]*|[^{c}"\\n][^{c}\\n]*|{c})*\\n')"""

    def fields(c):
        return f"""regexp_extract_all(rtrim(line, chr(10)) || '{c}', '"(?:[^"]|"")*"[^{c}\\n]*{c}|[^{c}"\\n][^{c}\\n]*{c}|{c}')"""

    first = "\n  UNION ALL SELECT \"time\", is_semi, headed, ls[1] FROM ql WHERE NOT headed" if keep_first_pair else ""
    return f"""WITH {SI_SQL["carflow_quoted"]},
ql AS (SELECT "time", is_semi, headed, CASE WHEN is_semi THEN {line(";")} ELSE {line(",")} END AS ls FROM carflow_quoted),
qr AS (SELECT "time", is_semi, headed, unnest(ls[2:]) AS line FROM ql{first}),
qf AS (SELECT "time", headed, CASE WHEN is_semi THEN {fields(";")} ELSE {fields(",")} END AS t FROM qr),
qv AS (SELECT "time", regexp_replace(t[1], '^"?([^"]*)"?.$', '\\1') AS i, regexp_replace(t[CASE WHEN headed THEN 3 ELSE 2 END], '^"?([^"]*)"?.$', '\\1') AS l
       FROM qf WHERE len(t) >= CASE WHEN headed THEN 3 ELSE 2 END)
SELECT timezone('UTC', TRY_CAST("time" AS TIMESTAMPTZ)) AS time_utc, CAST(i AS BIGINT) AS id, CAST(l AS DOUBLE) AS traffic_level FROM qv"""


ORACLE["flatten_carflow_quoted"] = _quoted_sql(True)
ORACLE["flatten_carflow_quoted_strict"] = _quoted_sql(False)

_CAL = ("hour AS \"timestamp\", CAST(hour(hour) AS INTEGER) AS hour, CAST(minute(hour) AS INTEGER) AS minute, "
        "CAST(day(hour) AS INTEGER) AS day, CAST(month(hour) AS INTEGER) AS month, "
        "CAST(isodow(hour) - 1 AS INTEGER) AS weekday, CAST(CASE WHEN isodow(hour) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend")
ORACLE["melt_counts"] = W("readings_wide") + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {_CAL}, '{s}' AS sensor_id, round({s}, 6) AS \"count\" FROM readings_wide" for s in WIDE_SENSORS) + ")"
ORACLE["melt_with_features"] = W("readings_wide", "station_clean") + """, hw AS (
  SELECT date_trunc('hour', datetime) AS hour, avg(temperature) AS temperature, avg(air_pressure) AS air_pressure
  FROM station_clean GROUP BY 1)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT w.hour, round(hw.temperature, 6) AS temperature, round(hw.air_pressure, 6) AS air_pressure, "
    f"'{s}' AS location, round(w.{s}, 6) AS \"count\" FROM readings_wide w LEFT JOIN hw USING (hour)"
    for s in WIDE_SENSORS) + ")"
ORACLE["location_index"] = W("readings") + """SELECT r.sensor, r.ts, i.location_id FROM readings r
JOIN (SELECT sensor, CAST(row_number() OVER (ORDER BY sensor) - 1 AS INTEGER) AS location_id
      FROM (SELECT DISTINCT sensor FROM readings)) i USING (sensor)"""
ORACLE["latest_row_to_kv"] = W("wide_long") + """SELECT hour, sensor, round(value, 6) AS value FROM wide_long
WHERE hour = (SELECT max(hour) FROM readings_wide)"""
ORACLE["pivot_predictions"] = W("wide_long") + """, lp AS (
  SELECT hour, sensor, value AS actual, lag(value, 1) OVER (PARTITION BY sensor ORDER BY hour) AS pred FROM wide_long)
SELECT hour, """ + ", ".join(
    f"round(max(actual) FILTER (WHERE sensor = '{s}'), 6) AS {s}_actual, "
    f"round(max(pred) FILTER (WHERE sensor = '{s}'), 6) AS {s}_xgb_pred" for s in WIDE_SENSORS) + " FROM lp GROUP BY hour"
ORACLE["sensor_direction_split"] = W("locations") + """SELECT sensor_id_full, split_part(sensor_id_full, '_', 1) AS sensor_id,
  TRY_CAST(split_part(sensor_id_full, '_', 2) AS INTEGER) AS sensor_direction FROM locations"""

# ---------------------------------------------------------------------------
# 2.3 scalar functions
# ---------------------------------------------------------------------------

ORACLE["parse_iso_utc"] = W("carflow_raw") + """SELECT "time", timezone('UTC', TRY_CAST("time" AS TIMESTAMPTZ)) AS time_utc FROM carflow_raw"""
ORACLE["to_local_time"] = W("vessels") + """SELECT event_id, time_utc,
  timezone('Europe/Amsterdam', timezone('UTC', time_utc)) AS time_local FROM vessels"""
ORACLE["frame_floor"] = W("readings") + "SELECT event_id, ts, time_bucket(INTERVAL 3 MINUTE, ts) AS frame_time FROM readings"
ORACLE["drop_tz"] = W("vessels") + """SELECT event_id, timezone('Europe/Amsterdam', timezone('UTC', time_utc)) AS wall_clock FROM vessels"""
ORACLE["localize"] = W("readings") + """, u AS (
  SELECT event_id, ts, timezone('UTC', timezone('Europe/Amsterdam', ts)) AS u0 FROM readings),
g AS (
  SELECT *, timezone('Europe/Amsterdam', timezone('UTC', u0)) <> ts AS in_gap FROM u),
f AS (
  SELECT event_id, ts, in_gap,
         CASE WHEN in_gap THEN timezone('UTC', timezone('Europe/Amsterdam', date_trunc('hour', ts) + INTERVAL 1 HOUR))
              ELSE u0 END AS ts_utc FROM g)
SELECT event_id, ts, ts_utc,
  (NOT in_gap) AND (timezone('Europe/Amsterdam', timezone('UTC', ts_utc + INTERVAL 1 HOUR)) = ts
                    OR timezone('Europe/Amsterdam', timezone('UTC', ts_utc - INTERVAL 1 HOUR)) = ts) AS ambiguous
FROM f"""
ORACLE["decimal_comma"] = W("ploc") + "SELECT sensor, width_txt, width FROM ploc"
ORACLE["split_lat_lon"] = W("ploc") + "SELECT sensor, lat, lon FROM ploc"
ORACLE["hour24_fix"] = W("station_hourly") + """SELECT YYYYMMDD, HH,
  strptime(CAST(YYYYMMDD AS VARCHAR), '%Y%m%d') + to_hours(HH) AS datetime FROM station_hourly"""
ORACLE["tenths_to_units"] = W("station_clean") + "SELECT * FROM station_clean"
ORACLE["imperial_to_metric"] = W("wt_num") + """SELECT event_id,
  (temperature - 32) * 5 / 9 AS temperature, (dew_point - 32) * 5 / 9 AS dew_point,
  wind_speed * 0.44704 AS wind_speed, wind_gust * 0.44704 AS wind_gust,
  pressure * 33.8639 AS pressure, "precip." * 25.4 AS precipitation FROM wt_num"""
ORACLE["clean_text"] = W("weather_text") + f"""SELECT event_id, {clean('temperature')} AS temperature,
  {clean('humidity')} AS humidity, {clean('condition')} AS condition FROM weather_text"""
ORACLE["extract_number"] = W("weather_text") + f"""SELECT event_id, {num('wind_speed')} AS wind_speed,
  {num('pressure')} AS pressure, {num('condition')} AS condition_number FROM weather_text"""
ORACLE["parse_date_ampm"] = W("weather_text") + """SELECT event_id,
  TRY_STRPTIME("date" || ' ' || "time", '%d/%m/%y %I:%M %p') AS "timestamp" FROM weather_text"""
ORACLE["select_rename"] = W("wt_num") + """SELECT "timestamp", temperature, dew_point, humidity, wind_speed, wind_gust,
  pressure, "precip." AS precipitation, condition FROM wt_num"""
ORACLE["calendar_features"] = W("readings") + """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  round(sin(2 * pi() * hour(ts) / 24.0), 9) AS time_sin, round(cos(2 * pi() * hour(ts) / 24.0), 9) AS time_cos
FROM readings"""
ORACLE["crowd_flow"] = W("readings", "ploc") + """SELECT r.event_id, r.sensor,
  CAST(trunc(r."count") AS BIGINT) / l.width / 3.0 AS flow FROM readings r JOIN ploc l ON r.sensor = l.sensor"""
ORACLE["id_text"] = """WITH kv AS (
  SELECT s_suppkey AS feature_id, 'WVK_ID' AS prop, CAST(s_suppkey AS VARCHAR) AS val FROM supplier
  UNION ALL SELECT s_suppkey, 'name', s_name FROM supplier
  UNION ALL SELECT s_suppkey, 'nation', 'N' || CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT feature_id, prop, regexp_replace(val, '^([+-]?[0-9]+)[.][0-9]+$', '\\1') AS id_text FROM kv"""


def _half_up(x, digits):
    return f"printf('%.{digits}f', {x})"


ORACLE["vessel_label"] = W("vessels") + f"""SELECT event_id,
  'ID: ' || id_str || '<br/>Time: ' || strftime(timezone('Europe/Amsterdam', timezone('UTC', time_utc)), '%Y-%m-%d %H:%M:%S')
  || '<br/>Lon: ' || {_half_up('lon', 5)} || '<br/>Lat: ' || {_half_up('lat', 5)}
  || '<br/>Speed: ' || CASE WHEN speed_cm_s IS NOT NULL THEN {_half_up('speed_cm_s / 100.0', 2)} || ' m/s' ELSE 'n/a' END
  AS tooltip FROM vessels"""


def _poly_sql(terms, a, b):
    total = "0.0"
    for p, qq, coef in terms:
        ap = "1.0" + "".join(f" * {a}" for _ in range(p))
        bp = "1.0" + "".join(f" * {b}" for _ in range(qq))
        total = f"({total} + (({coef!r} * ({ap})) * ({bp})))"
    return total


_A = f"((x - {RD_X0!r}) * 1e-05)"
_B = f"((y - {RD_Y0!r}) * 1e-05)"
ORACLE["rd_to_lonlat"] = f"""WITH xy AS (
  SELECT event_id, 100000.0 + value * 100.0 AS x, 450000.0 + (event_id % 1000) * 50.0 AS y FROM events
  WHERE event_id % 50 <> 0)
SELECT event_id,
  round({RD_LON0!r} + {_poly_sql(RD_LON_TERMS, _A, _B)} / 3600.0, 9) AS lon,
  round({RD_LAT0!r} + {_poly_sql(RD_LAT_TERMS, _A, _B)} / 3600.0, 9) AS lat
FROM xy"""

# ---------------------------------------------------------------------------
# 2.4 filters
# ---------------------------------------------------------------------------

ORACLE["filter_sensors"] = W("readings") + "SELECT * FROM readings WHERE sensor IN (" + ", ".join(
    str(s) for s in Q.CHOSEN_SENSORS) + ")"
ORACLE["filter_time_range"] = W("readings") + """SELECT * FROM readings
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"""
ORACLE["filter_date_slice"] = W("station_clean") + """SELECT * FROM station_clean
WHERE datetime >= TIMESTAMP '2024-01-05 00:00:00' AND datetime < TIMESTAMP '2024-01-10 00:00:00'"""
ORACLE["recent_window"] = W("vessels") + """SELECT * FROM vessels
WHERE time_utc >= (SELECT max(time_utc) FROM vessels) - INTERVAL 1440 MINUTE
  AND time_utc <= (SELECT max(time_utc) FROM vessels)"""
ORACLE["recent_window_daily"] = ORACLE["recent_window"]
ORACLE["drop_incomplete"] = W("ploc") + """SELECT sensor, name, lat, lon, width FROM ploc
WHERE lat IS NOT NULL AND lon IS NOT NULL AND width IS NOT NULL"""
ORACLE["incomplete_rows"] = W("ploc") + """SELECT DISTINCT sensor, name FROM ploc
WHERE lat IS NULL OR lon IS NULL OR name IS NULL OR sensor IS NULL
UNION SELECT DISTINCT sensor, name FROM ploc
WHERE lat IS NULL OR lon IS NULL OR name IS NULL OR sensor IS NULL OR direction IS NULL"""
ORACLE["drop_null_flow"] = W("flow") + "SELECT event_id, sensor, flow FROM flow WHERE flow IS NOT NULL AND NOT isnan(flow)"
ORACLE["split_past_now_future"] = W("readings") + """SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' THEN 'historic'
  WHEN ts = TIMESTAMP '2024-01-15 12:00:00' THEN 'current' ELSE 'actual_future' END AS type
FROM readings WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 60 MINUTE"""
ORACLE["positive_only"] = W("flow") + "SELECT event_id, sensor, flow FROM flow WHERE flow > 0"
ORACLE["missing_profile"] = W("readings_wide") + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS BIGINT) AS nulls FROM readings_wide"
    if c != "hour" else
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls FROM readings_wide"
    for c in ["hour"] + WIDE_SENSORS) + ")"
ORACLE["describe_profile"] = W("readings") + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({e}) AS "count", round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std,
  min({e}) AS min, round(quantile_cont({e}, 0.25), 6) AS p25, round(quantile_cont({e}, 0.5), 6) AS p50,
  round(quantile_cont({e}, 0.75), 6) AS p75, max({e}) AS max FROM readings"""
    for c, e in (("count", 'CAST("count" AS DOUBLE)'), ("sensor", "CAST(sensor AS DOUBLE)"))) + ")"
ORACLE["duplicate_count"] = W("readings") + """, g AS (SELECT sensor, date_trunc('hour', ts) AS hour, count(*) AS c FROM readings GROUP BY 1, 2)
SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(count(*) AS BIGINT) AS distinct_rows,
  CAST(sum(c) - count(*) AS BIGINT) AS duplicates FROM g"""

# ---------------------------------------------------------------------------
# 2.5 joins
# ---------------------------------------------------------------------------

ORACLE["asof_nearest"] = W("counts_for_weather", "weather") + """SELECT c.ts, c.event_id, c.sensor, c."count",
  w.ts AS weather_ts, w.w_id, w.temperature
FROM counts_for_weather c LEFT JOIN weather w
  ON w.ts BETWEEN c.ts - INTERVAL 60 MINUTE AND c.ts + INTERVAL 60 MINUTE
QUALIFY row_number() OVER (PARTITION BY c.event_id
  ORDER BY abs(epoch_us(w.ts) - epoch_us(c.ts)), w.ts,
           CASE WHEN w.ts <= c.ts THEN -w.w_id ELSE w.w_id END) = 1"""
ORACLE["join_sensor_location"] = W("readings", "ploc") + """SELECT s.sensor, l.name, l.lat, l.lon, l.width
FROM (SELECT DISTINCT sensor FROM readings) s LEFT JOIN ploc l ON s.sensor = l.sensor"""
ORACLE["flow_for_timestamp"] = W("flow") + "SELECT ts, sensor, event_id, flow FROM flow"
ORACLE["locations_with_reading"] = W("ploc", "latest_counts") + """SELECT l.sensor, l.name, l.lat, l.lon,
  coalesce(r."count", 0.0) AS "count" FROM ploc l LEFT JOIN latest_counts r USING (sensor)"""
ORACLE["roads_with_traffic"] = W("seg") + """SELECT s.s_suppkey AS feature_id, g.frame_time, g.id_str AS rid_str,
  round(g.mean_level, 6) AS mean_level FROM supplier s JOIN seg g ON CAST(s.s_suppkey AS VARCHAR) = g.id_str"""
ORACLE["detect_join_key"] = W("cf", "roads_long") + """, ids AS (SELECT DISTINCT CAST(id AS VARCHAR) AS v FROM cf),
sc AS (SELECT prop, count(*) FILTER (WHERE val IN (SELECT v FROM ids)) AS overlap FROM roads_long GROUP BY prop)
SELECT prop AS key_field, overlap FROM sc
ORDER BY overlap DESC, CASE prop WHEN 'WVK_ID' THEN 0 WHEN 'WVKID' THEN 1 WHEN 'wegvakid' THEN 2 WHEN 'wegvak_id' THEN 3
  WHEN 'road_id' THEN 4 WHEN 'ROAD_ID' THEN 5 WHEN 'ID' THEN 6 WHEN 'id' THEN 7 ELSE 8 END, prop LIMIT 1"""
ORACLE["merge_suffixes"] = """SELECT c.c_custkey AS sensorId, c.c_name AS name_sensor, c.c_nationkey AS nation_sensor,
  s.s_name AS name_loc, s.s_nationkey AS nation_loc
FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey"""
ORACLE["attach_features"] = W("readings", "station_clean") + """, hw AS (
  SELECT date_trunc('hour', datetime) AS hour, avg(temperature) AS temperature FROM station_clean GROUP BY 1)
SELECT r.event_id, r.sensor, r."count", round(hw.temperature, 6) AS temperature
FROM readings r LEFT JOIN hw ON date_trunc('hour', r.ts) = hw.hour"""

# ---------------------------------------------------------------------------
# 2.6 aggregations
# ---------------------------------------------------------------------------

_TOT = ", tot AS (SELECT time_bucket(INTERVAL 3 MINUTE, ts) AS frame, coalesce(sum(\"count\"), 0.0) AS total FROM readings GROUP BY 1)\n"
ORACLE["total_crowd"] = W("readings") + _TOT + "SELECT frame, round(total, 6) AS total FROM tot"
ORACLE["total_crowd_wide"] = W("readings_wide") + "SELECT hour, round(" + " + ".join(
    f"coalesce({s}, 0.0)" for s in WIDE_SENSORS) + ", 6) AS total FROM readings_wide"
ORACLE["mean_by_hour"] = W("readings") + _TOT + """SELECT CAST(hour(frame) AS INTEGER) AS hour,
  round(avg(total), 6) AS mean_total FROM tot GROUP BY 1"""
ORACLE["mean_by_weekday"] = W("readings") + _TOT + """SELECT CAST(isodow(frame) - 1 AS INTEGER) AS weekday,
  round(avg(total), 6) AS mean_total FROM tot GROUP BY 1"""
ORACLE["segment_mean_in_frame"] = W("seg") + "SELECT frame_time, id_str, round(mean_level, 6) AS mean_level FROM seg"
ORACLE["resample_3min"] = W("res3") + "SELECT id_str, time_local, round(traffic_level, 6) AS traffic_level FROM res3"
ORACLE["resample_hourly"] = W("readings") + """, h AS (SELECT date_trunc('hour', ts) AS hour, avg("count") AS c FROM readings GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
SELECT grid.hour, round(h.c, 6) AS "count" FROM grid LEFT JOIN h USING (hour)"""
ORACLE["frame_list"] = W("frames") + "SELECT DISTINCT frame_time FROM frames WHERE frame_time IS NOT NULL"
ORACLE["distinct_times_range"] = W("cf") + """SELECT count(*) AS n_rows, count(DISTINCT time_utc) AS n_times,
  min(time_utc) AS first_time, max(time_utc) AS last_time FROM cf"""
ORACLE["map_center"] = W("latest_vessels") + """SELECT round(quantile_cont(lat, 0.5), 6) AS center_lat,
  round(quantile_cont(lon, 0.5), 6) AS center_lon FROM latest_vessels"""
ORACLE["map_center_lines"] = W("roads_f", "cf") + """SELECT coalesce(TRY_CAST(arg_min(lat_txt, feature_id) AS DOUBLE), 52.37) AS center_lat,
  coalesce(TRY_CAST(arg_min(lon_txt, feature_id) AS DOUBLE), 4.9) AS center_lon
FROM roads_f WHERE rid_str IN (SELECT CAST(id AS VARCHAR) FROM cf)"""
ORACLE["frame_range"] = W("frames") + "SELECT min(time_local) AS range_start, max(time_local) AS range_end FROM frames"
ORACLE["metrics_by_location"] = W("scored") + """SELECT sensor, round(avg(abs("count" - pred)), 6) AS mae,
  round(sqrt(avg(("count" - pred) * ("count" - pred))), 6) AS rmse, count(*) AS n FROM scored GROUP BY sensor"""
ORACLE["r2_by_sensor"] = W("r2t") + "SELECT sensor, round(r2, 6) AS r2, round(mae, 6) AS mae, n FROM r2t"
ORACLE["metrics_summary"] = W("r2t") + "SELECT round(avg(mae), 6) AS mean_mae, round(avg(r2), 6) AS mean_r2 FROM r2t"
ORACLE["mse"] = W("scored") + """SELECT round(avg(("count" - pred) * ("count" - pred)), 6) AS mse FROM scored"""

# ---------------------------------------------------------------------------
# 2.7 windows
# ---------------------------------------------------------------------------

ORACLE["lag_features"] = "WITH " + SI_SQL["readings"] + ",\n" + _feat_sql(Q.LAGS, [], "lf") + \
    "\nSELECT ts, sensor, event_id, \"count\", " + ", ".join(f"lag_{k}" for k in Q.LAGS) + " FROM lf"
ORACLE["rolling_means"] = "WITH " + SI_SQL["readings"] + ",\n" + _feat_sql([], Q.ROLLING, "rf") + \
    "\nSELECT ts, sensor, event_id, \"count\", " + ", ".join(
        f"round(roll_mean_{n}, 6) AS roll_mean_{n}" for n in Q.ROLLING) + " FROM rf"
_FEAT_OUT = ("ts, sensor, event_id, \"count\", hour, minute, day, month, weekday, is_weekend, "
             + ", ".join(f"lag_{k}" for k in Q.LAGS) + ", "
             + ", ".join(f"round(roll_mean_{n}, 6) AS roll_mean_{n}" for n in Q.ROLLING))
ORACLE["create_features"] = W("featd") + f"SELECT {_FEAT_OUT} FROM featd"
ORACLE["latest_per_key"] = W("latest_vessels") + "SELECT * FROM latest_vessels"
ORACLE["latest_feature_row"] = W("feat") + f"""SELECT {_FEAT_OUT} FROM feat
QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY ts DESC, event_id DESC) = 1"""
ORACLE["tail_n_per_key"] = W("res3") + """SELECT id_str, time_local, round(traffic_level, 6) AS traffic_level FROM res3
QUALIFY row_number() OVER (PARTITION BY id_str ORDER BY time_local DESC) <= 20"""
ORACLE["sliding_window_vectors"] = W("wide_long") + """, sw AS (
  SELECT sensor, hour AS window_end,
         list(coalesce(value, 0.0)) OVER w3 AS past_values,
         avg(coalesce(value, 0.0)) OVER w3 AS past_mean,
         coalesce(stddev_samp(coalesce(value, 0.0)) OVER w3, 0.0) AS past_std,
         lead(value, 1) OVER w AS target, lead(hour, 1) OVER w AS target_ts,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sensor) AS n
  FROM wide_long
  WINDOW w AS (PARTITION BY sensor ORDER BY hour), w3 AS (PARTITION BY sensor ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT sensor, window_end, list_transform(past_values, lambda x: round(x, 6)) AS past_values, round(past_mean, 6) AS past_mean,
  round(past_std, 6) AS past_std, round(target, 6) AS target, target_ts
FROM sw WHERE i >= 2 AND i < n - 1"""

# ---------------------------------------------------------------------------
# 2.8 top-k
# ---------------------------------------------------------------------------

_TOP5 = ", top5 AS (SELECT id_str, avg(traffic_level) AS mean_level FROM res3 GROUP BY id_str ORDER BY mean_level DESC, id_str LIMIT 5)\n"
ORACLE["topk_segments"] = W("res3") + _TOP5 + "SELECT id_str, round(mean_level, 6) AS mean_level FROM top5"
ORACLE["topk_series"] = W("res3") + _TOP5 + """SELECT id_str, time_local, round(traffic_level, 6) AS traffic_level
FROM res3 WHERE id_str IN (SELECT id_str FROM top5)
QUALIFY row_number() OVER (PARTITION BY id_str ORDER BY time_local DESC) <= 20"""
ORACLE["worst_k_models"] = W("r2t") + """SELECT sensor, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM r2t
ORDER BY mae DESC, sensor LIMIT 5"""
ORACLE["best_worst_model"] = W("r2t") + """SELECT (SELECT sensor FROM r2t ORDER BY r2 DESC, sensor LIMIT 1) AS best_sensor, round(max(r2), 6) AS best_r2,
  (SELECT sensor FROM r2t ORDER BY r2, sensor LIMIT 1) AS worst_sensor, round(min(r2), 6) AS worst_r2 FROM r2t"""
ORACLE["sort_series"] = W("readings") + "SELECT * FROM readings ORDER BY sensor, ts"

# ---------------------------------------------------------------------------
# 2.9 set operations
# ---------------------------------------------------------------------------

ORACLE["concat_typed_series"] = W("readings") + """SELECT sensor, ts AS "timestamp", "count" AS value,
  CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' THEN 'historic'
       WHEN ts = TIMESTAMP '2024-01-15 12:00:00' THEN 'current' ELSE 'actual_future' END AS type
FROM readings WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 60 MINUTE"""
ORACLE["concat_history_current"] = W("readings") + "SELECT * FROM readings WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'"
ORACLE["concat_columns"] = W("readings_wide", "station_clean") + """, hw AS (
  SELECT date_trunc('hour', datetime) AS hour, avg(temperature) AS temperature, avg(rainfall) AS rainfall
  FROM station_clean GROUP BY 1)
SELECT coalesce(w.hour, hw.hour) AS hour, """ + ", ".join(f"round(w.{s}, 6) AS {s}" for s in WIDE_SENSORS) + """,
  round(hw.temperature, 6) AS temperature, round(hw.rainfall, 6) AS rainfall
FROM readings_wide w FULL OUTER JOIN hw ON w.hour = hw.hour"""
ORACLE["distinct_sensors"] = W("vessels") + "SELECT DISTINCT id_str FROM vessels WHERE id_str IS NOT NULL"

# ---------------------------------------------------------------------------
# 2.10 bands and map-ready tables
# ---------------------------------------------------------------------------


def _band(x, edges, op="<="):
    lo, mid, hi = edges
    return (f"CASE WHEN {x} {op} {lo} THEN 'green' WHEN {x} {op} {mid} THEN 'yellow' "
            f"WHEN {x} {op} {hi} THEN 'orange' ELSE 'red' END")


def _colour(band, colours):
    return "CASE " + " ".join(f"WHEN {band} = '{k}' THEN '{v}'" for k, v in colours.items()) + " END"


from crowdlake.functions import bands as _B  # noqa: E402

ORACLE["band_count"] = W("latest_counts") + f"""SELECT sensor, "count", {_band('"count"', _B.COUNT_EDGES)} AS band,
  {_colour(_band('"count"', _B.COUNT_EDGES), _B.COUNT_COLOURS)} AS colour, 2.0 + "count" * 0.2 AS radius FROM latest_counts"""
_FLOWB = W("flow") + ", fb AS (SELECT * FROM flow WHERE flow IS NOT NULL AND NOT isnan(flow))\n"
ORACLE["band_flow"] = _FLOWB + f"""SELECT event_id, flow, {_band('flow', _B.FLOW_EDGES)} AS band,
  {_colour(_band('flow', _B.FLOW_EDGES), _B.FLOW_COLOURS)} AS colour, 2.0 + flow AS radius FROM fb"""
ORACLE["band_arrow_count"] = W("ploc", "latest_counts") + f""", j AS (
  SELECT l.sensor, l.direction, coalesce(r."count", 0.0) AS "count" FROM ploc l LEFT JOIN latest_counts r USING (sensor))
SELECT sensor, direction, "count", {_band('"count"', _B.ARROW_COUNT_EDGES)} AS band,
  {_colour(_band('"count"', _B.ARROW_COUNT_EDGES), _B.ARROW_COLOURS)} AS colour FROM j"""
ORACLE["band_arrow_flow"] = _FLOWB + f"""SELECT event_id, flow, {_band('flow', _B.ARROW_FLOW_EDGES)} AS band,
  {_colour(_band('flow', _B.ARROW_FLOW_EDGES), _B.ARROW_COLOURS)} AS colour FROM fb"""
_TB = ("CASE WHEN mean_level IS NULL OR isnan(mean_level) THEN 'grey' WHEN mean_level < 0.5 THEN 'green' "
       "WHEN mean_level < 0.7 THEN 'yellow' WHEN mean_level < 0.85 THEN 'orange' ELSE 'red' END")
_RGBA = "CASE " + " ".join(f"WHEN {_TB} = '{k}' THEN [{', '.join(str(v) for v in vals)}]"
                           for k, vals in _B.TRAFFIC_RGBA.items()) + " END"
ORACLE["band_traffic"] = W("seg") + f"SELECT frame_time, id_str, {_TB} AS band, {_RGBA} AS rgba FROM seg"
ORACLE["heat_points"] = W("ploc", "latest_counts") + """, j AS (
  SELECT l.sensor, l.name, l.lat, l.lon, coalesce(r."count", 0.0) AS "count" FROM ploc l LEFT JOIN latest_counts r USING (sensor))
SELECT sensor, [lat, lon, "count"] AS point FROM j
WHERE lat IS NOT NULL AND lon IS NOT NULL AND name IS NOT NULL AND sensor IS NOT NULL AND "count" > 0"""
ORACLE["highlight_flag"] = W("latest_vessels") + f"""SELECT id_str, id_str IN ({', '.join(repr(s) for s in Q.SELECTED_VESSELS)}) AS highlighted,
  CASE WHEN id_str IN ({', '.join(repr(s) for s in Q.SELECTED_VESSELS)}) THEN {_B.HIGHLIGHT_RGBA[0]} ELSE {_B.DEFAULT_RGBA[0]} END AS r,
  CASE WHEN id_str IN ({', '.join(repr(s) for s in Q.SELECTED_VESSELS)}) THEN {_B.HIGHLIGHT_RGBA[1]} ELSE {_B.DEFAULT_RGBA[1]} END AS g,
  CASE WHEN id_str IN ({', '.join(repr(s) for s in Q.SELECTED_VESSELS)}) THEN {_B.HIGHLIGHT_RGBA[2]} ELSE {_B.DEFAULT_RGBA[2]} END AS b,
  CASE WHEN id_str IN ({', '.join(repr(s) for s in Q.SELECTED_VESSELS)}) THEN {_B.HIGHLIGHT_RGBA[3]} ELSE {_B.DEFAULT_RGBA[3]} END AS a
FROM latest_vessels"""
ORACLE["traffic_features"] = W("seg") + f"""SELECT s.s_suppkey AS feature_id, g.frame_time, CAST(printf('%.2f', g.mean_level) AS DOUBLE) AS traffic_level_2d,
  3.0 AS width, {_TB.replace('mean_level', 'g.mean_level')} AS band, {_RGBA.replace('mean_level', 'g.mean_level')} AS rgba
FROM supplier s JOIN seg g ON CAST(s.s_suppkey AS VARCHAR) = g.id_str"""

# ---------------------------------------------------------------------------
# entry flagship
ORACLE["flow_at_time"] = W("readings", "ploc", "flow") + """, m AS (SELECT max(ts) AS at FROM readings)
SELECT s.sensor, m.at AS ts, CASE WHEN f.event_id IS NULL THEN 0.0 ELSE f.flow END AS flow
FROM (SELECT DISTINCT sensor FROM readings) s CROSS JOIN m LEFT JOIN flow f ON f.sensor = s.sensor AND f.ts = m.at"""
# ---------------------------------------------------------------------------

ORACLE["crowd_flow_map"] = _FLOWB + f"""SELECT ts, sensor, event_id, "count", width, flow,
  {_band('flow', _B.FLOW_EDGES)} AS band, {_colour(_band('flow', _B.FLOW_EDGES), _B.FLOW_COLOURS)} AS colour,
  2.0 + flow AS radius FROM fb"""
ORACLE["vessel_snapshot"] = W("vessels") + """, rw AS (
  SELECT * FROM vessels WHERE id_str IS NOT NULL AND time_utc IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL
    AND time_utc >= (SELECT max(time_utc) FROM vessels) - INTERVAL 1440 MINUTE)
SELECT id_str, time_utc, lon, lat, speed_cm_s, timezone('Europe/Amsterdam', timezone('UTC', time_utc)) AS time_ams
FROM rw QUALIFY row_number() OVER (PARTITION BY id_str ORDER BY time_utc DESC, event_id DESC) = 1"""
