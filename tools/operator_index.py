"""Write OPERATORS.md: every SURVEY §2 key -> library entry points its query calls -> check kind.

Usage: python tools/operator_index.py [--out OPERATORS.md]
"""

from __future__ import annotations

import argparse
import inspect
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# SURVEY §2 keys, in the survey's order (sections 2.1 .. 2.12).
SECTIONS = [
    ("2.1 Scans, sources, sinks", "read_locations read_crowd read_weather_hourly read_weather_text read_carflow_nested "
     "read_carflow_flat read_carflow_any read_vessels read_snapshot_parquet read_stops flatten_api_pages read_roads "
     "write_parquet write_csv_gz write_both write_csv"),
    ("2.2 Flattening and reshaping", "flatten_carflow flatten_carflow_strict pack_carflow melt_counts melt_with_features "
     "location_index latest_row_to_kv pivot_predictions sensor_direction_split"),
    ("2.3 Projections and scalar functions", "parse_iso_utc to_local_time frame_floor drop_tz localize decimal_comma "
     "split_lat_lon hour24_fix tenths_to_units imperial_to_metric clean_text extract_number parse_date_ampm "
     "select_rename calendar_features crowd_flow id_text vessel_label rd_to_lonlat"),
    ("2.4 Filters and predicates", "filter_sensors filter_time_range filter_date_slice recent_window drop_incomplete "
     "incomplete_rows drop_null_flow split_past_now_future positive_only missing_profile describe_profile "
     "duplicate_count"),
    ("2.5 Joins", "asof_nearest join_sensor_location flow_for_timestamp locations_with_reading roads_with_traffic "
     "detect_join_key merge_suffixes attach_features"),
    ("2.6 Aggregations", "total_crowd mean_by_hour mean_by_weekday segment_mean_in_frame resample_3min resample_hourly "
     "frame_list distinct_times_range map_center metrics_by_location r2_by_sensor metrics_summary mse"),
    ("2.7 Window functions", "lag_features rolling_means create_features latest_per_key latest_feature_row "
     "tail_n_per_key sliding_window_vectors"),
    ("2.8 Sorts, limits, top-k", "topk_segments topk_series worst_k_models best_worst_model top_importances sort_series"),
    ("2.9 Set operations", "concat_typed_series concat_history_current concat_columns distinct_sensors"),
    ("2.10 Classification and map-ready tables", "band_count band_flow band_arrow_count band_arrow_flow band_traffic "
     "heat_points stop_class highlight_flag traffic_features"),
    ("2.11 Machine learning", "chronological_split ordered_fraction_split random_split rolling_folds standard_scale "
     "train_global_model train_per_sensor predict feature_importance save_load_model recursive_forecast "
     "forecast_vs_actual"),
    ("2.12 Streaming", "stream_latest_reading stream_crowd_flow stream_history stream_frames_3min "
     "stream_vessel_window stream_features"),
]

ALIASES = {"S": "functions.scalars", "B": "functions.bands", "A": "operators.aggregates", "FL": "operators.filters",
           "J": "operators.joins", "M": "operators.maps", "R": "operators.reshape", "SO": "operators.setops",
           "TK": "operators.topk", "W": "operators.windows", "RD": "sources.readers", "SK": "sources.sinks",
           "SP": "ml.splits", "MD": "ml.models", "FC": "ml.forecast", "ST": "streaming.jobs", "jobs": "plans.jobs"}
HELPERS = {"features_table": "ml.features.create_features_long", "flat_carflow": "operators.flatten.carflow_flat",
           "carflow_frames": "plans.jobs.frame_table", "resampled_3min": "operators.aggregates.resample_minutes",
           "parsed_locations": "operators.joins.parse_locations", "station_clean": "sources.readers.clean_station",
           "weather_text_numbers": "sources.readers.clean_weather_text", "scored_table": "ml.features.create_features_long",
           "_r2": "operators.aggregates.r2_by_sensor", "_latest_counts": "operators.windows.latest_per_key",
           "_frame_totals": "operators.aggregates.total_crowd", "_forecast": "ml.forecast.recursive_forecast",
           "_model": "ml.models.train_global_model", "_model_and_rows": "ml.models.train_global_model"}
DIRECT = {"carflow_flat": "operators.flatten.carflow_flat", "flatten_carflow": "operators.flatten.flatten_carflow",
          "pack_carflow": "operators.flatten.pack_carflow", "positions_from_grid": "sources.readers.positions_from_grid",
          "parse_locations": "operators.joins.parse_locations", "create_features_long":
          "ml.features.create_features_long"}


def entry_points(fn) -> list[str]:
    src = inspect.getsource(fn)
    found = []
    for alias, name in re.findall(r"\b(S|B|A|FL|J|M|R|SO|TK|W|RD|SK|SP|MD|FC|ST|jobs)\.([a-z_][a-z0-9_]*)\(", src):
        found.append(f"{ALIASES[alias]}.{name}")
    for helper, target in HELPERS.items():
        if re.search(rf"\b{helper}\(", src):
            found.append(target)
    for name, target in DIRECT.items():
        if re.search(rf"(?<![.\w]){name}\(", src):
            found.append(target)
    out = []
    for f in found:
        if f not in out and not f.endswith(".table") and ".standins." not in f:
            out.append(f)
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--out", default="OPERATORS.md")
    args = ap.parse_args()
    from crowdlake.plans import io_queries, ml_queries, queries, stream_queries
    from crowdlake.plans.registry import all_oracle_sql

    raw = {}
    for mod in (queries, io_queries, ml_queries, stream_queries):
        raw.update(mod.QUERIES)
    oracle = all_oracle_sql()
    lines = ["# Operator index", "",
             "Every key of SURVEY §2 in the survey's order, the `crowdlake` entry points its registered query "
             "calls (found in the query's source by `tools/operator_index.py`), and how it is checked: "
             "`oracle` = exact match with the DuckDB SQL of `oracle_sql()` at sf0.01, `rows` = the driver's "
             "rows-only check plus the unit tests named in README.", ""]
    n = 0
    for title, keys in SECTIONS:
        lines += [f"## {title}", "", "| # | key | entry points | check |", "|---|---|---|---|"]
        for key in keys.split():
            n += 1
            eps = entry_points(raw[key]) if key in raw else []
            check = "oracle" if key in oracle else ("rows" if key in raw else "not built")
            lines.append(f"| {n} | `{key}` | {', '.join(f'`{e}`' for e in eps)} | {check} |")
        lines.append("")
    with open(args.out, "w") as f:
        f.write("\n".join(lines))
    print(f"{n} keys written to {args.out}")


if __name__ == "__main__":
    main()
